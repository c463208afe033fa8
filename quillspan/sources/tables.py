"""The given tables and the roles that the cohort operators play on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold predictions from labels and documents: two feature sets, two protocols, three seeds.

    Scores lie on a grid of 1/100, so ties are many; the fold of the second protocol is a whole language.
    """
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return rows.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(protocol).alias("cv_protocol"),
                        F.lit(name).alias("feature_set"),
                        F.lit(seed).alias("seed"),
                        fold.alias("outer_fold"),
                        (((F.col("n_chars") * step + seed) % modulus) / 100.0).alias("probability"),
                    )
                    for protocol, fold in (
                        ("standard", (F.col("doc_id") % 5).cast("int")),
                        ("group", F.expr("CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END")),
                    )
                    for name, modulus, step in (("signal", 101, 1), ("signal_qc", 97, 7))
                    for seed in (0, 1, 2)
                ]
            )
        ).alias("p"),
        F.col("doc_id").alias("subject"),
        F.col("quality").cast("int").alias("label"),
    ).select("p.*", "subject", "label", ((F.col("p.outer_fold") + 3) / 10).alias("fold_threshold"))


#: The same rows in SQL; a query starts from ``WITH {PREDICTIONS_SQL}``.
PREDICTIONS_SQL = """
predictions AS (
    SELECT p.cv_protocol, f.feature_set, s.seed,
           CASE WHEN p.cv_protocol = 'standard' THEN CAST(d.doc_id % 5 AS INTEGER)
                ELSE CASE d.lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END END AS outer_fold,
           ((d.n_chars * f.step + s.seed) % f.modulus) / 100.0 AS probability,
           l.doc_id AS subject, CAST(l.quality AS INTEGER) AS label,
           (3 + CASE WHEN p.cv_protocol = 'standard' THEN CAST(d.doc_id % 5 AS INTEGER)
                ELSE CASE d.lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END END) / 10.0::DOUBLE AS fold_threshold
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id
    CROSS JOIN (VALUES ('standard'), ('group')) p(cv_protocol)
    CROSS JOIN (VALUES ('signal', 101, 1), ('signal_qc', 97, 7)) f(feature_set, modulus, step)
    CROSS JOIN (VALUES (0), (1), (2)) s(seed)
)"""


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of ROLES as a DataFrame."""
    source, columns, where = ROLES[name]
    rows = table(spark, sf_dir, source)
    if source == "events":
        rows = rows.withColumn("ms", F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000 - 1704067200000"))
    return (rows.filter(where) if where else rows).selectExpr(*columns)


def role_sql(*names: str) -> str:
    """The same roles as the common table expressions of a query."""
    out = []
    for name in names:
        source, columns, where = ROLES[name]
        rows = "(SELECT *, epoch_us(ts) // 1000 - 1704067200000 AS ms FROM events)" if source == "events" else source
        out.append(f"{name} AS (SELECT {', '.join(columns)} FROM {rows}{f' WHERE {where}' if where else ''})")
    return ", ".join(out)


#: Roles of the cohort model on the given tables: source, columns, condition; plain SQL that both engines read.
ROLES: dict[str, tuple[str, list[str], str]] = {
    "subjects": (
        "customer",
        [
            "c_custkey AS subject",
            "'A' || lpad(CAST(c_nationkey AS STRING), 2, '0') || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') AS a_id",
            "CASE c_custkey % 13 WHEN 0 THEN '#N/A' WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE CAST(4 + c_custkey % 20 AS STRING)"
            " || CASE WHEN c_custkey % 3 = 0 THEN '.5' ELSE '' END END AS age",
            "CASE c_custkey % 7 WHEN 0 THEN ' NA ' WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN ' male ' WHEN 4 THEN 'male' ELSE 'female' END AS sex",
            "CASE c_custkey % 6 WHEN 0 THEN 'None' WHEN 1 THEN 'G7' WHEN 2 THEN 'G8' WHEN 3 THEN 'G10' WHEN 4 THEN 'G11' ELSE 'other school' END AS grade",
            "CASE WHEN c_custkey % 17 = 0 THEN '' WHEN c_acctbal > 4500 THEN '1' ELSE '0' END AS label",
            "c_mktsegment AS diagnosis",
            "CAST(c_nationkey AS STRING) AS site",
            "CAST(c_custkey % 2 AS INT) AS has_eeg",
            "CAST((c_custkey % 3 + 1) / 2 AS INT) AS has_fnirs_raw",
            "CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END AS has_fnirs",
            "CASE WHEN c_custkey % 5 > 1 THEN 1 ELSE 0 END AS has_face",
            "CASE WHEN c_custkey % 7 > 3 THEN 1 ELSE 0 END AS has_eye",
            "c_acctbal AS balance",
        ],
        "",
    ),
    "takes": (
        "lineitem",
        [
            "CAST(l_suppkey % 4 AS STRING) AS device",
            "l_returnflag AS task",
            "CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey END AS subject",
            "'rec/' || l_returnflag || '/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || CASE WHEN l_linestatus = 'F' THEN '.bdf' ELSE '.evt' END AS path",
            "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS complete",
            "CAST(l_quantity AS INT) AS n_segments",
            "l_extendedprice AS duration",
            "CAST(l_tax * 100 AS INT) AS size",
            "l_orderkey AS stamp",
            "l_linenumber AS line",
        ],
        "",
    ),
    "trials": (
        "events",
        [
            "user_id AS subject",
            "CAST(floor(ms / 86400000) AS INT) % 6 AS block",
            "event_id AS trial",
            "CAST(ms AS DOUBLE) / 1000 AS onset_sec",
            "event_type AS stimulus",
            "CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' WHEN 'purchase' THEN '1' WHEN 'signup' THEN '2' ELSE '' END AS response",
            "CASE WHEN event_type = 'error' THEN NULL ELSE value / 2e1 END AS rt_sec",
            "CASE event_type WHEN 'signup' THEN 'win' WHEN 'purchase' THEN 'win' WHEN 'error' THEN 'loss' WHEN 'click' THEN 'loss' ELSE '' END AS feedback",
            "CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS target",
            "CASE WHEN value > 10 THEN 1e0 ELSE 0e0 END AS logged_correct",
        ],
        "",
    ),
    "gaze": (
        "events",
        [
            "user_id AS recording",
            "ms AS time_ms",
            "event_id AS sample",
            "CASE WHEN event_type = 'error' THEN NULL ELSE (event_id * 37 % 101) / 1e2 END AS x",
            "CASE WHEN event_type = 'error' THEN NULL ELSE (event_id * 53 % 103) / 1.02e2 END AS y",
            "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS valid",
            "value AS pupil",
            "CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN '' ELSE 'c' END AS media",
        ],
        "",
    ),
}
