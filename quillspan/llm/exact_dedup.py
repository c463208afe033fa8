"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition yields one run: its digests, sorted, each with the best row of that
run.  The runs are exchanged in binomial rounds.  In one round, ``fan_in`` neighbouring
runs meet and are merged by digest (a sort aggregation), and each digest keeps the smallest
identifier among the candidates that pass verification: besides the SHA-256, length and a
second 64-bit hash of the text have to agree, so they are part of the key at every level.
A digest thus never meets more than ``fan_in`` rows in one round, however many copies the
text has.  The winners then go down the tree again, from the one run to the many and to
the rows; on that way, too, a digest meets a row per run at most.

Only DataFrame functions are used.

Defined cases: a null text counts as empty; empty texts (or texts of white space only)
equal each other; of equal texts the row with the most code points in the original stays,
then the smallest doc_id, null ids last; rows with the same id and text are separate rows
of one group, of which the one that comes first in ``row_id`` is kept (``deduplicate`` keeps any one of
them); other columns, whatever their names, are carried through ``deduplicate`` untouched, and the operator's own columns win over
columns of the same name in ``exact_groups``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents, dropped, fresh_names, small, stored

#: The characters that are deleted before texts are compared.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
KEY = ("digest", "norm_length", "second_hash")


def normalised(text: Column) -> Column:
    """The text without white space; null becomes empty."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def digest_rows(docs: DataFrame) -> DataFrame:
    """One slim row per document with its digest and the run (input partition) it lies in; stored."""
    slim = docs.select(
        "doc_id",
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias("n_code_points"),
        normalised(F.col("text")).alias("norm"),
    )
    return stored(
        slim.select(
            "doc_id",
            "n_code_points",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.octet_length("norm").alias("norm_length"),
            F.xxhash64("norm").alias("second_hash"),
            F.monotonically_increasing_id().alias("row_id"),
            F.spark_partition_id().alias("run_0"),
        ),
        "digests",
    )


def best_first() -> Column:
    """Smallest first: most code points, then smallest id (null last), then first row."""
    return F.struct((-F.col("n_code_points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")


def merge_runs(rows: DataFrame, fan_in: int) -> list[DataFrame]:
    """The levels of the tree, from ``fan_in`` input partitions a run up to one run; each is stored.

    The lowest exchange takes the sorted runs that map-side aggregation makes of the input partitions.
    """
    last = rows.agg(F.max("run_0")).first()[0] or 0
    below = rows.select(*KEY, "run_0", best_first().alias("best"), F.lit(1).cast("long").alias("copies"))
    levels: list[DataFrame] = []
    while not levels or last > 0:
        k = len(levels)
        merged = (
            below.withColumn(f"run_{k + 1}", F.floor(F.col(f"run_{k}") / fan_in).cast("int"))
            .groupBy(*KEY, f"run_{k + 1}")
            .agg(F.min("best").alias("best"), F.sum("copies").alias("copies"))
        )
        below = stored(merged, f"runs-{k + 1}")
        levels.append(below)
        last //= fan_in
    return levels


def exact_groups(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_code_points of every row of docs."""
    rows = digest_rows(docs)
    levels = merge_runs(rows, fan_in)
    top = len(levels)
    won = levels[-1].filter("copies > 1").select(*KEY, f"run_{top}", F.col("best").alias("winner"), F.col("copies").alias("group_size"))
    for k in range(top - 1, 0, -1):
        runs = levels[k - 1].select(*KEY, f"run_{k}", F.floor(F.col(f"run_{k}") / fan_in).cast("int").alias(f"run_{k + 1}"))
        won = runs.join(won, [*KEY, f"run_{k + 1}"]).drop(f"run_{k + 1}")
    rows = rows.withColumn("run_1", F.floor(F.col("run_0") / fan_in).cast("int"))
    alone = F.col("winner").isNull()
    return rows.join(won, [*KEY, "run_1"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("winner.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("winner.row_id") == F.col("row_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_code_points",
    )


def deduplicate(docs: DataFrame, fan_in: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The rows to go are matched by id, digest and length.  Only where a row that goes looks
    like one that stays (the same row twice) is one row of each such kind picked, by an aggregation
    that keeps one row a task before anything is exchanged.
    """
    of = fresh_names(docs, "id", "sha", "points")
    groups = stored(exact_groups(docs, fan_in).filter("group_size > 1"), "groups")
    keys = groups.select(F.col("doc_id").alias(of[0]), F.col("text_sha256").alias(of[1]), F.col("n_code_points").alias(of[2]), "kept")
    stay = keys.filter("kept").drop("kept").distinct()
    go = keys.filter(~F.col("kept")).drop("kept").distinct()

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in of])

    twice = stored(go.join(stay, same(go, stay), "left_semi"), "twice")
    gone = stored(go.join(stay, same(go, stay), "left_anti"), "gone")
    dropped(groups)
    marked = docs.select(
        "*",
        F.col("doc_id").alias(of[0]),
        F.sha2(normalised(F.col("text")), 256).alias(of[1]),
        F.length(F.coalesce(F.col("text"), F.lit(""))).alias(of[2]),
    )
    left = marked.join(small(gone), same(marked, gone), "left_anti")
    if not twice.isEmpty():
        again = left.join(small(twice), same(left, twice), "left_semi").dropDuplicates(of)
        left = left.join(small(twice), same(left, twice), "left_anti").unionByName(again)
    return left.drop(*of)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
with n as (
    select doc_id, length(coalesce(text, '')) as points,
           sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]', '', 'g')) as text_sha256
    from documents
), g as (
    select *, count(*) over (partition by text_sha256) as group_size,
           first_value(doc_id) over (partition by text_sha256 order by points desc, doc_id) as keep_id
    from n
)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g
"""
