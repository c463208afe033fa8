"""Queries of the projection and cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import clean
from quillspan.plans.base import Book
from quillspan.sources.tables import role, role_sql, table

book = Book()
QUERIES, SQL = book.queries, book.sql
S = f"WITH {role_sql('subjects')} "
M = "('', '#N/A', 'NA', 'N/A', 'nan', 'None')"


def subjects(spark, sf_dir):
    return role(spark, sf_dir, "subjects")


@book.query("p01_normalize_missing", S + f"SELECT subject, CASE WHEN trim(sex) IN {M} THEN '[missing]' ELSE trim(sex) END AS sex FROM subjects")
def p01(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.normalize_missing(F.col("sex")).alias("sex"))


@book.query("p02_parse_age", S + "SELECT subject, CAST(trunc(TRY_CAST(trim(age) AS DOUBLE)) AS INTEGER) AS age FROM subjects")
def p02(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.parse_age(F.col("age")).alias("age"))


@book.query("p03_clean_range", S + "SELECT subject, CASE WHEN TRY_CAST(age AS DOUBLE) BETWEEN 9 AND 20 THEN TRY_CAST(age AS DOUBLE) END AS age FROM subjects")
def p03(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.clean_range(F.col("age")).alias("age"))


@book.query(
    "p04_age_bin",
    S
    + """, a AS (SELECT subject, CAST(trunc(TRY_CAST(age AS DOUBLE)) AS INTEGER) AS n FROM subjects)
    SELECT subject, CASE WHEN n IS NULL THEN '[missing]' WHEN n < 9 OR n > 20 THEN 'abnormal' WHEN n < 12 THEN '9-11'
        WHEN n < 15 THEN '12-14' WHEN n < 18 THEN '15-17' ELSE '18-20' END AS age_bin FROM a""",
)
def p04(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.age_bin(F.col("age")).alias("age_bin"))


GRADES = {"G7": "junior", "G8": "junior", "G10": "senior", "G11": "senior"}


@book.query(
    "p05_category_group",
    S
    + """SELECT subject, CASE WHEN grade = 'None' THEN '[missing]' WHEN grade IN ('G7', 'G8') THEN 'junior'
        WHEN grade IN ('G10', 'G11') THEN 'senior' ELSE 'other' END AS grade_group FROM subjects""",
)
def p05(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.category_group(F.col("grade"), GRADES).alias("grade_group"))


@book.query("p06_clean_category", S + f"SELECT subject, CASE WHEN trim(sex) NOT IN {M} THEN trim(sex) END AS sex FROM subjects")
def p06(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.clean_category(F.col("sex")).alias("sex"))


def flags():
    return {"e": F.col("has_eeg"), "n": F.col("has_fnirs"), "f": F.col("has_face"), "y": F.col("has_eye")}


@book.query(
    "p07_presence_pattern",
    S
    + """SELECT subject, (CASE has_eeg WHEN 1 THEN 'E' ELSE 'e' END) || (CASE has_fnirs WHEN 1 THEN 'N' ELSE 'n' END)
        || (CASE has_face WHEN 1 THEN 'F' ELSE 'f' END) || (CASE has_eye WHEN 1 THEN 'Y' ELSE 'y' END) AS pattern FROM subjects""",
)
def p07(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.presence_pattern(flags()).alias("pattern"))


@book.query("p08_presence_count", S + "SELECT subject, has_eeg + has_fnirs + has_face + has_eye AS n FROM subjects")
def p08(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.presence_count(list(flags().values())).alias("n"))


@book.query(
    "p09_cohort_flags",
    S
    + """, f AS (SELECT subject, label IN ('0', '1') AS labelled, has_eeg + has_fnirs + has_face AS n, has_eye FROM subjects)
    SELECT subject, labelled, labelled AND n + has_eye > 0 AS coverage_maximized, labelled AND n = 3 AS matched,
           labelled AND n + has_eye > 0 AND n + has_eye < 4 AS missing_modality FROM f""",
)
def p09(spark, sf_dir):
    found = clean.cohort_flags(F.col("label"), [F.col("has_eeg"), F.col("has_fnirs"), F.col("has_face")], F.col("has_eye"))
    return subjects(spark, sf_dir).select("subject", *[c.alias(k) for k, c in found.items()])


@book.query(
    "p10_derive_label",
    S
    + """SELECT subject, CASE WHEN diagnosis = 'BUILDING' THEN 0 WHEN diagnosis IN ('MACHINERY', 'HOUSEHOLD') THEN 1 END AS broad,
        CASE WHEN diagnosis IN ('BUILDING', 'AUTOMOBILE') THEN 0 WHEN diagnosis = 'MACHINERY' THEN 1 END AS narrow FROM subjects""",
)
def p10(spark, sf_dir):
    d = F.col("diagnosis")
    return subjects(spark, sf_dir).select(
        "subject", clean.derive_label(d, ["BUILDING"], ["MACHINERY", "HOUSEHOLD"]).alias("broad"), clean.derive_label(d, ["BUILDING", "AUTOMOBILE"], ["MACHINERY"]).alias("narrow")
    )


@book.query(
    "p11_extract_ids",
    S
    + r"""SELECT subject, array_to_string(list_transform(regexp_extract_all('x/' || lower(a_id) || '_' || a_id || '9/' || a_id || ';B00001x',
        '(?:^|[^A-Za-z0-9])([A-Za-z]\d{5})(?:_|/|;|$)', 1), lambda v: upper(v)), ',') AS ids FROM subjects""",
)
def p11(spark, sf_dir):
    text = F.concat(F.lit("x/"), F.lower("a_id"), F.lit("_"), "a_id", F.lit("9/"), "a_id", F.lit(";B00001x"))
    return subjects(spark, sf_dir).select("subject", F.array_join(clean.extract_ids(text), ",").alias("ids"))


@book.query("p12_redact_names", S + "SELECT subject, 'rec ' || (CASE subject % 3 WHEN 0 THEN '<name>' WHEN 1 THEN '中' ELSE '<name>三' END) || ' ' || a_id AS text FROM subjects")
def p12(spark, sf_dir):
    name = F.expr("CASE subject % 3 WHEN 0 THEN '王小明' WHEN 1 THEN '中' ELSE '一二三四三' END")
    return subjects(spark, sf_dir).select("subject", clean.redact_names(F.concat(F.lit("rec "), name, F.lit(" "), "a_id")).alias("text"))


CODE = "CASE subject % 4 WHEN 0 THEN '1.0' WHEN 1 THEN ' 2' WHEN 2 THEN 'x3' ELSE '' END"


@book.query("p13_normalize_code", S + "SELECT subject, CASE subject % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'x3' ELSE '' END AS code FROM subjects")
def p13(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.normalize_code(F.expr(CODE)).alias("code"))


@book.query("p14_map_codes", S + "SELECT subject, CASE subject % 4 WHEN 0 THEN 'win' WHEN 1 THEN 'loss' ELSE '' END AS feedback FROM subjects")
def p14(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.map_codes(F.expr(CODE), {"1": "win", "2": "loss"}).alias("feedback"))


@book.query(
    "p15_hmsms_to_seconds",
    S
    + """SELECT subject, CASE WHEN subject % 5 = 0 THEN NULL WHEN subject % 5 = 1 THEN NULL
        ELSE (subject % 3) * 3600.0 + (subject % 60) * 60.0 + subject % 59 + (subject % 1000) / 1000.0 END AS seconds FROM subjects""",
)
def p15(spark, sf_dir):
    text = F.expr(
        "CASE WHEN subject % 5 = 0 THEN '1:2:3' WHEN subject % 5 = 1 THEN '1:x:3:4' ELSE concat_ws(':', subject % 3, subject % 60, subject % 59, subject % 1000) END"
    )
    return subjects(spark, sf_dir).select("subject", clean.hmsms_to_seconds(text).alias("seconds"))


@book.query("p16_group_prefix", S + "SELECT subject, left(a_id, 1) AS family, left(a_id, 3) AS site, CASE WHEN length(site) >= 2 THEN left(site, 2) ELSE '[missing]' END AS short_site FROM subjects".replace("length(site)", "length(subjects.site)").replace("left(site", "left(subjects.site"))
def p16(spark, sf_dir):
    return subjects(spark, sf_dir).select(
        "subject", clean.group_prefix(F.col("a_id"), 1).alias("family"), clean.group_prefix(F.col("a_id"), 3).alias("site"), clean.group_prefix(F.col("site"), 2).alias("short_site")
    )


@book.query(
    "p18_check_leakage",
    """SELECT table_name AS dataset, column_name, CASE WHEN lower(column_name) IN ('label', 'quality') THEN 'exact' ELSE 'pattern' END AS rule
    FROM information_schema.columns WHERE table_name IN ('labels', 'documents', 'events', 'embeddings')
    AND (lower(column_name) IN ('label', 'quality') OR regexp_matches(lower(column_name), '^(toxic|n_).*'))""",
)
def p18(spark, sf_dir):
    from quillspan.operators.audit import check_leakage

    return check_leakage({n: table(spark, sf_dir, n) for n in ("labels", "documents", "events", "embeddings")}, ["label", "quality"], ["^(toxic|n_).*"])


@book.query("p19_labeled_cv_only", S + "SELECT subject, CAST(label AS INTEGER) AS label FROM subjects WHERE label IN ('0', '1') AND subject % 5 <> 0")
def p19(spark, sf_dir):
    from quillspan.operators.audit import assert_no_holdout, cv_only, labeled_only

    rows = subjects(spark, sf_dir).withColumn("split_group", F.when(F.col("subject") % 5 == 0, "locked").otherwise("cv")).withColumn("is_locked", (F.col("subject") % 5 == 0).cast("int"))
    kept = cv_only(labeled_only(rows))
    return assert_no_holdout(kept, "is_locked").select("subject", F.col("label").cast("int").alias("label"))


@book.query(
    "p21_stable_hash",
    S + "SELECT subject, sha1(CAST(subject AS VARCHAR)) AS digest, CAST(('0x' || substr(sha1('7|' || a_id || '|' || CAST(subject AS VARCHAR)), 1, 8)) AS BIGINT) AS seed FROM subjects",
)
def p21(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.stable_hash(F.col("subject")).alias("digest"), clean.stable_number(7, F.col("a_id"), F.col("subject")).alias("seed"))


@book.query("p22_median_split", S + "SELECT subject, CASE WHEN balance IS NULL THEN NULL WHEN balance > (SELECT median(balance) FROM subjects) THEN 1 ELSE 0 END AS high FROM subjects")
def p22(spark, sf_dir):
    from quillspan.operators.audit import median_split

    return median_split(subjects(spark, sf_dir), "balance", "high").select("subject", "high")


@book.query("p23_logit", S + "SELECT subject, round(ln(p / (1 - p)), 6) AS logit FROM (SELECT subject, greatest(least((subject % 101) / 100.0, 1 - 1e-6), 1e-6) AS p FROM subjects)")
def p23(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", F.round(clean.logit((F.col("subject") % 101) / 100.0), 6).alias("logit"))


@book.query(
    "p25_pathlength_factor",
    S
    + """, a AS (SELECT subject, least(greatest(coalesce(TRY_CAST(age AS DOUBLE), 13.0), 1.0), 50.0) AS a, CASE WHEN subject % 2 = 0 THEN 690.0::DOUBLE ELSE 830.0::DOUBLE END AS w FROM subjects)
    SELECT subject, round(223.3 + 0.05624 * power(a, 0.8493) - 5.723e-7 * power(w, 3) + 0.001245 * power(w, 2) - 0.9025 * w, 6) AS factor FROM a""",
)
def p25(spark, sf_dir):
    w = F.when(F.col("subject") % 2 == 0, 690.0).otherwise(830.0)
    return subjects(spark, sf_dir).select("subject", F.round(clean.pathlength_factor(w, F.col("age").try_cast("double")), 6).alias("factor"))


@book.query(
    "p27_region_label",
    S
    + """, p AS (SELECT subject, subject % 91 - 45 AS x, subject % 131 - 60 AS y FROM subjects)
    SELECT (CASE WHEN x < -20 THEN 'left' WHEN x > 20 THEN 'right' ELSE 'mid' END) || '_' ||
           (CASE WHEN y > 50 THEN 'frontopolar' WHEN y > 20 THEN 'anterior' WHEN y > -10 THEN 'central' ELSE 'posterior' END) AS region,
           count(*) AS n FROM p GROUP BY 1""",
)
def p27(spark, sf_dir):
    return subjects(spark, sf_dir).groupBy(clean.region_label(F.col("subject") % 91 - 45, F.col("subject") % 131 - 60).alias("region")).agg(F.count("*").alias("n"))


@book.query(
    "p28_qc_gate",
    S
    + """, r AS (SELECT subject, CASE WHEN balance < 0 THEN 'negative_balance' END AS a, CASE WHEN has_eeg = 0 THEN 'no_eeg' END AS b,
        CASE WHEN TRY_CAST(age AS DOUBLE) IS NULL THEN 'no_age' END AS c FROM subjects)
    SELECT subject, concat_ws(';', a, b, c) = '' AS passed, concat_ws(';', a, b, c) AS reasons FROM r""",
)
def p28(spark, sf_dir):
    reasons = clean.gate_reasons([(F.col("balance") < 0, "negative_balance"), (F.col("has_eeg") == 0, "no_eeg"), (F.col("age").try_cast("double").isNull(), "no_age")])
    return subjects(spark, sf_dir).select("subject", (reasons == "").alias("passed"), reasons.alias("reasons"))


@book.query(
    "p29_expand_box",
    S
    + """, b AS (SELECT subject, (subject % 300) * 1.0 AS x0, (subject % 200) * 1.0 AS y0, (subject % 300) + 40.0 AS x1, (subject % 200) + 60.0 AS y1 FROM subjects)
    SELECT subject, CAST(greatest((x0 + x1) / 2 - (x1 - x0) * 0.65, 0) AS DOUBLE) AS x0, CAST(greatest((y0 + y1) / 2 - (y1 - y0) * 0.65, 0) AS DOUBLE) AS y0,
           CAST(least((x0 + x1) / 2 + (x1 - x0) * 0.65, 320) AS DOUBLE) AS x1, CAST(least((y0 + y1) / 2 + (y1 - y0) * 0.65, 240) AS DOUBLE) AS y1 FROM b""",
)
def p29(spark, sf_dir):
    x0, y0 = (F.col("subject") % 300).cast("double"), (F.col("subject") % 200).cast("double")
    return subjects(spark, sf_dir).select("subject", *[c.alias(k) for k, c in zip(("x0", "y0", "x1", "y1"), clean.expand_box(x0, y0, x0 + 40, y0 + 60, 1.3, 320, 240))])


@book.query("p30_clean_name", S + "SELECT subject, regexp_replace(diagnosis || ' - ' || a_id || ' (v1)', '[^0-9A-Za-z]+', '_', 'g') AS name FROM subjects")
def p30(spark, sf_dir):
    return subjects(spark, sf_dir).select("subject", clean.clean_name(F.concat("diagnosis", F.lit(" - "), "a_id", F.lit(" (v1)"))).alias("name"))


G = f"WITH {role_sql('gaze')} "


@book.query("p31_pupil_mean", G + "SELECT sample, CASE WHEN valid = 0 THEN pupil + 1 ELSE (pupil + pupil + 1) / 2 END AS pupil FROM gaze")
def p31(spark, sf_dir):
    left = F.when(F.col("valid") == 0, float("nan")).otherwise(F.col("pupil"))
    return role(spark, sf_dir, "gaze").select("sample", clean.pupil_mean(left, F.col("pupil") + 1).alias("pupil"))


@book.query(
    "p32_valid_gaze",
    G + "SELECT sample, CASE WHEN ok THEN x END AS x, CASE WHEN ok THEN y END AS y, CASE WHEN ok THEN pupil END AS pupil, ok AS valid"
    " FROM (SELECT sample, x, y, pupil, coalesce(valid = 1 AND x BETWEEN 0 AND 0.9 AND y BETWEEN 0 AND 0.9, false) AS ok FROM gaze)",
)
def p32(spark, sf_dir):
    from quillspan.operators.gaze import valid_gaze

    return valid_gaze(role(spark, sf_dir, "gaze"), F.col("valid") == 1, high=0.9).select("sample", "x", "y", "pupil", "valid")


@book.query("p33_path_digest", f"WITH {role_sql('takes')} SELECT path, substr(sha1(path), 1, 12) AS digest FROM takes")
def p33(spark, sf_dir):
    return role(spark, sf_dir, "takes").select("path", clean.path_digest(F.col("path")).alias("digest"))


@book.query(
    "p34_issue_status",
    f"""WITH {role_sql('takes')}, r AS (SELECT path, concat_ws('|', CASE WHEN n_segments < 10 THEN 'few_segments' END,
        CASE WHEN duration < 20000 THEN 'short' END, CASE WHEN size = 0 THEN 'empty_file' END) AS issues, size FROM takes)
    SELECT path, CASE WHEN size = 0 THEN 'fail' WHEN issues <> '' THEN 'warn' ELSE 'ok' END AS status, issues FROM r""",
)
def p34(spark, sf_dir):
    rules = [(F.col("n_segments") < 10, "few_segments"), (F.col("duration") < 20000, "short"), (F.col("size") == 0, "empty_file")]
    status, issues = clean.issue_status(rules, F.col("size") == 0)
    return role(spark, sf_dir, "takes").select("path", status.alias("status"), issues.alias("issues"))
