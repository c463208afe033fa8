"""Queries of the aggregation and feature operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import clean
from quillspan.operators import audit, features as X, metrics, resample
from quillspan.operators import windows as W
from quillspan.plans.base import Book
from quillspan.plans.cohort import HOLDOUT, HOUR, REGIONS, S, SK, ST, K, T, Z, holdout, regions
from quillspan.plans.evaluation import F4, FOLD, G, GROUP, P, auroc_sql
from quillspan.sources.tables import predictions, role, role_sql, table

book = Book()
QUERIES, SQL = book.queries, book.sql
AGE = "CAST(trunc(TRY_CAST(age AS DOUBLE)) AS INTEGER)"
AGE_BIN = f"CASE WHEN {AGE} IS NULL THEN '[missing]' WHEN {AGE} < 9 OR {AGE} > 20 THEN 'abnormal' WHEN {AGE} < 12 THEN '9-11' WHEN {AGE} < 15 THEN '12-14' WHEN {AGE} < 18 THEN '15-17' ELSE '18-20' END"
M = "('', '#N/A', 'NA', 'N/A', 'nan', 'None')"


def subjects(spark, d):
    return role(spark, d, "subjects")


def trials(spark, d):
    return role(spark, d, "trials")


def gaze(spark, d):
    return role(spark, d, "gaze")


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def all_rounded(df, digits=6):
    return rounded(df, *[c for c, t in df.dtypes if t == "double"], digits=digits)


@book.query("a01_count_values", f"{S}, v AS (SELECT unnest(['sex', 'label', 'has_eeg']) AS field, unnest([trim(sex), trim(label), CAST(has_eeg AS VARCHAR)]) AS value FROM subjects) SELECT field, CASE WHEN value = '' THEN '[missing]' ELSE value END AS value, count(*) AS n FROM v GROUP BY ALL")
def a01(spark, d):
    return audit.count_values(subjects(spark, d), ["sex", "label", "has_eeg"])


@book.query("a02_demographic_summary", f"{S}, c AS (SELECT CASE WHEN trim(sex) IN {M} THEN '[missing]' ELSE trim(sex) END AS sex, {AGE_BIN} AS age_bin FROM subjects) SELECT sex, age_bin, count(*) AS n, count(*) FILTER (age_bin = 'abnormal') AS n_abnormal FROM c GROUP BY GROUPING SETS ((sex), (age_bin), ())")
def a02(spark, d):
    t = subjects(spark, d).select(clean.normalize_missing(F.col("sex")).alias("sex"), clean.age_bin(F.col("age")).alias("age_bin"))
    return t.groupingSets([["sex"], ["age_bin"], []], "sex", "age_bin").agg(F.count("*").alias("n"), F.count_if(F.col("age_bin") == "abnormal").alias("n_abnormal"))


@book.query("a03_rollup_availability", f"{K} SELECT subject, max(complete) AS has_file, max(CASE WHEN n_segments > 25 THEN 1 ELSE 0 END) AS has_qc, array_to_string(list_sort(list(DISTINCT task)), '|') AS tasks FROM takes GROUP BY subject")
def a03(spark, d):
    return role(spark, d, "takes").groupBy("subject").agg(F.max("complete").alias("has_file"), F.max((F.col("n_segments") > 25).cast("int")).alias("has_qc"), F.array_join(F.array_sort(F.collect_set("task")), "|").alias("tasks"))


FLAGS = ("has_eeg", "has_fnirs", "has_face")
L = "label IN ('0', '1')"


@book.query("a04_cohort_counts", f"{S}, n AS (SELECT *, has_eeg + has_fnirs + has_face AS k FROM subjects) SELECT count(*) AS n, count(*) FILTER ({L}) AS n_labelled, count(*) FILTER (k > 0) AS n_any, count(*) FILTER (k = 3) AS n_all, count(*) FILTER (k > 0 AND {L}) AS n_any_labelled, count(*) FILTER (k = 3 AND {L}) AS n_all_labelled, " + ", ".join(f"count(*) FILTER ({f} = 1) AS n_{f}, count(*) FILTER ({f} = 1 AND {L}) AS n_{f}_labelled" for f in FLAGS) + " FROM n")
def a04(spark, d):
    return X.availability_counts(subjects(spark, d), FLAGS)


@book.query("a05_core_cohorts", f"{S} SELECT subject, CASE WHEN has_eeg + has_fnirs + has_face = 3 THEN 'complete' WHEN has_eeg + has_fnirs + has_face > 0 THEN 'incomplete' ELSE 'none' END AS cohort FROM subjects WHERE {L}")
def a05(spark, d):
    n = clean.presence_count([F.col(f) for f in FLAGS])
    return audit.labeled_only(subjects(spark, d)).select("subject", F.when(n == 3, "complete").when(n > 0, "incomplete").otherwise("none").alias("cohort"))


@book.query("a06_infer_device", f"{SK}, u AS (SELECT subject, list_sort(list(DISTINCT device)) AS ds FROM takes WHERE device IN ('0', '1') AND line = 1 GROUP BY subject) SELECT subject, CASE WHEN len(ds) > 1 THEN 'both' WHEN len(ds) = 1 THEN ds[1] WHEN has_fnirs = 1 THEN 'unknown' ELSE 'none' END AS device FROM subjects LEFT JOIN u USING (subject)")
def a06(spark, d):
    return X.infer_device(subjects(spark, d), role(spark, d, "takes").filter("line = 1"), "subject", "has_fnirs", ["0", "1"]).select("subject", "device")


@book.query("a07_duplicate_summary", f"{K}, c AS (SELECT device, task, subject, count(*) AS n FROM takes WHERE subject IS NOT NULL GROUP BY ALL HAVING count(*) > 1) SELECT device, task, count(*) AS n_duplicated, array_to_string(list_sort(list(subject))[1:20], '|') AS examples FROM c GROUP BY ALL")
def a07(spark, d):
    c = audit.duplicate_keys(role(spark, d, "takes").filter("subject IS NOT NULL"), ["device", "task", "subject"])
    counts = c.groupBy("device", "task").agg(F.count("*").alias("n_duplicated"))
    first = W.top_k(c, ["device", "task"], ["subject"], 20).groupBy("device", "task").agg(F.array_join(F.transform(F.array_sort(F.collect_list("subject")), lambda x: x.cast("string")), "|").alias("examples"))
    return counts.join(first, ["device", "task"])


SPLIT = f"{HOLDOUT}, m AS (SELECT subject, site, CAST(label AS INTEGER) AS label, CASE WHEN TRY_CAST(age AS DOUBLE) BETWEEN 9 AND 20 THEN TRY_CAST(age AS DOUBLE) END AS age, CASE WHEN trim(sex) NOT IN {M} THEN trim(sex) END AS sex, cv_fold, CASE WHEN split_group = 'locked' THEN 1 ELSE 0 END AS is_locked_test, split_group FROM split)"


def manifest(spark, d):
    return holdout(spark, d).select("subject", "site", F.col("label").cast("int").alias("label"), clean.clean_range(F.col("age")).alias("age"), clean.clean_category(F.col("sex")).alias("sex"), "cv_fold", "is_locked_test", "split_group")


@book.query(
    "a08_group_summary",
    f"""{SPLIT}, b AS (SELECT site, count(*) AS n, count(label) AS labelled, CAST(sum(label) AS BIGINT) AS positives, round(avg(age), 6) AS mean_age, array_to_string(list_sort(list(DISTINCT cv_fold) FILTER (cv_fold IS NOT NULL)), '|') AS folds, CAST(sum(is_locked_test) AS BIGINT) AS n_locked FROM m GROUP BY site),
    sx AS (SELECT site, array_to_string(list_sort(list(coalesce(sex, '[missing]') || ':' || n)), '|') AS sex_counts FROM (SELECT site, sex, count(*) AS n FROM m GROUP BY ALL) GROUP BY site)
    SELECT b.*, round(positives / labelled, 6) AS rate, CASE WHEN labelled >= 20 AND (positives / labelled <= 0.15 OR positives / labelled >= 0.85) THEN 'high' ELSE 'normal' END AS risk, sex_counts FROM b JOIN sx USING (site)""",
)
def a08(spark, d):
    return rounded(X.group_summary(manifest(spark, d), "site"), "mean_age", "rate")


@book.query("a09_coverage_by_unit", f"{SK} SELECT device, task, count(*) AS recordings, count(DISTINCT t.subject) AS n_subjects, count(DISTINCT s.subject) AS in_manifest, count(DISTINCT s.subject) FILTER (s.label = '1') AS positives, round(count(DISTINCT s.subject) FILTER (s.label = '1') / nullif(count(DISTINCT s.subject) FILTER (s.label IN ('0', '1')), 0), 6) AS positive_rate FROM takes t LEFT JOIN subjects s USING (subject) GROUP BY ALL")
def a09(spark, d):
    t = role(spark, d, "takes").join(subjects(spark, d).select("subject", "label", F.col("subject").alias("known")), "subject", "left")
    pos, lab = F.count_distinct(F.when(F.col("label") == "1", F.col("known"))), F.count_distinct(F.when(F.col("label").isin("0", "1"), F.col("known")))
    return t.groupBy("device", "task").agg(F.count("*").alias("recordings"), F.count_distinct("subject").alias("n_subjects"), F.count_distinct("known").alias("in_manifest"), pos.alias("positives"), F.round(F.try_divide(pos.cast("double"), lab.cast("double")), 6).alias("positive_rate"))


REASON = "CASE WHEN subject IS NULL THEN NULL WHEN n_segments < 10 THEN 'few_segments' WHEN duration < 20000 THEN 'short' ELSE '' END"


@book.query("a10_reason_counts", f"{K}, r AS (SELECT *, {REASON} AS reason FROM takes) SELECT device, reason, count(DISTINCT subject) AS n_subjects FROM r GROUP BY ALL")
def a10(spark, d):
    return role(spark, d, "takes").withColumn("reason", F.expr(REASON)).groupBy("device", "reason").agg(F.count_distinct("subject").alias("n_subjects"))


@book.query("a12_detection_summary", f"{K} SELECT task, count(*) AS videos, count(*) FILTER (complete = 1) AS valid, count(*) FILTER (complete = 0) AS blocked, round(avg(n_segments), 6) AS mean_segments, CAST(sum(CASE WHEN size = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks FROM takes GROUP BY task")
def a12(spark, d):
    return role(spark, d, "takes").groupBy("task").agg(F.count("*").alias("videos"), F.count_if(F.col("complete") == 1).alias("valid"), F.count_if(F.col("complete") == 0).alias("blocked"), F.round(F.avg("n_segments"), 6).alias("mean_segments"), F.count_if(F.col("size") == 0).alias("fallbacks"))


@book.query("a13_event_inventory", f"{T}, p AS (SELECT stimulus, subject, count(*) AS n FROM trials GROUP BY ALL) SELECT stimulus, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_subjects, min(n) AS fewest, median(n) AS median, max(n) AS most FROM p GROUP BY stimulus")
def a13(spark, d):
    return trials(spark, d).groupBy("stimulus", "subject").agg(F.count("*").alias("n")).groupBy("stimulus").agg(F.sum("n").alias("n_events"), F.count("*").alias("n_subjects"), F.min("n").alias("fewest"), F.median("n").alias("median"), F.max("n").alias("most"))


@book.query("a14_event_sequence_examples", f"{T}, f AS (SELECT * FROM trials WHERE subject < 20 QUALIFY row_number() OVER (PARTITION BY subject ORDER BY onset_sec, trial) <= 30) SELECT subject, string_agg(stimulus, ' ' ORDER BY onset_sec, trial) AS codes FROM f GROUP BY subject ORDER BY subject LIMIT 10")
def a14(spark, d):
    t = trials(spark, d)
    ten = t.filter("subject IS NOT NULL").select("subject").distinct().orderBy("subject").limit(10)
    first = W.top_k(t.join(F.broadcast(ten), "subject", "left_semi"), ["subject"], ["onset_sec", "trial"], 30)
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("onset_sec", "trial", "stimulus"))), lambda x: x["stimulus"]), " ")
    return first.groupBy("subject").agg(codes.alias("codes")).orderBy("subject")


@book.query("a15_summarize_vector", f"{T} SELECT stimulus, round(avg(rt_sec), 6) AS mean, round(stddev_pop(rt_sec), 6) AS std, min(rt_sec) AS min, max(rt_sec) AS max, round(quantile_cont(rt_sec, 0.25), 6) AS p25, round(quantile_cont(rt_sec, 0.5), 6) AS p50, round(quantile_cont(rt_sec, 0.75), 6) AS p75 FROM trials GROUP BY stimulus")
def a15(spark, d):
    return rounded(trials(spark, d).groupBy("stimulus").agg(*X.vector_summary("rt_sec")), "mean", "std", "p25", "p50", "p75")


SIGNAL = "signal AS (SELECT vec_id AS recording, label AS condition, unnest(range(0, 64)) AS sample, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def signal(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("recording"), F.col("label").alias("condition"), F.posexplode("embedding").alias("sample", "value")).withColumns({"value": F.col("value").cast("double"), "sample": F.col("sample").cast("long")})


@book.query("a16_time_moments", f"WITH {SIGNAL}, m AS (SELECT condition, avg(value) AS m FROM signal GROUP BY 1), c AS (SELECT condition, avg(m) AS mean, avg(power(value - m, 2)) AS v, avg(power(value - m, 3)) AS s, avg(power(value - m, 4)) AS k, avg(abs(value)) AS a, quantile_cont(value, 0.01) AS p01, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.99) AS p99 FROM signal JOIN m USING (condition) GROUP BY 1) SELECT condition, round(mean, 6) AS mean, round(sqrt(v), 6) AS std, round(s / power(v, 1.5), 5) AS skew, round(k / (v * v), 5) AS kurtosis, round(a, 6) AS abs_mean, round(p01, 6) AS p01, round(p50, 6) AS p50, round(p99, 6) AS p99 FROM c")
def a16(spark, d):
    t = signal(spark, d).groupBy("condition").agg(*X.time_moments("value"))
    return rounded(rounded(t, "mean", "std", "abs_mean", "p01", "p50", "p99"), "skew", "kurtosis", digits=5)


@book.query("a17_channel_stats", f"WITH {SIGNAL}, c AS (SELECT condition, sample, avg(value) AS m, stddev_pop(value) AS s, regr_slope(value, recording) AS b FROM signal GROUP BY ALL) SELECT condition, round(avg(m), 6) AS mean_mean, round(stddev_pop(m), 6) AS mean_std, round(avg(s), 6) AS std_mean, round(stddev_pop(s), 6) AS std_std, round(avg(b) * 1000, 6) AS slope_mean FROM c GROUP BY condition")
def a17(spark, d):
    c = signal(spark, d).groupBy("condition", "sample").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.regr_slope("value", "recording").alias("b"))
    return all_rounded(c.groupBy("condition").agg(F.avg("m").alias("mean_mean"), F.stddev_pop("m").alias("mean_std"), F.avg("s").alias("std_mean"), F.stddev_pop("s").alias("std_std"), (F.avg("b") * 1000).alias("slope_mean")))


@book.query("a18_describe_rt", f"{T}, m AS (SELECT *, avg(rt_sec) OVER (PARTITION BY subject) AS m, stddev_samp(rt_sec) OVER (PARTITION BY subject) AS s FROM trials) SELECT subject, count(rt_sec) AS n, round(avg(rt_sec), 6) AS mean, round(median(rt_sec), 6) AS median, round(stddev_samp(rt_sec), 6) AS sd, round(stddev_samp(rt_sec) / avg(rt_sec), 6) AS cv, round(quantile_cont(rt_sec, 0.75) - quantile_cont(rt_sec, 0.25), 6) AS iqr, min(rt_sec) AS min, max(rt_sec) AS max, round(CASE WHEN count(rt_sec) > 2 THEN avg(power((rt_sec - m) / s, 3)) END, 5) AS skew FROM m GROUP BY subject")
def a18(spark, d):
    t = trials(spark, d).groupBy("subject").agg(*X.describe_rt("rt_sec"))
    return rounded(rounded(t, "mean", "median", "sd", "cv", "iqr"), "skew", digits=5)


def poly(cs, x):
    out = str(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + ({c}))"
    return out


def inverse_normal_sql(p):
    q = f"({p} - 0.5)"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda t: f"{poly(X.ACKLAM_C, t)} / {poly((*X.ACKLAM_D, 1.0), t)}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 0.97575 THEN -({tail(high)}) ELSE {poly(X.ACKLAM_A, f'({q} * {q})')} * {q} / {poly((*X.ACKLAM_B, 1.0), f'({q} * {q})')} END"


COUNTS = "SELECT subject, count(*) FILTER (target = 1 AND yes) AS hits, count(*) FILTER (target = 1) AS targets, count(*) FILTER (target = 0 AND yes) AS alarms, count(*) FILTER (target = 0) AS others FROM (SELECT *, response <> '' AS yes FROM trials) GROUP BY subject"
DETECT = f"c AS ({COUNTS}), z AS (SELECT *, (hits + 0.5::DOUBLE) / (targets + 1) AS ph, (alarms + 0.5::DOUBLE) / (others + 1) AS pf FROM c), n AS (SELECT *, {inverse_normal_sql('ph')} AS zh, {inverse_normal_sql('pf')} AS zf FROM z)"


@book.query("a19_signal_detection", f"{T}, {DETECT} SELECT subject, round(hits / nullif(targets, 0), 6) AS hit_rate, round(alarms / nullif(others, 0), 6) AS false_alarm_rate, round(CASE WHEN targets > 0 AND others > 0 THEN zh - zf END, 6) AS d_prime, round(CASE WHEN targets > 0 AND others > 0 THEN -(zh + zf) / 2 END, 6) AS criterion FROM n")
def a19(spark, d):
    c = X.detection_counts(trials(spark, d), ["subject"], F.col("target") == 1, F.col("response") != "")
    found = X.signal_detection(*[F.col(n) for n in ("hits", "targets", "alarms", "others")])
    return c.select("subject", *[F.round(v, 6).alias(k) for k, v in found.items()])


O = "PARTITION BY subject, block ORDER BY onset_sec, trial"


@book.query(
    "a20_nback_features",
    f"""{T}, w AS (SELECT *, CASE WHEN row_number() OVER ({O}) = 1 THEN 'block_initial' WHEN stimulus = lag(stimulus) OVER ({O}) THEN 'match' ELSE 'non_match' END AS condition FROM trials),
    s AS (SELECT *, CASE WHEN response = '' THEN NULL WHEN condition = 'match' THEN CAST(response = '1' AS DOUBLE) ELSE CAST(response = '2' AS DOUBLE) END AS correct FROM w WHERE condition <> 'block_initial'),
    q AS (SELECT *, lag(correct) OVER ({O}) AS before FROM s)
    SELECT subject, count(*) AS n_used, round(avg(correct), 6) AS accuracy, round(avg(correct) FILTER (condition = 'match'), 6) AS accuracy_match, round(avg(correct) FILTER (condition = 'non_match'), 6) AS accuracy_non_match,
        round(avg(CAST(response = '' AS DOUBLE)), 6) AS omission_rate, round(round(avg(rt_sec) FILTER (condition = 'match') - avg(rt_sec) FILTER (condition = 'non_match'), 9), 6) AS rt_match_difference,
        round(round(avg(rt_sec) FILTER (before = 0) - avg(rt_sec) FILTER (before = 1), 9), 6) AS post_error_slowing, round(avg(CAST(correct = logged_correct AS DOUBLE)), 6) AS qc_agreement FROM q GROUP BY subject""",
)
def a20(spark, d):
    t = W.nback_condition(trials(spark, d), ["subject", "block"], ["onset_sec", "trial"]).filter("condition <> 'block_initial'")
    match = F.col("condition") == "match"
    correct = F.when(F.col("response") == "", F.lit(None)).when(match, (F.col("response") == "1").cast("double")).otherwise((F.col("response") == "2").cast("double"))
    t = W.with_previous(t.withColumn("correct", correct), ["subject", "block"], ["onset_sec", "trial"], ["correct"])
    rt = lambda c: F.avg(F.when(c, F.col("rt_sec")))
    return all_rounded(t.groupBy("subject").agg(
        F.count("*").alias("n_used"), F.avg("correct").alias("accuracy"), F.avg(F.when(match, F.col("correct"))).alias("accuracy_match"), F.avg(F.when(~match, F.col("correct"))).alias("accuracy_non_match"),
        F.avg((F.col("response") == "").cast("double")).alias("omission_rate"), F.round(rt(match) - rt(~match), 9).alias("rt_match_difference"),
        F.round(rt(F.col("previous_correct") == 0) - rt(F.col("previous_correct") == 1), 9).alias("post_error_slowing"), F.avg((F.col("correct") == F.col("logged_correct")).cast("double")).alias("qc_agreement"),
    ))


BLOCKS = "b AS (SELECT subject, block, avg(rt_sec) AS rt FROM trials GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY block) AS k, count(*) OVER (PARTITION BY subject) AS n FROM b), sl AS (SELECT subject, CASE WHEN max(n) >= 3 THEN regr_slope(rt, k) END AS slope, avg(rt) FILTER (k > n - n // 2) - avg(rt) FILTER (k <= n // 2) AS half_change FROM r GROUP BY subject)"


@book.query("a21_oddball_features", f"{T}, {DETECT}, {BLOCKS} SELECT subject, round(hits / nullif(targets, 0), 6) AS hit_rate, round(1 - hits / nullif(targets, 0), 6) AS miss_rate, round(alarms / nullif(others, 0), 6) AS false_alarm_rate, round(CASE WHEN targets > 0 AND others > 0 THEN zh - zf END, 6) AS d_prime, round(slope, 6) AS rt_slope, round(half_change, 6) AS rt_half_change FROM n JOIN sl USING (subject)")
def a21(spark, d):
    t = trials(spark, d)
    c = X.detection_counts(t, ["subject"], F.col("target") == 1, F.col("response") != "")
    found = X.signal_detection(*[F.col(n) for n in ("hits", "targets", "alarms", "others")])
    blocks = W.block_change(t.groupBy("subject", "block").agg(F.avg("rt_sec").alias("rt")), "subject", "block", "rt")
    return all_rounded(c.join(blocks, "subject").select("subject", found["hit_rate"].alias("hit_rate"), (1 - found["hit_rate"]).alias("miss_rate"), found["false_alarm_rate"].alias("false_alarm_rate"), found["d_prime"].alias("d_prime"), F.col("slope").alias("rt_slope"), F.col("half_change").alias("rt_half_change")))


@book.query("a22_choice_features", f"{T}, r AS (SELECT *, CASE WHEN response <> '' THEN response END AS r FROM trials), p AS (SELECT *, lag(r) OVER ({O}) AS pr, lag(feedback) OVER ({O}) AS pf FROM r), q AS (SELECT *, CASE WHEN r IS NOT NULL AND pr IS NOT NULL THEN CAST(r = pr AS DOUBLE) END AS stay FROM p), a AS (SELECT subject, avg(CAST(r = '1' AS DOUBLE)) AS choice_bias, avg(1 - stay) AS switch_rate, avg(stay) FILTER (pf = 'win') AS win_stay, avg(1 - stay) FILTER (pf = 'loss') AS lose_shift, avg(CAST(r IS NULL AS DOUBLE)) AS omission_rate FROM q GROUP BY subject) SELECT subject, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("choice_bias", "switch_rate", "win_stay", "lose_shift", "omission_rate")) + ", round(win_stay + lose_shift - 1, 6) AS sensitivity FROM a")
def a22(spark, d):
    return all_rounded(X.choice_pairs(trials(spark, d), "subject", ["subject", "block"], ["onset_sec", "trial"]))


@book.query("a23_ols_slope", f"{T}, k AS (SELECT subject, rt_sec, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY subject) AS n FROM trials WHERE rt_sec IS NOT NULL WINDOW w AS (PARTITION BY subject ORDER BY trial)) SELECT subject, round(CASE WHEN count(*) >= 2 THEN regr_slope(rt_sec, k / (n - 1)) END, 6) AS slope FROM k GROUP BY subject")
def a23(spark, d):
    return rounded(X.linspace_slope(trials(spark, d), ["subject"], "rt_sec", "trial"), "slope")


@book.query("a24_autocorr_lag1", f"WITH {SIGNAL}, l AS (SELECT recording, value AS y, lag(value) OVER (PARTITION BY recording ORDER BY sample) AS x FROM signal) SELECT recording, round(corr(x, y), 5) AS autocorr FROM l GROUP BY recording")
def a24(spark, d):
    return rounded(X.autocorr_lag1(signal(spark, d), ["recording"], "value", "sample"), "autocorr", digits=5)


@book.query("a25_connectivity", f"WITH {SIGNAL}, s AS (SELECT condition, recording, sample, value FROM signal), r AS (SELECT a.condition, a.sample AS p, b.sample AS q, corr(a.value, b.value) AS r FROM s a JOIN s b ON a.condition = b.condition AND a.recording = b.recording AND a.sample < b.sample GROUP BY ALL) SELECT condition, round(avg(r), 5) AS mean, round(stddev_pop(r), 5) AS std, count(r) AS n_pairs FROM r GROUP BY condition")
def a25(spark, d):
    return all_rounded(X.connectivity(signal(spark, d), "condition", "recording", "sample", "value"), 5)


@book.query("a26_hjorth", f"WITH {SIGNAL}, a AS (SELECT *, value - lag(value) OVER w AS d FROM signal WINDOW w AS (PARTITION BY recording ORDER BY sample)), b AS (SELECT *, d - lag(d) OVER (PARTITION BY recording ORDER BY sample) AS dd FROM a), v AS (SELECT recording, var_pop(value) AS v0, var_pop(d) AS v1, var_pop(dd) AS v2 FROM b GROUP BY recording) SELECT recording, round(v0, 6) AS activity, round(sqrt(v1 / v0), 6) AS mobility, round(sqrt(v2 / v1) / sqrt(v1 / v0), 6) AS complexity FROM v")
def a26(spark, d):
    return all_rounded(X.hjorth(signal(spark, d), ["recording"], "value", "sample"))


@book.query("a27_hb_correlation", f"WITH {SIGNAL}, p AS (SELECT a.condition, a.recording, a.sample, a.value AS hbo, b.value AS hbr FROM signal a JOIN signal b ON a.recording = b.recording AND b.sample = a.sample + 32), r AS (SELECT condition, sample, corr(hbo, hbr) AS r FROM p GROUP BY ALL) SELECT condition, round(avg(r), 5) AS mean, round(stddev_pop(r), 5) AS std FROM r GROUP BY condition")
def a27(spark, d):
    s = signal(spark, d)
    b = s.select("recording", (F.col("sample") - 32).alias("sample"), F.col("value").alias("hbr"))
    r = s.withColumnRenamed("value", "hbo").join(b, ["recording", "sample"]).groupBy("condition", "sample").agg(resample.pearson(F.col("hbo"), F.col("hbr")).alias("r"))
    return all_rounded(r.groupBy("condition").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std")), 5)


@book.query("a28_block_response", f"WITH {SIGNAL}, b AS (SELECT recording, avg(value) FILTER (sample < 16) AS base, avg(value) FILTER (sample BETWEEN 16 AND 47) AS m, max(value) FILTER (sample BETWEEN 16 AND 47) AS pk, sum(value) FILTER (sample BETWEEN 16 AND 47) AS s, avg(value) FILTER (sample >= 48) AS rec, count(*) FILTER (sample BETWEEN 16 AND 47) AS n FROM signal GROUP BY recording), f AS (SELECT recording, min(sample) AS at_sample FROM signal JOIN b USING (recording) WHERE value = pk AND sample BETWEEN 16 AND 47 GROUP BY recording) SELECT recording, round(base, 6) AS baseline, n AS n_task, round(m - base, 6) AS response, round(pk - base, 6) AS peak, (at_sample - 16) / 32.0::DOUBLE AS time_to_peak, round(s - base * n, 6) AS area, round(rec - base, 6) AS recovery FROM b JOIN f USING (recording)")
def a28(spark, d):
    n = F.col("sample")
    return rounded(X.block_response(signal(spark, d), ["recording"], n < 16, n.between(16, 47), n >= 48, "value", (n - 16) / 32), "baseline", "response", "peak", "area", "recovery")


@book.query("a29_whole_recording", f"WITH {SIGNAL}, c AS (SELECT condition, sample, stddev_pop(value) AS s, regr_slope(value, recording) AS b FROM signal GROUP BY ALL), w AS (SELECT condition, avg(value) AS mean, stddev_pop(value) AS std FROM signal GROUP BY 1) SELECT condition, round(w.mean, 6) AS mean, round(w.std, 6) AS std, round(avg(s), 6) AS channel_std, round(avg(b) * 1000, 6) AS slope_mean, round(stddev_pop(b) * 1000, 6) AS slope_std FROM c JOIN w USING (condition) GROUP BY condition, w.mean, w.std")
def a29(spark, d):
    s = signal(spark, d)
    c = s.groupBy("condition", "sample").agg(F.stddev_pop("value").alias("s"), F.regr_slope("value", "recording").alias("b")).groupBy("condition").agg(F.avg("s").alias("channel_std"), (F.avg("b") * 1000).alias("slope_mean"), (F.stddev_pop("b") * 1000).alias("slope_std"))
    return all_rounded(s.groupBy("condition").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).join(c, "condition"))


@book.query("a30_signal_qc", f"""WITH {SIGNAL}, v AS (SELECT condition, recording, sample, CASE WHEN (recording + sample) % 17 = 0 THEN NULL ELSE value END AS value FROM signal), st AS (SELECT *, value - lag(value) OVER (PARTITION BY condition, sample ORDER BY recording) AS step FROM v),
    l AS (SELECT condition, median(abs(value)) + 6 * stddev_pop(value) AS threshold FROM v GROUP BY 1), f AS (SELECT condition, avg(CAST(flat AS DOUBLE)) AS flat_rate FROM (SELECT condition, sample, stddev_pop(value) < 1e-9 AS flat FROM v GROUP BY ALL) GROUP BY 1)
    SELECT condition, round(threshold, 6) AS threshold, round(avg(CAST(value IS NULL AS DOUBLE)), 6) AS missing_rate, round(stddev_pop(step), 6) AS motion, round(avg(CAST(abs(value) > threshold AS DOUBLE)), 6) AS extreme_rate, round(max(flat_rate), 6) AS flat_rate FROM st JOIN l USING (condition) JOIN f USING (condition) GROUP BY condition, threshold""")
def a30(spark, d):
    s = signal(spark, d).withColumn("value", F.when((F.col("recording") + F.col("sample")) % 17 != 0, F.col("value")))
    return all_rounded(X.signal_qc(s, "condition", "sample", "value", "recording"))


EVOKED = f"{SIGNAL}, e AS (SELECT recording % 20 AS subject, CASE WHEN condition < 5 THEN 'target' ELSE 'standard' END AS kind, sample, avg(value) AS value FROM signal GROUP BY ALL)"


def evoked(spark, d):
    return signal(spark, d).groupBy((F.col("recording") % 20).alias("subject"), F.when(F.col("condition") < 5, "target").otherwise("standard").alias("kind"), "sample").agg(F.avg("value").alias("value"))


DIFF = f"{EVOKED}, w AS (SELECT a.subject, a.sample, a.value - b.value AS difference FROM e a JOIN e b ON a.subject = b.subject AND a.sample = b.sample AND a.kind = 'target' AND b.kind = 'standard')"


@book.query("a31_difference_wave", f"WITH {DIFF} SELECT subject, sample, round(difference, 6) AS difference FROM w")
def a31(spark, d):
    return rounded(X.difference_wave(evoked(spark, d), ["subject", "sample"], "kind", "value", "target", "standard"), "difference")


@book.query("a32_wave_window_features", f"""WITH {DIFF}, x AS (SELECT w.*, n AS "window" FROM w JOIN (VALUES ('early', 0, 20), ('late', 18, 45)) v(n, a, b) ON sample BETWEEN a AND b), t AS (SELECT *, (difference + lag(difference) OVER o) / 2 * (sample - lag(sample) OVER o) AS tr FROM x WINDOW o AS (PARTITION BY subject, "window" ORDER BY sample))
    SELECT subject, "window", round(avg(difference), 6) AS mean, round(max(difference), 6) AS peak, round(min(difference), 6) AS trough, arg_min(sample, (-difference, sample)) AS peak_latency, round(coalesce(sum(tr), 0), 6) AS area, round(max(difference) - min(difference), 6) AS peak_to_peak FROM t GROUP BY ALL""".replace("arg_min(sample, (-difference, sample))", "arg_max(sample, difference)"))
def a32(spark, d):
    waves = X.difference_wave(evoked(spark, d), ["subject", "sample"], "kind", "value", "target", "standard")
    return rounded(X.wave_window_features(waves, ["subject"], "sample", "difference", {"early": (0, 20), "late": (18, 45)}), "mean", "peak", "trough", "area", "peak_to_peak")


@book.query("a33_validity_effect", f"WITH {DIFF} SELECT sample, round(avg(difference), 6) AS effect, round(avg(difference) / stddev_samp(difference), 6) AS cohen_d, round(avg(CAST(difference > 0 AS DOUBLE)), 6) AS share_positive FROM w GROUP BY sample")
def a33(spark, d):
    w = X.difference_wave(evoked(spark, d), ["subject", "sample"], "kind", "value", "target", "standard")
    return all_rounded(w.groupBy("sample").agg(F.avg("difference").alias("effect"), F.try_divide(F.avg("difference"), F.stddev_samp("difference")).alias("cohen_d"), F.avg((F.col("difference") > 0).cast("double")).alias("share_positive")))


@book.query("a34_trial_counts_pivot", f"{T}, c AS (SELECT subject, count(*) FILTER (stimulus = 'click') AS click, count(*) FILTER (stimulus = 'purchase') AS purchase, count(*) FILTER (stimulus = 'error') AS error FROM trials GROUP BY subject) SELECT round(avg(click), 6) AS mean_click, min(click) AS min_click, max(click) AS max_click, round(avg(purchase), 6) AS mean_purchase, round(avg(error), 6) AS mean_error FROM c")
def a34(spark, d):
    c = trials(spark, d).groupBy("subject").pivot("stimulus", ["click", "purchase", "error"]).count().fillna(0)
    return all_rounded(c.agg(F.avg("click").alias("mean_click"), F.min("click").alias("min_click"), F.max("click").alias("max_click"), F.avg("purchase").alias("mean_purchase"), F.avg("error").alias("mean_error")))


@book.query("a35_region_shares", f"{REGIONS} SELECT recording, " + ", ".join(f"round(count(*) FILTER (region = '{r}') / nullif(count(region), 0), 6) AS share_{r}" for r in ("eyes", "mouth", "face_other", "off_face")) + ", count(region) AS n_usable FROM placed GROUP BY recording")
def a35(spark, d):
    return all_rounded(X.region_shares(regions(spark, d), ["recording"], ["eyes", "mouth", "face_other", "off_face"]))


@book.query("a36_bcea", f"{Z} SELECT recording, round(CASE WHEN count(x) >= 3 THEN 2 * -ln(1 - 0.68::DOUBLE) * pi() * stddev_samp(x) * stddev_samp(y) * sqrt(1 - power(corr(x, y), 2)) END, 5) AS bcea FROM gaze GROUP BY recording")
def a36(spark, d):
    return rounded(X.bcea(gaze(spark, d), ["recording"]), "bcea", digits=5)


@book.query("a37_drift_estimate", f"""{Z}, c AS (SELECT recording, time_ms // {24 * HOUR} AS day, median(x) AS x, median(y) AS y FROM gaze WHERE x IS NOT NULL AND y IS NOT NULL AND time_ms % {24 * HOUR} >= {HOUR} GROUP BY ALL HAVING count(*) >= 2),
    m AS (SELECT recording, count(*) AS n_crosses, median(x) AS mx, median(y) AS my, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr_x, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS iqr_y FROM c GROUP BY 1)
    SELECT recording, n_crosses, round(iqr_x, 6) AS iqr_x, round(iqr_y, 6) AS iqr_y, n_crosses >= 10 AS usable, round(CASE WHEN n_crosses >= 10 THEN mx - 0.5 ELSE 0 END, 6) AS dx, round(CASE WHEN n_crosses >= 10 THEN my - 0.5 ELSE 0 END, 6) AS dy FROM m""")
def a37(spark, d):
    day = 24 * HOUR
    g = gaze(spark, d).withColumn("cross", F.floor(F.col("time_ms") / day))
    return all_rounded(X.drift_estimate(g, "recording", "cross", F.col("time_ms") % day, HOUR, 2, 10))


@book.query("a43_subject_scores", f"{P} SELECT cv_protocol, feature_set, subject, round(avg(probability), 6) AS mean_score, round(median(probability), 6) AS median_score, count(*) AS n FROM predictions GROUP BY ALL")
def a43(spark, d):
    return all_rounded(predictions(spark, d).groupBy("cv_protocol", "feature_set", "subject").agg(F.avg("probability").alias("mean_score"), F.median("probability").alias("median_score"), F.count("*").alias("n")))


@book.query("a44_embedding_pool", f"WITH {SIGNAL} SELECT condition, sample AS dim, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM signal GROUP BY ALL")
def a44(spark, d):
    return all_rounded(signal(spark, d).groupBy("condition", F.col("sample").alias("dim")).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


@book.query("a45_segment_contrast", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))), 5) AS total, 64::INTEGER AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def a45(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    contrast = F.zip_with("embedding", "other", lambda x, y: x.cast("double") - y.cast("double"))
    j = e.filter("vec_id % 2 = 0").join(b, "vec_id").withColumn("contrast", contrast)
    return j.select("vec_id", F.round(F.aggregate("contrast", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("contrast").alias("n"))


@book.query("a46_seed_average", f"{P}, m AS (SELECT cv_protocol, feature_set, subject, max(label) AS label, avg(probability) AS probability FROM predictions GROUP BY ALL), s AS (SELECT cv_protocol, feature_set, avg(auroc) AS seed_mean, stddev_samp(auroc) AS seed_std, min(auroc) AS seed_min, max(auroc) AS seed_max FROM {auroc_sql(G)} GROUP BY ALL) SELECT cv_protocol, feature_set, round(auroc, 5) AS auroc_of_mean, round(seed_mean, 6) AS seed_mean, round(seed_std, 6) AS seed_std, round(seed_min, 6) AS seed_min, round(seed_max, 6) AS seed_max FROM {auroc_sql('cv_protocol, feature_set', '(SELECT cv_protocol, feature_set, label, round(probability, 9) AS probability FROM m)')} JOIN s USING (cv_protocol, feature_set)")
def a46(spark, d):
    rows = predictions(spark, d)
    keys = ["cv_protocol", "feature_set"]
    mean = rows.groupBy(*keys, "subject").agg(F.max("label").alias("label"), F.round(F.avg("probability"), 9).alias("probability"))
    spread = metrics.auroc(rows, GROUP).groupBy(*keys).agg(F.avg("auroc").alias("seed_mean"), F.stddev_samp("auroc").alias("seed_std"), F.min("auroc").alias("seed_min"), F.max("auroc").alias("seed_max"))
    return rounded(rounded(metrics.auroc(mean, keys).withColumnRenamed("auroc", "auroc_of_mean").join(spread, keys), "auroc_of_mean", digits=5), "seed_mean", "seed_std", "seed_min", "seed_max")


LADDER = f"(SELECT cv_protocol, seed, max(auroc) FILTER (feature_set = 'signal_qc') - max(auroc) FILTER (feature_set = 'signal') AS diff, max(auroc) FILTER (feature_set = 'signal') AS base FROM {auroc_sql(G)} GROUP BY ALL)"


def ladder(spark, d):
    wide = metrics.auroc(predictions(spark, d), GROUP).groupBy("cv_protocol", "seed").pivot("feature_set", ["signal", "signal_qc"]).agg(F.max("auroc"))
    return wide.select("cv_protocol", "seed", (F.col("signal_qc") - F.col("signal")).alias("diff"), F.col("signal").alias("base"))


@book.query("a47_decision_with_total", f"{P} SELECT coalesce(cv_protocol, 'ALL') AS unit, count(*) AS n, count(*) FILTER (diff > 0) AS positive FROM {LADDER} GROUP BY ROLLUP (cv_protocol)")
def a47(spark, d):
    return ladder(spark, d).rollup("cv_protocol").agg(F.count("*").alias("n"), F.count_if(F.col("diff") > 0).alias("positive")).select(F.coalesce("cv_protocol", F.lit("ALL")).alias("unit"), "n", "positive")


@book.query("a48_modality_decision", f"{P}, c AS (SELECT seed, count(*) FILTER (diff > 0 AND cv_protocol = 'standard') AS up_standard, count(*) FILTER (diff > 0 AND cv_protocol = 'group') AS up_group FROM {LADDER} GROUP BY seed) SELECT *, up_standard > 0 AND up_group > 0 AS credited FROM c")
def a48(spark, d):
    up = lambda p: F.count_if((F.col("diff") > 0) & (F.col("cv_protocol") == p))
    return ladder(spark, d).groupBy("seed").agg(up("standard").alias("up_standard"), up("group").alias("up_group")).withColumn("credited", (F.col("up_standard") > 0) & (F.col("up_group") > 0))


@book.query("a49_strictness_ladder", f"{P} SELECT count(*) AS n, count(*) FILTER (diff > 0) AS l1, count(*) FILTER (diff > 0 AND base > 0.5) AS l2, count(*) FILTER (diff > 0 AND base > 0.5 AND cv_protocol = 'group') AS l3 FROM {LADDER}")
def a49(spark, d):
    l1 = F.col("diff") > 0
    l2 = l1 & (F.col("base") > 0.5)
    return ladder(spark, d).agg(F.count("*").alias("n"), F.count_if(l1).alias("l1"), F.count_if(l2).alias("l2"), F.count_if(l2 & (F.col("cv_protocol") == "group")).alias("l3"))


@book.query("a50_conformance", f"{T}, o AS (SELECT stimulus, CAST(count(*) AS DOUBLE) AS observed FROM trials GROUP BY 1), e AS (SELECT * FROM (VALUES ('click', 2000.0::DOUBLE), ('view', 1500.0::DOUBLE), ('gaze', 10.0::DOUBLE)) v(stimulus, expected)) SELECT stimulus, expected, observed, CASE WHEN abs(observed - expected) <= abs(expected) * 0.1 THEN 'pass' WHEN abs(observed - expected) <= 3 * (abs(expected) * 0.1) THEN 'partial' ELSE 'FAIL' END AS status FROM e LEFT JOIN o USING (stimulus)")
def a50(spark, d):
    observed = trials(spark, d).groupBy("stimulus").agg(F.count("*").cast("double").alias("observed"))
    expected = spark.createDataFrame([("click", 2000.0), ("view", 1500.0), ("gaze", 10.0)], "stimulus string, expected double")
    return X.conformance(observed, expected, ["stimulus"], 0.1)


@book.query("a51_readiness_verdict", f"{K}, m AS (SELECT device, task, median(n_segments) AS segments, median(duration) AS duration FROM takes GROUP BY ALL) SELECT *, CASE WHEN segments >= 25.5 AND duration >= 38000 THEN 'READY' ELSE 'REVIEW' END AS verdict, concat_ws(',', CASE WHEN segments < 25.5 THEN 'segments' END, CASE WHEN duration < 38000 THEN 'duration' END) AS failed FROM m")
def a51(spark, d):
    m = role(spark, d, "takes").groupBy("device", "task").agg(F.median("n_segments").alias("segments"), F.median("duration").alias("duration"))
    return X.readiness_verdict(m, {"segments": 25.5, "duration": 38000.0})


@book.query("a52_quality_summary", f"{K}, u AS (SELECT device, unnest(['n_segments', 'duration']) AS field, unnest([CAST(n_segments AS DOUBLE), duration]) AS v FROM takes) SELECT device, field, count(*) AS n, median(v) AS p50, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, round(avg(CAST(v < 20 AS DOUBLE)), 6) AS share_low FROM u GROUP BY ALL")
def a52(spark, d):
    u = role(spark, d, "takes").select("device", F.explode(F.array(F.struct(F.lit("n_segments").alias("field"), F.col("n_segments").cast("double").alias("v")), F.struct(F.lit("duration").alias("field"), F.col("duration").alias("v")))).alias("s")).select("device", "s.*")
    # equal values are counted where they are read, so what a group's task reads is one row a distinct value
    u = u.groupBy("device", "field", "v").agg(F.count("*").alias("c"))
    quantile = lambda p: F.percentile("v", p, F.col("c"))
    low = F.sum(F.when(F.col("v") < 20, F.col("c")).otherwise(0)) / F.sum(F.when(F.col("v").isNotNull(), F.col("c")))
    return u.groupBy("device", "field").agg(F.sum("c").alias("n"), quantile(0.5).alias("p50"), quantile(0.25).alias("p25"), quantile(0.75).alias("p75"), F.round(low, 6).alias("share_low"))


@book.query("a53_cohort_identity", f"{T} SELECT count(DISTINCT subject) AS n, true AS same_keys, 0.0::DOUBLE AS max_relative_difference, true AS identical FROM trials")
def a53(spark, d):
    a = trials(spark, d).groupBy("subject").agg(F.count("*").alias("v"))
    b = trials(spark, d).groupBy("subject", "block").agg(F.count("*").alias("c")).groupBy("subject").agg(F.sum("c").alias("v"))
    return X.cohort_identity(a, b, ["subject"], "v")


@book.query("a56_split_distribution", f"{SPLIT} SELECT coalesce(nullif(trim(sex), ''), '[missing]') AS value, count(*) AS n_all, count(*) FILTER (split_group = 'locked') AS holdout, count(*) FILTER (split_group = 'cv') AS pool, " + ", ".join(f"count(*) FILTER (cv_fold = {i}) AS fold_{i}" for i in range(5)) + " FROM m GROUP BY 1")
def a56(spark, d):
    return X.split_distribution(manifest(spark, d), "sex", "split_group", "cv_fold", 5)


@book.query("a57_task_counts", f"{K} SELECT task, count(*) AS n, count(*) FILTER (complete = 1) AS readable, count(*) FILTER (n_segments > 25) AS qc_pass, count(*) FILTER (size > 0) AS has_features FROM takes GROUP BY task")
def a57(spark, d):
    return role(spark, d, "takes").groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.col("complete") == 1).alias("readable"), F.count_if(F.col("n_segments") > 25).alias("qc_pass"), F.count_if(F.col("size") > 0).alias("has_features"))


@book.query("a58_window_inventory", f"{ST}, w AS (SELECT block, t.subject, count(*) AS n, max(label) AS label FROM trials t JOIN subjects s USING (subject) GROUP BY ALL) SELECT block, count(*) AS n_subjects, CAST(sum(n) AS BIGINT) AS n_windows, count(*) FILTER (label = '1') AS n_positive FROM w GROUP BY block")
def a58(spark, d):
    w = trials(spark, d).join(subjects(spark, d).select("subject", "label"), "subject").groupBy("block", "subject").agg(F.count("*").alias("n"), F.max("label").alias("label"))
    return w.groupBy("block").agg(F.count("*").alias("n_subjects"), F.sum("n").alias("n_windows"), F.count_if(F.col("label") == "1").alias("n_positive"))


@book.query("a59_fold_mean_std", f"{P} SELECT {G}, count(*) AS n_folds, round(avg(auroc), 6) AS auroc_mean, round(stddev_samp(auroc), 6) AS auroc_std FROM {auroc_sql(F4)} GROUP BY ALL")
def a59(spark, d):
    return all_rounded(metrics.fold_spread(metrics.auroc(predictions(spark, d), FOLD), GROUP, ["auroc"]))


@book.query("a60_device_by_site", f"{SK}, u AS (SELECT DISTINCT device, subject FROM takes WHERE subject IS NOT NULL AND line = 1) SELECT site, " + ", ".join(f"count(*) FILTER (device = '{i}') AS device_{i}" for i in range(4)) + " FROM u JOIN subjects USING (subject) GROUP BY site")
def a60(spark, d):
    u = role(spark, d, "takes").filter("subject IS NOT NULL AND line = 1").select("device", "subject").distinct()
    t = u.join(subjects(spark, d).select("subject", "site"), "subject").groupBy("site").pivot("device", ["0", "1", "2", "3"]).count().fillna(0)
    return t.select("site", *[F.col(str(i)).alias(f"device_{i}") for i in range(4)])


@book.query("a61_frame_qc", f"{Z} SELECT recording, round(avg(valid), 6) AS detection_rate, round(avg(CAST(media = '' AS DOUBLE)), 6) AS no_face_rate, round(avg(pupil), 6) AS area_mean, round(stddev_pop(pupil), 6) AS area_sd, round(avg(CAST(pupil < 5 AS DOUBLE)), 6) AS small_rate, count(*) FILTER (valid = 1) >= 40 AS enough_frames FROM gaze GROUP BY recording")
def a61(spark, d):
    return all_rounded(gaze(spark, d).groupBy("recording").agg(F.avg("valid").alias("detection_rate"), F.avg((F.col("media") == "").cast("double")).alias("no_face_rate"), F.avg("pupil").alias("area_mean"), F.stddev_pop("pupil").alias("area_sd"), F.avg((F.col("pupil") < 5).cast("double")).alias("small_rate"), (F.count_if(F.col("valid") == 1) >= 40).alias("enough_frames")))


@book.query("p24_optical_density", f"WITH {SIGNAL}, v AS (SELECT recording, sample, greatest(value + 5, 1e-9) AS v FROM signal), b AS (SELECT recording, avg(v) FILTER (sample < 10) AS b, median(v) AS m FROM v GROUP BY 1) SELECT recording, sample, round(-ln(v / CASE WHEN b > 0 THEN b ELSE m END), 6) AS density FROM v JOIN b USING (recording)")
def p24(spark, d):
    from quillspan.operators.signals import optical_density

    return optical_density(signal(spark, d).withColumn("value", F.col("value") + 5), ["recording"], "sample", "value", 10).select("recording", "sample", F.round("density", 6).alias("density"))


def _path_sql(w):
    return f"greatest(3.0::DOUBLE * (223.3 + 0.05624 * power(age, 0.8493) - 5.723e-7 * power({w}, 3) + 0.001245 * power({w}, 2) - 0.9025 * {w}), 1e-9)"


@book.query(
    "p26_beer_lambert",
    f"""WITH {SIGNAL}, p AS (SELECT a.recording, a.sample, CAST(5 + a.recording % 16 AS DOUBLE) AS age, a.value AS d1, b.value AS d2 FROM signal a JOIN signal b ON a.recording = b.recording AND b.sample = a.sample + 32),
    n AS (SELECT recording, sample, d1 / {_path_sql(690.0)} AS n1, d2 / {_path_sql(830.0)} AS n2 FROM p)
    SELECT recording, sample, round((n1 * 693.04 - n2 * 2051.96) / (276.0 * 693.04 - 2051.96 * 974.0) * 1e6, 5) AS hbo, round((n2 * 276.0 - n1 * 974.0) / (276.0 * 693.04 - 2051.96 * 974.0) * 1e6, 5) AS hbr FROM n""",
)
def p26(spark, d):
    from quillspan.operators.signals import beer_lambert

    s = signal(spark, d)
    long = s.select("recording", (F.col("sample") % 32).alias("sample"), F.when(F.col("sample") < 32, 690).otherwise(830).alias("wavelength"), F.col("value").alias("density"))
    age = (5 + F.col("recording") % 16).cast("double")
    return all_rounded(beer_lambert(long, ["recording", "sample"], (690, 830), F.lit(30.0), age), 5)


HALVES = f"{T}, h AS (SELECT subject, stimulus AS feature, trial % 2 AS half, avg(rt_sec) AS v FROM trials WHERE rt_sec IS NOT NULL GROUP BY ALL), w AS (SELECT subject, feature, max(v) FILTER (half = 0) AS a, max(v) FILTER (half = 1) AS b FROM h GROUP BY ALL), c AS (SELECT feature, count(*) AS n, corr(a, b) AS r_half FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)"


@book.query("e25_split_half", f"{HALVES} SELECT feature, n, round(CASE WHEN n >= 20 THEN r_half END, 5) AS r_half, round(CASE WHEN n >= 20 THEN least(1, 2 * r_half / (1 + r_half)) END, 5) AS spearman_brown FROM c")
def e25(spark, d):
    h = trials(spark, d).filter("rt_sec IS NOT NULL").groupBy("subject", F.col("stimulus").alias("feature"), (F.col("trial") % 2).alias("half")).agg(F.avg("rt_sec").alias("v"))
    return rounded(resample.split_half(h, "subject", "feature", "half", "v"), "r_half", "spearman_brown", digits=5)


@book.query("e26_univariate_screen", f"{S}, v AS (SELECT unnest(['balance', 'n_flags']) AS feature, unnest([balance, CAST(has_eeg + has_face AS DOUBLE)]) AS probability, CAST(label AS INTEGER) AS label FROM subjects WHERE label <> '') SELECT feature, round(auroc, 6) AS auroc FROM {auroc_sql('feature', 'v')}")
def e26(spark, d):
    t = audit.labeled_only(subjects(spark, d)).select(F.col("label").cast("int").alias("label"), F.explode(F.array(F.struct(F.lit("balance").alias("feature"), F.col("balance").alias("probability")), F.struct(F.lit("n_flags").alias("feature"), (F.col("has_eeg") + F.col("has_face")).cast("double").alias("probability")))).alias("v")).select("label", "v.*")
    return rounded(metrics.auroc(t, ["feature"]), "auroc")


@book.query("e27_reliability_summary", f"{T}, c AS (SELECT stimulus AS feature, 'd' || subject % 3 AS device, avg(logged_correct) AS v FROM trials GROUP BY ALL), w AS (SELECT feature, max(v) FILTER (device = 'd0') AS d0, max(v) FILTER (device = 'd1') AS d1, max(v) FILTER (device = 'd2') AS d2, median(v) AS m, min(v) AS l FROM c GROUP BY 1) SELECT feature, round(d0, 6) AS d0, round(d1, 6) AS d1, round(d2, 6) AS d2, round(m, 6) AS median, l >= 0.3 AS reliable_on_all FROM w")
def e27(spark, d):
    c = trials(spark, d).groupBy(F.col("stimulus").alias("feature"), F.concat(F.lit("d"), (F.col("subject") % 3).cast("string")).alias("device")).agg(F.avg("logged_correct").alias("v"))
    return rounded(resample.reliability_summary(c, "feature", "device", "v", ["d0", "d1", "d2"], 0.3), "d0", "d1", "d2", "median")
