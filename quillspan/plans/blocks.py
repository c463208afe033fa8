"""Queries of block, region, condition and spectral summaries, and of the sinks that write and read back."""

from __future__ import annotations


from pyspark.sql import functions as F

from quillspan.operators import blocks as B
from quillspan.operators import features as X
from quillspan.operators import metrics, signals
from quillspan.operators.features import hjorth
from quillspan.plans.base import Book
from quillspan.plans.cohort import HOUR, T, Z
from quillspan.plans.evaluation import FOLD, G, P, F4, auroc_sql
from quillspan.plans.features import SIGNAL, all_rounded, rounded, signal
from quillspan.plans.inputs import SACCADES, scored
from quillspan.sources.shared import scratch
from quillspan.sources import readers as R
from quillspan.sources.tables import predictions, role

book = Book()
QUERIES, SQL = book.queries, book.sql

BLOCKS = f"""WITH {SIGNAL}, b AS (SELECT condition, recording, avg(value) FILTER (sample < 16) AS base, avg(value) FILTER (sample BETWEEN 16 AND 47) AS m, max(value) FILTER (sample BETWEEN 16 AND 47) AS pk,
        sum(value) FILTER (sample BETWEEN 16 AND 47) AS s, avg(value) FILTER (sample >= 48) AS rec, count(*) FILTER (sample BETWEEN 16 AND 47) AS n FROM signal GROUP BY ALL),
    f AS (SELECT recording, min(sample) AS at_sample FROM signal JOIN b USING (recording) WHERE value = pk AND sample BETWEEN 16 AND 47 GROUP BY recording),
    r AS (SELECT condition, recording % 6 AS block, CASE WHEN recording % 2 = 0 THEN 'left' ELSE 'right' END AS region, m - base AS response, pk - base AS peak, (at_sample - 16) / 32.0::DOUBLE AS time_to_peak, s - base * n AS area, rec - base AS recovery FROM b JOIN f USING (recording)),
    k AS (SELECT condition, stddev_pop(m) AS c, arg_min(m, block) - arg_max(m, block) AS d FROM (SELECT condition, block, avg(response) AS m FROM r GROUP BY ALL) GROUP BY 1)"""


@book.query(
    "a28_block_summary",
    f"""{BLOCKS} SELECT condition, {', '.join(f'round(avg({n}), 5) AS {n}_mean' for n in ('response', 'peak', 'time_to_peak', 'area', 'recovery'))}, round(stddev_pop(response), 5) AS response_std, count(DISTINCT block) AS n_blocks,
        round(avg(response) FILTER (region = 'left'), 5) AS response_left, round(avg(response) FILTER (region = 'right'), 5) AS response_right,
        round(avg(response) FILTER (region = 'right') - avg(response) FILTER (region = 'left'), 5) AS lateralisation, round(max(k.c), 5) AS consistency_std, round(max(k.d), 5) AS first_minus_last FROM r JOIN k USING (condition) GROUP BY condition""",
)
def a28(spark, d):
    n = F.col("sample")
    rows = X.block_response(signal(spark, d), ["condition", "recording"], n < 16, n.between(16, 47), n >= 48, "value", (n - 16) / 32)
    rows = rows.withColumns({"block": F.col("recording") % 6, "region": F.when(F.col("recording") % 2 == 0, "left").otherwise("right")})
    return all_rounded(B.block_summary(rows, ["condition"], "block", "region"), 5)


@book.query(
    "a29_whole_recording_regions",
    f"""WITH {SIGNAL}, r AS (SELECT a.condition, a.sample AS p, b.sample AS q, corr(a.value, b.value) AS r FROM signal a JOIN signal b ON a.condition = b.condition AND a.recording = b.recording AND a.sample < b.sample GROUP BY ALL),
    c AS (SELECT condition, avg(r) AS m, stddev_pop(r) AS s FROM r GROUP BY condition)
    SELECT condition, round(max(m), 5) AS connectivity_mean, round(max(s), 5) AS connectivity_std, round(avg(value) FILTER (sample < 32), 5) AS mean_left, round(avg(value) FILTER (sample >= 32), 5) AS mean_right FROM signal JOIN c USING (condition) GROUP BY condition""",
)
def a29(spark, d):
    return all_rounded(B.whole_recording(signal(spark, d), "condition", "recording", "sample", "value", F.when(F.col("sample") < 32, "left").otherwise("right")), 5)


@book.query(
    "a30_line_noise",
    f"""WITH {SIGNAL}, s AS (SELECT *, value - lag(value) OVER (PARTITION BY condition, sample ORDER BY recording) AS step FROM signal), c AS (SELECT condition, sample, stddev_pop(step) / (stddev_pop(value) + 1e-12) AS r FROM s GROUP BY ALL)
    SELECT condition, round(avg(r), 6) AS line_noise FROM c GROUP BY condition""",
)
def a30(spark, d):
    return all_rounded(B.line_noise(signal(spark, d), "condition", "sample", "recording", "value"))


@book.query(
    "w14_saccade_dynamics",
    f"""{SACCADES}, n AS (SELECT s.recording, s.onset, g.time_ms, g.x FROM scored s JOIN gaze g ON g.recording = s.recording AND g.x IS NOT NULL AND g.time_ms BETWEEN s.onset + s.latency - {10 * HOUR} AND s.onset + s.latency + {10 * HOUR}),
    v AS (SELECT *, abs((x - lag(x) OVER w) / nullif((time_ms - lag(time_ms) OVER w) / {HOUR}.0::DOUBLE, 0)) AS v FROM n WINDOW w AS (PARTITION BY recording, onset ORDER BY time_ms))
    SELECT recording, onset, round(CASE WHEN count(*) >= 3 THEN max(v) END, 6) AS peak_velocity, count(*) AS n_near FROM v GROUP BY ALL""",
)
def w14(spark, d):
    return rounded(B.saccade_dynamics(role(spark, d, "gaze"), scored(spark, d), "recording", "time_ms", 10 * HOUR, float(HOUR)), "peak_velocity")


SPLIT = f"{SACCADES}, q AS (SELECT *, CASE WHEN CAST(onset // {HOUR} AS BIGINT) % 3 = 0 THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END AS size, CASE WHEN CAST(onset // {HOUR} AS BIGINT) % 2 = 0 THEN 'anti' ELSE 'pro' END AS task FROM scored)"


def _rates(where):
    return f"avg(CAST(NOT correct AS DOUBLE)) FILTER ({where} AND latency IS NOT NULL)", f"median(latency) FILTER ({where} AND correct)"


@book.query(
    "a40_saccade_splits",
    f"""{SPLIT} SELECT recording, {', '.join(f'round({_rates(w)[0]}, 6) AS {n}_error_rate, round({_rates(w)[1]}, 6) AS {n}_latency_median' for n, w in (('small', 'size < 0.2'), ('large', 'size >= 0.2')))},
        round({_rates("task = 'anti'")[0]} - {_rates("task = 'pro'")[0]}, 6) AS contrast_error_rate, round({_rates("task = 'anti'")[1]} - {_rates("task = 'pro'")[1]}, 6) AS contrast_latency_median FROM q GROUP BY recording""",
)
def a40(spark, d):
    hour = F.floor(F.col("onset") / HOUR)
    t = scored(spark, d).withColumns({"amplitude": F.when(hour % 3 == 0, 0.1).otherwise(0.3), "task": F.when(hour % 2 == 0, "anti").otherwise("pro")})
    return all_rounded(B.saccade_splits(t, ["recording"], "task"))


FOLLOW = f"{Z}, p AS (SELECT recording, time_ms, x, y, (sample * 41 % 97) / 96.0::DOUBLE AS tx, (sample * 29 % 89) / 88.0::DOUBLE AS ty, CASE sample % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'slow' ELSE 'sweep' END AS condition, CAST(sample // 3 AS BIGINT) % 2 AS block FROM gaze)"


def follow(spark, d):
    n = F.col("sample")
    return role(spark, d, "gaze").select(
        "recording", "time_ms", "x", "y", ((n * 41 % 97) / 96.0).alias("tx"), ((n * 29 % 89) / 88.0).alias("ty"),
        F.when(n % 3 == 0, "fast").when(n % 3 == 1, "slow").otherwise("sweep").alias("condition"), (F.floor(n / 3) % 2).alias("block"),
    )


@book.query(
    "a41_pursuit_conditions",
    f"""{FOLLOW}, b AS (SELECT recording, condition, block, corr(x, tx) AS corr_x, corr(y, ty) AS corr_y, regr_slope(x, tx) AS gain_x, regr_slope(y, ty) AS gain_y, sqrt(avg(power(x - tx, 2) + power(y - ty, 2))) AS rmse
        FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 5 AND max(time_ms) - min(time_ms) >= 5000),
    c AS (SELECT recording, condition, {', '.join(f'avg({m}) AS {m}' for m in B.PURSUIT)}, count(*) AS n_blocks, CASE WHEN count(*) = 2 THEN abs(max(corr_x) - min(corr_x)) END AS corr_x_repeat_diff FROM b GROUP BY ALL),
    k AS (SELECT recording, {', '.join(f"max({m}) FILTER (condition = 'fast') - max({m}) FILTER (condition = 'slow') AS fast_minus_slow_{m}" for m in B.PURSUIT)} FROM c GROUP BY recording)
    SELECT recording, condition, {', '.join(f'round({m}, 5) AS {m}' for m in B.PURSUIT)}, n_blocks, round(corr_x_repeat_diff, 5) AS corr_x_repeat_diff, {', '.join(f'round(fast_minus_slow_{m}, 5) AS fast_minus_slow_{m}' for m in B.PURSUIT)} FROM c JOIN k USING (recording)""",
)
def a41(spark, d):
    return all_rounded(B.pursuit_conditions(follow(spark, d), "recording", "condition", "block", "time_ms", 5, 5000, "fast", "slow"), 5)


@book.query("a42_target_following", f"{FOLLOW} SELECT recording, count(x) AS n, round(CASE WHEN count(x) >= 10 THEN corr(x, tx) END, 5) AS corr FROM p GROUP BY recording")
def a42(spark, d):
    return all_rounded(B.target_following(follow(spark, d), ["recording"]), 5)


WINDOWS, VALENCES = ("early", "late"), ("view", "click", "signup")


@book.query(
    "a38_viewing_windows",
    f"""{T}, v AS (SELECT *, CASE WHEN block < 3 THEN 'early' ELSE 'late' END AS win FROM trials),
    m AS (SELECT subject, {', '.join(f"avg(rt_sec) FILTER (win = '{w}' AND stimulus = '{v}') AS {w}_{v}_mean, stddev_samp(rt_sec) FILTER (win = '{w}' AND stimulus = '{v}') AS {w}_{v}_sd" for w in WINDOWS for v in VALENCES)},
        {', '.join(f"1000 * CASE WHEN count(rt_sec) FILTER (win = '{w}') >= 3 THEN regr_slope(rt_sec, trial) FILTER (win = '{w}') END AS {w}_trend" for w in WINDOWS)} FROM v GROUP BY subject)
    SELECT subject, {', '.join(f'round({w}_{v}_{s}, 9) AS {w}_{v}_{s}' for w in WINDOWS for v in VALENCES for s in ('mean', 'sd'))}, {', '.join(f'round({w}_trend, 5) AS {w}_trend' for w in WINDOWS)},
        {', '.join(f'round({w}_{v}_mean - {w}_view_mean, 9) AS {w}_contrast_{v}' for w in WINDOWS for v in VALENCES[1:])} FROM m""",
)
def a38(spark, d):
    t = role(spark, d, "trials").withColumn("win", F.when(F.col("block") < 3, "early").otherwise("late"))
    out = B.viewing_windows(t, "subject", "stimulus", "rt_sec", "win", "trial", WINDOWS, VALENCES)
    # means of few values with few digits end in a 5, so nine places of them are kept
    return all_rounded(out.withColumns({f"{w}_trend": F.round(F.col(f"{w}_trend") * 1000, 5) for w in WINDOWS}), 9)


def regions(bands):
    """Spectra by condition; a recording is a channel, of the left or the right side."""
    return bands.withColumn("region", F.when(F.col("recording") % 2 == 0, "left").otherwise("right"))


@book.query("a54_spectral_regions")
def a54(spark, d):
    density = signals.welch(signal(spark, d), ["condition", "recording"], "sample", "value", 64.0, 32)
    return all_rounded(B.spectral_regions(regions(B.band_table(density, ["condition", "recording"])), ["condition"], "region"), 5)


@book.query("a55_rest_summary")
def a55(spark, d):
    """Spectra averaged over windows, with asymmetries, Hjorth measures and connectivity."""
    s = signal(spark, d)
    keys = ["condition", "recording"]
    density = signals.welch(s.withColumn("window", F.floor(F.col("sample") / 32).cast("int")), [*keys, "window"], "sample", "value", 64.0, 16)
    density = density.groupBy(*keys, "frequency").agg(F.avg("power").alias("power"))
    spectra = B.spectral_regions(regions(B.band_table(density, keys)), ["condition"], "region")
    shape = hjorth(s, keys, "value", "sample").groupBy("condition").agg(F.avg(F.log10("activity")).alias("activity"), F.avg("mobility").alias("mobility"), F.avg("complexity").alias("complexity"))
    pairs = X.connectivity(s, "condition", "recording", "sample", "value").select("condition", F.col("mean").alias("connectivity_mean"), F.col("std").alias("connectivity_std"))
    return all_rounded(spectra.join(shape, "condition").join(pairs, "condition"), 5)


def fold_table(spark, d):
    return metrics.auroc(predictions(spark, d), FOLD).withColumn("auroc", F.round("auroc", 6))


@book.query("s11_read_jobs", f"{P} SELECT cv_protocol, feature_set, CAST(seed AS VARCHAR) AS seed, CAST(outer_fold AS VARCHAR) AS outer_fold, CASE WHEN feature_set = 'signal' THEN '' ELSE 'd' || seed END AS device, CAST(count(*) AS VARCHAR) AS n FROM predictions GROUP BY ALL")
def s11(spark, d):
    jobs = predictions(spark, d).groupBy(*FOLD).agg(F.count("*").alias("n"))
    jobs = jobs.select("cv_protocol", "feature_set", "seed", "outer_fold", F.when(F.col("feature_set") != "signal", F.concat(F.lit("d"), F.col("seed").cast("string"))).alias("device"), "n")
    root = scratch(spark, "jobs")
    for name in ("signal", "signal_qc"):
        jobs.filter(F.col("feature_set") == name).write.option("header", True).csv(f"{root}/{name}")
    return R.read_jobs(spark, root)


@book.query("s13_write_result", f"{P} SELECT {F4}, round(auroc, 6) AS auroc FROM {auroc_sql(F4)}")
def s13(spark, d):
    path = scratch(spark, "result")
    R.write_result(fold_table(spark, d), path)
    return spark.read.parquet(path)


@book.query(
    "s14_write_union",
    f"""{P}, f AS (SELECT {F4}, round(auroc, 6) AS auroc FROM {auroc_sql(F4)}), g AS (SELECT {G}, count(*) AS n FROM predictions GROUP BY ALL)
    SELECT cv_protocol, feature_set, CAST(seed AS VARCHAR) AS seed, CAST(outer_fold AS VARCHAR) AS outer_fold, auroc, '' AS n FROM f
    UNION ALL SELECT cv_protocol, feature_set, CAST(seed AS VARCHAR), '', NULL, CAST(n AS VARCHAR) FROM g""",
)
def s14(spark, d):
    path = scratch(spark, "union")
    R.write_union([fold_table(spark, d), predictions(spark, d).groupBy("cv_protocol", "feature_set", "seed").agg(F.count("*").alias("n"))], path)
    t = spark.read.option("header", True).csv(path).fillna("")
    return t.withColumn("auroc", F.col("auroc").try_cast("double"))
