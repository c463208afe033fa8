"""Queries of the window and sequence operators on the event roles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.clean import stable_number
from quillspan.operators import windows as W
from quillspan.plans.base import Book
from quillspan.sources.tables import role, role_sql, table

book = Book()
QUERIES, SQL = book.queries, book.sql
T, Z, K = (f"WITH {role_sql(n)}" for n in ("trials", "gaze", "takes"))
BLOCK, ORDER = ["subject", "block"], ["onset_sec", "trial"]
O = "PARTITION BY subject, block ORDER BY onset_sec, trial"


def trials(spark, sf_dir):
    return role(spark, sf_dir, "trials")


def gaze(spark, sf_dir):
    return role(spark, sf_dir, "gaze")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@book.query("w01_nback_condition", f"{T} SELECT trial, CASE WHEN row_number() OVER ({O}) = 1 THEN 'block_initial' WHEN stimulus = lag(stimulus) OVER ({O}) THEN 'match' ELSE 'non_match' END AS condition FROM trials")
def w01(spark, sf_dir):
    return W.nback_condition(trials(spark, sf_dir), BLOCK, ORDER).select("trial", "condition")


AFTER = f"""{T}, p AS (SELECT *, lag(feedback) OVER ({O}) AS pf, lag(response) OVER ({O}) AS pr FROM trials),
    q AS (SELECT *, CASE WHEN response <> '' AND pr <> '' THEN CAST(response = pr AS DOUBLE) END AS stay FROM p)"""


@book.query(
    "w02_after_outcome",
    f"""{AFTER} SELECT subject, round(avg(rt_sec) FILTER (pf = 'win'), 6) AS rt_after_win, round(avg(rt_sec) FILTER (pf = 'loss'), 6) AS rt_after_loss,
        round(avg(stay) FILTER (pf = 'win'), 6) AS win_stay, round(avg(1 - stay) FILTER (pf = 'loss'), 6) AS lose_shift, count(stay) FILTER (pf = 'win') AS n_win_pairs FROM q GROUP BY subject""",
)
def w02(spark, sf_dir):
    return rounded(W.after_outcome(trials(spark, sf_dir), "subject", BLOCK, ORDER), "rt_after_win", "rt_after_loss", "win_stay", "lose_shift")


@book.query(
    "w03_block_change",
    f"""{T}, b AS (SELECT subject, block, avg(rt_sec) AS rt FROM trials GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY block) AS k, count(*) OVER (PARTITION BY subject) AS n FROM b)
    SELECT subject, max(n) AS n_blocks, round(max(rt) FILTER (k = n) - max(rt) FILTER (k = 1), 6) AS last_minus_first,
        round(avg(rt) FILTER (k > n - n // 2) - avg(rt) FILTER (k <= n // 2), 6) AS half_change, round(CASE WHEN max(n) >= 3 THEN regr_slope(rt, k) END, 6) AS slope FROM r GROUP BY subject""",
)
def w03(spark, sf_dir):
    blocks = trials(spark, sf_dir).groupBy("subject", "block").agg(F.avg("rt_sec").alias("rt"))
    return rounded(W.block_change(blocks, "subject", "block", "rt"), "last_minus_first", "half_change", "slope")


RUNS = f"""{Z}, k AS (SELECT * FROM gaze WHERE media <> '' AND media <> 'b'), m AS (SELECT *, coalesce(CAST(media <> lag(media) OVER (PARTITION BY recording ORDER BY time_ms, sample) AS INT), 1) AS fresh FROM k),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY recording ORDER BY time_ms, sample) AS run FROM m)"""


@book.query("w04_run_segments", f"{RUNS} SELECT recording, CAST(run AS BIGINT) AS run, media, min(time_ms) AS start, max(time_ms) AS \"end\", count(*) AS n_samples FROM r GROUP BY recording, run, media")
def w04(spark, sf_dir):
    return W.run_segments(gaze(spark, sf_dir), "recording", "time_ms", "media", skip=("b",))


HOUR = 3600 * 1000
ISLANDS = f"{Z}, m AS (SELECT *, sum(valid) OVER (PARTITION BY recording ORDER BY time_ms) AS island FROM gaze), g AS (SELECT recording, island, max(time_ms) - min(time_ms) AS gap FROM m WHERE valid = 0 GROUP BY ALL)"


@book.query(
    "w05_gap_summary",
    f"""{ISLANDS}, f AS (SELECT recording, count(*) FILTER (gap >= {HOUR}) AS n_gaps, CAST(coalesce(sum(gap) FILTER (gap >= {HOUR}), 0) AS BIGINT) AS gap_ms, max(gap) AS longest_gap_ms FROM g GROUP BY recording)
    SELECT recording, coalesce(n_gaps, 0) AS n_gaps, coalesce(gap_ms, 0) AS gap_ms, coalesce(longest_gap_ms, 0) AS longest_gap_ms FROM (SELECT DISTINCT recording FROM gaze) LEFT JOIN f USING (recording)""",
)
def w05(spark, sf_dir):
    return W.gap_summary(gaze(spark, sf_dir), "recording", "time_ms", F.col("valid") == 1, HOUR)


@book.query(
    "w06_present_blocks",
    f"""{Z}, m AS (SELECT *, sum(1 - valid) OVER (PARTITION BY recording ORDER BY time_ms) AS island FROM gaze),
    r AS (SELECT recording, min(time_ms) AS start, max(time_ms) AS "end" FROM m WHERE valid = 1 GROUP BY recording, island)
    SELECT recording, start, "end", CAST(row_number() OVER (PARTITION BY recording ORDER BY start) AS INTEGER) AS block FROM r WHERE "end" - start >= {10 * HOUR}""",
)
def w06(spark, sf_dir):
    return W.present_blocks(gaze(spark, sf_dir), "recording", "time_ms", F.col("valid") == 1, 10 * HOUR)


@book.query(
    "w07_fill_short_gaps",
    f"""{Z}, a AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY time_ms) AS k FROM gaze),
    b AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN k END) OVER (PARTITION BY recording ORDER BY k) AS kb,
        min(CASE WHEN x IS NOT NULL THEN k END) OVER (PARTITION BY recording ORDER BY k DESC) AS ka FROM a)
    SELECT b.sample, round(coalesce(b.x, CASE WHEN b.ka - b.kb - 1 <= 1 THEN l.x + (r.x - l.x) * (b.k - b.kb) / (b.ka - b.kb) END), 6) AS filled
    FROM b LEFT JOIN a l ON l.recording = b.recording AND l.k = b.kb LEFT JOIN a r ON r.recording = b.recording AND r.k = b.ka""",
)
def w07(spark, sf_dir):
    return rounded(W.fill_short_gaps(gaze(spark, sf_dir), "recording", "time_ms", "x", 1).select("sample", "filled"), "filled")


@book.query(
    "w08_resolve_duplicates",
    f"""{K} SELECT path, subject, CASE WHEN subject IS NOT NULL THEN CAST(row_number() OVER w AS INTEGER) END AS take_rank, CASE WHEN subject IS NOT NULL THEN first_value(path) OVER w END AS kept_path,
        CASE WHEN subject IS NULL THEN 'missing_key' WHEN row_number() OVER w > 1 THEN 'duplicate_take' END AS reason FROM takes
    WINDOW w AS (PARTITION BY device, task, subject ORDER BY complete DESC, n_segments DESC, duration DESC, size DESC, stamp DESC, line DESC)""",
)
def w08(spark, sf_dir):
    from quillspan.operators.audit import resolve_duplicates

    order = [F.desc(c) for c in ("complete", "n_segments", "duration", "size", "stamp", "line")]
    return resolve_duplicates(role(spark, sf_dir, "takes"), ["device", "task", "subject"], order).select("path", "subject", "take_rank", "kept_path", "reason")


@book.query(
    "w09_clock_align",
    f"""{Z}, s AS (SELECT *, CASE WHEN recording % 3 > 0 THEN 2500000000 END AS duration, max(time_ms) OVER w - min(time_ms) OVER w AS span FROM gaze WINDOW w AS (PARTITION BY recording))
    SELECT sample, round(coalesce(duration / nullif(span, 0), 1.0), 6) AS clock_scale, round(time_ms * coalesce(duration / nullif(span, 0), 1.0), 3) AS aligned_time FROM s""",
)
def w09(spark, sf_dir):
    rows = gaze(spark, sf_dir).withColumn("duration", F.when(F.col("recording") % 3 > 0, 2500000000))
    return W.clock_align(rows, "recording", "time_ms", "duration").select("sample", F.round("clock_scale", 6).alias("clock_scale"), F.round("aligned_time", 3).alias("aligned_time"))


@book.query(
    "w11_scanpath",
    f"""{Z}, f AS (SELECT recording, time_ms AS start, x, y FROM gaze WHERE valid = 1), s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS d FROM f WINDOW w AS (PARTITION BY recording ORDER BY start))
    SELECT recording, count(*) AS n_fixations, round(coalesce(sum(d), 0), 6) AS scanpath, min(start) AS first_fixation FROM s GROUP BY recording""",
)
def w11(spark, sf_dir):
    return rounded(W.scanpath(gaze(spark, sf_dir).filter("valid = 1").withColumnRenamed("time_ms", "start"), "recording"), "scanpath")


@book.query(
    "w13_trials_from_steps",
    f"""{Z}, s AS (SELECT sample, recording, time_ms, media = 'a' AS out FROM gaze WHERE media IN ('a', 'b')),
    t AS (SELECT *, min(CASE WHEN NOT out THEN time_ms END) OVER (PARTITION BY recording ORDER BY time_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, max(time_ms) OVER (PARTITION BY recording) AS last FROM s)
    SELECT sample, recording, time_ms, coalesce(nxt, last) AS "offset" FROM t WHERE out""",
)
def w13(spark, sf_dir):
    steps = gaze(spark, sf_dir).filter("media IN ('a', 'b')").select("sample", "recording", "time_ms", "media")
    return W.trials_from_steps(steps, "recording", "time_ms", F.col("media") == "a").drop("media")


@book.query(
    "w16_block_windows",
    f"""{T} SELECT trial, CAST(b AS INTEGER) AS block_no, greatest(onset_sec + b * 15 - 5, 0) AS baseline_start, onset_sec + b * 15 AS task_start, least(onset_sec + b * 15 + 15, 2000000) AS task_end, least(onset_sec + b * 15 + 25, 2000000) AS recovery_end
    FROM trials, range(0, 4) r(b) WHERE stimulus = 'click'""",
)
def w16(spark, sf_dir):
    onsets = trials(spark, sf_dir).filter("stimulus = 'click'").select("trial", "onset_sec")
    found = W.block_windows(onsets, "onset_sec", 4, 15.0, 5.0, 10.0, F.lit(2000000.0))
    return found.select("trial", F.col("block").alias("block_no"), "baseline_start", "task_start", "task_end", "recovery_end")


WINDOWED = f"{Z}, k AS (SELECT *, CAST((row_number() OVER (PARTITION BY recording ORDER BY time_ms, sample) - 1) // 10 AS INTEGER) AS win FROM gaze), f AS (SELECT * FROM k QUALIFY count(*) OVER (PARTITION BY recording, win) = 10)"


@book.query("w17_fixed_windows", f'{WINDOWED} SELECT sample, recording, win AS "window" FROM f')
def w17(spark, sf_dir):
    return W.fixed_windows(gaze(spark, sf_dir), "recording", ["time_ms", "sample"], 10).select("sample", "recording", "window")


@book.query(
    "w18_reject_windows",
    f"""{WINDOWED}, l AS (SELECT recording, win, unnest([0, 1]) AS channel, unnest([pupil, 100 * x]) AS v FROM f), p AS (SELECT recording, win, channel, max(v) - min(v) AS ptp FROM l GROUP BY ALL),
    b AS (SELECT recording, win, bool_or(ptp > 40) AS bad FROM p WHERE channel <> 1 GROUP BY ALL), c AS (SELECT recording, count(*) FILTER (NOT bad) AS n_kept, count(*) FILTER (bad) AS n_rejected FROM b GROUP BY recording)
    SELECT recording, n_kept, n_rejected, CASE WHEN n_kept < 3 THEN 'too_few_windows' ELSE '' END AS reason FROM c""",
)
def w18(spark, sf_dir):
    w = W.fixed_windows(gaze(spark, sf_dir), "recording", ["time_ms", "sample"], 10)
    long = w.select("recording", "window", F.posexplode(F.array("pupil", 100 * F.col("x"))).alias("channel", "v"))
    return W.reject_windows(long, ["recording"], "channel", "v", 40, 3, ignored=(1,))


@book.query("w19_baseline_correct", f"{T} SELECT trial, round(rt_sec - avg(CASE WHEN target = 0 THEN rt_sec END) OVER (PARTITION BY subject, block), 9) AS corrected FROM trials")
def w19(spark, sf_dir):
    # means of few values with few digits end in a 5 at the seventh place, so nine places are kept
    return W.baseline_correct(trials(spark, sf_dir), BLOCK, "rt_sec", F.col("target") == 0).select("trial", F.round("corrected", 9).alias("corrected"))


@book.query(
    "w20_even_subsample",
    f"""{T}, k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY onset_sec, trial) - 1 AS a, count(*) OVER (PARTITION BY subject) AS n FROM trials)
    SELECT subject, trial FROM k WHERE n <= 5 OR a IN (SELECT CAST(floor(i * (n - 1) / 4 + 1e-9) AS BIGINT) FROM range(0, 5) r(i))""",
)
def w20(spark, sf_dir):
    return W.even_subsample(trials(spark, sf_dir), ["subject"], ORDER, 5).select("subject", "trial")


@book.query(
    "w21_standardize",
    f"""{T}, s AS (SELECT subject, stimulus, avg(rt_sec) AS m, stddev_pop(rt_sec) AS sd, median(rt_sec) AS med FROM trials WHERE rt_sec IS NOT NULL GROUP BY ALL),
    d AS (SELECT t.subject, t.stimulus, median(abs(rt_sec - med)) AS mad FROM trials t JOIN s USING (subject, stimulus) WHERE rt_sec IS NOT NULL GROUP BY ALL)
    SELECT trial, round((rt_sec - m) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END, 5) AS z, round((rt_sec - med) / CASE WHEN mad * 1.4826 < 1e-6 THEN 1 ELSE mad * 1.4826 END, 5) AS robust_z
    FROM trials JOIN s USING (subject, stimulus) JOIN d USING (subject, stimulus) WHERE rt_sec IS NOT NULL""",
)
def w21(spark, sf_dir):
    rows = trials(spark, sf_dir).filter("rt_sec IS NOT NULL")
    return W.standardize(rows, ["subject", "stimulus"], "rt_sec").select("trial", F.round("z", 5).alias("z"), F.round("robust_z", 5).alias("robust_z"))


@book.query("w22_top_k_per_group", f"{T} SELECT subject, trial, rt_sec FROM trials WHERE rt_sec IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject ORDER BY rt_sec DESC, trial) <= 5")
def w22(spark, sf_dir):
    return W.top_k(trials(spark, sf_dir).filter("rt_sec IS NOT NULL"), ["subject"], [F.desc("rt_sec"), "trial"], 5).select("subject", "trial", "rt_sec")


@book.query("w23_balanced_sample", f"WITH {role_sql('subjects')} SELECT subject, label FROM subjects WHERE label <> '' QUALIFY row_number() OVER (PARTITION BY label ORDER BY sha1('7:' || subject), subject) <= 50")
def w23(spark, sf_dir):
    rows = role(spark, sf_dir, "subjects").filter("label <> ''")
    return W.balanced_sample(rows, "label", [F.sha1(F.concat(F.lit("7:"), F.col("subject").cast("string"))), "subject"], 50).select("subject", "label")


HASH = "CAST(('0x' || substr(sha1('3|' || trial), 1, 8)) AS BIGINT)"


@book.query(
    "w24_quota_sample",
    f"""{T}, k AS (SELECT *, row_number() OVER (PARTITION BY subject, target ORDER BY {HASH}, trial) - 1 AS a, count(*) OVER (PARTITION BY subject, target) AS n FROM trials)
    SELECT subject, target, trial, CAST(d AS INTEGER) AS draw FROM k, range(0, 25) r(d) WHERE d % n = a""",
)
def w24(spark, sf_dir):
    return W.quota_sample(trials(spark, sf_dir), ["subject", "target"], stable_number(3, F.col("trial")), "trial", 25).select("subject", "target", "trial", "draw")


@book.query(
    "w25_balanced_negatives",
    f"""{T}, k AS (SELECT *, sum(CAST(stimulus = 'purchase' AS INT)) OVER (PARTITION BY subject) AS np, row_number() OVER (PARTITION BY subject, stimulus = 'purchase' ORDER BY {HASH}, trial) AS a FROM trials)
    SELECT subject, trial, stimulus FROM k WHERE stimulus = 'purchase' OR a <= np""",
)
def w25(spark, sf_dir):
    return W.balanced_negatives(trials(spark, sf_dir), ["subject"], F.col("stimulus") == "purchase", stable_number(3, F.col("trial")), "trial").select("subject", "trial", "stimulus")


@book.query(
    "w26_segment_index",
    f"""WITH {role_sql('subjects')}, s AS (SELECT subject, (subject % 100) * 1.0::DOUBLE AS anchor, CASE WHEN subject % 4 > 0 THEN balance / 1000 END AS lead FROM subjects),
    u AS (SELECT *, coalesce(lead, (SELECT median(lead) FROM s)) AS used FROM s)
    SELECT subject, round(used, 6) AS used_lead_in, CASE WHEN anchor + used + 10 <= 90 THEN round(anchor + used, 6) END AS segment_start, CASE WHEN anchor + used + 10 <= 90 THEN round(anchor + used + 10, 6) END AS segment_end,
        concat_ws(';', CASE WHEN lead IS NULL THEN 'median_lead_in' END, CASE WHEN anchor + used + 10 > 90 THEN 'beyond_end' END) AS reason FROM u""",
)
def w26(spark, sf_dir):
    rows = role(spark, sf_dir, "subjects").select("subject", (F.col("subject") % 100).cast("double").alias("anchor"), F.when(F.col("subject") % 4 > 0, F.col("balance") / 1000).alias("lead"), F.lit(90.0).alias("limit"))
    found = W.segment_index(rows, "subject", "anchor", "lead", 10.0, "limit")
    return rounded(found.select("subject", "used_lead_in", "segment_start", "segment_end", "reason"), "used_lead_in", "segment_start", "segment_end")


@book.query(
    "w27_largest_detection",
    f"""{Z}, fr AS (SELECT DISTINCT recording, CAST(floor(time_ms / {HOUR}) AS BIGINT) AS frame FROM gaze), d AS (SELECT recording, CAST(floor(time_ms / {HOUR}) AS BIGINT) AS frame, sample, pupil * (1 + sample % 7) AS area FROM gaze WHERE valid = 1)
    SELECT fr.recording, fr.frame, b.sample, round(b.area, 6) AS area FROM fr LEFT JOIN (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY recording, frame ORDER BY area DESC, sample) = 1) b USING (recording, frame)""",
)
def w27(spark, sf_dir):
    rows = gaze(spark, sf_dir).withColumn("frame", F.floor(F.col("time_ms") / HOUR))
    frames = rows.select("recording", "frame").distinct()
    found = W.largest_detection(frames, rows.filter("valid = 1").select("recording", "frame", "sample", "pupil"), ["recording", "frame"], F.col("pupil") * (1 + F.col("sample") % 7), "sample")
    return rounded(found.select("recording", "frame", "sample", "area"), "area")
