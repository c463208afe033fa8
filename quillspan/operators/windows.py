"""Window and sequence operators on event and sample tables.

Windows are partitioned by recording, subject or block; where a recording may be long, state is carried over its chunks (``scans``).  Where order decides, the order
ends in a unique column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.quantiles import median
from quillspan.operators.scans import carried, long_keys


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first k rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n")


def nback_condition(trials: DataFrame, keys: Sequence[str], order: Sequence[str], stimulus: str = "stimulus") -> DataFrame:
    """``condition``: block_initial for the first trial of a block, else match or non_match with the trial before."""
    before = F.lag(stimulus).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1
    return trials.withColumn("condition", F.when(first, "block_initial").when(F.col(stimulus) == before, "match").otherwise("non_match"))


def with_previous(trials: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``previous_<column>`` from the trial before in the same block."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return trials.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})


def after_outcome(trials: DataFrame, subject: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Per subject: mean reaction time after wins and losses, and how often the response is kept after a win or changed after a loss."""
    t = with_previous(trials, keys, order, ["feedback", "response"])
    both = (F.coalesce("response", F.lit("")) != "") & (F.coalesce("previous_response", F.lit("")) != "")
    stay = F.when(both, (F.col("response") == F.col("previous_response")).cast("double"))
    won, lost = F.col("previous_feedback") == "win", F.col("previous_feedback") == "loss"
    return t.groupBy(subject).agg(
        F.avg(F.when(won, F.col("rt_sec"))).alias("rt_after_win"), F.avg(F.when(lost, F.col("rt_sec"))).alias("rt_after_loss"),
        F.avg(F.when(won, stay)).alias("win_stay"), F.avg(F.when(lost, 1 - stay)).alias("lose_shift"), F.count(F.when(won, stay)).alias("n_win_pairs"),
    )


def block_change(blocks: DataFrame, subject: str, block: str, value: str) -> DataFrame:
    """Per subject over blocks: last minus first, second half minus first half (n // 2 blocks each), slope by block place if there are 3 or more."""
    w = Window.partitionBy(subject).orderBy(block)
    t = blocks.withColumn("_at", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(subject)))
    half = F.floor(F.col("_n") / 2)
    return t.groupBy(subject).agg(
        F.max("_n").alias("n_blocks"),
        (F.max_by(value, "_at") - F.min_by(value, "_at")).alias("last_minus_first"),
        (F.avg(F.when(F.col("_at") > F.col("_n") - half, F.col(value))) - F.avg(F.when(F.col("_at") <= half, F.col(value)))).alias("half_change"),
        F.when(F.max("_n") >= 3, F.regr_slope(value, "_at")).alias("slope"),
    )


def run_segments(samples: DataFrame, key: str, time: str, label: str, skip: Sequence[str] = ()) -> DataFrame:
    """Runs of one label; blank and skipped labels do not break a run."""
    kept = samples.filter((F.coalesce(label, F.lit("")) != "") & ~F.col(label).isin(*skip) if skip else F.coalesce(label, F.lit("")) != "")
    found = long_keys(kept, [key], time)
    marked = carried(kept, [key], [time], found, before={"_before": F.col(label)})
    marked = marked.withColumn("_new", F.coalesce((F.col(label) != F.col("_before")).cast("int"), F.lit(1)))
    runs = carried(marked, [key], [time], found, upto={"run": F.col("_new")})
    return runs.groupBy(key, "run", label).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n_samples"))


def gap_summary(samples: DataFrame, key: str, time: str, valid: Column, least_ms: float = 300) -> DataFrame:
    """Per recording: gaps (last minus first invalid time) of ``least_ms`` or more, their sum, and the longest of all."""
    islands = carried(samples.withColumn("_ok", valid.cast("int")), [key], [time], long_keys(samples, [key], time), upto={"_island": F.col("_ok")})
    gaps = islands.filter("_ok = 0").groupBy(key, "_island").agg((F.max(time) - F.min(time)).alias("_gap"))
    long = F.col("_gap") >= least_ms
    found = gaps.groupBy(key).agg(F.count_if(long).alias("n_gaps"), F.sum(F.when(long, F.col("_gap")).otherwise(0)).alias("gap_ms"), F.max("_gap").alias("longest_gap_ms"))
    return samples.select(key).distinct().join(found, key, "left").fillna(0, ["n_gaps", "gap_ms", "longest_gap_ms"])


def present_blocks(samples: DataFrame, key: str, time: str, present: Column, least_ms: float) -> DataFrame:
    """Runs where the target is there for ``least_ms`` or more, numbered from 1."""
    found = long_keys(samples, [key], time)
    marked = carried(samples.withColumn("_ok", present.cast("int")), [key], [time], found, upto={"_island": 1 - F.col("_ok")})
    runs = marked.filter("_ok = 1").groupBy(key, "_island").agg(F.min(time).alias("start"), F.max(time).alias("end")).filter(F.col("end") - F.col("start") >= least_ms)
    # the chunks of the samples serve their runs as well
    return carried(runs, [key], ["start"], found, upto={"block": F.lit(1)}).withColumn("block", F.col("block").cast("int")).drop("_island")


def fill_short_gaps(samples: DataFrame, key: str, time: str, value: str, longest: int) -> DataFrame:
    """Missing values inside a series filled on the line between their neighbours, if the run has at most ``longest`` samples."""
    found = long_keys(samples, [key], time)
    t = carried(samples, [key], [time], found, upto={"_at": F.lit(1).cast("long")})
    here = F.when(F.col(value).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(value).alias("v")))
    t = carried(t, [key], [time], found, last={"_b": here}, coming={"_a": here})
    run = F.col("_a.at") - F.col("_b.at") - 1
    line = F.col("_b.v") + (F.col("_a.v") - F.col("_b.v")) * (F.col("_at") - F.col("_b.at")) / (F.col("_a.at") - F.col("_b.at"))
    return t.withColumn("filled", F.coalesce(value, F.when(run <= longest, line))).drop("_at", "_a", "_b")


def clock_align(samples: DataFrame, key: str, time: str, duration: str) -> DataFrame:
    """Times stretched so that the recording's span fits its stated duration; unchanged where either is missing."""
    spans = samples.groupBy(key).agg((F.max(time) - F.min(time)).alias("_span"))
    scale = F.coalesce(F.when(F.col(duration) > 0, F.try_divide(F.col(duration).cast("double"), F.col("_span").cast("double"))), F.lit(1.0))
    return samples.join(spans, key, "left").withColumn("clock_scale", scale).withColumn("aligned_time", F.col(time) * F.col("clock_scale")).drop("_span")


def scanpath(fixations: DataFrame, key: str, start: str = "start") -> DataFrame:
    """Per recording: fixations, the length of the path between them, and the time of the first."""
    w = Window.partitionBy(key).orderBy(start)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return fixations.withColumn("_step", step).groupBy(key).agg(F.count("*").alias("n_fixations"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("scanpath"), F.min(start).alias("first_fixation"))


def trials_from_steps(steps: DataFrame, key: str, time: str, outward: Column) -> DataFrame:
    """Outward steps as trials, each lasting until the next inward step or the end of the track."""
    t = steps.withColumn("_out", outward)
    t = carried(t, [key], [time], long_keys(steps, [key], time), after={"offset": F.when(~F.col("_out"), F.col(time))})
    ends = steps.groupBy(key).agg(F.max(time).alias("_end"))
    return t.filter("_out").join(ends, key, "left").withColumn("offset", F.coalesce("offset", "_end")).drop("_out", "_end")


def block_windows(onsets: DataFrame, onset: str, blocks: int, length: float, baseline: float, recovery: float, end: Column | None = None) -> DataFrame:
    """Baseline, task and recovery intervals of ``blocks`` consecutive blocks after each onset; clamped to ``end``."""
    t = onsets.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    start = F.col(onset) + F.col("block") * length
    stop = start + length
    last = stop + recovery if end is None else F.least(stop + recovery, end)
    return t.withColumns({"baseline_start": F.greatest(start - baseline, F.lit(0.0)), "task_start": start, "task_end": stop if end is None else F.least(stop, end), "recovery_end": last})


def fixed_windows(samples: DataFrame, key: str, order: Sequence[str], length: int) -> DataFrame:
    """``window`` of ``length`` consecutive samples; a shorter tail is dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    t = samples.withColumn("window", F.floor((F.row_number().over(w) - 1) / length).cast("int"))
    return t.withColumn("_n", F.count("*").over(Window.partitionBy(key, "window"))).filter(F.col("_n") == length).drop("_n")


def reject_windows(samples: DataFrame, keys: Sequence[str], channel: str, value: str, most: float, least: int, ignored: Sequence[int] = ()) -> DataFrame:
    """Per recording: windows kept and dropped by peak-to-peak of any channel that counts, and why it is blocked."""
    ptp = samples.filter(~F.col(channel).isin(*ignored) if ignored else F.lit(True)).groupBy(*keys, "window", channel).agg((F.max(value) - F.min(value)).alias("_ptp"))
    windows = ptp.groupBy(*keys, "window").agg(F.bool_or(F.col("_ptp") > most).alias("_bad"))
    out = windows.groupBy(*keys).agg(F.count_if(~F.col("_bad")).alias("n_kept"), F.count_if("_bad").alias("n_rejected"))
    return out.withColumn("reason", F.when(F.col("n_kept") < least, "too_few_windows").otherwise(""))


def baseline_correct(samples: DataFrame, keys: Sequence[str], value: str, inside: Column) -> DataFrame:
    """Values minus the mean over the baseline samples of the same trial and channel."""
    return samples.withColumn("corrected", F.col(value) - F.avg(F.when(inside, F.col(value))).over(Window.partitionBy(*keys)))


def even_subsample(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k rows at evenly spaced places, int(linspace(0, n - 1, k)); all rows if there are k or fewer."""
    w = Window.partitionBy(*keys)
    t = rows.withColumns({"_at": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(1, k - 1)) + 1e-9))
    return t.filter((F.col("_n") <= k) | F.array_contains(places, F.col("_at").cast("long"))).drop("_at", "_n")


def standardize(samples: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """z-scores by window and channel (a spread below 1e-6 counts as 1), and robust ones by median and MAD."""
    stats = samples.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.median(value).alias("_med"))
    t = samples.join(stats, list(keys))
    mad = t.groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    t = t.join(mad, list(keys))
    wide = lambda s: F.when(s < 1e-6, 1.0).otherwise(s)
    return t.withColumns({"z": (F.col(value) - F.col("_m")) / wide(F.col("_s")), "robust_z": (F.col(value) - F.col("_med")) / wide(F.col("_mad") * 1.4826)}).drop("_m", "_s", "_med", "_mad")


def balanced_sample(rows: DataFrame, label: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """k rows of each class, the first in the order."""
    return top_k(rows, [label], order, k)


def quota_sample(rows: DataFrame, keys: Sequence[str], order: Column, unique: str, quota: int) -> DataFrame:
    """Exactly ``quota`` rows per group in hash order; groups that are too small repeat their rows in turn."""
    w = Window.partitionBy(*keys)
    t = rows.withColumns({"_at": F.row_number().over(w.orderBy(order, unique)) - 1, "_n": F.count("*").over(w)})
    draws = F.filter(F.sequence(F.lit(0), F.lit(quota - 1)), lambda d: d % F.col("_n") == F.col("_at"))
    return t.withColumn("draw", F.explode(draws)).drop("_at", "_n")


def balanced_negatives(rows: DataFrame, keys: Sequence[str], positive: Column, order: Column, unique: str) -> DataFrame:
    """All positives and as many negatives, those first in hash order."""
    t = rows.withColumn("_pos", positive)
    w = Window.partitionBy(*keys)
    t = t.withColumns({"_np": F.sum(F.col("_pos").cast("long")).over(w), "_at": F.row_number().over(Window.partitionBy(*keys, "_pos").orderBy(order, unique))})
    return t.filter(F.col("_pos") | (F.col("_at") <= F.col("_np"))).drop("_pos", "_np", "_at")


def largest_detection(frames: DataFrame, detections: DataFrame, frame: Sequence[str], area: Column, unique: str) -> DataFrame:
    """The largest box of each frame; frames without one stay, with NULLs."""
    best = top_k(detections.withColumn("area", area), frame, [F.desc("area"), unique], 1)
    return frames.join(best, list(frame), "left")


def segment_index(segments: DataFrame, subject: str, anchor: str, lead_in: str, length: float, limit: str) -> DataFrame:
    """Segment starts and ends relative to an anchor, with the cohort's median lead-in where a subject has none; beyond the end they are NULL, with a reason."""
    t = segments.withColumn("used_lead_in", F.coalesce(F.col(lead_in).cast("double"), F.lit(median(segments, lead_in)).cast("double")))
    start = F.col(anchor) + F.col("used_lead_in")
    inside = start + length <= F.col(limit)
    return t.withColumns({"segment_start": F.when(inside, start), "segment_end": F.when(inside, start + length),
                          "reason": F.concat_ws(";", F.when(F.col(lead_in).isNull(), "median_lead_in"), F.when(~inside, "beyond_end"))})
