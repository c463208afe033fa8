"""Joins of the cohort and event model.

Interval joins use an equi key (recording and a time bucket), so they never become nested loops;
as-of and next-match joins are one window over the union of both sides.  Dimension tables
are joined plainly: Spark broadcasts the ones that are small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.scans import carried, long_keys


def combine_signal_qc(split: DataFrame, signal: DataFrame, qc: DataFrame, key: str, label: str = "label") -> DataFrame:
    return split.join(signal, key).join(qc, key).withColumn(label, F.col(label).try_cast("int"))


def join_availability(split: DataFrame, parts: Sequence[DataFrame], key: str, defaults: dict[str, object]) -> DataFrame:
    """Left joins, with a default where a subject has no row."""
    return reduce(lambda a, b: a.join(b, key, "left"), parts, split).fillna(defaults)


def intersection_cohort(frames: Sequence[DataFrame], key: str) -> list[DataFrame]:
    """Each frame restricted to the ids that all have."""
    ids = reduce(lambda a, b: a.intersect(b), [f.select(key) for f in frames])
    return [f.join(ids, key, "left_semi") for f in frames]


def restrict_to(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def reconcile(found: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """One row: ids on both sides, only found, only flagged."""
    a = found.select(key).distinct().withColumn("_f", F.lit(1))
    b = flagged.select(key).distinct().withColumn("_g", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("both"), F.count_if(F.col("_g").isNull()).alias("found_not_flagged"), F.count_if(F.col("_f").isNull()).alias("flagged_not_found")
    )


def attach_subjects(rows: DataFrame, split: DataFrame, key: str) -> DataFrame:
    return rows.join(split.withColumn("_there", F.lit(True)), key, "left").withColumn("in_manifest", F.coalesce("_there", F.lit(False))).drop("_there")


def name_map_join(dirs: DataFrame, names: DataFrame, name: str, key: str) -> DataFrame:
    """Per name: the subjects it may stand for, and whether it is matched or ambiguous."""
    joined = dirs.select(name).distinct().join(names.select(name, key).distinct(), name, "left")
    return joined.groupBy(name).agg(F.count_distinct(key).alias("n_subjects")).withColumn("status", F.when(F.col("n_subjects") == 0, "unmatched").when(F.col("n_subjects") == 1, "matched").otherwise("ambiguous"))


def with_protocol(dataset: DataFrame, protocols: dict[str, DataFrame], key: str, fold: str = "outer_fold") -> DataFrame:
    """The dataset once per protocol, with its fold; rows without a fold are left out."""
    folds = [p.select(key, F.col(fold).alias("outer_fold")).withColumn("cv_protocol", F.lit(name)) for name, p in protocols.items()]
    return dataset.join(reduce(DataFrame.unionByName, folds).filter("outer_fold IS NOT NULL"), key)


def attach_comparator(paired: DataFrame, pooled: DataFrame, keys: Sequence[str], auroc: str = "comparator_auroc") -> DataFrame:
    return paired.join(pooled, list(keys), "left").withColumn("above_chance", F.coalesce((F.col(auroc) > 0.5).cast("int"), F.lit(0)))


#: Columns that place an interval: its level, and a bucket of that level.
LEVEL, BUCKET = "_level", "_bucket"


def leveled(intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """Intervals under the buckets that they touch: of ``width`` doubled so often that a bucket is as long as the interval, so they are two at most.

    An interval that ends before it starts, or lacks an end, holds nothing and is left out.
    """
    times = F.ceil(F.log2((F.col(end) - F.col(start)).cast("double") / width))
    sized = intervals.filter(F.col(end) >= F.col(start)).withColumn(LEVEL, F.greatest(F.lit(0), times).cast("int"))
    at = lambda c: F.floor(F.col(c) / (width * F.pow(F.lit(2.0), F.col(LEVEL)))).cast("long")
    return sized.withColumn(BUCKET, F.explode(F.sequence(at(start), at(end))))


def window_join(samples: DataFrame, intervals: DataFrame, key: str, time: str, start: str, end: str, width: float, closed: bool = True) -> DataFrame:
    """Samples inside intervals of the same recording; closed at both ends or half-open.

    Intervals are listed by length: under two buckets at most of a level of their own (``leveled``), whatever their lengths, and a sample
    looks up one bucket of each level that there is.  So the range join is an equi join whose work follows the matches.
    """
    spread = leveled(intervals, start, end, width)
    # a number for each doubling between the shortest interval and the longest
    levels = [r[0] for r in spread.select(LEVEL).distinct().collect()]
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end)))
    looked = F.explode(F.array(*[F.struct(F.lit(n).alias(LEVEL), F.floor(F.col(time) / (width * 2.0**n)).cast("long").alias(BUCKET)) for n in sorted(levels) or [0]])).alias("_look")
    placed = samples.select("*", looked).select(*samples.columns, f"_look.{LEVEL}", f"_look.{BUCKET}")
    return placed.join(spread, [key, LEVEL, BUCKET]).filter(inside).drop(LEVEL, BUCKET)


def asof_prior(events: DataFrame, markers: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each event with the time and value of the last marker before it (or at the same time)."""
    both = events.withColumn("_m", F.lit(None).cast(f"struct<at:{_type(markers, time)},v:{_type(markers, value)}>")).withColumn("_e", F.lit(1)).unionByName(
        markers.select(key, time, F.struct(F.col(time).alias("at"), F.col(value).alias("v")).alias("_m")).withColumn("_e", F.lit(0)), allowMissingColumns=True
    )
    found = carried(both, [key], [time, "_e"], long_keys(both, [key], time), last={"_last": F.col("_m")}).filter("_e = 1")
    return found.withColumns({"marker_time": F.col("_last.at"), "marker_value": F.col("_last.v")}).drop("_m", "_e", "_last")


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def next_match(marks: DataFrame, key: str, time: str, opens: Column, closes: Column) -> DataFrame:
    """Opening marks with the first later closing mark; those without one are dropped."""
    t = carried(marks, [key], [time], long_keys(marks, [key], time), after={"closed_at": F.when(closes, F.col(time))})
    return t.filter(opens & F.col("closed_at").isNotNull())


def assign_region(points: DataFrame, rects: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first region, in the order, whose rectangle holds the point; else off_face.  Rects are wide: <region>_x0 and so on, one row a stimulus."""
    joined = points.join(rects, key, "left")
    chosen = F.when(F.lit(False), F.lit(""))
    for r in order:
        chosen = chosen.when(F.col("x").between(F.col(f"{r}_x0"), F.col(f"{r}_x1")) & F.col("y").between(F.col(f"{r}_y0"), F.col(f"{r}_y1")), "face_other" if r == "face" else r)
    return joined.withColumn("region", F.when(F.col("x").isNull() | F.col("y").isNull(), F.lit(None)).otherwise(chosen.otherwise("off_face"))).select(*points.columns, "region")


def frame_lookup(samples: DataFrame, track: DataFrame, key: str, time: str, fps: Column, frames: Column) -> DataFrame:
    """The frame that is shown at each sample: trunc(t * fps / 1000), kept inside the track."""
    frame = F.greatest(F.lit(0), F.least(frames - 1, (F.col(time) * fps / 1000).cast("long"))).cast("long")
    return samples.withColumn("frame", frame).join(track, [key, "frame"], "left")


def match_event_file(data: DataFrame, events: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """Data and event recordings of each subject with a status, blocked with a reason where they disagree."""
    a = data.select(key, *[F.col(c).alias(f"data_{c}") for c in compare]).withColumn("_d", F.lit(1))
    b = events.select(key, *[F.col(c).alias(f"event_{c}") for c in compare]).withColumn("_e", F.lit(1))
    j = a.join(b, key, "full")
    reason = F.when(F.col("_d").isNull(), "no_data_file").when(F.col("_e").isNull(), "no_event_file")
    for c in compare:
        reason = reason.when(~F.col(f"data_{c}").eqNullSafe(F.col(f"event_{c}")), f"{c}_mismatch")
    j = j.withColumn("reason", reason.otherwise(""))
    return j.withColumn("status", F.when(F.col("reason") == "", "paired").otherwise("blocked")).select(key, "status", "reason")


def epoch_join(samples: DataFrame, events: DataFrame, key: str, time: str, onset: str, tmin: float, tmax: float) -> DataFrame:
    """Each event with the samples of its recording in [onset + tmin, onset + tmax], by relative time and index."""
    e = events.withColumns({"_from": F.col(onset) + tmin, "_to": F.col(onset) + tmax})
    j = window_join(samples, e, key, time, "_from", "_to", max(tmax - tmin, 1e-9))
    w = Window.partitionBy(key, onset).orderBy(time)
    return j.withColumns({"relative_time": F.col(time) - F.col(onset), "sample_index": F.row_number().over(w) - 1}).drop("_from", "_to")


def build_availability(split: DataFrame, files: DataFrame, probes: DataFrame, qa: DataFrame, key: str) -> DataFrame:
    """Per subject: file, readable and QC flags, bad rate, and the reason of failure (a missing file comes first)."""
    j = split.join(files, key, "left").join(probes, key, "left").join(qa, key, "left")
    there = F.coalesce(F.col("n_files"), F.lit(0)) > 0
    candidates = F.coalesce("n_valid", F.lit(0)) + F.coalesce("n_rejected", F.lit(0))
    readable = there & F.coalesce("readable", F.lit(False))
    passed = readable & (F.coalesce("n_valid", F.lit(0)) > 0)
    return j.select(
        *split.columns, there.cast("int").alias("file_exists"), readable.cast("int").alias("file_readable"), candidates.alias("n_candidates"),
        F.try_divide(F.coalesce("n_rejected", F.lit(0)).cast("double"), candidates.cast("double")).alias("bad_rate"), passed.cast("int").alias("qc_pass"),
        F.when(~there, "missing_file").when(~readable, "unreadable").when(~passed, "no_valid_window").otherwise("").alias("reason"),
    )


def annotate_takes(takes: DataFrame, timelines: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    j = takes.join(timelines.withColumn("_t", F.lit(True)), list(keys), "left")
    found = F.coalesce("_t", F.lit(False))
    return j.withColumns({"timeline_found": found, "n_media_segments": F.coalesce("n_media_segments", F.lit(0)), "timeline_complete": (found & (F.coalesce("n_media_segments", F.lit(0)) >= expected)).cast("int")}).drop("_t")


def round_robin_limit(df: DataFrame, group: str, order: Sequence[str], n: int) -> DataFrame:
    """Rows taken in turn from each class until there are n."""
    w = Window.partitionBy(group).orderBy(*order)
    # no class gives more than n rows, so tasks keep the first n of each before the exchange
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).orderBy("turn", group).limit(n)


def union_aligned(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """All rows, columns by name in a fixed order, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*columns)
