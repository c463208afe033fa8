"""Per-subject features from trials, traces and signals, as plain aggregations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.clean import presence_count
from quillspan.operators.resample import pearson


def vector_summary(value: Column | str) -> list[Column]:
    """Mean, population deviation, extremes and quartiles of the values that are numbers."""
    v = F.nanvl(F.col(value) if isinstance(value, str) else value, F.lit(None))
    quantiles = [F.percentile(v, q).alias(n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    return [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), *quantiles]


def time_moments(value: str) -> list[Column]:
    """Mean, deviation, skew, plain (not excess) kurtosis, mean size, and outer percentiles, from power sums."""
    v = F.col(value)
    m, m2 = F.avg(v), F.avg(v * v) - F.avg(v) * F.avg(v)
    m3 = F.avg(v * v * v) - 3 * m * F.avg(v * v) + 2 * m * m * m
    m4 = F.avg(v * v * v * v) - 4 * m * F.avg(v * v * v) + 6 * m * m * F.avg(v * v) - 3 * m * m * m * m
    safe = F.when(m2 > 1e-12, m2)
    return [m.alias("mean"), F.sqrt(F.greatest(m2, F.lit(0.0))).alias("std"), (m3 / F.pow(safe, 1.5)).alias("skew"), (m4 / (safe * safe)).alias("kurtosis"), F.avg(F.abs(v)).alias("abs_mean"),
            *[F.percentile(v, q).alias(n) for n, q in (("p01", 0.01), ("p50", 0.5), ("p99", 0.99))]]


def describe_rt(value: str) -> list[Column]:
    """n, mean, median, sample deviation, coefficient of variation, IQR, extremes, and skew = mean(((x - m) / sd)**3) for n > 2."""
    v = F.col(value)
    n, m, sd = F.count(v), F.avg(v), F.stddev_samp(v)
    m3 = F.avg(v * v * v) - 3 * m * F.avg(v * v) + 2 * m * m * m
    return [n.alias("n"), m.alias("mean"), F.median(v).alias("median"), sd.alias("sd"), F.try_divide(sd, m).alias("cv"), (F.percentile(v, 0.75) - F.percentile(v, 0.25)).alias("iqr"),
            F.min(v).alias("min"), F.max(v).alias("max"), F.when((n > 2) & (sd > 1e-9), F.try_divide(m3, F.pow(sd, 3))).alias("skew")]


#: Coefficients of Acklam's rational approximation of the inverse normal distribution.
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
ACKLAM_LOW = 0.02425


def polynomial(coefficients: Sequence[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + c, coefficients[1:], F.lit(coefficients[0]))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution."""
    q = p - 0.5
    r = q * q
    middle = polynomial(ACKLAM_A, r) * q / polynomial((*ACKLAM_B, 1.0), r)
    tail = lambda t: polynomial(ACKLAM_C, t) / polynomial((*ACKLAM_D, 1.0), t)
    low, high = F.sqrt(-2 * F.log(F.greatest(p, F.lit(1e-300)))), F.sqrt(-2 * F.log(F.greatest(1 - p, F.lit(1e-300))))
    return F.when(p < ACKLAM_LOW, tail(low)).when(p > 1 - ACKLAM_LOW, -tail(high)).otherwise(middle)


def signal_detection(hits: Column, targets: Column, alarms: Column, others: Column) -> dict[str, Column]:
    """Raw hit and false-alarm rates; d' and criterion from the log-linear rates (h + 0.5) / (n + 1)."""
    zh, zf = inverse_normal((hits + 0.5) / (targets + 1)), inverse_normal((alarms + 0.5) / (others + 1))
    both = (targets > 0) & (others > 0)
    return {"hit_rate": F.try_divide(hits.cast("double"), targets.cast("double")), "false_alarm_rate": F.try_divide(alarms.cast("double"), others.cast("double")),
            "d_prime": F.when(both, zh - zf), "criterion": F.when(both, -(zh + zf) / 2)}


def detection_counts(trials: DataFrame, keys: Sequence[str], target: Column, responded: Column) -> DataFrame:
    yes = responded.cast("boolean")
    return trials.groupBy(*keys).agg(F.count_if(target & yes).alias("hits"), F.count_if(target).alias("targets"), F.count_if(~target & yes).alias("alarms"), F.count_if(~target).alias("others"))


def ols_slope(df: DataFrame, keys: Sequence[str], y: str, x: str, least: int) -> DataFrame:
    """Slope where there are ``least`` pairs or more."""
    ok = F.col(y).isNotNull() & F.col(x).isNotNull()
    return df.groupBy(*keys).agg(F.when(F.count_if(ok) >= least, F.regr_slope(y, x)).alias("slope"))


def linspace_slope(df: DataFrame, keys: Sequence[str], y: str, order: str) -> DataFrame:
    """Slope over evenly spaced places in [0, 1] of the values that are there; two or more."""
    w = Window.partitionBy(*keys)
    t = df.filter(F.col(y).isNotNull()).withColumns({"_k": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return ols_slope(t.withColumn("_x", F.try_divide(F.col("_k").cast("double"), (F.col("_n") - 1).cast("double"))), keys, y, "_x", 2)


def autocorr_lag1(df: DataFrame, keys: Sequence[str], y: str, order: str) -> DataFrame:
    """Correlation of a series with itself one step later, each part about its own mean."""
    t = df.withColumn("_p", F.lag(y).over(Window.partitionBy(*keys).orderBy(order)))
    return t.groupBy(*keys).agg(pearson(F.col("_p"), F.col(y)).alias("autocorr"))


#: Samples whose pairs of channels are summed at a time, and the sums of a pair.
SAMPLES, PAIR_SUMS = 2048, ("n", "x", "y", "xx", "yy", "xy")


def _pair_batches(key: str):
    """For each pair of channels of a key: the sums of a batch that a correlation is made of, by products of matrices."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy()
            for k in np.unique(code).tolist():
                mine = batch.filter(pa.array(code == k))
                for at in range(0, mine.num_rows, SAMPLES):
                    some = mine.slice(at, SAMPLES)
                    own = some.column("_v").flatten()
                    if len(own) < 2:
                        continue
                    yield summed(some.column(key).slice(0, 1), some.column("_v"), *own.flatten())

    def summed(head: pa.Array, lists: pa.Array, channel: pa.Array, value: pa.Array) -> pa.RecordBatch:
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        coded = channel.dictionary_encode(null_encoding="encode")
        known = coded.dictionary.take(pc.sort_indices(coded.dictionary, null_placement="at_start"))
        place = np.argsort(pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy())[coded.indices.to_numpy()]
        # a channel that a sample has twice takes a further column
        again = np.arange(len(row)) - np.maximum.accumulate(np.where(np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1])), np.arange(len(row)), 0))
        columns, column = np.unique(np.stack([place, again]), axis=1, return_inverse=True)
        shape = (len(lists), columns.shape[1])
        v, there, odd = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        x = value.to_numpy(zero_copy_only=False).astype(float)
        at = (row, column.ravel())
        there[at] = value.is_valid().to_numpy(zero_copy_only=False)
        odd[at] = ~np.isfinite(x) & (there[at] > 0)
        v[at] = np.where(np.isfinite(x), x, 0.0)
        a, b = np.triu_indices(shape[1], 1)
        n, sx, sxx, sxy = there.T @ there, v.T @ there, (v * v).T @ there, v.T @ v
        # sums with a value that is no finite number are none
        bad = odd.T @ there > 0
        sx[bad], sxx[bad], sxy[bad | bad.T] = np.nan, np.nan, np.nan
        take = pa.array(np.zeros(len(a), np.int64))
        names = [known.take(pa.array(columns[0][i])) for i in (a, b)]
        data = [n[a, b].astype(np.int64), sx[a, b], sx[b, a], sxx[a, b], sxx[b, a], sxy[a, b]]
        return pa.RecordBatch.from_arrays([head.take(take), *names, *(pa.array(d) for d in data)], [key, "a", "b", *PAIR_SUMS])

    return sums


def connectivity(df: DataFrame, key: str, sample: str, channel: str, value: str) -> DataFrame:
    """Mean and deviation of the correlations of all channel pairs.

    Quadratic in channels, linear in samples: the channels of a sample are put side by side, and the sums of their
    pairs are made in the tasks, by products of matrices of SAMPLES samples, before they are exchanged.
    """
    side = df.groupBy(key, sample).agg(F.array_sort(F.collect_list(F.struct(F.col(channel).alias("c"), F.col(value).cast("double").alias("v")))).alias("_v")).select(key, "_v")
    kind = {c: df.schema[c].dataType.simpleString() for c in (key, channel)}
    schema = f"`{key}` {kind[key]}, a {kind[channel]}, b {kind[channel]}, n long, {', '.join(f'{s} double' for s in PAIR_SUMS[1:])}"
    t = side.mapInArrow(_pair_batches(key), schema).groupBy(key, "a", "b").agg(*[F.sum(s).alias(s) for s in PAIR_SUMS])
    mean = {s: F.try_divide(F.col(s), F.col("n")) for s in PAIR_SUMS[1:]}
    vx, vy = mean["xx"] - mean["x"] * mean["x"], mean["yy"] - mean["y"] * mean["y"]
    r = t.withColumn("r", F.when((vx > 1e-9) & (vy > 1e-9), (mean["xy"] - mean["x"] * mean["y"]) / F.sqrt(F.greatest(vx * vy, F.lit(1e-300)))))
    return r.groupBy(key).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.count("r").alias("n_pairs"))


def hjorth(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    t = df.withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_dd", F.col("_d") - F.lag("_d").over(w))
    v = t.groupBy(*keys).agg(F.var_pop(value).alias("activity"), F.var_pop("_d").alias("_1"), F.var_pop("_dd").alias("_2"))
    mobility = F.sqrt(F.try_divide(F.col("_1"), F.col("activity")))
    return v.withColumn("mobility", mobility).withColumn("complexity", F.try_divide(F.sqrt(F.try_divide(F.col("_2"), F.col("_1"))), F.col("mobility"))).drop("_1", "_2")


def bcea(df: DataFrame, keys: Sequence[str], share: float = 0.68) -> DataFrame:
    """Bivariate contour ellipse area; NULL under 3 points, 0 without spread."""
    x, y = F.col("x"), F.col("y")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    sx, sy, rho, n = F.stddev_samp(x), F.stddev_samp(y), F.coalesce(pearson(x, y), F.lit(0.0)), F.count(x)
    area = 2 * -F.log(F.lit(1 - share)) * F.lit(3.141592653589793) * sx * sy * F.sqrt(F.greatest(1 - rho * rho, F.lit(0.0)))
    return df.groupBy(*keys).agg(F.when(n >= 3, area).alias("bcea"))


def region_shares(points: DataFrame, keys: Sequence[str], regions: Sequence[str]) -> DataFrame:
    """Share of usable samples in each region; NULL without any."""
    n = F.count("region")
    return points.groupBy(*keys).agg(*[F.try_divide(F.count_if(F.col("region") == r).cast("double"), n.cast("double")).alias(f"share_{r}") for r in regions], n.alias("n_usable"))


def drift_estimate(samples: DataFrame, key: str, cross: str, offset: Column, skip: float, least_samples: int, least_crosses: int) -> DataFrame:
    """Median over crosses of the median gaze of each, minus the centre; 0 and not usable with too few crosses."""
    per = samples.filter((offset >= skip) & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy(key, cross).agg(F.median("x").alias("_x"), F.median("y").alias("_y"), F.count("*").alias("_n")).filter(F.col("_n") >= least_samples)
    found = per.groupBy(key).agg(F.count("*").alias("n_crosses"), F.median("_x").alias("_x"), F.median("_y").alias("_y"), (F.percentile("_x", 0.75) - F.percentile("_x", 0.25)).alias("iqr_x"), (F.percentile("_y", 0.75) - F.percentile("_y", 0.25)).alias("iqr_y"))
    usable = F.col("n_crosses") >= least_crosses
    return found.withColumns({"usable": usable, "dx": F.when(usable, F.col("_x") - 0.5).otherwise(0.0), "dy": F.when(usable, F.col("_y") - 0.5).otherwise(0.0)}).drop("_x", "_y")


def block_response(samples: DataFrame, keys: Sequence[str], baseline: Column, task: Column, recovery: Column, value: str, place: Column) -> DataFrame:
    """Per block: baseline mean, response, peak, time to peak (share of the task), area in sample units, recovery mean."""
    v, inside = F.col(value), F.when(task, F.col(value))
    base = F.avg(F.when(baseline, v))
    agg = samples.groupBy(*keys).agg(
        base.alias("baseline"), F.avg(inside).alias("_task"), F.max(inside).alias("_peak"), F.sum(inside).alias("_sum"), F.count(inside).alias("n_task"),
        F.min_by(F.when(task, place), F.when(task, F.struct(-v, place))).alias("_at"), F.avg(F.when(recovery, v)).alias("_rec"),
    )
    b = F.col("baseline")
    return agg.select(*keys, "baseline", "n_task", (F.col("_task") - b).alias("response"), (F.col("_peak") - b).alias("peak"), F.col("_at").alias("time_to_peak"), (F.col("_sum") - b * F.col("n_task")).alias("area"), (F.col("_rec") - b).alias("recovery"))


def wave_window_features(waves: DataFrame, keys: Sequence[str], time: str, value: str, windows: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per named window (closed): mean, peak, trough, latency of the first maximum, area by trapezoids, peak to peak."""
    chosen = F.array(*[F.when(F.col(time).between(a, b), F.lit(n)) for n, (a, b) in windows.items()])
    t = waves.withColumn("window", F.explode(F.array_compact(chosen)))
    w = Window.partitionBy(*keys, "window").orderBy(time)
    t = t.withColumn("_trapezoid", (F.col(value) + F.lag(value).over(w)) / 2 * (F.col(time) - F.lag(time).over(w)))
    return t.groupBy(*keys, "window").agg(
        F.avg(value).alias("mean"), F.max(value).alias("peak"), F.min(value).alias("trough"), F.min_by(time, F.struct(-F.col(value), F.col(time))).alias("peak_latency"),
        F.coalesce(F.sum("_trapezoid"), F.lit(0.0)).alias("area"), (F.max(value) - F.min(value)).alias("peak_to_peak"),
    )


def difference_wave(evoked: DataFrame, keys: Sequence[str], condition: str, value: str, minuend: str, subtrahend: str) -> DataFrame:
    wide = evoked.groupBy(*keys).agg(F.max(F.when(F.col(condition) == minuend, F.col(value))).alias("_a"), F.max(F.when(F.col(condition) == subtrahend, F.col(value))).alias("_b"))
    return wide.filter("_a IS NOT NULL AND _b IS NOT NULL").withColumn("difference", F.col("_a") - F.col("_b")).drop("_a", "_b")


def signal_qc(df: DataFrame, key: str, channel: str, value: str, order: str) -> DataFrame:
    """Missing, flat and extreme rates, motion (deviation of steps), and the threshold median + 6 * deviation."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key, channel).orderBy(order))
    t = df.withColumn("_step", step)
    limits = t.groupBy(key).agg(F.median(F.abs(F.col(value))).alias("_m"), F.stddev_pop(value).alias("_s")).withColumn("threshold", F.col("_m") + 6 * F.col("_s"))
    flat = t.groupBy(key, channel).agg((F.stddev_pop(value) < 1e-9).alias("_flat")).groupBy(key).agg(F.avg(F.col("_flat").cast("double")).alias("flat_rate"))
    rates = t.join(limits, key).groupBy(key, "threshold").agg(
        F.avg(F.col(value).isNull().cast("double")).alias("missing_rate"), F.stddev_pop("_step").alias("motion"), F.avg((F.abs(F.col(value)) > F.col("threshold")).cast("double")).alias("extreme_rate")
    )
    return rates.join(flat, key)


def conformance(observed: DataFrame, expected: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """pass within the tolerance of the expected value, partial within three times it, else FAIL; FAIL without an observation."""
    off = F.abs(F.col("observed") - F.col("expected"))
    limit = F.abs(F.col("expected")) * tolerance
    return expected.join(observed, list(keys), "left").withColumn("status", F.when(off <= limit, "pass").when(off <= 3 * limit, "partial").otherwise("FAIL"))


def readiness_verdict(medians: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """READY if each median reaches its limit, else REVIEW with the names that fail."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(F.col(k) < v, F.lit(True)), F.lit(k)) for k, v in limits.items()]))
    return medians.withColumns({"verdict": F.when(F.size(failed) == 0, "READY").otherwise("REVIEW"), "failed": F.array_join(failed, ",")})


def cohort_identity(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """One row: whether both tables have the same keys, and the largest difference relative to the largest value."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys), "full")
    found = j.agg(F.count("*").alias("n"), F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("same_keys"), F.try_divide(F.max(F.abs(F.col("_a") - F.col("_b"))), F.max(F.abs("_b"))).alias("max_relative_difference"))
    return found.withColumn("identical", F.col("same_keys") & (F.coalesce("max_relative_difference", F.lit(0.0)) <= tolerance))


def split_distribution(df: DataFrame, column: str, group: str, fold: str, folds: int) -> DataFrame:
    """Counts of each value over all, the holdout, the pool and each fold."""
    value = F.coalesce(F.nullif(F.trim(F.col(column).cast("string")), F.lit("")), F.lit("[missing]"))
    per_fold = [F.count_if(F.col(fold) == i).alias(f"fold_{i}") for i in range(folds)]
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n_all"), F.count_if(F.col(group) == "locked").alias("holdout"), F.count_if(F.col(group) == "cv").alias("pool"), *per_fold)


def bar_joined_counts(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """value:count pairs of each group, sorted, joined by bars."""
    counts = df.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    pairs = F.concat(F.coalesce(F.col(column), F.lit("[missing]")), F.lit(":"), F.col("_n").cast("string"))
    return counts.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(pairs)), "|").alias(f"{column}_counts"))


def group_summary(df: DataFrame, group: str) -> DataFrame:
    """Per site: n, labelled, positives, rate, mean age, counts of sex, folds, locked rows, and risk (high: 20 labelled or more and a rate up to 0.15 or from 0.85)."""
    rate = F.try_divide(F.col("positives").cast("double"), F.col("labelled").cast("double"))
    base = df.groupBy(group).agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum(F.coalesce("label", F.lit(0)).cast("long")).alias("positives"), F.avg("age").alias("mean_age"),
        F.array_join(F.transform(F.array_sort(F.collect_set("cv_fold")), lambda f: f.cast("string")), "|").alias("folds"), F.sum(F.col("is_locked_test").cast("long")).alias("n_locked"),
    ).withColumn("rate", rate)
    risk = F.when((F.col("labelled") >= 20) & ((F.col("rate") <= 0.15) | (F.col("rate") >= 0.85)), "high").otherwise("normal")
    return base.withColumn("risk", risk).join(bar_joined_counts(df, [group], "sex"), group)


def choice_pairs(trials: DataFrame, subject: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Choice bias, switch, win-stay, lose-shift, sensitivity and omissions of each subject; pairs never cross blocks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    made = F.when(F.col("response") != "", F.col("response"))
    t = trials.withColumn("_r", made).withColumns({"_pr": F.lag("_r").over(w), "_pf": F.lag("feedback").over(w)})
    stay = F.when(F.col("_r").isNotNull() & F.col("_pr").isNotNull(), (F.col("_r") == F.col("_pr")).cast("double"))
    t = t.withColumn("_stay", stay)
    out = t.groupBy(subject).agg(
        F.avg(F.when(F.col("_r").isNotNull(), (F.col("_r") == "1").cast("double"))).alias("choice_bias"), F.avg(1 - F.col("_stay")).alias("switch_rate"),
        F.avg(F.when(F.col("_pf") == "win", F.col("_stay"))).alias("win_stay"), F.avg(F.when(F.col("_pf") == "loss", 1 - F.col("_stay"))).alias("lose_shift"),
        F.avg(F.col("_r").isNull().cast("double")).alias("omission_rate"),
    )
    return out.withColumn("sensitivity", F.col("win_stay") + F.col("lose_shift") - 1)


def availability_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """One row of conditional counts: each flag, any, all, and those with a label."""
    n = presence_count([F.col(f) for f in flags])
    labelled = F.col("label").isin("0", "1")
    each = [c for f in flags for c in (F.count_if(F.col(f) == 1).alias(f"n_{f}"), F.count_if((F.col(f) == 1) & labelled).alias(f"n_{f}_labelled"))]
    return df.agg(F.count("*").alias("n"), F.count_if(labelled).alias("n_labelled"), F.count_if(n > 0).alias("n_any"), F.count_if(n == len(flags)).alias("n_all"), F.count_if((n > 0) & labelled).alias("n_any_labelled"), F.count_if((n == len(flags)) & labelled).alias("n_all_labelled"), *each)


def infer_device(subjects: DataFrame, takes: DataFrame, key: str, flag: str, devices: Sequence[str]) -> DataFrame:
    """The device of a subject, ``both`` for several, ``unknown`` if flagged but not found, ``none`` if not flagged."""
    seen = takes.filter(F.col("device").isin(*devices)).groupBy(key).agg(F.array_sort(F.collect_set("device")).alias("_d"))
    n = F.coalesce(F.size("_d"), F.lit(0))
    chosen = F.when(n > 1, "both").when(n == 1, F.try_element_at("_d", F.lit(1))).when(F.col(flag) == 1, "unknown").otherwise("none")
    return subjects.join(seen, key, "left").withColumn("device", chosen).drop("_d")
