"""Summaries over blocks, conditions and regions: responses, recordings, saccades, pursuit, spectra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.features import connectivity
from quillspan.operators.resample import pearson
from quillspan.operators.signals import BANDS


def block_summary(blocks: DataFrame, keys: Sequence[str], block: str, region: str) -> DataFrame:
    """Per unit over its block rows (one a channel and block): means of response, peak, time to peak, area and recovery; the spread of channels;
    consistency (deviation of the block means), first minus last block, and the right minus the left region.
    """
    names = ("response", "peak", "time_to_peak", "area", "recovery")
    side = lambda r: F.avg(F.when(F.col(region) == r, F.col("response")))
    out = blocks.groupBy(*keys).agg(
        *[F.avg(n).alias(f"{n}_mean") for n in names], F.stddev_pop("response").alias("response_std"), F.count_distinct(block).alias("n_blocks"),
        side("left").alias("response_left"), side("right").alias("response_right"), (side("right") - side("left")).alias("lateralisation"),
    )
    means = blocks.groupBy(*keys, block).agg(F.avg("response").alias("_m")).groupBy(*keys).agg(
        F.when(F.count("*") > 1, F.stddev_pop("_m")).alias("consistency_std"), F.when(F.count("*") > 1, F.min_by("_m", block) - F.max_by("_m", block)).alias("first_minus_last")
    )
    return out.join(means, list(keys))


def whole_recording(samples: DataFrame, key: str, order: str, channel: str, value: str, region: Column) -> DataFrame:
    """Per unit: mean and deviation of the correlations of its channel pairs, and the mean of each region (left, right)."""
    sides = samples.groupBy(key).agg(*[F.avg(F.when(region == r, F.col(value))).alias(f"mean_{r}") for r in ("left", "right")])
    pairs = connectivity(samples, key, order, channel, value)
    return pairs.select(key, F.col("mean").alias("connectivity_mean"), F.col("std").alias("connectivity_std")).join(sides, key)


def line_noise(samples: DataFrame, key: str, channel: str, order: str, value: str) -> DataFrame:
    """Mean over channels of the deviation of steps over the deviation of values, a stand-in for line noise."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key, channel).orderBy(order))
    per = samples.withColumn("_step", step).groupBy(key, channel).agg((F.stddev_pop("_step") / (F.stddev_pop(value) + 1e-12)).alias("_r"))
    return per.groupBy(key).agg(F.avg("_r").alias("line_noise"))


def saccade_dynamics(samples: DataFrame, scored: DataFrame, key: str, time: str, around: float, unit: float) -> DataFrame:
    """Per answered trial: the largest horizontal speed within ``around`` of the first movement, from three samples on, per ``unit`` of time."""
    from quillspan.operators.joins import window_join

    moved = scored.filter("latency IS NOT NULL").select(key, "onset", (F.col("onset") + F.col("latency") - around).alias("_from"), (F.col("onset") + F.col("latency") + around).alias("_to"))
    near = window_join(samples.filter("x IS NOT NULL").select(key, time, "x"), moved, key, time, "_from", "_to", 2 * around)
    w = Window.partitionBy(key, "onset").orderBy(time)
    speed = F.abs(F.try_divide(F.col("x") - F.lag("x").over(w), (F.col(time) - F.lag(time).over(w)) / unit))
    return near.withColumn("_v", speed).groupBy(key, "onset").agg(F.when(F.count("*") >= 3, F.max("_v")).alias("peak_velocity"), F.count("*").alias("n_near"))


def saccade_splits(scored: DataFrame, keys: Sequence[str], task: str, small: float = 0.2) -> DataFrame:
    """Per unit: error rate and median latency of the right trials, for small and large amplitudes, and anti minus pro of both over all."""
    right, answered = F.col("correct") == 1, F.col("latency").isNotNull()

    def error(where: Column) -> Column:
        return F.avg(F.when(where & answered, (~right).cast("double")))

    def latency(where: Column) -> Column:
        return F.median(F.when(where & right, F.col("latency")))

    sizes = {"small": F.col("amplitude") < small, "large": F.col("amplitude") >= small}
    tasks = {t: F.col(task) == t for t in ("anti", "pro")}
    return scored.groupBy(*keys).agg(
        *[f(c).alias(f"{n}_{m}") for n, c in sizes.items() for m, f in (("error_rate", error), ("latency_median", latency))],
        (error(tasks["anti"]) - error(tasks["pro"])).alias("contrast_error_rate"), (latency(tasks["anti"]) - latency(tasks["pro"])).alias("contrast_latency_median"),
    )


PURSUIT = ("corr_x", "corr_y", "gain_x", "gain_y", "rmse")


def pursuit_conditions(pairs: DataFrame, key: str, condition: str, block: str, time: str, least_samples: int, least_span: float, fast: str, slow: str) -> DataFrame:
    """Per unit and condition, over its blocks of enough samples and length: mean correlation, gain and error on both axes, the difference of two
    repeats in corr_x, and the fast minus the slow condition of each measure (the same in every row of a unit).
    """
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("tx").isNotNull() & F.col("ty").isNotNull()
    used = pairs.filter(ok)
    per = used.groupBy(key, condition, block).agg(
        F.count("*").alias("_n"), (F.max(time) - F.min(time)).alias("_span"), pearson(F.col("x"), F.col("tx")).alias("corr_x"), pearson(F.col("y"), F.col("ty")).alias("corr_y"),
        F.regr_slope("x", "tx").alias("gain_x"), F.regr_slope("y", "ty").alias("gain_y"), F.sqrt(F.avg(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))).alias("rmse"),
    ).filter((F.col("_n") >= least_samples) & (F.col("_span") >= least_span))
    by = per.groupBy(key, condition).agg(
        *[F.avg(m).alias(m) for m in PURSUIT], F.count("*").alias("n_blocks"),
        F.when(F.count("*") == 2, F.abs(F.max("corr_x") - F.min("corr_x"))).alias("corr_x_repeat_diff"),
    )
    pick = lambda c, m: F.max(F.when(F.col(condition) == c, F.col(m)))
    contrast = by.groupBy(key).agg(*[(pick(fast, m) - pick(slow, m)).alias(f"fast_minus_slow_{m}") for m in PURSUIT])
    return by.join(contrast, key)


def target_following(pairs: DataFrame, keys: Sequence[str], least: int = 10) -> DataFrame:
    """Correlation of gaze and target where at least ``least`` samples have both."""
    n = F.count(F.when(F.col("x").isNotNull() & F.col("tx").isNotNull(), 1))
    return pairs.groupBy(*keys).agg(n.alias("n"), F.when(n >= least, pearson(F.col("x"), F.col("tx"))).alias("corr"))


def viewing_windows(trials: DataFrame, subject: str, valence: str, value: str, window: str, order: str, windows: Sequence[str], valences: Sequence[str]) -> DataFrame:
    """Per subject: mean and sample deviation of each window and valence, later valences minus the first in each window, and each window's trend over trials."""
    cell = lambda w, v: F.when((F.col(window) == w) & (F.col(valence) == v), F.col(value))
    own = lambda w: F.when(F.col(window) == w, F.col(value))
    out = trials.groupBy(subject).agg(
        *[f(cell(w, v)).alias(f"{w}_{v}_{n}") for w in windows for v in valences for n, f in (("mean", F.avg), ("sd", F.stddev_samp))],
        *[F.when(F.count(own(w)) >= 3, F.regr_slope(own(w), F.col(order))).alias(f"{w}_trend") for w in windows],
    )
    return out.withColumns({f"{w}_contrast_{v}": F.col(f"{w}_{v}_mean") - F.col(f"{w}_{valences[0]}_mean") for w in windows for v in valences[1:]})


def band_table(density: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, band, power, relative: sums of the density over each band, and their share of the whole density."""
    band = F.coalesce(*[F.when((F.col("frequency") >= a) & (F.col("frequency") < b), F.lit(n)) for n, (a, b) in BANDS.items()])
    total = density.groupBy(*keys).agg(F.greatest(F.sum("power"), F.lit(1e-300)).alias("_t"))
    sums = density.withColumn("band", band).filter("band IS NOT NULL").groupBy(*keys, "band").agg(F.greatest(F.sum("power"), F.lit(1e-300)).alias("power"))
    return sums.join(total, list(keys)).withColumn("relative", F.col("power") / F.col("_t")).drop("_t")


def spectral_regions(bands: DataFrame, unit: Sequence[str], region: str) -> DataFrame:
    """Per unit over its channels: theta/alpha and beta/alpha ratios, mean log power and share of each region and band, and log(right / left) of each band."""
    power = lambda b, r=None: F.avg(F.when((F.col("band") == b) & (F.lit(True) if r is None else F.col(region) == r), F.col("power")))
    cells = [(b, r) for b in BANDS for r in ("left", "right")]
    cell = lambda b, r, c: F.avg(F.when((F.col("band") == b) & (F.col(region) == r), c))
    return bands.groupBy(*unit).agg(
        (power("theta") / power("alpha")).alias("theta_alpha_ratio"), (power("beta") / power("alpha")).alias("beta_alpha_ratio"),
        *[cell(b, r, F.log10("power")).alias(f"{r}_{b}_log") for b, r in cells], *[cell(b, r, F.col("relative")).alias(f"{r}_{b}_relative") for b, r in cells],
        *[F.log((power(b, "right") + 1e-12) / (power(b, "left") + 1e-12)).alias(f"asymmetry_{b}") for b in BANDS],
    )
