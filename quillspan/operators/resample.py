"""Resampling on prediction tables: intervals and increments of bootstrap draws, permutations, false discovery."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def interval(draws: DataFrame, keys: Sequence[str], metrics: Sequence[str], level: float = 0.95) -> DataFrame:
    """Percentile interval and mean of each metric over the replicates."""
    tail = (1 - level) / 2
    parts = [x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.percentile(m, tail).alias(f"{m}_low"), F.percentile(m, 1 - tail).alias(f"{m}_high"))]
    return draws.groupBy(*keys).agg(*parts, F.count("*").alias("n_replicates"))


def pair_predictions(rows: DataFrame, keys: Sequence[str], pairs: DataFrame, subject: str, fold: str, least: int = 10) -> DataFrame:
    """Predictions of feature sets a and b of each declared pair side by side, for groups of ``least`` rows or more."""
    side = lambda s: rows.select(*keys, F.col(subject), F.col(fold), "label", F.col("feature_set").alias(f"feature_set_{s}"), F.col("probability").alias(f"probability_{s}"))
    joined = F.broadcast(pairs).join(side("a"), "feature_set_a").join(side("b").drop("label"), ["feature_set_b", *keys, subject, fold])
    w = Window.partitionBy(*keys, "feature_set_a", "feature_set_b")
    return joined.withColumn("n_pairs", F.count("*").over(w)).filter(F.col("n_pairs") >= least)


def paired_draws(draws: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Differences b minus a of each replicate that has both."""
    def side(name: str, metric: str) -> Column:
        return F.max(F.when(F.col("feature_set") == name, F.col(metric)))

    found = draws.groupBy(*keys, "replicate").agg(
        F.count_if(F.col("feature_set") == a).alias("_a"), F.count_if(F.col("feature_set") == b).alias("_b"),
        (side(b, "auroc") - side(a, "auroc")).alias("auroc_diff"), (side(b, "auprc") - side(a, "auprc")).alias("auprc_diff"),
    )
    return found.filter("_a > 0 AND _b > 0").drop("_a", "_b")


def paired_p(draws: DataFrame, keys: Sequence[str], diff: str = "auroc_diff") -> DataFrame:
    """Median difference and two-sided tail probability, at least one over the replicates."""
    b = F.count(diff)
    low, high = F.sum((F.col(diff) <= 0).cast("double")) / b, F.sum((F.col(diff) >= 0).cast("double")) / b
    return draws.groupBy(*keys).agg(F.median(diff).alias("median_diff"), F.least(F.lit(1.0), F.greatest(2 * F.least(low, high), 1.0 / b)).alias("p"))


def benjamini_hochberg(df: DataFrame, keys: Sequence[str], p: str = "p", order: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """``rejected``: whether the step-up rule rejects, which it does up to the largest rank that passes."""
    whole = Window.partitionBy(*keys)
    ranked = df.withColumn("_rank", F.row_number().over(whole.orderBy(p, *order))).withColumn("_m", F.count(p).over(whole))
    last = F.max(F.when(F.col(p) <= F.col("_rank") / F.col("_m") * level, F.col("_rank"))).over(whole)
    return ranked.withColumn("rejected", F.coalesce(F.col("_rank") <= last, F.lit(False))).drop("_rank", "_m")


#: A prime below 2**31, so that a square fits a long, the rounds of a permutation, and counts that a task hands on at a time.
PRIME, ROUNDS, CELLS = 2147483647, 32, 1 << 17


def permuted_places(place: np.ndarray, size: np.ndarray, replicate: np.ndarray | int) -> np.ndarray:
    """permuted_place of arrays: a round takes a fixed number of operations a place."""
    def noise(x, turn: int):
        v = (x + turn * 48271 + replicate * 1640531527) % PRIME
        v = (v * v + 12345 + x) % PRIME
        return (v * v + turn) % PRIME

    for turn in range(1, ROUNDS + 1):
        partner = (noise(0, turn) - place) % size
        place = np.where(noise(np.maximum(place, partner), turn) // 1024 % 2 == 1, partner, place)
    return place


def permuted_place(place: Column, size: Column, replicate: Column) -> Column:
    """Where a place below ``size`` goes in a replicate: a bijection of all places (swap or not), which needs no other row.

    In each round a place has one partner, the mirror about a point of that round; whether the two change places is
    read from the greater one, so both agree.
    """
    def moved(place: pd.Series, size: pd.Series, replicate: pd.Series) -> pd.Series:
        return pd.Series(permuted_places(place.to_numpy(np.int64), size.to_numpy(np.int64), replicate.to_numpy(np.int64)))

    return F.pandas_udf(moved, LongType())(*[c.cast("long") for c in (place, size, replicate)])


def _numbered(rows: DataFrame, keys: Sequence[str], subject: str, seed: int) -> DataFrame:
    """rows with _place, the row's number in its keys in hash order, from 0, _n, how many there are, and _positives; dealt to all cores by subject."""
    from quillspan.operators.splits import hash_order, hash_ranks

    ranked = hash_ranks(rows, keys, hash_order(seed, subject), subject)
    positives = rows.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.sum("label").cast("long").alias("_positives"))
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    known = ranked.join(positives, same) if keys else ranked.crossJoin(F.broadcast(positives))
    # few rows with much to do each, so their number of tasks is given
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return known.select(*rows.columns, (F.col("_k") - 1).cast("long").alias("_place"), F.col("_n").cast("long"), "_positives").repartition(tasks, subject)


def permute_labels(rows: DataFrame, keys: Sequence[str], subject: str, replicates: int, seed: int = 0) -> DataFrame:
    """Rows of each replicate with the labels shuffled inside the keys, so their shares stay.

    Rows are numbered once, in hash order.  A replicate moves the numbers by a bijection, and the rows whose number is then below the number of
    positives are its positives: nothing is sorted or joined a replicate.
    """
    copies = _numbered(rows, keys, subject, seed).withColumn("replicate", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"))))
    place = permuted_place(F.col("_place"), F.col("_n"), F.col("replicate"))
    return copies.withColumn("label", (place < F.col("_positives")).cast("int")).select(*rows.columns, "replicate")


def permuted_counts(rows: DataFrame, keys: Sequence[str], subject: str, replicates: int, by: Sequence[str], seed: int = 0) -> DataFrame:
    """by, replicate, label, weight: how many rows of permute_labels are equal in these.  A task counts its rows, so no row is copied a replicate between processes."""
    by = list(by)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place, size, positives = (batch.column(c).to_numpy() for c in ("_place", "_n", "_positives"))
            kind = batch.select(by).to_pandas().groupby(by, sort=False, dropna=False).ngroup().to_numpy()
            _, first, every = np.unique(kind, return_index=True, return_counts=True)
            step = max(1, CELLS // len(every))
            for start in range(1, replicates + 1, step):
                numbers = np.arange(start, min(start + step, replicates + 1))
                ones = np.stack([np.bincount(kind[permuted_places(place, size, int(n)) < positives], minlength=len(every)) for n in numbers])
                for label, weight in ((1, ones), (0, every - ones)):
                    of, at = np.nonzero(weight)
                    columns = [batch.column(c).take(pa.array(first[at])) for c in by]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers[of]), pa.array(np.full(len(at), label, np.int32)), pa.array(weight[of, at])], [*by, "replicate", "label", "weight"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    parts = _numbered(rows, keys, subject, seed).select(*by, "_place", "_n", "_positives").mapInArrow(counted, f"{schema}, replicate long, label int, weight long")
    return parts.groupBy(*by, "replicate", "label").agg(F.sum("weight").alias("weight"))


def permutation_null(null: DataFrame, observed: DataFrame, keys: Sequence[str], stat: str = "auroc") -> DataFrame:
    """Mean, sample deviation and maximum of the null, and the share of it at or above what was observed."""
    seen = observed.select(*keys, F.col(stat).alias("observed"))
    joined = null.join(F.broadcast(seen), list(keys)) if keys else null.crossJoin(F.broadcast(seen))
    return joined.groupBy(*keys).agg(
        F.first("observed").alias("observed"), F.avg(stat).alias("null_mean"), F.stddev_samp(stat).alias("null_std"), F.max(stat).alias("null_max"),
        F.avg((F.col(stat) >= F.col("observed")).cast("double")).alias("exceedance"),
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation from sums; NULL where a spread is below 1e-9."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    mx, my = F.avg(x), F.avg(y)
    vx, vy = F.avg(x * x) - mx * mx, F.avg(y * y) - my * my
    return F.when((vx > 1e-9) & (vy > 1e-9), (F.avg(x * y) - mx * my) / F.sqrt(F.greatest(vx * vy, F.lit(1e-300))))


def split_half(df: DataFrame, subject: str, feature: str, half: str, value: str, least: int = 20) -> DataFrame:
    """Per feature: correlation of the two halves over subjects, and its Spearman-Brown form, at most 1."""
    wide = df.groupBy(subject, feature).agg(F.max(F.when(F.col(half) == 0, F.col(value))).alias("a"), F.max(F.when(F.col(half) == 1, F.col(value))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    r = wide.groupBy(feature).agg(F.count("*").alias("n"), pearson(F.col("a"), F.col("b")).alias("r_half"))
    r = r.withColumn("r_half", F.when(F.col("n") >= least, F.col("r_half")))
    return r.withColumn("spearman_brown", F.least(F.lit(1.0), F.try_divide(2 * F.col("r_half"), 1 + F.col("r_half"))))


def reliability_summary(df: DataFrame, feature: str, device: str, value: str, devices: Sequence[str], least: float = 0.5) -> DataFrame:
    """Per feature: the coefficient of each device, their median, and whether all reach ``least``."""
    wide = df.groupBy(feature).pivot(device, list(devices)).agg(F.max(value))
    middle = df.filter(F.col(device).isin(*devices)).groupBy(feature).agg(F.median(value).alias("median"), F.count(value).alias("_n"), F.min(value).alias("_least"))
    return wide.join(middle, feature).withColumn("reliable_on_all", (F.col("_n") == len(devices)) & (F.col("_least") >= least)).drop("_n", "_least")
