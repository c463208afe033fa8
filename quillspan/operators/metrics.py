"""Metrics of scored predictions; every function is a pure aggregation of the prediction table.

Ranking metrics first count rows per distinct score, so tied scores form one block and the
window that follows sees one row per score instead of one per prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(None)).otherwise(b))


def score_counts(df: DataFrame, keys: Sequence[str], score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Weight of positives and of negatives at each distinct score of each group."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return df.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0.0)).alias("neg"),
    )


#: Ranges of a score between 0 and 1 that are summed apart.
SCORE_RANGES = 4096


def cumulative(counts: DataFrame, keys: Sequence[str], score: str, descending: bool, **sums: Column) -> DataFrame:
    """counts with running sums over the scores of each group, the score's own row included.

    Scores are dealt by ranges of equal width and summed within each; the sums of the ranges before are added.  So the scores of a
    large group lie in many tasks, and only one row a range passes through the window over the whole group.
    """
    t = counts.withColumn("_range", F.floor(F.col(score) * (-SCORE_RANGES if descending else SCORE_RANGES)))
    for name, c in sums.items():
        t = t.withColumn(f"_{name}", c)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "_range").orderBy(F.desc(score) if descending else score).rowsBetween(Window.unboundedPreceding, 0)
    ranges = t.groupBy(*keys, "_range").agg(*[F.sum(f"_{n}").alias(f"_total_{n}") for n in sums])
    ranges = ranges.select(*keys, "_range", *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0.0)).alias(f"_before_{n}") for n in sums])
    t = t.withColumns({f"_within_{n}": F.sum(f"_{n}").over(within) for n in sums})
    joined = t.join(ranges, [*keys, "_range"])
    return joined.select(*counts.columns, *[(F.col(f"_within_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums])


def auroc(df: DataFrame, keys: Sequence[str], score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Mann-Whitney AUROC with ties as one half; null where a group has one class only."""
    ranked = cumulative(score_counts(df, keys, score, label, weight), keys, score, False, up_to=F.col("neg"))
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (F.col("up_to") - 0.5 * F.col("neg"))), F.sum("pos") * F.sum("neg")).alias("auroc")
    )


def average_precision(df: DataFrame, keys: Sequence[str], score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Step-wise average precision; tied scores form one block at its last precision."""
    ranked = cumulative(score_counts(df, keys, score, label, weight), keys, score, True, tp=F.col("pos"), fp=F.col("neg"))
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))), F.sum("pos")).alias("auprc")
    )


def ranking(df: DataFrame, keys: Sequence[str], score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    """AUROC and average precision from one pass over the scores."""
    ranked = cumulative(score_counts(df, keys, score, label, weight), keys, score, True, tp=F.col("pos"), fp=F.col("neg"))
    every = F.sum("pos") * F.sum("neg")
    return ranked.groupBy(*keys).agg(
        F.try_divide(every - F.sum(F.col("pos") * F.col("fp")) + 0.5 * F.sum(F.col("pos") * F.col("neg")), every).alias("auroc"),
        F.try_divide(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))), F.sum("pos")).alias("auprc"),
    )


def confusion(df: DataFrame, keys: Sequence[str], threshold: Column, score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn of score >= threshold; the threshold may differ by row."""
    w = F.lit(1).cast("long") if weight is None else weight
    called, real = F.col(score) >= threshold, F.col(label) == 1

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, w).otherwise(0)).alias(name)

    return df.groupBy(*keys).agg(total(called & real, "tp"), total(called & ~real, "fp"), total(~called & ~real, "tn"), total(~called & real, "fn"))


THRESHOLD_METRICS = ("accuracy", "balanced_accuracy", "sensitivity", "specificity", "ppv", "npv", "f1", "macro_f1", "positive_rate")


def threshold_metrics(counts: DataFrame) -> DataFrame:
    """The metrics of a confusion table; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    found = (ratio(tp + tn, n), (sens + spec) / 2, sens, spec, ratio(tp, tp + fp), ratio(tn, tn + fn), f1, (f1 + f0) / 2, ratio(tp + fp, n))
    return counts.withColumns(dict(zip(THRESHOLD_METRICS, found)))


def brier(df: DataFrame, keys: Sequence[str], score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return df.groupBy(*keys).agg((F.sum(w * F.pow(F.col(score) - F.col(label), 2)) / F.sum(w)).alias("brier"))


def calibration_bins(df: DataFrame, keys: Sequence[str], bins: int = 10, score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Per bin of equal width: n, mean score, share of positives.  Edges are i * (1 / bins) as doubles; the last bin is closed."""
    width = 1.0 / bins
    edges = F.array(*[F.lit(i * width) for i in range(1, bins)])
    w = F.lit(1).cast("long") if weight is None else weight
    return (
        df.withColumn("bin", F.size(F.filter(edges, lambda e: F.col(score) >= e)))
        .groupBy(*keys, "bin")
        .agg(F.sum(w).alias("n"), (F.sum(w * F.col(score)) / F.sum(w)).alias("mean_score"), (F.sum(w * F.col(label)) / F.sum(w)).alias("positive_share"))
    )


def calibration(df: DataFrame, keys: Sequence[str], bins: int = 10, score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    """Expected and maximum calibration error."""
    gap = F.abs(F.col("mean_score") - F.col("positive_share"))
    return calibration_bins(df, keys, bins, score, label, weight).groupBy(*keys).agg((F.sum(gap * F.col("n")) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def all_metrics(df: DataFrame, keys: Sequence[str], threshold: Column, score: str = "probability", label: str = "label", weight: Column | None = None) -> DataFrame:
    """One row per group with every metric; the parts share the group keys, so they join without a new grouping."""
    w = F.lit(1).cast("long") if weight is None else weight
    out = df.groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).cast("long").alias("n_positive"))
    for part in (
        brier(df, keys, score, label, weight), ranking(df, keys, score, label, weight),
        threshold_metrics(confusion(df, keys, threshold, score, label, weight)), calibration(df, keys, score=score, label=label, weight=weight),
    ):
        out = out.join(part, list(keys))
    return out


def select_threshold(df: DataFrame, keys: Sequence[str], grid: Sequence[float], score: str = "probability", label: str = "label") -> DataFrame:
    """The first threshold of the grid with the best balanced accuracy.

    Rows are counted by how many thresholds they reach before anything is tried, so the grid meets at most its own length of rows a group.
    """
    reached = F.size(F.filter(F.array(*[F.lit(float(g)) for g in sorted(grid)]), lambda g: F.col(score) >= g))
    counts = df.groupBy(*keys, reached.alias("_reached"), (F.col(label) == 1).cast("int").alias("_real")).agg(F.count("*").alias("_n"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(g)).alias("threshold")) for i, g in enumerate(sorted(grid))])
    tried = counts.withColumn("_step", F.explode(steps)).select("*", "_step.threshold", (F.col("_reached") > F.col("_step.i")).cast("double").alias("_called"))
    scored = threshold_metrics(confusion(tried, [*keys, "threshold"], F.lit(0.5), "_called", "_real", F.col("_n")))
    best = Window.partitionBy(*keys).orderBy(F.desc(F.round("balanced_accuracy", 12)), "threshold")
    return scored.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(*keys, "threshold", "balanced_accuracy")


def select_threshold_f1(df: DataFrame, keys: Sequence[str], score: str = "probability", label: str = "label") -> DataFrame:
    """The score at which calling it and all above positive gives the best F1; the lowest on ties."""
    counts = score_counts(df, keys, score, label)
    ranked = cumulative(counts, keys, score, True, tp=F.col("pos"), called=F.col("pos") + F.col("neg"))
    ranked = ranked.join(counts.groupBy(*keys).agg(F.sum("pos").alias("real")), list(keys))
    f1 = F.try_divide(2 * F.col("tp"), F.col("called") + F.col("real"))
    best = ranked.withColumn("f1", f1).groupBy(*keys).agg(F.min_by(F.struct(F.col(score).alias("threshold"), "f1"), F.struct(-F.round("f1", 12), F.col(score))).alias("best"))
    return best.select(*keys, "best.threshold", "best.f1")


def fold_spread(folds: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Folds, and mean and sample deviation of each metric over them."""
    spread = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return folds.groupBy(*keys).agg(F.count("*").alias("n_folds"), *spread)
