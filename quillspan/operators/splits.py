"""Leakage-free subject splits.  Every random choice is the order of a SHA-1 of seed and id, so results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratum_labels(df: DataFrame, hierarchy: Sequence[Sequence[str]], least: int, label: str) -> DataFrame:
    """The finest of the nested column sets whose stratum has ``least`` rows; strata that end up rare become the class label."""
    chosen = []
    for columns in hierarchy:
        size = F.count("*").over(Window.partitionBy(*columns))
        chosen.append(F.when(size >= least, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])))
    t = df.withColumn("stratum", F.coalesce(*chosen, F.col(label).cast("string")))
    return t.withColumn("stratum", F.when(F.count("*").over(Window.partitionBy("stratum")) >= least, F.col("stratum")).otherwise(F.col(label).cast("string")))


def hash_order(seed: str | int, key: str) -> Column:
    return F.sha1(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def hash_ranks(df: DataFrame, groups: Sequence[str], digest: Column, key: str) -> DataFrame:
    """df with _k, the rank of each row in its group by digest and key, and _n, the group's size.

    Ranks are counted within the 65,536 ranges of the digest's first four digits and shifted by the sizes of the ranges before, so
    a group that holds most rows is spread over many tasks; what is exchanged for the shift is one row a range.
    """
    t = df.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 4))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = t.groupBy(*groups, "_range").agg(F.count("*").alias("_size"))
    sizes = sizes.select(
        *[F.col(c).alias(f"_of_{c}") for c in (*groups, "_range")], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(*groups)).alias("_n")
    )
    ranked = t.withColumn("_k", F.row_number().over(Window.partitionBy(*groups, "_range").orderBy("_digest", key)))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*groups, "_range")])
    return ranked.join(sizes, same).select(*df.columns, (F.col("_before") + F.col("_k")).alias("_k"), "_n")


def holdout_split(df: DataFrame, key: str, stratum: str, fraction: float, folds: int, seed: int = 0) -> DataFrame:
    """split_group (locked or cv) and cv_fold (0 to folds - 1, NULL if locked), stratified by hash order."""
    t = hash_ranks(df, [stratum], hash_order(seed, key), key)
    n_locked = F.bround(F.col("_n") * fraction)
    locked = F.col("_k") <= n_locked
    fold = F.when(~locked, ((F.col("_k") - n_locked - 1) % folds).cast("int"))
    return t.withColumns({"split_group": F.when(locked, "locked").otherwise("cv"), "is_locked_test": locked.cast("int"), "cv_fold": fold}).drop("_k", "_n")


def hash_split(df: DataFrame, key: str, label: str, fraction: float) -> DataFrame:
    """part (train or test): per class the first max(1, half-even round(n * fraction)) ids by SHA-1 are test."""
    t = hash_ranks(df, [label], F.sha1(F.col(key).cast("string")), key)
    return t.withColumn("part", F.when(F.col("_k") <= F.greatest(F.lit(1), F.bround(F.col("_n") * fraction)), "test").otherwise("train")).drop("_k", "_n")


#: Groups that group_folds takes at most; they pass through the driver.
MOST_GROUPS = 100_000


def group_folds(df: DataFrame, group: str, label: str, locked: str, folds: int, target: float = 0.3) -> DataFrame:
    """robustness_fold: whole groups, the largest first, each to the fold with the smallest load, then the share of positives nearest to the target.

    Spark reduces the table to one row a group (their number is checked); the greedy pass over these is on the driver.
    Locked rows count in the loads and get no fold.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(label) == 1, F.lit(False)).cast("int")).alias("pos")).orderBy(F.desc("n"), group).limit(MOST_GROUPS + 1).collect()
    if len(sizes) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    load, positive, chosen = [0] * folds, [0] * folds, []
    for row in sizes:
        def key(f: int, row=row):
            return load[f], abs((positive[f] + row["pos"]) / (load[f] + row["n"]) - target), f
        best = min(range(folds), key=key)
        load[best] += row["n"]
        positive[best] += row["pos"]
        chosen.append((row[group], best))
    kind = df.schema[group].dataType.simpleString()
    dealt = df.sparkSession.createDataFrame(chosen, f"`{group}` {kind}, robustness_fold int")
    return df.join(F.broadcast(dealt), group, "left").withColumn("robustness_fold", F.when(F.col(locked) == 0, F.col("robustness_fold")))


def outer_folds(df: DataFrame, key: str, fold: str) -> DataFrame:
    """fold, part (train or val) of every id."""
    rows = df.select(F.col(key), F.col(fold).alias("_own")).filter("_own IS NOT NULL")
    folds = rows.select(F.col("_own").alias("_fold")).distinct()
    return rows.crossJoin(F.broadcast(folds)).select(F.col("_fold").alias("fold"), key, F.when(F.col("_own") == F.col("_fold"), "val").otherwise("train").alias("part"))


def inner_splits(df: DataFrame, key: str, label: str, fold: str, k: int, stop: float, seed: int = 0) -> DataFrame:
    """For each outer fold, k inner folds of its training ids: part val, stopping or fit, disjoint and covering, stratified by label."""
    train = outer_folds(df, key, fold).filter("part = 'train'").join(df.select(key, label), key)
    seeded = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("fold"), F.col(key)))
    t = hash_ranks(train, ["fold", label], seeded, key).withColumn("_v", (F.col("_k") - 1) % k).drop("_k", "_n")
    t = t.withColumn("inner_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_is_val", F.col("_v") == F.col("inner_fold"))
    again = F.sha1(F.concat_ws("|", F.lit(f"{seed}-stop"), F.col("fold"), F.col("inner_fold"), F.col(key)))
    t = hash_ranks(t, ["fold", "inner_fold", label, "_is_val"], again, key)
    part = F.when(F.col("_is_val"), "val").when(F.col("_k") <= F.bround(F.col("_n") * stop), "stopping").otherwise("fit")
    return t.select("fold", "inner_fold", key, part.alias("part"))


def check_split(df: DataFrame, key: str, group: str, fold: str) -> DataFrame:
    """One row: ids in both groups, ids with two folds, locked rows with a fold, ids."""
    per = df.groupBy(key).agg(F.count_distinct(group).alias("g"), F.count_distinct(fold).alias("f"), F.max(F.when((F.col(group) == "locked") & F.col(fold).isNotNull(), 1).otherwise(0)).alias("l"))
    return per.agg(F.count_if(F.col("g") > 1).alias("in_both"), F.count_if(F.col("f") > 1).alias("two_folds"), F.sum("l").alias("locked_with_fold"), F.count("*").alias("n"))
