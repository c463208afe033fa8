"""Checks on tables: unique keys, forbidden columns, disjoint splits, duplicates, coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.quantiles import median


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, or an error that lists some of the keys that occur twice."""
    found = duplicate_keys(df, keys).limit(5).collect()
    if found:
        raise ValueError(f"not unique by {list(keys)}: {[tuple(r) for r in found]}")
    return df


def check_leakage(tables: Mapping[str, DataFrame], exact: Sequence[str], patterns: Sequence[str]) -> DataFrame:
    """dataset, column_name and rule of every forbidden column: by name without case, then by pattern."""
    spark = next(iter(tables.values())).sparkSession
    catalog = spark.createDataFrame([(n, c) for n, df in tables.items() for c in df.columns], "dataset string, column_name string")
    named = F.lower("column_name").isin([e.lower() for e in exact])
    matched = reduce(lambda a, b: a | b, [F.lower("column_name").rlike(p) for p in patterns], F.lit(False))
    return catalog.filter(named | matched).withColumn("rule", F.when(named, "exact").otherwise("pattern"))


def labeled_only(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isin("0", "1"))


def cv_only(df: DataFrame, group: str = "split_group") -> DataFrame:
    return df.filter(F.col(group) == "cv")


def assert_no_holdout(df: DataFrame, locked: str = "is_locked_test") -> DataFrame:
    if not df.filter(F.col(locked) == 1).isEmpty():
        raise ValueError("rows of the locked test set are left")
    return df


def median_split(df: DataFrame, col: str, out: str) -> DataFrame:
    """1 where col is above the median of all rows, 0 where not, NULL where NULL."""
    return df.withColumn(out, F.when(F.col(col).isNotNull(), (F.col(col) > F.lit(median(df, col))).cast("int")))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if not a.select(key).intersect(b.select(key)).isEmpty():
        raise ValueError(f"{key} is shared")


def count_values(df: DataFrame, columns: Sequence[str], marker: str = "[missing]") -> DataFrame:
    """field, value, n: how often each value of each column occurs; blanks count under the marker."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns])).alias("v")).select("v.*")
    return long.groupBy("field", F.coalesce(F.nullif("value", F.lit("")), F.lit(marker)).alias("value")).agg(F.count("*").alias("n"))


def role_files(files: DataFrame, key: str, path: str, patterns: Mapping[str, str]) -> DataFrame:
    """key, role, path of the first file of each role by path, and how many there are."""
    chosen = reduce(lambda c, kv: c.when(F.col(path).rlike(kv[1]), kv[0]), patterns.items(), F.when(F.lit(False), F.lit(None)))
    known = files.withColumn("role", chosen).filter("role IS NOT NULL")
    return known.groupBy(key, "role").agg(F.min(path).alias(path), F.count("*").alias("n_files"))


def resolve_duplicates(takes: DataFrame, keys: Sequence[str], order: Sequence[Column], path: str = "path") -> DataFrame:
    """Each take with its rank, the path that is kept, and why it is discarded (NULL: it is kept)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (
        takes.withColumn("take_rank", F.when(whole, F.row_number().over(w)))
        .withColumn("kept_path", F.when(whole, F.first(path).over(w)))
        .withColumn("reason", F.when(~whole, "missing_key").when(F.col("take_rank") > 1, "duplicate_take"))
    )


def overlap_matrix(df: DataFrame, unit: str, subject: str) -> DataFrame:
    """Subjects that two units share, for each pair of units."""
    own = df.select(unit, subject).filter(F.col(subject).isNotNull()).distinct()
    a, b = own.withColumnRenamed(unit, "a"), own.withColumnRenamed(unit, "b")
    return a.join(b, subject).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
