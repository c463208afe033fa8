"""Decision tables over increments: which count, under which protocols, after false-discovery control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.joins import attach_comparator
from quillspan.operators.resample import benjamini_hochberg


def required_increments(paired: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The declared comparisons, each with significant_positive and significant_negative by the sign of its interval."""
    kept = paired.join(F.broadcast(declared), list(keys), "left_semi")
    return kept.withColumns({"significant_positive": (F.col("auroc_diff_low") > 0).cast("int"), "significant_negative": (F.col("auroc_diff_high") < 0).cast("int")})


def credit_increments(paired: DataFrame, pooled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A positive increment is credited only if the comparator is above chance."""
    return attach_comparator(paired, pooled, keys).withColumn("credited", (F.col("significant_positive") == 1).cast("int") * F.col("above_chance"))


def build_decision(increments: DataFrame, unit: Sequence[str], protocols: Sequence[str], p: str = "p", folds: str = "folds_up", least_folds: int = 4, level: float = 0.05) -> DataFrame:
    """confirmed: under every protocol the interval is above 0, the comparator above chance, enough folds agree and the false-discovery control rejects; exploratory: under some; else none."""
    tested = benjamini_hochberg(increments, ["cv_protocol"], p, unit, level)
    good = (F.col("significant_positive") == 1) & (F.col("above_chance") == 1) & (F.col(folds) >= least_folds) & F.col("rejected")
    counts = tested.groupBy(*unit).agg(F.count_distinct(F.when(good, F.col("cv_protocol"))).alias("n_protocols"))
    return counts.withColumn("decision", F.when(F.col("n_protocols") == len(protocols), "confirmed").when(F.col("n_protocols") > 0, "exploratory").otherwise("none"))
