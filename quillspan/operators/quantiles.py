"""Exact quantiles of a whole column without holding its values in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a round cuts the values into, and distinct values that are looked at one by one in the end.
RANGES, FEW = 256, 1 << 14


def values_at(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float]:
    """The values at these places (from 0) of the ascending order of what is not null.

    Every round counts the values in ranges between approximate quantiles and keeps the ranges that hold a wanted place, so a round leaves a small
    share of the values (or a single one, however often it occurs); where few distinct ones are left they are counted themselves.  How good the
    quantiles are decides how many rounds it takes, not the result.
    """
    out: dict[int, float] = {}
    v = F.col("v")
    todo = [(df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL"), {int(r): int(r) for r in ranks})]
    while todo:
        rows, wanted = todo.pop()
        share = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
        cuts, distinct = rows.agg(F.percentile_approx("v", share, F.lit(16 * RANGES)), F.approx_count_distinct("v")).first()
        if distinct <= FEW:
            # about FEW distinct values, each with its count
            placed = sorted((r[0], r[1]) for r in rows.groupBy("v").count().collect())
            before = 0
            for value, n in placed:
                out |= {name: value for name, r in wanted.items() if before <= r < before + n}
                before += n
            continue
        cuts = sorted(set(cuts))
        known = F.array(*map(F.lit, cuts))
        # a value that is a cut has a range of its own, so every other range is smaller than the one before
        named = F.size(F.filter(known, lambda c: c < v)) + F.size(F.filter(known, lambda c: c <= v))
        before = 0
        for at, n, low, high in sorted(map(tuple, rows.groupBy(named.alias("at")).agg(F.count("*"), F.min("v"), F.max("v")).collect())):
            here = {name: r - before for name, r in wanted.items() if before <= r < before + n}
            before += n
            if here and low == high:
                out |= dict.fromkeys(here, low)
            elif here:
                todo.append((rows.filter((v >= low) & (v <= high)), here))
    return [out[int(r)] for r in ranks]


def median(df: DataFrame, column: str) -> float | None:
    """The median of a column, the mean of the two middle values if there are two; None without values."""
    n = df.select(F.count(column)).first()[0]
    if not n:
        return None
    low, high = values_at(df, column, [(n - 1) // 2, n // 2])
    return (low + high) / 2
