"""Connected components of a large edge table by repeated minimum-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import dropped, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node that has an edge.

    Each round hooks every node's larger neighbours to its smallest (large star), then the smaller
    ones (small star), until no edge changes; the table ends as one star per component.  All sums and minima are pre-aggregated, so
    a node with very many edges costs no task more than its share.
    """
    star = stored(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi > lo").distinct(), "edges"
    )
    before = None
    while True:
        large = _star(star, larger_only=True)
        small_ = _star(large, larger_only=False)
        after = stored(small_.distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        dropped(star)
        star = after
        if mark == before:
            break
        before = mark
    return star.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        star.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Connect neighbours of each node to the smallest among node and neighbours.

    Large star moves the larger neighbours, small star the smaller ones and the node itself.
    """
    if larger_only:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.filter("v > u").join(least, "u")
        return moved.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    down = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
