"""Windows over long keys: state that is carried from chunk to chunk.

A window over a recording puts the whole recording into one task.  Here a recording of more than CHUNK rows is cut into chunks of
equal spans of time.  Windows run inside the chunks; what a chunk hands on (its last value, its sum, its first value) is one row,
and only these rows, a chunk each, meet in a window over the recording.  Keys of up to CHUNK rows are one chunk, and a table that has no longer key is
read with plain windows.  The time of a row decides its chunk, so equal times are never cut apart and results do not depend on the cuts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key that one task takes in one window.
CHUNK = 1 << 16


def long_keys(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame | None:
    """The keys of more than CHUNK rows, with their number of chunks and span of time; None if there is none.

    At most a row for every CHUNK rows of the table.
    """
    t = F.col(time).cast("double")
    sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / CHUNK).alias("_chunks"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    found = sizes.filter("_chunks > 1")
    return None if found.isEmpty() else found


def _chunked(df: DataFrame, keys: Sequence[str], time: str, found: DataFrame) -> DataFrame:
    """``_chunk``, counted from 0; rows without a time are in the first one, where an ascending order has them."""
    place = F.floor(F.try_divide((F.col(time).cast("double") - F.col("_lo")) * F.col("_chunks"), F.col("_hi") - F.col("_lo")))
    return df.join(found, list(keys), "left").withColumn("_chunk", F.coalesce(F.least(place, F.col("_chunks") - 1), F.lit(0).cast("long"))).drop("_chunks", "_lo", "_hi")


def carried(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], found: DataFrame | None,
    last: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None, upto: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None, coming: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Columns by the order (time first) of each key, with ``found`` of ``long_keys``.

    ``last`` is the last value that is not null at or before the row, ``before`` the one strictly before it, ``upto`` the sum up to the row,
    ``coming`` the first value that is not null at or after the row and ``after`` the one strictly after it.
    """
    last, before, upto, after, coming = last or {}, before or {}, upto or {}, after or {}, coming or {}
    named = {f"_v_{n}": c for part in (last, before, upto, after, coming) for n, c in part.items()}
    t = df.withColumns(named)
    if found is not None:
        t = _chunked(t, keys, order[0], found)
    place = [*keys, "_chunk"] if found is not None else list(keys)
    ahead = Window.partitionBy(*place).orderBy(*order)
    back = Window.partitionBy(*place).orderBy(*[F.desc_nulls_last(o) for o in order])
    start = Window.unboundedPreceding
    out: dict[str, Column] = {}
    for names, window, end in ((last, ahead, 0), (before, ahead, -1), (coming, back, 0), (after, back, -1)):
        out |= {n: F.last(f"_v_{n}", True).over(window.rowsBetween(start, end)) for n in names}
    out |= {n: F.sum(f"_v_{n}").over(ahead.rowsBetween(start, 0)) for n in upto}
    t = t.withColumns(out)
    if found is None:
        return t.drop(*named)

    def edge(pick, name: str) -> Column:
        value = F.col(f"_v_{name}")
        return pick(F.when(value.isNotNull(), F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))).getField("v")

    of_chunk = [edge(F.max, n).alias(f"_e_{n}") for n in (*last, *before)] + [edge(F.min, n).alias(f"_e_{n}") for n in (*after, *coming)] + [F.sum(f"_v_{n}").alias(f"_e_{n}") for n in upto]
    ends = t.join(found.select(*keys), list(keys), "left_semi").groupBy(*place).agg(*of_chunk)
    up, down = (Window.partitionBy(*keys).orderBy(o).rowsBetween(start, -1) for o in ("_chunk", F.desc("_chunk")))
    handed = {f"_c_{n}": F.last(f"_e_{n}", True).over(w) for names, w in ((last, up), (before, up), (after, down), (coming, down)) for n in names}
    handed |= {f"_c_{n}": F.sum(f"_e_{n}").over(up) for n in upto}
    ends = ends.select(*place, *[c.alias(n) for n, c in handed.items()])
    t = t.join(ends, place, "left")
    joined = {n: F.coalesce(n, f"_c_{n}") for n in (*last, *before, *after, *coming)} | {n: F.col(n) + F.coalesce(f"_c_{n}", F.lit(0)) for n in upto}
    return t.withColumns(joined).drop(*named, *handed, "_chunk")
