"""Hard negatives from a GNAT-style multiway hyperplane tree of range tables.

Vectors are quantised (component x becomes floor(256 x)) and scored by their integer inner product with an anchor.  With one
more component that gives all rows the norm M of the longest, a score s of anchor q is the distance sqrt(|q|^2 + M^2 - 2 s), so a
window of scores is an annulus around q.

1. *Tree.*  Split points of every node are far points of a sample of at most SAMPLE rows; a row belongs to the nearest of
   them (ties to the first), down to a cell.  The sample shapes the tree alone: every row is routed to its cell, and the
   distances from each split point to the rows below each sibling, least and greatest, are taken over all rows.
2. *Elimination.*  An anchor at distance D of a split point can be no closer to a row of a sibling subtree with the range [a, b] than
   D - b and a - D, and no farther than D + b.  A subtree is left out where this interval meets none of the
   anchor's annuli, for any of the split points of its node and the nodes above.
3. *Cells.*  A cell lies in blocks of about BLOCK rows, dealt by a hash, however many rows share a vector; the anchors that reach a cell meet each of its blocks
   in parts of about PART anchors.  There all scores are computed exactly, and the best rows of every window leave the block.
4. *Passes.*  The cell of an anchor gives a lower bound for the score of its last positive, the search within that bound gives the positives, and
   their windows, from LEAST per cent of a positive's score up to that score, give the negatives.

Defined cases: rows with a null label, a null vector, or a null or non-finite component take no part; an empty vector, and what a shorter
vector lacks, counts as zeros; a null vec_id is no anchor, is not relabelled and comes last among ties; repeated rows are rows of
their own (each may be the other's positive); negative positives have an empty window; components are held as 32-bit integers, the
farthest value standing for all beyond, and scores are exact below 2^53; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.llm.common import dropped, small, stored

SCALE = 256
#: Rows whose vec_id is divisible by these are anchors, and carry the next label, of so many labels.
ANCHOR, RELABEL, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 5
#: A negative has at least so many per cent of the positive's score.
LEAST = 80
#: Rows that shape the tree, split points of a node, sample rows that are not split further, and levels at most.
SAMPLE, FANOUT, LEAF, LEVELS = 8192, 8, 96, 6
#: Rows of a block of a cell, and anchors that meet it at a time.
BLOCK, PART = 2048, 2048
#: Stands for a null vec_id where ids are compared.
NO_ID = np.iinfo(np.int64).max
LOWEST, HIGHEST = -(1 << 62), 1 << 62


def _quantised(column: pa.Array) -> tuple[np.ndarray, list[bytes], list[float]]:
    """Which rows take part, and the vectors of these as packed 32-bit integers with their squared norms."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    there = pc.is_valid(column).to_numpy(zero_copy_only=False)
    length = np.where(there, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), 0)
    x = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    ends = np.cumsum(length)
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    good = there & (bad[ends] == bad[ends - length])
    limit = np.iinfo(np.int32).max
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(SCALE * np.where(np.isfinite(x), x, 0)), -limit, limit)
    own = [whole[ends[i] - length[i] : ends[i]] for i in np.flatnonzero(good).tolist()]
    return good, [v.astype("<i4").tobytes() for v in own], [float(v @ v) for v in own]


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, packed, square = _quantised(batch.column("embedding"))
        kept = batch.select(["row", "vec_id", "label"]).filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(packed, pa.binary()), pa.array(square, pa.float64())], ["row", "vec_id", "label", "vector", "square"])


def vectors(rows: DataFrame) -> DataFrame:
    """row (a number of our own), vec_id, label, vector (packed 32-bit integers), square (its squared norm) of the rows that take part; stored."""
    label = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("int").alias("label"), "embedding")
    return stored(numbered.filter("label IS NOT NULL").mapInArrow(_vector_batches, "row long, vec_id long, label int, vector binary, square double"), "vectors")


def matrix(packed: list[bytes]) -> np.ndarray:
    """Packed vectors as rows, shorter ones filled with zeros."""
    width = max(map(len, packed), default=0) // 4
    if all(len(p) == 4 * width for p in packed):
        return np.frombuffer(b"".join(packed), "<i4").reshape(len(packed), width).astype(np.float64)
    out = np.zeros((len(packed), width))
    for i, p in enumerate(packed):
        out[i, : len(p) // 4] = np.frombuffer(p, "<i4")
    return out


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b; what one of them lacks counts as zero."""
    width = min(a.shape[1], b.shape[1])
    return a[:, :width] @ b[:, :width].T


@dataclass
class Node:
    """Split points, their lifting components, what lies below each, and the ranges of distances from point i to the rows below j."""

    points: np.ndarray
    lifted: np.ndarray
    below: list[int] = field(default_factory=list)  # a node, or -1 - cell
    least: np.ndarray | None = None
    most: np.ndarray | None = None


class Tree:
    """The nodes, the root first; without any all rows are in cell 0."""

    def __init__(self, sample: np.ndarray, longest: float) -> None:
        self.longest, self.nodes, self.cells = longest, [], 0
        self._grow(sample, 0)
        for node in self.nodes:
            node.least, node.most = np.full((len(node.below),) * 2, np.inf), np.full((len(node.below),) * 2, -np.inf)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.longest - (x * x).sum(1)))

    def distances(self, x: np.ndarray, lifted: np.ndarray, node: Node) -> np.ndarray:
        """From rows, with their lifting component, to the split points."""
        return np.sqrt(np.maximum(0, 2 * (self.longest - dots(x, node.points) - np.outer(lifted, node.lifted))))

    def _grow(self, sample: np.ndarray, level: int) -> int:
        node = self._split(sample) if len(sample) > LEAF and level < LEVELS else None
        if node is None:
            self.cells += 1
            return -self.cells
        at = len(self.nodes)
        self.nodes.append(node)
        of = self.distances(sample, self.lift(sample), node).argmin(1)
        node.below = [self._grow(sample[of == j], level + 1) for j in range(len(node.points))]
        return at

    def _split(self, sample: np.ndarray) -> Node | None:
        """Points that are far from each other: the farthest from the mean, then always the farthest from those taken."""
        lifted = self.lift(sample)
        full = np.column_stack([sample, lifted])
        away = ((full - full.mean(0)) ** 2).sum(1)
        taken = [int(away.argmax())]
        away = ((full - full[taken[0]]) ** 2).sum(1)
        while len(taken) < FANOUT and away.max() > 0:
            taken.append(int(away.argmax()))
            away = np.minimum(away, ((full - full[taken[-1]]) ** 2).sum(1))
        return Node(sample[taken], lifted[taken]) if len(taken) > 1 else None

    def route(self, x: np.ndarray, ranges: bool = False) -> np.ndarray:
        """The cell of each row; with ``ranges`` the rows' distances widen those of the nodes that they pass."""
        cell, lifted = np.zeros(len(x), np.int64), self.lift(x)
        todo = [(0, np.arange(len(x)))] if self.nodes and len(x) else []
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            d = self.distances(x[rows], lifted[rows], node)
            of = d.argmin(1)
            for j in np.unique(of).tolist():
                own = of == j
                if ranges:
                    node.least[:, j] = np.minimum(node.least[:, j], d[own].min(0))
                    node.most[:, j] = np.maximum(node.most[:, j], d[own].max(0))
                if node.below[j] < 0:
                    cell[rows[own]] = -1 - node.below[j]
                else:
                    todo.append((node.below[j], rows[own]))
        return cell

    def reached(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each cell with the anchors that may have a row there with a score in one of their windows (a column each)."""
        if not self.nodes:
            yield 0, np.arange(len(x))
            return
        square = (x * x).sum(1)
        away = lambda s: np.sqrt(np.maximum(0, (square + self.longest)[:, None] - 2.0 * s))
        slack = 1e-6 * (1 + np.sqrt(self.longest + square))[:, None]
        inner, outer = away(high) - slack, away(low) + slack
        inner[low > high] = np.inf
        todo = [(0, np.arange(len(x)), np.zeros(len(x)), np.full(len(x), np.inf))]
        while todo:
            at, rows, near, far = todo.pop()
            node = self.nodes[at]
            d = np.sqrt(np.maximum(0, (square[rows] + self.longest)[:, None] - 2 * dots(x[rows], node.points)))
            for j, below in enumerate(node.below):
                if not np.isfinite(node.least[0, j]):
                    continue  # no row lies there
                closest = np.maximum(near, np.maximum(d - node.most[:, j], node.least[:, j] - d).max(1))
                farthest = np.minimum(far, (d + node.most[:, j]).min(1))
                meets = ((closest[:, None] <= outer[rows]) & (farthest[:, None] >= inner[rows])).any(1)
                if not meets.any():
                    continue
                if below < 0:
                    yield -1 - below, rows[meets]
                else:
                    todo.append((below, rows[meets], closest[meets], farthest[meets]))


def grown(stock: DataFrame) -> tuple[Tree, DataFrame, DataFrame]:
    """The tree over the stored vectors, how many blocks each cell has (a row a cell), and the vectors with their cell and block."""
    n, longest = stock.agg(F.count("*"), F.max("square")).first()
    # sampled by a hash at the rate that leaves about SAMPLE rows
    kept = stock.filter(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, SAMPLE / max(1, n)))).select("vector")
    sample = [r[0] for r in kept.limit(2 * SAMPLE).collect()]
    tree = Tree(matrix(sample), float(longest or 0))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = tree.route(matrix(batch.column("vector").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(tree.cells or 1, np.int64)
        for batch in batches:
            np.add.at(seen, tree.route(matrix(batch.column("vector").to_pylist()), ranges=True), 1)
        rows = [(at, i, j, float(node.least[i, j]), float(node.most[i, j])) for at, node in enumerate(tree.nodes) for j in range(len(node.below)) if np.isfinite(node.least[0, j]) for i in range(len(node.below))]
        rows += [(-1, cell, int(count), 0.0, 0.0) for cell, count in enumerate(seen.tolist()) if count]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["node", "i", "j", "least", "most"])

    dealt = stored(stock.mapInArrow(routed, "row long, vec_id long, label int, vector binary, square double, cell long"), "routed")
    seen = stock.mapInArrow(measured, "node long, i long, j long, least double, most double")
    # a row for each pair of siblings, and for each cell: as many as the sample allows
    ranges = seen.groupBy("node", "i", F.when(F.col("node") >= 0, F.col("j")).alias("of")).agg(F.min("least"), F.max("most"), F.sum(F.when(F.col("node") < 0, F.col("j"))))
    blocks: dict[int, int] = {}
    for node, i, j, least, most, count in ranges.collect():
        if node < 0:
            blocks[i] = -(-count // BLOCK)
        else:
            tree.nodes[node].least[i, j], tree.nodes[node].most[i, j] = least, most
    spark = stock.sparkSession
    of_cell = F.broadcast(spark.createDataFrame(sorted(blocks.items()), "cell long, blocks long"))
    return tree, of_cell, dealt.join(of_cell, "cell").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))


ASKING = "row long, vec_id long, label int, vector binary, low array<long>, high array<long>, cell long"


def _reaching_batches(tree: Tree):
    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = max(1, max(len(w) for w in batch.column("low").to_pylist()))
            low, high = np.full((batch.num_rows, width), HIGHEST, np.float64), np.full((batch.num_rows, width), LOWEST, np.float64)
            for i, (a, b) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())):
                low[i, : len(a)], high[i, : len(b)] = a, b
            for cell, rows in tree.reached(matrix(batch.column("vector").to_pylist()), low, high):
                yield batch.take(pa.array(rows)).append_column("cell", pa.array(np.full(len(rows), cell, np.int64)))

    return reaching


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of one key after the other, from sorted rows."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _best_batches(same: bool, k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first k rows of the block for every window of every anchor: higher scores, then smaller ids first."""
        for table in _groups(batches, ("cell", "block", "part")):
            asks = table["asks"].to_numpy()
            queries, rows = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
            if not queries.num_rows or not rows.num_rows:
                continue
            ids, own, label = pc.fill_null(rows["vec_id"], NO_ID).to_numpy(), rows["row"].to_numpy(), rows["label"].to_numpy()
            order = np.lexsort((own, ids))
            ids, own, label = ids[order], own[order], label[order]
            scores = dots(matrix(queries["vector"].to_pylist()), matrix([rows["vector"][int(i)].as_py() for i in order]))
            fits = (queries["label"].to_numpy()[:, None] == label) == same
            fits &= queries["row"].to_numpy()[:, None] != own
            lows, highs = queries["low"].to_pylist(), queries["high"].to_pylist()
            fits &= (scores >= np.array([min(x) for x in lows], np.float64)[:, None]) & (scores <= np.array([max(x) for x in highs], np.float64)[:, None])
            anchor, window, score, found, by = [], [], [], [], []
            for i, (row, low, high) in enumerate(zip(queries["row"].to_pylist(), lows, highs)):
                mine = np.flatnonzero(fits[i])
                mine = mine[np.argsort(-scores[i, mine], kind="stable")]
                descending = -scores[i, mine]
                for w, (a, b) in enumerate(zip(low, high)):
                    at, to = np.searchsorted(descending, -float(b), "left"), np.searchsorted(descending, -float(a), "right")
                    took = mine[at : min(to, at + k)]
                    anchor += [row] * len(took)
                    window += [w] * len(took)
                    score.append(scores[i, took])
                    found.append(ids[took])
                    by.append(own[took])
            if anchor:
                found = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(window, pa.int32()), pa.array(np.concatenate(score).astype(np.int64)), pa.array(found, mask=found == NO_ID), pa.array(np.concatenate(by))],
                    ["anchor", "window", "score", "found_id", "found_row"],
                )

    return best


def search(asking: DataFrame, dealt: DataFrame, of_cell: DataFrame, same: bool, k: int) -> DataFrame:
    """anchor, window, rank, score, found_id of the first k rows in each window of each asking row at a cell (columns ASKING, stored)."""
    # a row a cell, as many as the sample allows
    parts = F.broadcast(asking.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts")))
    place = ("cell", "block", "part")
    queries = asking.join(of_cell, "cell").join(parts, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("row"), "parts").alias("part"),
        F.lit(True).alias("asks"), "row", "vec_id", "label", "vector", "low", "high",
    )
    none = F.lit(None).cast("array<long>")
    rows = dealt.join(parts, "cell").select(
        "cell", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.lit(False).alias("asks"), "row", "vec_id", "label", "vector", none.alias("low"), none.alias("high"),
    )
    met = queries.unionByName(rows).repartition(*place).sortWithinPartitions(*place)
    best = met.mapInArrow(_best_batches(same, k), "anchor long, window int, score long, found_id long, found_row long")
    first = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "found_row")
    return best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).drop("found_row")


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor and positive that has a negative."""
    stock = vectors(rows)
    tree, of_cell, dealt = grown(stock)
    anchors = stored(dealt.filter(F.col("vec_id") % ANCHOR == 0).select("row", "vec_id", "label", "vector", "cell"), "anchors")

    def windows(low, high) -> list:
        return [F.array(low.cast("long")).alias("low"), F.array(high.cast("long")).alias("high")]

    columns = ["row", "vec_id", "label", "vector", "low", "high"]
    own = stored(anchors.select("row", "vec_id", "label", "vector", *windows(F.lit(LOWEST), F.lit(HIGHEST)), "cell"), "asking")
    seen = search(own, dealt, of_cell, True, positives).filter(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("bound"))
    bounded = anchors.join(small(stored(seen, "bounds")), "row", "left")
    asking = bounded.select(*columns[:4], *windows(F.coalesce("bound", F.lit(LOWEST)), F.lit(HIGHEST))).mapInArrow(_reaching_batches(tree), ASKING)
    asking = stored(asking, "asking")
    found = search(asking, dealt, of_cell, True, positives).select(
        F.col("anchor").alias("row"), (F.col("rank") - 1).alias("window"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    found = stored(found, "positives")
    dropped(own, asking)
    # at most ``positives`` rows an anchor
    of = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("window", "positive_score"))).alias("of"))
    score = F.col("of.positive_score")
    lows = F.transform(score, lambda s: ((LEAST * s + F.pmod(-LEAST * s, F.lit(100))) / 100).cast("long"))
    asking = anchors.join(of, "row").select(*columns[:4], lows.alias("low"), score.alias("high")).mapInArrow(_reaching_batches(tree), ASKING)
    asking = stored(asking, "asking")
    far = search(asking, dealt, of_cell, False, negatives).select(F.col("anchor").alias("row"), "window", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return far.join(found, ["row", "window"]).join(named, "row").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
with v as (
    select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * cast(x as double)) for x in embedding] as q
    from embeddings where label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
    select a.r, a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
    from v a join v b on a.r <> b.r where a.vec_id % 100 = 0
), p as (
    select r, vec_id as positive_id, score as positive_score, row_number() over (partition by r order by score desc, vec_id) as k from s where same qualify k <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by s.r, k order by score desc, vec_id) as int) as rank, vec_id as negative_id, positive_score, score as negative_score
from s join p on s.r = p.r and not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
"""
