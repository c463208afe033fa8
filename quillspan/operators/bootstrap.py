"""The bootstrap with the weights of all replicates of a row as one packed vector.

*Draws.*  A replicate has exactly as many draws as its group has subjects.  The subjects of a group, in the order of a hash, lie in
FANOUT ranges of it.  The draws are dealt to the ranges in proportion to how many subjects lie in each, every draw by its own number, and in
a range to the subjects; so counts are multinomial, and no row is numbered.  Draws are numbers mixed from the group, the node, the replicate and
their place, so results do not depend on partitions, and feature sets of one group share their draws.

*Metrics.*  A range's slim rows are in one task, which makes its draws and sums the weights of equal rows at once: what is handed on are
vectors of CHUNK replicates for each distinct score, label and threshold, not one for each row.  They are exchanged by group, chunk and range of the score,
and sorted; running sums of the vectors give the ranking metrics of all replicates at once, and products of the weights with the columns of the
other metrics give their sums.  In a group of many distinct rows the sums of the vectors in the ranges above come first, as one row a range.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.clean import stable_number
from quillspan.operators.metrics import threshold_metrics
from quillspan.sources.shared import written

#: A prime below 2**31, so that a square fits a long.
PRIME = 2147483647
#: Ranges of the hash, one for each hex digit.
FANOUT = 16
#: Vectors that a range hands on in one batch; replicates of a vector; replicates whose draws are dealt to the ranges in one row; draws that are made at a time.
LEAF, CHUNK, DEALT, DRAWS = 1024, 125, 25, 1 << 14
#: Bits of a draw's number that its box leaves out.
BOX = np.uint64(20)
#: Vectors of a group from which on its scores are read in RANGES ranges.
LARGE, RANGES = 1 << 16, 256
#: Rows whose vectors are unpacked at a time.
ROWS = 512
BINS = 10


def _folded(x: np.ndarray, spare: np.ndarray) -> None:
    """x modulo PRIME, which is 2**31 - 1, in place, less what is left over: below 2**31 + 2**18 for x below 2**62 + 2**49."""
    np.right_shift(x, np.uint64(31), out=spare)
    np.bitwise_and(x, np.uint64(PRIME), out=x)
    np.add(x, spare, out=x)
    # a difference below 0 wraps to a great number
    np.subtract(x, np.uint64(PRIME), out=spare)
    np.minimum(x, spare, out=x)


def draws(group: int, node: int, replicate: int, count: int) -> Iterator[np.ndarray]:
    """A number below PRIME for each draw, in blocks that are written over each other; squaring modulo the prime mixes what is put in."""
    here = np.arange(min(count, DRAWS), dtype=np.uint64)
    numbers, spares = np.empty_like(here), np.empty_like(here)
    for at in range(0, count, DRAWS):
        i, x, spare = (v[: count - at] for v in (here, numbers, spares))
        first = (at + group + 16807 * node) % PRIME
        np.add(i, np.uint64((first + replicate * 1640531527) % PRIME), out=x)
        for more in (i, np.uint64(first + 12345)), (np.uint64(replicate % PRIME),), (i, np.uint64(at % PRIME)):
            np.multiply(x, x, out=x)
            for v in more:
                np.add(x, v, out=x)
            _folded(x, spare)
        _folded(x, spare)
        yield x


def dealt(group: int, node: int, replicate: int, count: int, below: np.ndarray) -> np.ndarray:
    """How many draws fall to each range, in proportion to what lies in them."""
    ends = np.cumsum(below).tolist()
    # the least numbers whose place is at the end of a range or beyond
    limits = np.array([-(-e * PRIME // ends[-1]) for e in ends[:-1]], np.uint64)
    # numbers are counted in boxes; those in the box of a limit are compared with it
    box_of = limits >> BOX
    boxes, less = np.zeros(int(PRIME >> BOX) + 1, np.int64), np.zeros(len(limits), np.int64)
    edge = np.zeros(len(boxes), bool)
    edge[box_of] = True
    for x in draws(group, node, replicate, count):
        box = (x >> BOX).view(np.int64)
        boxes += np.bincount(box, minlength=len(boxes))
        near = x[edge[box], None]
        less += ((near >> BOX == box_of) & (near < limits)).sum(0)
    under = np.append(0, np.cumsum(boxes))[box_of] + less
    return np.diff(under, prepend=0, append=count)


def subject_counts(group: int, node: int, replicate: int, count: int, subjects: int) -> np.ndarray:
    """How often each subject of a range is drawn."""
    places, at = np.empty(count, np.uint64), 0
    for x in draws(group, node, replicate, count):
        np.multiply(x, np.uint64(subjects), out=x)
        np.floor_divide(x, np.uint64(PRIME), out=places[at : at + len(x)])
        at += len(x)
    return np.bincount(places.view(np.int64), minlength=subjects)


def _packed(vectors: np.ndarray) -> pa.Array:
    """Each row as bytes: one a number, or four where one exceeds 255."""
    vectors = np.ascontiguousarray(vectors, np.uint8 if vectors.max(initial=0) < 256 else np.int32)
    offsets = np.arange(len(vectors) + 1, dtype=np.int32) * (vectors.shape[1] * vectors.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(vectors)])


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    lengths = pc.binary_length(column).to_numpy()
    out = np.zeros((len(column), width))
    for kind in (np.uint8, np.int32):
        at = np.flatnonzero(lengths == width * np.dtype(kind).itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), kind).reshape(-1, width)
    return out


def _dealt_batches(keys: Sequence[str], replicates: int):
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                group, chunk, below = (row.column(c)[0].as_py() for c in ("number", "chunk", "below"))
                sizes = np.array([b["n"] for b in below])
                found = np.array([dealt(group, 0, r, int(sizes.sum()), sizes) for r in range(1 + chunk * DEALT, 1 + min(replicates, (chunk + 1) * DEALT))], np.int64).T
                take = pa.array(np.zeros(len(below), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(k).take(take) for k in keys), pa.array([b["child"] for b in below]), pa.array([chunk] * len(below)), pa.array([v.tobytes() for v in found], pa.binary())], [*keys, "child", "chunk", "counts"]
                )

    return ranges


def _leaf_batches(keys: Sequence[str], subject: str, columns: Sequence[str], width: int):
    """Per range of the hash: the weights of its rows, summed over rows that are equal in the columns, in vectors of ``width`` replicates."""
    def summed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        head = rows.slice(0, 1)
        group, child = head.column("number")[0].as_py(), head.column("child")[0].as_py()
        counts = np.concatenate([np.frombuffer(c["counts"], np.int64) for c in head.column("counts")[0].as_py()]).tolist()
        rows = rows.slice(1)
        who = [np.concatenate([c.indices.to_numpy() for c in rows.column(n).dictionary_encode().chunks]) for n in ("hash", subject)]
        place = np.cumsum(np.any([np.append(False, w[1:] != w[:-1]) for w in who], axis=0))
        subjects = int(place[-1]) + 1
        equal = rows.select(columns).to_pandas().groupby(list(columns), sort=False, dropna=False).ngroup().to_numpy()
        first, starts = (np.unique(v, return_index=True)[1] for v in (equal, np.sort(equal)))
        place = place[np.argsort(equal, kind="stable")]
        drawn = np.empty(len(place), np.int64)
        for at in range(0, len(counts), width):
            sums = np.zeros((width, len(first)), np.int32)
            for i, n in enumerate(counts[at : at + width]):
                np.take(subject_counts(group, 1 + child, at + i + 1, n, subjects), place, out=drawn, mode="clip")
                sums[i] = np.add.reduceat(drawn, starts)
            for start in range(0, len(first), LEAF):
                which = pa.array(first[start : start + LEAF])
                some = rows.select([*keys, *columns]).take(which).combine_chunks()
                data = [some.column(c).combine_chunks() for c in some.column_names]
                yield pa.RecordBatch.from_arrays([*data, pa.array(np.full(len(which), at // width)), _packed(sums[:, start : start + LEAF].T)], [*keys, *columns, "chunk", "weights"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            # a range begins with the row of its counts
            starts = np.flatnonzero(batch.column("counts").is_valid().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([0, *starts], [*starts, batch.num_rows]):
                if a in starts and parts:
                    yield from summed(parts)
                    parts = []
                if b > a:
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield from summed(parts)

    return leaves


def summed_weights(rows: DataFrame, keys: Sequence[str], subject: str, columns: Sequence[str], replicates: int, width: int, seed: int = 0) -> DataFrame:
    """keys, columns, chunk, weights: how often each replicate draws the rows that are equal in the columns, a vector of ``width`` replicates a chunk.

    Keys and subjects may not be null.  A last chunk that is not full ends in zeros.  Equal rows of different ranges of the hash stay apart.
    """
    keys, columns = list(keys), list(columns)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kind[k]}" for k in keys)
    hashed = rows.select(*dict.fromkeys([*keys, subject, *columns]), stable_number(seed, *[F.col(k) for k in keys], F.col(subject)).alias("hash")).withColumn("child", F.shiftright("hash", 28))
    number = (stable_number(seed, *[F.col(k) for k in keys]) % PRIME).alias("number")
    sizes = hashed.select(*keys, subject, "child").distinct().groupBy(*keys, "child").agg(F.count("*").alias("n"))
    groups = sizes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("below"))
    # few rows with much to do each, so their number of tasks is given
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((replicates - 1) // DEALT).cast("long"))).alias("chunk")
    parts = groups.select(*keys, number, "below", chunks).repartition(tasks, *keys, "chunk")
    counts = parts.mapInArrow(_dealt_batches(keys, replicates), f"{schema}, child long, chunk long, counts binary")
    heads = counts.groupBy(*keys, "child").agg(F.array_sort(F.collect_list(F.struct("chunk", "counts"))).alias("counts")).select(*keys, number, "child", "counts")
    met = hashed.unionByName(heads, allowMissingColumns=True).repartition(tasks, *keys, "child").sortWithinPartitions(*keys, "child", F.col("counts").isNull(), "hash", subject)
    out = ", ".join(f"`{c}` {kind[c]}" for c in [*keys, *columns])
    return met.mapInArrow(_leaf_batches(keys, subject, columns, width), f"{out}, chunk long, weights binary")


def subject_weights(rows: DataFrame, keys: Sequence[str], subject: str, replicates: int, seed: int = 0) -> DataFrame:
    """keys, subject, weights: how often each replicate draws each subject of the group, one byte a replicate (four if a subject is drawn more than 255 times).

    Keys and subjects may not be null.  The counts of a replicate sum to the number of subjects of the group.
    """
    known = rows.select(*keys, F.col(subject).alias("subject")).distinct()
    return summed_weights(known, keys, "subject", ["subject"], replicates, replicates, seed).drop("chunk")


#: The sums of a group: pairs of a positive below a negative (ties one half), the sum of precisions, weights of positives and of negatives, squared errors;
#: then tp, fp, tn, fn of each kind of threshold, and weight, scores and positives of each bin.
SUMS = ("lost", "precisions", "pos", "neg", "squares")


class Running:
    """The sums of one range of a group, from its rows in falling order of the score."""

    def __init__(self, replicates: int, kinds: int, above: bytes | None) -> None:
        self.sums = np.zeros((len(SUMS) + 4 * kinds + 3 * BINS, replicates))
        start = np.frombuffer(above, np.int64).reshape(2, replicates) if above else np.zeros((2, replicates))
        self.tp, self.fp = start.astype(np.float64)
        self.tied: tuple[float, np.ndarray, np.ndarray] | None = None

    def add(self, score: np.ndarray, label: np.ndarray, thresholds: np.ndarray, weights: np.ndarray) -> None:
        one = label == 1
        bins = (score[:, None] >= np.arange(1, BINS) * (1.0 / BINS)).sum(1)
        called = score[:, None] >= thresholds
        parts = [called & one[:, None], called & ~one[:, None], ~called & ~one[:, None], ~called & one[:, None]]
        inside = (bins[:, None] == np.arange(BINS)).astype(np.float64)
        columns = [one, ~one, (score - label) ** 2, *(p[:, k] for k in range(thresholds.shape[1]) for p in parts), *inside.T, *(inside.T * score), *(inside.T * label)]
        self.sums[2:] += np.stack(columns).astype(np.float64) @ weights
        start = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
        pos, neg = (np.add.reduceat(weights * c[:, None], start, axis=0) for c in (one, ~one))
        first = score[start]
        if self.tied is not None:
            if self.tied[0] == first[0]:
                pos[0] += self.tied[1]
                neg[0] += self.tied[2]
            else:
                first, pos, neg = np.append(self.tied[0], first), np.vstack([self.tied[1][None], pos]), np.vstack([self.tied[2][None], neg])
        self.tied = first[-1], pos[-1], neg[-1]
        self._rank(pos[:-1], neg[:-1])

    def _rank(self, pos: np.ndarray, neg: np.ndarray) -> None:
        if not len(pos):
            return
        tp, fp = self.tp + np.cumsum(pos, 0), self.fp + np.cumsum(neg, 0)
        self.sums[0] += (pos * (fp - 0.5 * neg)).sum(0)
        self.sums[1] += np.divide(pos * tp, tp + fp, out=np.zeros_like(tp), where=tp + fp > 0).sum(0)
        self.tp, self.fp = tp[-1], fp[-1]

    def done(self) -> np.ndarray:
        if self.tied is not None:
            self._rank(self.tied[1][None], self.tied[2][None])
        return self.sums


def _runs(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a batch with equal keys."""
    coded = [batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False) for k in keys]
    cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in coded], axis=0)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
        yield tuple(batch.column(k)[a].as_py() for k in keys), batch.slice(a, b - a)


def _range_batches(groups: Sequence[str], kinds: Sequence[str], replicates: int):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*head, pa.array([running.done().tobytes()], pa.binary())], [*groups, "sums"])

        last = running = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, run in _runs(batch, [*groups, "range"]):
                if key != last:
                    if running is not None:
                        yield out()
                    above = run.column("above")[0].as_py()
                    last, head, running = key, [run.column(g).slice(0, 1) for g in groups], Running(replicates, len(kinds), above)
                run = run.filter(run.column("weights").is_valid())
                for at in range(0, run.num_rows, ROWS):
                    some = run.slice(at, ROWS)
                    score, label = some.column("probability").to_numpy(), some.column("label").to_numpy().astype(np.int64)
                    thresholds = np.stack([some.column(k).to_numpy() for k in kinds], 1) if kinds else np.zeros((some.num_rows, 0))
                    weights = unpacked(some.column("weights"), replicates)
                    running.add(score, label, thresholds, weights)
        if running is not None:
            yield out()

    return summed


def _total_batches(groups: Sequence[str], names: Sequence[str], replicates: int):
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            take = pa.array(np.zeros(replicates, np.int64))
            return pa.RecordBatch.from_arrays([*(h.take(take) for h in head), pa.array(np.arange(1, replicates + 1)), *(pa.array(v.copy()) for v in total)], [*groups, "replicate", *names])

        last = total = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, run in _runs(batch, groups):
                if key != last:
                    if total is not None:
                        yield out()
                    last, head, total = key, [run.column(g).slice(0, 1) for g in groups], np.zeros((len(names), replicates))
                for data in run.column("sums").to_pylist():
                    total += np.frombuffer(data).reshape(total.shape)
        if total is not None:
            yield out()

    return totals


def _vector_sums(names: Sequence[str], replicates: int):
    """Per stretch of equal keys: the weights of positives and of negatives, summed."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for _, run in _runs(batch, names):
                both = np.zeros((2, replicates), np.int64)
                for at in range(0, run.num_rows, ROWS):
                    some = run.slice(at, ROWS)
                    if "pair" in run.schema.names:
                        both += np.frombuffer(b"".join(some.column("pair").to_pylist()), np.int64).reshape(-1, 2, replicates).sum(0)
                    else:
                        w = unpacked(some.column("weights"), replicates).astype(np.int64)
                        one = some.column("label").to_numpy() == 1
                        both += np.stack([w[one].sum(0), w[~one].sum(0)])
                yield pa.RecordBatch.from_arrays([*(run.column(n).slice(0, 1) for n in names), pa.array([both.tobytes()], pa.binary())], [*names, "pair"])

    return sums


def _above_batches(groups: Sequence[str], replicates: int):
    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What lies above each range, from the sums of the ranges in falling order; pairs of one range follow each other."""
        last, sofar, of, pending = None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for key, run in _runs(batch, [*groups, "range"]):
                pair = np.frombuffer(b"".join(run.column("pair").to_pylist()), np.int64).reshape(-1, 2, replicates).sum(0)
                if key[:-1] != last:
                    last, sofar, of, pending = key[:-1], np.zeros_like(pair), None, np.zeros_like(pair)
                if key[-1] != of:
                    sofar, pending, of = sofar + pending, np.zeros_like(pair), key[-1]
                    yield pa.RecordBatch.from_arrays([*(run.column(g).slice(0, 1) for g in [*groups, "range"]), pa.array([sofar.tobytes()], pa.binary())], [*groups, "range", "above"])
                pending = pending + pair

    return above


def replicate_sums(rows: DataFrame, keys: Sequence[str], by: Sequence[str], subject: str, replicates: int, thresholds: Mapping[str, Column], seed: int = 0) -> DataFrame:
    """A row for each group and replicate with the sums that the metrics are made of; rows without a score or label take no part."""
    groups, kinds = [*keys, *by], [f"_at_{name}" for name in thresholds]
    kept = rows.filter(F.col("probability").isNotNull() & F.col("label").isNotNull())
    slim = kept.select(*groups, subject, F.col("label").cast("long").alias("label"), F.col("probability").cast("double").alias("probability"), *[c.cast("double").alias(k) for k, c in zip(kinds, thresholds.values())])
    # all draws are made here, once for everything that is derived from them
    summed = written(summed_weights(slim, keys, subject, [*by, "label", "probability", *kinds], replicates, CHUNK, seed), "weights")
    share = F.array(*[F.lit((k + 1) / RANGES) for k in range(RANGES - 1)])
    bounds = summed.filter("chunk = 0").groupBy(*groups).agg(F.count("*").alias("n"), F.percentile_approx("probability", share, F.lit(4 * RANGES)).alias("cuts")).filter(F.col("n") > LARGE)
    # a row a group
    large = bounds.count() > 0
    weighted = summed.join(F.broadcast(bounds.drop("n")), groups, "left").withColumn("range", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("probability"))), F.lit(0))).drop("cuts") if large else summed.withColumn("range", F.lit(0))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{g}` {kind[g]}" for g in groups) + ", chunk long"
    weighted = weighted.withColumn("above", F.lit(None).cast("binary"))
    groups = [*groups, "chunk"]
    if large:
        place = [*groups, "range"]
        partial = weighted.sortWithinPartitions(*place).mapInArrow(_vector_sums(place, CHUNK), f"{schema}, range int, pair binary")
        above = partial.repartition(*groups).sortWithinPartitions(*groups, F.desc("range")).mapInArrow(_above_batches(groups, CHUNK), f"{schema}, range int, above binary")
        weighted = weighted.unionByName(above, allowMissingColumns=True)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    met = weighted.repartition(tasks, *groups, "range").sortWithinPartitions(*groups, "range", F.col("above").isNull(), F.desc("probability"))
    sums = met.mapInArrow(_range_batches(groups, kinds, CHUNK), f"{schema}, sums binary")
    names = [*SUMS, *(f"{c}{k}" for k in kinds for c in ("tp", "fp", "tn", "fn")), *(f"{c}_{b}" for c in ("weight", "scores", "positives") for b in range(BINS))]
    totals = sums.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(_total_batches(groups, names, CHUNK), f"{schema}, replicate long, {', '.join(f'{n} double' for n in names)}")
    return totals.withColumn("replicate", F.col("chunk") * CHUNK + F.col("replicate")).filter(F.col("replicate") <= replicates).drop("chunk")


def _ranking(sums: DataFrame) -> dict[str, Column]:
    every = F.col("pos") * F.col("neg")
    return {"auroc": F.try_divide(every - F.col("lost"), every), "auprc": F.try_divide(F.col("precisions"), F.col("pos"))}


def bootstrap_metrics(rows: DataFrame, keys: Sequence[str], by: Sequence[str], subject: str, replicates: int, seed: int = 0) -> DataFrame:
    """AUROC and average precision of each replicate for each group of (keys, by); draws are shared over ``by``."""
    sums = replicate_sums(rows, keys, by, subject, replicates, {}, seed)
    return sums.select(*keys, *by, "replicate", *[c.alias(name) for name, c in _ranking(sums).items()])


def bootstrap_all(rows: DataFrame, keys: Sequence[str], by: Sequence[str], subject: str, replicates: int, thresholds: Mapping[str, Column], seed: int = 0) -> DataFrame:
    """Every metric of each replicate, once for each kind of threshold (a column of ``rows`` or a constant)."""
    sums = replicate_sums(rows, keys, by, subject, replicates, thresholds, seed)
    whole = F.col("pos") + F.col("neg")
    gap = [F.try_divide(F.abs(F.col(f"scores_{b}") - F.col(f"positives_{b}")), F.col(f"weight_{b}")) for b in range(BINS)]
    metrics = _ranking(sums) | {
        "brier": F.try_divide(F.col("squares"), whole),
        "ece": F.try_divide(sum(F.abs(F.col(f"scores_{b}") - F.col(f"positives_{b}")) for b in range(BINS)), whole),
        "mce": F.greatest(*gap),
    }
    counts = F.array(*[F.struct(F.lit(name).alias("threshold_type"), *[F.col(f"{c}_at_{name}").cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")]) for name in thresholds])
    found = sums.select(*keys, *by, "replicate", *[c.alias(name) for name, c in metrics.items()], F.explode(counts).alias("_kind"))
    return threshold_metrics(found.select("*", "_kind.*").drop("_kind"))
