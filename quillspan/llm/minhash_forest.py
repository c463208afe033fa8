"""Near-duplicate classes by an LSH forest of sorted MinHash orders.

A document is the set of its distinct three-word shingles; two documents link when the Jaccard similarity of their sets is
0.85 or more, which is confirmed on the full sets.

1. *Sketch.*  A set has FUNCTIONS MinHash values of one byte.  Documents of one set form a class and are searched as one.
2. *Orders.*  Each of ORDERS sorted orders reads the values in a sequence of its own.  Sets with a long common
   prefix lie next to each other in that order.
3. *Adaptive depth.*  A region is what shares a prefix.  Regions are counted at the first of DEPTHS; one of more than REGION sets is
   cut again at the next depth, alone, and so on, so thin regions are read at a shallow depth and crowded ones at a deep one.
   Counts and each region's smallest set come from aggregates, so a crowded region lies in no one task.
4. *Candidates.*  First the smallest set of every region, at every depth that was tried, with the others of the region; what these
   links connect need not be compared again, nor what was compared.  Then, at the first depth, in the sorted orders, the unconnected neighbours in every region of at most
   REGION sets; and in larger ones, where at most OUTSIDE sets are outside the region's main component, those sets with all others.
5. *Crowds.*  Regions of the first depth with more sets outside, and that have sets in common, are one crowd.  Its sets are dealt to blocks of about BLOCK shingles by their size,
   and by whether they are in the crowd's main component.  Two blocks whose sizes may link and that are not all connected meet in one task, which compares
   all unconnected pairs; so no pair that shares a first prefix is left out, whatever the size of a group, and no crowd lies in one task.
6. *Confirmation.*  A candidate whose sketches agree in under AGREED values is left out (a linked pair is with a chance under
   1e-8).  The sets of the others are compared shingle by shingle.  Centres (a region's smallest set, those outside its main component) that have most partners
   in common, by the least hash of a partner, form a bundle of about BUNDLE; a set is sent to a place of the bundle once, not once for each
   centre that it meets there, and a bundle with many pairs has several places.
7. *Components* by minimum-star steps; the label is the smallest doc_id.

A pair of similarity s is met in one order with chance s^5 at the first depth: a pair at 0.85 is missed by all orders with a chance of 8e-7.  Deeper
depths only connect crowded regions early, so that less is left to compare; the tests measure recall against brute force.

Defined cases: null and empty texts, and texts of white space only, have an empty set, link with nothing and are their own
component; a text of one or two words has its whole sequence as its only shingle; repeated rows are members of one class and each
gets its row; a null doc_id takes part and gets the class's smallest id; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents, dropped, small, stored
from quillspan.llm.components import components
from quillspan.llm.textcore import mix, shingle_sets

WORDS = 3
#: Similarity in per cent.
PERCENT = 85
#: MinHash values of a sketch, and sorted orders.
FUNCTIONS, ORDERS = 128, 24
#: Values that a region has in common; a region of more than REGION sets is cut at the next depth.
DEPTHS = (5, 8, 16, 32, 64, 128)
REGION = 40
#: Sets outside the main component of a crowded region that meet all others as candidates; a region with more of them is part of a crowd.
OUTSIDE = 12
#: Shingles of a block of a crowd.
BLOCK = 1 << 19
#: Sketch values that a candidate agrees in: six deviations below the mean of a pair at PERCENT.
AGREED = 84
#: Pairs that are compared at one place, and centres that are held there at a time.
PLACE, BUNDLE = 512, 16
#: Shingles that are hashed at a time.
HASHED = 1 << 16

_SEEDS = mix(np.arange(1, 2 * FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = _SEEDS[:FUNCTIONS], _SEEDS[FUNCTIONS:] | np.uint64(1)


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    one = mix(shingles ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64) ^ np.uint64(len(shingles))
    two = mix(shingles ^ np.uint64(0x3333333333333333)).sum(dtype=np.uint64)
    return tuple(mix(np.array([one, two])).view(np.int64).tolist())


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of FUNCTIONS bytes for each set; none of them is empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    least = np.empty((FUNCTIONS, len(sets)), np.uint64)
    hashed = np.empty_like(every)
    for f in range(FUNCTIONS):
        np.bitwise_xor(every, _XOR[f], out=hashed)
        np.multiply(hashed, _ODD[f], out=hashed)
        least[f] = np.minimum.reduceat(hashed, starts)
    return np.ascontiguousarray((mix(least) >> np.uint64(56)).astype(np.uint8).T)


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        size = np.array([len(s) for s in sets], np.int64)
        signed = np.array([signature(s) for s in sets], np.int64).reshape(-1, 2)
        found = np.zeros((len(sets), FUNCTIONS), np.uint8)
        if size.any():
            found[size > 0] = sketches([s for s in sets if len(s)])
        packed = pa.array([x.tobytes() for x in found], pa.binary())
        return pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy()), packed], ["doc_id", "n_shingles", "sig", "sig_b", "sketch"])

    for batch in batches:
        held: list[np.ndarray] = []
        total = at = 0
        for i, own in enumerate(shingle_sets(batch.column("text"), WORDS)):
            if held and total + len(own) > HASHED:
                yield rows(batch.column("doc_id").slice(at, len(held)), held)
                held, total, at = [], 0, i
            held.append(own)
            total += len(own)
        if held:
            yield rows(batch.column("doc_id").slice(at, len(held)), held)


def profile(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sig and sig_b (hashes of the set) and the sketch; stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(docs.select("doc_id", "text").mapInArrow(_profile_batches, f"doc_id {kind}, n_shingles long, sig long, sig_b long, sketch binary"), "profile")


def unpacked(column: pa.Array) -> np.ndarray:
    """The sketches of a column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), FUNCTIONS)


def sequences() -> np.ndarray:
    """The functions in the sequence of each order: eight orders turn one shuffling by 16 places each, so that their first 16 functions are all different."""
    shuffled = [np.argsort(mix(np.arange(FUNCTIONS, dtype=np.uint64) + np.uint64(1000 * r + 7))) for r in range(-(-ORDERS // 8))]
    return np.stack([np.roll(shuffled[t // 8], -FUNCTIONS // 8 * (t % 8)) for t in range(ORDERS)])


def _order_batches(depth: int, every: bool):
    """For each set in each order, or in those of the bits of ``trees``: the first 16 values in two longs, and a name of the first ``depth``."""
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sequences()
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = unpacked(batch.column("sketch"))
            trees = np.full(batch.num_rows, -1) if every else batch.column("trees").to_numpy()
            for t in range(ORDERS):
                own = np.flatnonzero(trees >> t & 1)
                if not len(own):
                    continue
                values = np.ascontiguousarray(sketch[own][:, of[t]])
                key = np.ascontiguousarray(values[:, :16]).view(">u8").astype(np.uint64)
                name = key[:, 0] & np.uint64((1 << 64) - (1 << 8 * max(0, 8 - depth)))
                if depth > 8:
                    longs = np.ascontiguousarray(values[:, :depth]).view(np.uint64)
                    name = np.zeros(len(own), np.uint64)
                    for j in range(longs.shape[1]):
                        name = mix(name ^ longs[:, j]) + np.uint64(j)
                columns = [key[:, 0], key[:, 1], name]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), t, np.int32)), *(pa.array(c.astype(np.int64)) for c in columns), batch.column("sig").take(pa.array(own))], ["tree", "k1", "k2", "name", "sig"])

    return placed


PLACED = "tree int, k1 long, k2 long, name long, sig long"
REGION_KEY = ("tree", "name")


def regions(orders: DataFrame, depth: int) -> DataFrame:
    """The rows in a region of two sets or more, with its number of sets and its smallest one; stored."""
    known = orders.groupBy(*REGION_KEY).agg(F.count("*").alias("sets"), F.min("sig").alias("pivot")).filter("sets > 1")
    # the counts are stored first, so that a crowded region can be split in the join
    known = stored(known, "regions")
    found = stored(orders.join(small(known), list(REGION_KEY)).withColumn("depth", F.lit(depth)), "region-rows")
    dropped(known)
    return found


def forest(classes: DataFrame) -> list[DataFrame]:
    """The rows of regions at each depth tried: at the first one all sets, at the next ones those of crowded regions."""
    levels: list[DataFrame] = []
    for depth in DEPTHS:
        if levels:
            crowded = levels[-1].filter(F.col("sets") > REGION)
            if crowded.isEmpty():
                break
            # a set meets its sketch once, with its orders as bits
            trees = crowded.groupBy("sig").agg(F.expr("bit_or(shiftleft(1, tree))").alias("trees"))
            sets = stored(trees.join(classes.select("sig", "sketch"), "sig"), "crowded-sets")
            levels.append(regions(sets.mapInArrow(_order_batches(depth, False), PLACED), depth))
            dropped(sets)
        else:
            levels.append(regions(classes.select("sig", "sketch").mapInArrow(_order_batches(depth, True), PLACED), depth))
    return levels


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of unconnected neighbours in each region, from rows in the sorted orders; the last region of a batch waits for the next one."""
    names = ("tree", "depth", "name", "sig", "group")
    rest: list[np.ndarray] | None = None
    for batch in _and_end(batches):
        rows = [batch.column(c).to_numpy() for c in names] if batch is not None else None
        if rest is not None:
            rows = [np.append(a, b) for a, b in zip(rest, rows)] if rows else rest
        if rows is None or not len(rows[0]):
            continue
        fresh = np.append(True, np.any([c[1:] != c[:-1] for c in rows[:3]], axis=0))
        run = np.cumsum(fresh) - 1
        done = run < run[-1] if batch is not None else np.ones(len(run), bool)
        rest = [c[~done] for c in rows] if batch is not None else None
        sig, group = rows[3], rows[4]
        pairs = []
        for step in range(1, REGION):
            i = np.flatnonzero(done[:-step] & (run[:-step] == run[step:]) & (group[:-step] != group[step:])) if len(run) > step else np.zeros(0, np.int64)
            if len(i):
                pairs.append(np.stack([np.minimum(sig[i], sig[i + step]), np.maximum(sig[i], sig[i + step])], 1))
        if pairs:
            found = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def neighbours(leaves: DataFrame) -> DataFrame:
    """a, b: unconnected sets of one region of at most REGION, next to each other in one of the sorted orders."""
    rows = leaves.repartitionByRange(*REGION_KEY).sortWithinPartitions("tree", "depth", "k1", "k2", "name", "sig")
    return rows.select("tree", "depth", "name", "sig", "group").mapInArrow(_neighbour_batches, "a long, b long")


def _agreeing_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that sizes and sketches leave possible."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (unpacked(batch.column(f"{x}_sketch")) for x in "ab")
        n, m = (batch.column(f"{x}_n").to_numpy() for x in "ab")
        keep = ((one == two).sum(1) >= AGREED) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        yield batch.select(["a", "b", "a_rep", "b_rep"]).filter(pa.array(keep))


def candidates(pairs: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """lo, hi, a, b: the pairs that are not among those tried, each once, with one of its sets as the centre a; stored."""
    once = pairs.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("a").alias("a"))
    if tried is not None:
        once = once.join(tried.select("lo", "hi"), ["lo", "hi"], "left_anti")
    return stored(once.withColumn("b", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))), "candidates")


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, a_rep, b_rep of the pairs that may link; stored."""
    sides = [classes.select(F.col("sig").alias(x), F.col("rep").alias(f"{x}_rep"), F.col("n_shingles").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in "ab"]
    kind = classes.schema["rep"].dataType.simpleString()
    return stored(pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").mapInArrow(_agreeing_batches, f"a long, b long, a_rep {kind}, b_rep {kind}"), "possible")


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig, data = [], []
        for own in shingle_sets(batch.column("text"), WORDS):
            sig.append(signature(own)[0])
            data.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(data, pa.binary())], ["sig", "shingles"])


def linked(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether 100 * intersection >= PERCENT * union, of sorted sets."""
    if len(one) < len(two):
        one, two = two, one
    at = np.minimum(np.searchsorted(one, two), len(one) - 1)
    common = int((one[at] == two).sum())
    return 100 * common >= PERCENT * (len(one) + len(two) - common)


def _confirming_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links between the centres and partners of a place, from rows sorted by place with the centres first."""
    place, known = None, {}
    for batch in batches:
        a, b = [], []
        columns = [batch.column(c).to_pylist() for c in (*PLACE_KEY, "centres", "sig", "rep", "shingles")]
        for home, block, part, centres, sig, own, data in zip(*columns):
            if place != (home, block, part):
                place, known = (home, block, part), {}
            shingles = np.frombuffer(data, np.uint64)
            if centres is None:
                known[sig] = own, shingles
                continue
            for rep, other in (known[c] for c in centres if c in known):
                if linked(other, shingles):
                    a.append(rep)
                    b.append(own)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.column("rep").type), pa.array(b, batch.column("rep").type)], ["a", "b"])


PLACE_KEY = ("home", "block", "part")


def placed(pairs: DataFrame) -> DataFrame:
    """home, block, part, centres, sig, rep: the sets that meet at each place, each once; centres are null for a centre, else those that the set meets there.

    The least hash of a partner is the same for two centres as often as they share partners.
    """
    centres = stored(pairs.groupBy("a", "a_rep").agg(F.min(F.xxhash64("b")).alias("home"), F.count("*").alias("pairs")), "centres")
    blocks = centres.groupBy("home").agg(F.ceil(F.count("*") / BUNDLE).alias("blocks"))
    held = stored(centres.join(blocks, "home").withColumn("block", F.pmod(F.xxhash64("a"), "blocks")).select("a", "a_rep", "home", "block", "pairs"), "held")
    parts = held.groupBy("home", "block").agg(F.ceil(F.sum("pairs") / PLACE).alias("parts"))
    where = small(stored(held.drop("pairs").join(parts, ["home", "block"]), "bundles"))
    met = pairs.join(where.drop("a_rep"), "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    partners = met.groupBy(*PLACE_KEY, F.col("b").alias("sig"), F.col("b_rep").alias("rep")).agg(F.collect_set("a").alias("centres"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    own = where.select("home", "block", everywhere, F.col("a").alias("sig"), F.col("a_rep").alias("rep"))
    rows = stored(partners.unionByName(own, allowMissingColumns=True), "compared")
    dropped(centres, held)
    return rows


def shingled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """sig and shingles of the documents of these ids."""
    return docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi").select("text").mapInArrow(_set_batches, "sig long, shingles binary")


def confirmed(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b (doc_ids of classes): the stored pairs that link by their full sets; stored."""
    kind = pairs.schema["a_rep"].dataType.simpleString()
    rows = placed(pairs)
    sets = shingled(docs, stored(rows.select(F.col("rep").alias("doc_id")).distinct(), "wanted"))
    met = sets.join(small(rows), "sig").repartition(*PLACE_KEY).sortWithinPartitions(*PLACE_KEY, F.col("centres").isNotNull(), "sig")
    links = stored(met.mapInArrow(_confirming_batches, f"a {kind}, b {kind}"), "links")
    dropped(rows, pairs)
    return links


def _outside(crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """In crowded regions (stored rows with their group): pairs of sets outside the main group with the others, and the rows of regions with more than OUTSIDE outside."""
    sizes = crowded.groupBy(*REGION_KEY, "group").agg(F.count("*").alias("n")).groupBy(*REGION_KEY).agg(F.max_by("group", F.struct("n", "group")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"))
    sizes = stored(sizes.filter("outside > 0"), "mains")
    few = small(sizes.filter(F.col("outside") <= OUTSIDE).drop("outside"))
    some = stored(crowded.join(few, list(REGION_KEY)).filter("group <> main").select(*REGION_KEY, F.col("sig").alias("own"), F.col("group").alias("of")), "outside")
    pairs = crowded.join(small(some), list(REGION_KEY)).filter("group <> of").select(F.col("own").alias("a"), F.col("sig").alias("b"))
    many = small(sizes.filter(F.col("outside") > OUTSIDE).select(*REGION_KEY))
    return pairs, crowded.join(many, list(REGION_KEY), "left_semi").select(F.col("pivot").alias("a"), F.col("sig").alias("b"))


BLOCK_KEY = ("crowd", "level", "apart", "part")


def blocks(sets: DataFrame) -> DataFrame:
    """sets (stored: sig, rep, n_shingles, sketch, group, crowd) with the block of each; stored.

    Sets that link have the same level or two neighbouring ones; apart is a set outside the crowd's main group.
    """
    mains = sets.groupBy("crowd", "group").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.count("*").alias("groups"))
    mains = small(stored(mains.filter("groups > 1").drop("groups"), "crowds"))
    # a little wider than the bound, for rounding
    level = F.floor(F.log(F.col("n_shingles").cast("double")) / np.log(100 / (PERCENT - 1))).cast("int")
    sets = sets.join(mains, "crowd").withColumns({"level": level, "apart": F.col("group") != F.col("main")}).drop("main")
    parts = sets.groupBy(*BLOCK_KEY[:3]).agg(F.ceil(F.sum("n_shingles") / BLOCK).alias("parts"))
    return stored(sets.join(small(stored(parts, "parts")), list(BLOCK_KEY[:3])).withColumn("part", F.pmod(F.xxhash64("sig"), "parts")).drop("parts"), "dealt")


def meetings(dealt: DataFrame) -> DataFrame:
    """The blocks of each place, with side 0 or 1: two blocks that may have links, or a block with itself, unless all sets there are connected; stored."""
    known = dealt.groupBy(*BLOCK_KEY).agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
    one, two = (F.struct(*(f"{x}.{c}" for c in BLOCK_KEY[1:])) for x in "xy")
    near = known.withColumn("at", F.explode(F.array("level", F.col("level") - 1)))
    met = known.alias("x").join(near.alias("y"), (F.col("x.crowd") == F.col("y.crowd")) & (F.col("x.level") == F.col("y.at")) & (one <= two))
    met = met.filter(F.least("x.lo", "y.lo") != F.greatest("x.hi", "y.hi")).select(F.xxhash64("x.crowd", one, two).alias("place"), F.col("x.crowd").alias("crowd"), one.alias("one"), two.alias("two"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("of")), F.struct(F.lit(1).alias("side"), F.col("two").alias("of")))
    each = met.withColumn("s", F.explode(F.when(F.col("one") == F.col("two"), F.slice(sides, 1, 1)).otherwise(sides)))
    return stored(each.select("place", "s.side", "crowd", "s.of.*"), "meetings")


def met_links(side: np.ndarray, group: np.ndarray, sketch: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the groups of a place: of the sets of side 0 with those of side 1, or with each other if there are no others.

    What a link connects is one group from then on.
    """
    size = np.array([len(s) for s in sets])
    ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    # what only one set has counts for its size alone, and a set with too much of it links with none
    shared = times[ids] > 1
    ends = np.cumsum(np.add.reduceat(shared, np.cumsum(size) - size, dtype=np.int64))
    ids, marks = ids[shared].astype(np.int32), np.zeros(len(times), np.int32)
    width = np.diff(ends, prepend=0)
    starts = ends - width
    able = 100 * width >= PERCENT * size
    group = np.unique(group, return_inverse=True)[1]
    first = int((side == 0).sum())
    found = []
    for i in np.flatnonzero(able[:first]).tolist():
        at = first if first < len(sets) else i + 1
        others = at + np.flatnonzero((group[at:] != group[i]) & able[at:] & (100 * np.minimum(size[i], size[at:]) >= PERCENT * np.maximum(size[i], size[at:])))
        # equal values are counted eight at a time
        agreed = (sketch[others] == sketch[i]).view(np.uint64).sum(1, dtype=np.uint64) * np.uint64(0x0101010101010101) >> np.uint64(56)
        others = others[agreed >= AGREED]
        if not len(others):
            continue
        marks[ids[starts[i] : ends[i]]] = 1
        for low in range(0, len(others), PLACE):
            some = others[low : low + PLACE]
            some = some[group[some] != group[i]]
            until = np.cumsum(width[some])
            total = np.cumsum(marks[ids[np.repeat(starts[some] - until + width[some], width[some]) + np.arange(width[some].sum())]])
            common = np.diff(total[until - 1], prepend=0)
            for j in some[100 * common >= PERCENT * (size[i] + size[some] - common)].tolist():
                if group[j] != group[i]:
                    found.append((i, j))
                    group[group == group[j]] = group[i]
        marks[ids[starts[i] : ends[i]]] = 0
    return found


def _meeting_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each place, from rows sorted by place and side."""
    names = ("place", "side", "group", "rep", "sketch", "shingles")
    held: list[tuple] = []

    def links(kind: pa.DataType) -> pa.RecordBatch:
        _, side, group, rep, sketch, sets = zip(*held)
        found = met_links(np.array(side), np.array(group), np.frombuffer(b"".join(sketch), np.uint8).reshape(-1, FUNCTIONS), [np.frombuffer(s, np.uint64) for s in sets])
        return pa.RecordBatch.from_arrays([pa.array([rep[p[x]] for p in found], kind) for x in (0, 1)], ["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.column("rep").type
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if held and held[0][0] != row[0]:
                yield links(kind)
                held = []
            held.append(row)
    if held:
        yield links(kind)


def crowd_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b (doc_ids of classes): links that connect all that is linked in each crowd (stored sets: sig, rep, n_shingles, sketch, group, crowd); stored."""
    kind = sets.schema["rep"].dataType.simpleString()
    dealt = blocks(sets)
    met = meetings(dealt)
    # a set is read once, whatever number of blocks it meets
    full = shingled(docs, dealt.select(F.col("rep").alias("doc_id")).distinct())
    full = stored(full.dropDuplicates(["sig"]).join(small(dealt.drop("n_shingles")), "sig"), "crowd-sets")
    rows = full.join(small(met), list(BLOCK_KEY)).select("place", "side", "group", "rep", "sketch", "shingles")
    links = stored(rows.repartition("place").sortWithinPartitions("place", "side").mapInArrow(_meeting_batches, f"a {kind}, b {kind}"), "links")
    dropped(dealt, met, full)
    return links


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    rows = profile(docs)
    classes = stored(
        rows.filter("n_shingles > 0").groupBy("sig", "sig_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")).filter("rep IS NOT NULL"),
        "classes",
    )
    found = small(_connected(docs, classes))
    of_class = classes.join(found, "rep", "left").select("sig", "sig_b", "n_shingles", F.coalesce("component", "rep").alias("of_class"))
    key = [F.col(f"r.{c}") == F.col(f"c.{c}") for c in ("sig", "sig_b", "n_shingles")]
    named = rows.select("doc_id", "n_shingles", "sig", "sig_b").alias("r").join(of_class.alias("c"), key, "left")
    named = named.select("r.doc_id", "r.n_shingles", F.coalesce("c.of_class", "r.doc_id").alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _connected(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, component of every class that has a link; stored."""
    levels = forest(classes)
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionByName(level)
    pairs = rows.filter("sig <> pivot").select(F.col("pivot").alias("a"), F.col("sig").alias("b"))
    first = candidates(pairs)
    of = stored(components(confirmed(docs, possible(first, classes))), "components")

    def grouped(some: DataFrame, name: str) -> DataFrame:
        """``group``: a hash of the component so far; stored."""
        named = small(stored(classes.select("sig", "rep").join(small(of.withColumnRenamed("node", "rep")), "rep").select("sig", F.xxhash64("component").alias("group")), "groups"))
        return stored(some.join(named, "sig", "left").withColumn("group", F.coalesce("group", F.xxhash64("sig", F.lit(0)))), name)

    def connected(links: DataFrame) -> DataFrame:
        """The components with these links; what is connected so far stands for the links found before."""
        if links.isEmpty():
            return of
        so_far = of.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stored(components(so_far.unionByName(links)), "components")

    rows = grouped(levels[0], "rows")
    dropped(*levels)
    pairs, crowded = neighbours(rows.filter(F.col("sets") <= REGION)), None
    if len(levels) > 1:
        more, crowded = _outside(rows.filter(F.col("sets") > REGION))
        pairs, crowded = pairs.unionByName(more), stored(crowded, "crowded")
    fresh = candidates(pairs, first)
    of = connected(confirmed(docs, possible(fresh, classes)))
    dropped(first, fresh)
    if crowded is not None and not crowded.isEmpty():
        crowds = stored(components(crowded).select(F.col("node").alias("sig"), F.col("component").alias("crowd")), "crowds")
        sets = grouped(classes.select("sig", "rep", "n_shingles", "sketch").join(small(crowds), "sig"), "crowd")
        of = connected(crowd_links(docs, sets))
        dropped(crowds, sets, crowded)
    return of.withColumnRenamed("node", "rep")


def op11_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
