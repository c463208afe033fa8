"""Near-duplicate classes by an exact n-gram Jaccard join with T-occurrence search.

A document is the set of its distinct five-word shingles; two documents link when the Jaccard
similarity of their sets is 0.8 or more.

1. *Profile.*  Each task hashes the shingles of its documents and notes each set's size and
   signature, and the shingles it met in several texts.  Documents of one set form a class and are
   searched as one.
2. *Inverted lists.*  Linked sets of size n share at least T = ceil(0.8 n) shingles, so they share
   SHARED of the first n - T + SHARED in any common order, and more where their sizes are near
   (``needed_hits``).  The order puts shingles known to be frequent last, so the lists that are read are
   short; the very frequent ones are left to probing.
   Members of a list that are near in size form a run.  Short runs are merged: their pairs are
   counted, and a pair with as many hits as its sizes ask for is a candidate.  The members of a longer run form a star around its
   smallest member (for frequent shingles around the list's smallest signature, known by
   pre-aggregation and broadcast).  A linked pair without a common star thus has its hits in
   short runs alone, and all of them are counted.
3. *T-occurrence search.*  A star, in blocks of bounded size, is searched in memory by DivideSkip:
   the short inverted lists of a query are merged and counted, members with at
   least T - L hits are looked up by binary search in the L long lists, and those that
   reach the overlap remain.  The search runs twice: first over the first shingles of each set alone, a fifth of
   the bytes, which leaves the members that have a possible partner; then over the whole sets of these.
   Members known to be connected are not reported again, so a
   block hands on a spanning forest and never all its pairs.
4. *Blocks of large stars.*  A few pivots of every size class ask all blocks of their own and the next class, which
   connects the blocks of a star of near copies.  After the links so far are turned into components, the members
   outside a star's main component are sent, again their first shingles before their sets, as queries to its other blocks.  A block holds members of
   like size and is sent those queries alone whose sizes can link with its own; they are dealt over parts of bounded
   size, each with a copy of the block, so no task holds more than a block and a part.
5. *Components* by minimum-star steps; the label is the smallest doc_id.

Defined cases: null and empty texts, and texts of white space only, have an empty set, link with
nothing and are their own component (the doc_id); a text of one to four words has its whole
sequence as its only shingle; repeated rows are members of the same class and each gets its row;
a null doc_id takes part and gets the class's smallest id; an empty table gives an
empty result; other columns are ignored by ``near_classes`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents, dropped, lean, small, stored
from quillspan.llm.components import components
from quillspan.llm.textcore import mix, shingle_sets

WORDS = 5
#: Similarity in per cent.
PERCENT = 80
#: A shingle met in so many sets is put behind the others in the order of the lists.
FREQUENT = 32
#: So many of the most frequent shingles are known to all tasks (at most 12 bytes each).
FREQUENT_KEPT = 1 << 16
#: Shingles that a profile task holds before it counts them.
HELD_SHINGLES = 1 << 22
#: Inverted lists that two linked sets share at least, if they have as many shingles.
SHARED = 6
#: Runs of so many members are merged pair by pair, longer ones become stars.
SHORT_RUN = 12
#: Shingles of one block of a star, and of one part of the queries that a block is sent.
BLOCK_SHINGLES = 1 << 18
#: Blocks of one size class of a star, at most.
CLASS_BLOCKS = 1 << 20
#: Members of a size class that ask every block of their star's class and the next.
PIVOTS = 4
#: Inverted lists of more members than this are long.
LONG_LIST = 8


def needed_overlap(n: np.ndarray | int, m: np.ndarray | int):
    """The least intersection with which sets of n and m shingles link: 100 i >= 80 (n + m - i)."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def least_overlap(n: np.ndarray | int):
    """The least intersection of a set of n shingles with any set it links with."""
    return -(-PERCENT * n // 100)


def listed(n: np.ndarray | int):
    """How many shingles of a set of n are put into inverted lists, its first ones in the common order."""
    return np.minimum(n, n - least_overlap(n) + SHARED)


def needed_hits(n: np.ndarray | int, m: np.ndarray | int):
    """Listed shingles that linked sets of n and m have in common at least.

    Of the set whose listed part ends first, n - listed(n) shingles lie behind that end; the rest of the overlap is in both parts.
    """
    return np.maximum(1, needed_overlap(n, m) - np.maximum(n - listed(n), m - listed(m)))


#: The same in SQL, of columns n and m; ``div`` rounds positive numbers down.
_LISTED = f"least({{0}}, {{0}} - ({PERCENT} * {{0}} + 99) div 100 + {SHARED})"
NEEDED_HITS = (
    f"greatest(1, ({PERCENT} * (n + m) + {99 + PERCENT}) div {100 + PERCENT} - greatest(n - {_LISTED.format('n')}, m - {_LISTED.format('m')}))"
)


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    one = mix(shingles).sum(dtype=np.uint64)
    two = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(mix(np.array([one ^ np.uint64(len(shingles))]))[0].astype(np.int64)), int(two.astype(np.int64))


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(sets: list[np.ndarray]) -> pa.RecordBatch | None:
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        every.sort()
        at = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(every)))
        many = count > 1
        found = every[at[many]].view(np.int64)
        if not len(found):
            return None
        rest = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([rest.cast(kind), rest, rest, rest, pa.array(found), pa.array(count[many].astype(np.int64))], names)

    names = ["doc_id", "n_shingles", "sig_a", "sig_b", "shingle", "count"]
    held: dict[tuple[int, int], np.ndarray] = {}
    total = 0
    kind = pa.int64()
    for batch in batches:
        kind = batch.column("doc_id").type
        size, a, b = [], [], []
        for own in shingle_sets(batch.column("text"), WORDS):
            sig = signature(own)
            size.append(len(own))
            a.append(sig[0])
            b.append(sig[1])
            if sig not in held:
                held[sig] = own
                total += len(own)
        rest = pa.nulls(len(size), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), rest, rest], names)
        if total >= HELD_SHINGLES:
            if (out := counted(list(held.values()))) is not None:
                yield out
            held, total = {}, 0
    if held and (out := counted(list(held.values()))) is not None:
        yield out


def profile(docs: DataFrame) -> DataFrame:
    """A row per document (size and signature of its set) and rows of locally repeated shingles; stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, sig_a long, sig_b long, shingle long, count long"
    return stored(docs.select("doc_id", "text").mapInArrow(lean(_profile_batches), schema), "profile")


def frequent_shingles(profiled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and the rank of each (0: least frequent).

    This only shapes the order of the lists, which any fixed set of shingles would serve; so it is bounded
    by FREQUENT_KEPT whatever the input.
    """
    rows = (
        profiled.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("count").alias("n")).filter(F.col("n") >= FREQUENT)
        .orderBy(F.desc("n"), "shingle").limit(FREQUENT_KEPT).select("shingle").toPandas()
    )
    found = rows["shingle"].to_numpy(np.int64).view(np.uint64)[::-1]
    order = np.argsort(found)
    return found[order], order.astype(np.int64)


def in_order(own: np.ndarray, known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The listed shingles of a set, first in the common order first, and how many of them are not known to be frequent."""
    k = int(listed(len(own)))
    if not len(known):
        return own[:k], k
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    is_known = known[at] == own
    early = own[~is_known][:k]
    late = own[is_known][np.argsort(rank[at[is_known]])]
    return np.concatenate([early, late[: k - len(early)]]), len(early)


def _posting_batches(known: np.ndarray, rank: np.ndarray):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            shingle, sig, size, often = [], [], [], []
            for own in shingle_sets(batch.column("text"), WORDS):
                n = len(own)
                if not n or (key := signature(own)) in seen:
                    continue
                seen.add(key)
                first, rare = in_order(own, known, rank)
                shingle.append(first)
                often.append(np.arange(len(first)) >= rare)
                sig.append(np.full(len(first), key[0], np.int64))
                size.append(np.full(len(first), n, np.int32))
            if len(seen) > 200_000:
                seen.clear()
            if shingle:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(shingle).view(np.int64)), pa.array(np.concatenate(sig)), pa.array(np.concatenate(size)), pa.array(np.concatenate(often))],
                    ["shingle", "sig", "n", "frequent"],
                )

    return postings


def _star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of the pairs of short runs, and members of longer runs with the first member as centre.

    Rows come sorted by list, size and signature.  ``hits`` is null for members of longer runs.  The last run of a
    batch waits for the next one; of a longer run only its centre and the last members wait, and between these
    two no neighbours are compared, so that the run goes on from its last member.
    """
    names = ["centre", "sig", "hits"]
    rest: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    cut = False  # members between the first and the second row of rest were handed on
    for batch in _and_end(batches):
        if batch is None:
            if rest is None:
                return
            shingle, sig, n = rest
        else:
            shingle, sig, n = (batch.column(c).to_numpy() for c in ("shingle", "sig", "n"))
            n = n.astype(np.int64)
            if rest is not None:
                shingle, sig, n = np.append(rest[0], shingle), np.append(rest[1], sig), np.append(rest[2], n)
        if not len(shingle):
            continue
        again = np.append(False, (shingle[1:] == shingle[:-1]) & (sig[1:] == sig[:-1]) & (n[1:] == n[:-1]))
        shingle, sig, n = shingle[~again], sig[~again], n[~again]
        fresh = np.append(True, (shingle[1:] != shingle[:-1]) | (100 * n[:-1] < PERCENT * n[1:]))
        if cut:
            fresh[1] = False
        run = np.cumsum(fresh) - 1
        start = np.flatnonzero(fresh)
        length = np.bincount(run)
        done = run < run[-1] if batch is not None else np.ones(len(run), bool)
        if batch is not None:
            first = start[-1]
            keep = np.arange(first, len(run))
            cut = (cut and first == 0) or len(keep) > SHORT_RUN + 1
            if len(keep) > SHORT_RUN + 1:  # a longer run for certain: hand on all but its centre and the last members
                done[first + 1 : -SHORT_RUN] = True
                keep = np.append(first, keep[-SHORT_RUN:])
            rest = shingle[keep], sig[keep], n[keep]
        size, first_of = length[run], start[run]
        large = done & (size > SHORT_RUN)
        if large.any():
            pairs = np.unique(np.stack([sig[first_of[large]], sig[large]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int64())], names)
        short = done & (size <= SHORT_RUN)
        a, b = [], []
        for step in range(1, SHORT_RUN):
            i = np.flatnonzero(short[:-step] & (run[:-step] == run[step:])) if len(run) > step else np.zeros(0, np.int64)
            i = i[PERCENT * n[i + step] <= 100 * n[i]]
            if not len(i):
                continue
            a.append(np.minimum(sig[i], sig[i + step]))
            b.append(np.maximum(sig[i], sig[i + step]))
        if a:
            pairs, times = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(times.astype(np.int64))], names)


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def stars(docs: DataFrame, classes: DataFrame, known: np.ndarray, rank: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Members of stars and candidate pairs, both as centre, sig, rep, n and stored.

    Any two sets that link are members of a common star or a candidate pair (the centre is one of its two).
    """
    schema = "shingle long, sig long, n int, frequent boolean"
    postings = docs.select("text").mapInArrow(lean(_posting_batches(known, rank)), schema)
    near = stored(
        postings.filter("NOT frequent").drop("frequent").repartition("shingle").sortWithinPartitions("shingle", "n", "sig")
        .mapInArrow(lean(_star_batches), "centre long, sig long, hits long"),
        "near",
    )
    common = stored(postings.filter("frequent").select("shingle", "sig").distinct(), "frequent")
    # at most FREQUENT_KEPT rows of two numbers, so a broadcast
    centres = common.groupBy("shingle").agg(F.min("sig").alias("centre"), F.count("*").alias("members")).filter("members > 1")
    far = common.join(F.broadcast(centres), "shingle").select("centre", "sig")
    named = classes.filter("rep IS NOT NULL").select(F.col("sig_a").alias("sig"), "rep", F.col("n_shingles").alias("n"))
    two = near.filter("hits IS NOT NULL").groupBy("centre", "sig").agg(F.sum("hits").alias("hits"))
    two = two.join(named, "sig").join(named.select(F.col("sig").alias("centre"), F.col("rep").alias("centre_rep"), F.col("n").alias("m")), "centre")
    two = stored(two.filter(F.col("hits") >= F.expr(NEEDED_HITS)).select("centre", "sig", "rep", "n", "centre_rep", "m"), "pairs")
    pairs = two.select("centre", "sig", "rep", "n").unionByName(
        two.select("centre", F.col("centre").alias("sig"), F.col("centre_rep").alias("rep"), F.col("m").alias("n")).distinct()
    )
    members = near.filter("hits IS NULL").select("centre", "sig").unionByName(far).distinct()
    members = stored(members.join(named, "sig"), "members")
    dropped(near, common)
    return members, pairs


def _set_batches(cut):
    """signature and shingles of every text, a repeated text once a task; of the shingles those that ``cut`` leaves."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sig, data = [], []
            for own in shingle_sets(batch.column("text"), WORDS):
                key = signature(own)[0]
                if key in seen:
                    continue
                seen.add(key)
                sig.append(key)
                data.append(cut(own).tobytes())
            if len(seen) > 200_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(data, pa.binary())], ["sig", "shingles"])

    return sets


class Block:
    """The inverted lists of some sets, or of their listed shingles, searched by DivideSkip.

    ``sizes`` are those of the whole sets; ``needed(n, m)`` tells how many of the shingles given here
    linked sets of n and m have in common at least.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray, needed) -> None:
        self.m, self.sizes, self.needed = len(sets), sizes, needed
        every = np.concatenate(sets)
        member = np.repeat(np.arange(self.m, dtype=np.int64), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        every, self.member = every[order], member[order]
        new = np.append(True, every[1:] != every[:-1])
        self.names = every[new]
        self.start = np.append(np.flatnonzero(new), len(every))
        # list number and member in one sorted key, for binary search in any list
        self.keys = (np.cumsum(new) - 1) * self.m + self.member

    def search(self, query: np.ndarray, n: int) -> np.ndarray:
        """Members that have enough in common with the query, of a set of n, by their place in the block."""
        at = np.minimum(np.searchsorted(self.names, query), len(self.names) - 1)
        lists = at[self.names[at] == query]
        near = (PERCENT * self.sizes <= 100 * n) & (PERCENT * n <= 100 * self.sizes)
        wanted = self.needed(n, self.sizes)
        least = int(wanted[near].min()) if near.any() else self.m + len(query)
        if len(lists) < least:
            return np.zeros(0, np.int64)
        length = self.start[lists + 1] - self.start[lists]
        order = np.argsort(length, kind="stable")
        lists, length = lists[order], length[order]
        n_long = min(int((length > LONG_LIST).sum()), least - 1)
        n_short = len(lists) - n_long
        short, own = lists[:n_short], length[:n_short]
        # the short lists, merged: one run of places, counted by member
        ends = np.cumsum(own)
        places = np.repeat(self.start[short] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)
        hits = np.bincount(self.member[places], minlength=self.m)
        found = np.flatnonzero(near & (hits > 0) & (hits >= wanted - n_long))
        if n_long and len(found):
            hits = hits[found]
            wanted = wanted[found]
            long = lists[n_short:]
            for i in range(0, n_long, 64):  # probe, dropping members that can no longer reach the overlap
                probes = long[i : i + 64, None] * self.m + found[None, :]
                hit = np.searchsorted(self.keys, probes)
                hits = hits + (self.keys[np.minimum(hit, len(self.keys) - 1)] == probes).sum(0)
                alive = hits + max(0, n_long - i - 64) >= wanted
                found, hits, wanted = found[alive], hits[alive], wanted[alive]
                if not len(found):
                    break
            return found[hits >= wanted]
        return found[hits[found] >= wanted[found]]


class Forest:
    """Union-find over the rows of a block."""

    def __init__(self, groups: list) -> None:
        first: dict = {}
        self.parent = [first.setdefault(g, i) for i, g in enumerate(groups)]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


#: What names the rows that are searched together.
PLACE = ("centre", "block", "part")
#: Columns of a row that is searched, but for its doc_id and component.
ROW = "centre long, block long, part int, sig long, n long, asks boolean, answers boolean"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one place after the other, from rows sorted by place and sig; copies of a set are left out."""
    held: list[pa.Table] = []
    last: tuple | None = None
    keys = (*PLACE, "sig")
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in keys]
        same = [np.append(last is not None and c[0] == last[i], c[1:] == c[:-1]) for i, c in enumerate(columns)]
        here = same[0] & same[1] & same[2]
        last = tuple(c[-1] for c in columns)
        table = pa.Table.from_batches([batch])
        fresh = ~(here & same[3])
        cuts = [0, *(np.flatnonzero(~here[1:]) + 1).tolist(), len(here)]
        for x, y in zip(cuts, cuts[1:]):
            if not here[x] and held:
                yield pa.concat_tables(held)
                held = []
            own = table.slice(x, y - x).filter(pa.array(fresh[x:y]))
            if own.num_rows:
                held.append(own)
    if held:
        yield pa.concat_tables(held)


def _block_of(table: pa.Table, needed) -> tuple[list[np.ndarray], list[int], list[int], Block | None, np.ndarray]:
    """Sets, queries, members, the block of the members (None if nothing can be found) and the sizes."""
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
    queries = np.flatnonzero(table["asks"].to_numpy()).tolist()
    members = np.flatnonzero(table["answers"].to_numpy()).tolist()
    sizes = table["n"].to_numpy()
    some = table.num_rows > 1 and queries and members
    return sets, queries, members, Block([sets[j] for j in members], sizes[members], needed) if some else None, sizes


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from queries to members that connect what was not connected."""
    for table in _groups(batches):
        sets, queries, members, block, sizes = _block_of(table, needed_overlap)
        if block is None:
            continue
        rep = table["rep"].to_pylist()
        forest = Forest(table["component"].to_pylist())
        a, b = [], []
        for i in queries:
            for k in block.search(sets[i], int(sizes[i])).tolist():
                j = members[k]
                if j != i and forest.join(i, j):
                    a.append(rep[i])
                    b.append(rep[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, table["rep"].type), pa.array(b, table["rep"].type)], ["a", "b"])


def _possible_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The queries that have enough listed shingles in common with a member of another component, and those members."""
    names = ["centre", "block", "part", "sig", "n", "asks", "answers", "rep", "component"]
    for table in _groups(batches):
        sets, queries, members, block, sizes = _block_of(table, needed_hits)
        if block is None:
            continue
        component = np.unique(table["component"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
        of_member, members = component[members], np.array(members)
        asks, answers = np.zeros(len(sets), bool), np.zeros(len(sets), bool)
        for i in queries:
            found = block.search(sets[i], int(sizes[i]))
            found = members[found[of_member[found] != component[i]]]
            asks[i] = len(found) > 0
            answers[found] = True
        keep = asks | answers
        if keep.any():
            table = table.drop_columns(["asks", "answers", "shingles"]).append_column("asks", pa.array(asks)).append_column("answers", pa.array(answers))
            yield from table.filter(pa.array(keep)).select(names).to_batches()


def _sets_at(docs: DataFrame, rows: DataFrame, cut) -> DataFrame:
    """rows (stored) with the shingles of their sets, dealt by place."""
    wanted = small(stored(rows.select(F.col("rep").alias("doc_id")).distinct(), "wanted"))
    sets = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").select("text").mapInArrow(lean(_set_batches(cut)), "sig long, shingles binary")
    return sets.join(small(rows), "sig").repartition(*PLACE).sortWithinPartitions(*PLACE, "sig")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    profiled = profile(docs)
    rows = profiled.filter("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "sig_a", "sig_b")
    classes = stored(rows.filter("n_shingles > 0").groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    found = small(_connected(docs, profiled, classes, kind))
    of_class = classes.join(found, "rep", "left").select("sig_a", "sig_b", "n_shingles", F.coalesce("component", "rep").alias("of_class"))
    key = [F.col(f"r.{c}") == F.col(f"c.{c}") for c in ("sig_a", "sig_b", "n_shingles")]
    return rows.alias("r").join(of_class.alias("c"), key, "left").select(
        "r.doc_id", "r.n_shingles", F.coalesce("c.of_class", "r.doc_id").alias("component_id")
    )


def _connected(docs: DataFrame, profiled: DataFrame, classes: DataFrame, kind: str) -> DataFrame:
    """rep, component of every representative that has a link; stored."""
    known, rank = frequent_shingles(profiled)
    members, pairs = stars(docs, classes, known, rank)

    def possible(rows: DataFrame) -> DataFrame:
        found = _sets_at(docs, rows, lambda own: in_order(own, known, rank)[0]).mapInArrow(lean(_possible_batches), f"{ROW}, rep {kind}, component {kind}")
        found = stored(found, "possible")
        dropped(rows)
        return found

    def linked(rows: DataFrame) -> DataFrame:
        found = stored(_sets_at(docs, rows, lambda own: own).mapInArrow(lean(_link_batches), f"a {kind}, b {kind}"), "links")
        dropped(rows)
        return found

    def searched(rows: DataFrame, component: str, asks: bool, answers: bool) -> DataFrame:
        rows = rows.withColumns({"component": F.col(component), "asks": F.lit(asks), "answers": F.lit(answers)})
        return rows.select(*PLACE, "sig", "n", "asks", "answers", "rep", "component")

    size_class = F.floor(F.log("n") / math.log(100 / PERCENT)).cast("int")
    sized = members.withColumn("size_class", size_class).groupBy("centre", "size_class").agg(F.sum("n").alias("shingles"))
    over = sized.groupBy("centre").agg(F.sum("shingles").alias("total")).filter(F.col("total") > BLOCK_SHINGLES)
    large = sized.join(over, "centre", "left_semi").select("centre", "size_class", F.ceil(F.col("shingles") / BLOCK_SHINGLES).alias("blocks"))
    large = small(stored(large, "large"))
    block = F.col("size_class") * CLASS_BLOCKS + F.pmod(F.xxhash64("rep"), "blocks")
    placed = members.withColumn("size_class", size_class).join(large, ["centre", "size_class"], "left")
    placed = stored(
        placed.select("centre", "sig", "rep", "n", "size_class", F.coalesce(block, F.lit(0)).cast("long").alias("block"), F.lit(0).alias("part"), F.col("blocks").isNotNull().alias("wide")),
        "placed",
    )
    wide = placed.filter("wide")
    blocks = stored(
        wide.groupBy("centre", "size_class", F.col("block").alias("to")).agg(F.min("n").alias("least"), F.max("n").alias("most")), "blocks"
    )
    own = searched(placed, "rep", True, True)
    some_wide = not blocks.isEmpty()
    if some_wide:
        pivot = F.array(*(F.min(F.struct(F.xxhash64("sig", F.lit(i)).alias("h"), "sig", "rep", "n", "block")) for i in range(PIVOTS)))
        pivots = wide.groupBy("centre", "size_class").agg(F.array_distinct(F.transform(pivot, lambda x: x.dropFields("h"))).alias("p"))
        pivots = pivots.select("centre", F.col("size_class").alias("of"), F.explode("p").alias("p"))
        pivots = pivots.select("centre", F.explode(F.array("of", F.col("of") + 1)).alias("size_class"), "p.*")
        pivots = pivots.join(small(blocks), ["centre", "size_class"]).filter("to <> block").withColumn("block", F.col("to")).withColumn("part", F.lit(0))
        own = own.unionByName(searched(pivots, "rep", True, False))
    found = possible(stored(own, "own"))
    pairs = searched(pairs.withColumn("block", F.lit(-1).cast("long")).withColumn("part", F.lit(0)), "rep", True, True)
    pairs = pairs.withColumn("asks", F.col("sig") == F.col("centre")).withColumn("answers", F.col("sig") != F.col("centre"))
    rows = stored(found.unionByName(pairs), "rows")
    dropped(members, found)
    links = linked(rows)
    of = stored(components(links), "components").withColumnRenamed("node", "rep")
    dropped(links)
    if not some_wide:
        return of
    wide = stored(wide.join(small(of), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "wide")
    main = (
        wide.groupBy("centre", "component").agg(F.count("*").alias("size"))
        .groupBy("centre").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
    )
    outside = wide.join(small(stored(main, "main")), "centre").filter("component <> main").drop("main", "size_class")
    reaches = (F.col("to") != F.col("block")) & (PERCENT * F.col("n") <= 100 * F.col("most")) & (PERCENT * F.col("least") <= 100 * F.col("n"))
    asks = stored(outside.join(small(blocks), "centre").filter(reaches).withColumn("block", F.col("to")).drop("to", "least", "most", "size_class"), "asks")
    parts = asks.groupBy("centre", "block").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    parts = small(stored(parts, "parts"))
    # another hash than the one that deals members to blocks
    asks = asks.join(parts, ["centre", "block"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), "parts").cast("int"))
    answers = wide.join(parts, ["centre", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    more = stored(searched(asks, "component", True, False).unionByName(searched(answers, "component", False, True)), "more")
    links = linked(possible(more))
    if links.isEmpty():
        return of
    # the components so far are the nodes of what is left to do
    nodes = of.unionByName(links.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(of, "rep", "left_anti").withColumn("component", F.col("rep")))
    nodes = small(stored(nodes, "nodes"))
    ends = [nodes.select(F.col("rep").alias(c), F.col("component").alias(f"of_{c}")) for c in ("a", "b")]
    above = components(links.join(ends[0], "a").join(ends[1], "b").select("of_a", "of_b"), "of_a", "of_b")
    above = small(stored(above.select(F.col("node").alias("component"), F.col("component").alias("top")), "above"))
    return stored(nodes.join(above, "component", "left").select("rep", F.coalesce("top", "component").alias("component")), "components")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns."""
    found = stored(near_classes(docs), "near")
    gone = small(stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone"))
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = stored(found.filter("doc_id = component_id AND n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return left
    single = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return left.join(twice, "doc_id", "left_anti").unionByName(single)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
