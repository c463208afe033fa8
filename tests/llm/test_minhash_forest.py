"""The LSH forest against brute force over all pairs, with the regions' bounds as they are and so low that all are crowded."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import minhash_forest as mf

SCHEMA = "doc_id long, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} or ({tuple(words)} if words else set())


def brute(rows):
    """doc_id, n_shingles, component_id, kept for rows with ids."""
    sets = [shingle_set(t) for _, t in rows]
    of = {i: i for i, _ in rows}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for x, (i, _) in enumerate(rows):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = sorted((root(i), root(rows[y][0])))
                of[b] = a
    return sorted((i, len(s), root(i), root(i) == i) for (i, _), s in zip(rows, sets))


def corpus(seed=11):
    """Families of copies at all distances around the threshold, a passage that very many share, and short texts."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = ["", None, "  \n", "One", "one", "one two", "One TWO", "a b c", "a b c d"]
    for family in range(30):
        base = rng.choice(words, 120).tolist()
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(1, 9))):
            own = list(base)
            for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
                own[at] = words[int(rng.integers(4000))]
            texts.append(" ".join(own))
    hub = rng.choice(words, 150).tolist()
    for _ in range(90):  # one large group of near copies of a text
        own = list(hub)
        for at in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            own[at] = words[int(rng.integers(4000))]
        texts.append(" ".join(own))
    passage = rng.choice(words, 200).tolist()
    texts += [" ".join(passage + rng.choice(words, int(rng.integers(30, 60))).tolist()) for _ in range(60)]  # alike, but under the threshold
    texts += texts[9:30]
    order = rng.permutation(len(texts))
    return [(int(i), texts[j]) for i, j in enumerate(order)]


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("sig", "rep", "component", "kept", "group", "tree", "part", "sketch", "n_shingles")})
    return sorted(tuple(r) for r in mf.near_classes(df).collect())


@pytest.mark.parametrize(("region", "missed"), [(40, 0.005), (3, 0.03)])
def test_equals_brute_force(spark, monkeypatch, region, missed):
    """No link that is none, and next to none missed, also with regions so small that nearly all are cut down to the last depth."""
    monkeypatch.setattr(mf, "REGION", region)
    monkeypatch.setattr(mf, "OUTSIDE", min(region, mf.OUTSIDE))
    monkeypatch.setattr(mf, "PLACE", 40)
    rows = corpus()
    got, want = found(spark, rows), brute(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    real = {r[0]: r[2] for r in want}
    assert all(real[r[0]] == real[r[2]] for r in got)
    kept, gone = sum(r[3] for r in want), sum(not r[3] for r in want)
    assert gone > 100 and sum(r[3] for r in got) - kept <= missed * gone


def test_recall_of_pairs_at_the_threshold(spark):
    """Single pairs just over the threshold, which nothing else connects: the hardest case."""
    rng = np.random.default_rng(2)
    rows, linked = [], 0
    for k in range(250):
        base = [f"p{k}x{i}" for i in range(200)]
        own = list(base)
        for at in range(5, 5 + 3 * 60, 60 + k % 3):
            own[at : at + 3] = [f"q{k}y{at}{j}" for j in range(3)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(own))]
    got, want = found(spark, rows), brute(rows)
    linked = sum(not r[3] for r in want)
    assert linked > 200 and sum(not r[3] for r in got) >= 0.99 * linked
    assert all(a[2] in (a[0], b[2]) for a, b in zip(got, want))


def test_awkward_rows(spark):
    rows = [(None, "the same few words"), (7, "the same few words"), (7, "the same few words"), (9, "the SAME few\twords "), (4, None), (4, ""), (None, None), (5, "x " * 9000), (6, "x " * 7000)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in mf.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (9, 2, 7, False), (4, 0, 4, True), (4, 0, 4, True), (None, 0, None, True), (5, 1, 5, True), (6, 1, 5, False)], key=str)
    assert mf.near_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_orders_of_one_shuffling_share_no_function():
    of = mf.sequences()
    assert of.shape == (mf.ORDERS, mf.FUNCTIONS) and (np.sort(of, axis=1) == np.arange(mf.FUNCTIONS)).all()
    for first in range(0, mf.ORDERS, 8):
        assert len(np.unique(of[first : first + 8, :16])) == mf.FUNCTIONS


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    both, a, b = (np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (6000, 1000, 1000))
    one, two = mf.sketches([np.unique(np.append(both, a)), np.unique(np.append(both, b))])
    assert abs((one == two).mean() - 0.75) < 0.12


def recorded(monkeypatch, *names):
    """The tables of these names that are stored from now on, as rows."""
    seen = {n: [] for n in names}
    real = mf.stored

    def stored(df, name):
        out = real(df, name)
        if name in seen:
            seen[name].append(out.collect())
        return out

    monkeypatch.setattr(mf, "stored", stored)
    return seen


def test_a_set_is_sent_once_to_many_centres(spark, monkeypatch):
    """12 centres that meet the same 200 partners: 2,400 pairs are compared, but far fewer sets are sent."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(212):
        own = list(base)
        for at in rng.choice(300, int(rng.integers(2, 7)), replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, SCHEMA)
    sig = {r.doc_id: r.sig for r in mf.profile(docs).collect()}
    assert len(set(sig.values())) == 212
    pairs = [(sig[a], sig[b], a, b) for a in range(12) for b in range(12, 212)]
    seen = recorded(monkeypatch, "compared")
    stored = mf.stored(spark.createDataFrame(pairs, "a long, b long, a_rep long, b_rep long"), "pairs")
    got = {(r.a, r.b) for r in mf.confirmed(docs, stored).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    want = {(a, b) for a in range(12) for b in range(12, 212) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert got == want and 0 < len(want) < 2400
    assert len(seen["compared"][0]) <= 400


def test_no_pair_is_tried_twice(spark, monkeypatch):
    seen = recorded(monkeypatch, "candidates")
    found(spark, corpus())
    tried = [tuple(sorted((r.a, r.b))) for rows in seen["candidates"] for r in rows]
    assert len(tried) == len(set(tried)) > 100


def crowded_copies(copies=300, words=800):
    """A text and its near copies at just over the threshold, which are under it to one another."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(words)]
    rows = [(copies, " ".join(base))]
    for k in range(copies):
        own = list(base)
        for at in rng.choice(words // 4 - 1, 20, replace=False) * 4 + 1:
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [1 << 19, 12000])
def test_copies_of_one_text_in_a_crowd_that_does_not_link(spark, monkeypatch, block):
    """Each copy has one link, to a set that is no region's smallest but by chance, and meets it only in crowded regions; also over many blocks."""
    monkeypatch.setattr(mf, "REGION", 3)
    monkeypatch.setattr(mf, "OUTSIDE", 3)
    monkeypatch.setattr(mf, "BLOCK", block)
    rows = crowded_copies()
    want = brute(rows)
    assert sum(r[3] for r in want) == 1
    seen = recorded(monkeypatch, "dealt", "meetings")
    assert found(spark, rows) == want
    n = len({(r.crowd, r.level, r.apart, r.part) for r in seen["dealt"][0]})
    assert len(seen["dealt"][0]) > 250 and n > (15 if block == 12000 else 0)
    # places of two blocks and of one with itself
    assert len({r.place for r in seen["meetings"][0]}) <= n * (n + 1) // 2


def test_met_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    sets = []
    for _ in range(160):
        own = base.copy()
        at = rng.choice(200, int(rng.integers(4, 40)), replace=False)
        own[at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
        sets.append(np.unique(own)[int(rng.integers(0, 12)) :])
    sketch, group = mf.sketches(sets), np.arange(160)
    group[:10] = 0

    def parts(pairs):
        of = group.tolist()
        for i, j in pairs:
            of = [of[i] if x == of[j] else x for x in of]
        return [of.index(x) for x in of]

    for first in (160, 70):
        pairs = [(i, j) for i in range(first) for j in range(first if first < 160 else 0, 160) if i != j and mf.linked(sets[i], sets[j])]
        got = mf.met_links(np.repeat([0, 1], [first, 160 - first]), group, sketch, sets)
        assert 0 < len(got) < len(pairs) and set(got) <= set(pairs) and parts(got) == parts(pairs)
