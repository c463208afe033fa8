"""Hard negatives against brute force over all rows, and the elimination of the tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """The contract, row by row."""
    stock = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        stock.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v], label))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, (vec_id, q, label) in enumerate(stock):
        if vec_id is None or vec_id % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, w)), other, of) for j, (other, w, of) in enumerate(stock) if j != i]
        for ps, positive, _ in sorted((t for t in scored if t[2] == label), key=order)[:5]:
            negatives = sorted((t for t in scored if t[2] != label and 80 * ps <= 100 * t[0] <= 100 * ps), key=order)[:5]
            out += [(vec_id, positive, k + 1, other, ps, s) for k, (s, other, _) in enumerate(negatives)]
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("row", "cell", "block", "part", "low", "high", "score", "vector", "asks")})
    return sorted(map(tuple, hn.hard_negatives(df).collect()), key=str)


def around(rng, n, centres, spread):
    middle = rng.normal(size=(centres, 16))
    x = middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize(("leaf", "block", "part"), [(96, 2048, 2048), (8, 40, 2)])
def test_equals_brute_force(spark, monkeypatch, leaf, block, part):
    for name, value in (("LEAF", leaf), ("BLOCK", block), ("PART", part)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(3)
    x = around(rng, 700, 12, 0.4).astype(np.float32).tolist()
    rows = [(i, v, int(rng.integers(0, 4))) for i, v in enumerate(x)]
    hot = x[0]
    rows += [(1000 + i, hot, i % 2) for i in range(250)]  # one vector, a quarter of all rows
    rows += [(3000, None, 1), (3001, x[1], None), (3002, [*x[1][:-1], None], 1), (3100, [*x[1][:-1], math.nan], 1), (3200, [math.inf] * 16, 1)]
    rows += [(None, x[2], 1), (None, x[2], 2), (3300, [], 1), (3400, [0.0] * 16, 2), (3500, [-v for v in hot], 3), (3501, x[5][:7], 1), (3600, x[6] + [0.5], 2), (3700, [9e4] * 16, 9)]
    rows += [(200, x[200], 1), (200, x[200], 1), (201, x[200], 3)]
    assert found(spark, rows) == brute(rows)


def test_small_and_empty_tables(spark):
    assert found(spark, [(0, None, 1), (1, None, None)]) == []
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.9, 0.1], 2)]
    assert found(spark, few) == brute(few)


def test_subtrees_out_of_reach_are_left_out():
    rng = np.random.default_rng(5)
    x = np.floor(256 * around(rng, 4000, 40, 0.05))
    tree = hn.Tree(x[:1000], float((x * x).sum(1).max()))
    cell = tree.route(x, ranges=True)
    assert tree.cells > 20 and len(np.unique(cell)) > 20
    asks = x[:200]
    scores = asks @ x.T
    high = np.sort(scores, axis=1)[:, -2:-1]
    low = np.ceil(0.8 * high)
    met = np.zeros((len(asks), tree.cells), bool)
    for c, rows in tree.reached(asks, low, high):
        met[rows, c] = True
    a, b = np.nonzero((scores >= low) & (scores <= high))
    assert met[a, cell[b]].all()  # nothing of a window lies in a cell that is left out
    assert met.mean() < 0.5
