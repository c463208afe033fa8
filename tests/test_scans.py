"""Windows that carry state over the chunks of long keys: the same rows as with whole keys."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import joins, scans, windows


def samples(spark):
    rng = random.Random(8)
    rows = []
    for key, n in (("long", 400), ("other", 90), ("short", 5), ("bunched", 60)):
        times = sorted(rng.sample(range(100_000), n)) if key != "bunched" else [*range(58), 5_000, 900_000]
        for t in times:
            value = None if rng.random() < 0.6 else float(rng.randrange(9))
            rows.append((key, float(t), value, rng.choice(["a", "a", "b", "", None]), rng.random() < 0.3))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t double, v double, label string, ok boolean").repartition(3)


def marks(df, odd):
    return df.filter((F.col("t") % 3 == 0) if odd else (F.col("t") % 3 != 0)).select("k", "t", F.coalesce("v", F.lit(-1.0)).alias("v"))


#: Name, and the operator over the samples.
OPERATORS = {
    "runs": lambda s: windows.run_segments(s, "k", "t", "label"),
    "gaps": lambda s: windows.gap_summary(s, "k", "t", F.col("ok"), 300),
    "blocks": lambda s: windows.present_blocks(s, "k", "t", ~F.col("ok"), 200),
    "filled": lambda s: windows.fill_short_gaps(s, "k", "t", "v", 2),
    "trials": lambda s: windows.trials_from_steps(s, "k", "t", F.col("ok")),
    "asof": lambda s: joins.asof_prior(marks(s, True), marks(s, False), "k", "t", "v"),
    "next": lambda s: joins.next_match(s, "k", "t", F.col("ok"), F.col("label") == "b"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_chunks_change_nothing(spark, monkeypatch, name):
    s = samples(spark)
    whole = sorted(map(str, OPERATORS[name](s).collect()))
    monkeypatch.setattr(scans, "CHUNK", 7)
    assert scans.long_keys(s, ["k"], "t").count() == 3
    assert sorted(map(str, OPERATORS[name](s).collect())) == whole and whole


def test_against_plain_loops(spark, monkeypatch):
    """A running sum, and last and next values, row by row."""
    monkeypatch.setattr(scans, "CHUNK", 11)
    s = samples(spark)
    t = scans.carried(s, ["k"], ["t"], scans.long_keys(s, ["k"], "t"), last={"l": F.col("v")}, before={"b": F.col("v")}, upto={"n": F.lit(1)}, after={"a": F.col("v")}, coming={"c": F.col("v")})
    groups: dict = {}
    for r in t.collect():
        groups.setdefault(r.k, []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: r.t)
        known = [(i, r.v) for i, r in enumerate(rows) if r.v is not None]
        for i, r in enumerate(rows):
            pick = lambda some: some[0] if some else None
            assert r.n == i + 1
            assert r.l == pick([v for j, v in known if j <= i][-1:]) and r.b == pick([v for j, v in known if j < i][-1:])
            assert r.c == pick([v for j, v in known if j >= i]) and r.a == pick([v for j, v in known if j > i])
