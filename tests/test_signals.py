"""Spectra and correlations that are made for many series at once."""

import math

import numpy as np
import pytest

from quillspan.operators import features, signals


def test_welch_of_long_short_and_broken_series_in_small_batches(spark):
    rng = np.random.default_rng(2)
    series = {(None if i == 3 else i): rng.normal(size=n).tolist() for i, n in enumerate((500, 16, 3, 40, 1, 17, 8, 9))}
    series[5][4] = None
    rows = [(k, i, v) for k, values in series.items() for i, v in enumerate(values)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows, "k int, i int, v double")
        found: dict = {}
        for r in sorted(signals.welch(df, ["k"], "i", "v", 64.0, 16).collect(), key=lambda r: r.frequency):
            found.setdefault(r.k, []).append((r.frequency, r.power))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert set(found) == set(series)
    for k, values in series.items():
        x = np.array(values, float)
        n = min(16, len(x))
        window = np.hanning(n + 1)[:n]
        parts = [x[a : a + n] for a in range(0, len(x) - n + 1, max(1, n // 2))]
        with np.errstate(invalid="ignore"):
            want = np.mean([np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts], axis=0) / (64.0 * (window**2).sum())
        want[1 : (n + 1) // 2] *= 2
        np.testing.assert_allclose([p for _, p in found[k]], want)
        np.testing.assert_allclose([f for f, _ in found[k]], np.fft.rfftfreq(n, 1 / 64.0))


def test_pairs_are_summed_before_they_leave_a_task(spark):
    df = spark.range(3000).selectExpr("id % 2 AS k", "id AS s", "explode(sequence(0, 9)) AS c").selectExpr("*", "cast((s * (c + 3) * 7) % 101 AS double) AS v")
    plan = features.connectivity(df, "k", "s", "c", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(flatten" not in plan and "explode(_v" not in plan
    # one row a pair, key and batch, not one a pair and sample
    assert "MapInArrow" in plan
    want = df.toPandas().pivot(index=["k", "s"], columns="c", values="v").groupby("k").corr()
    for r in features.connectivity(df, "k", "s", "c", "v").collect():
        c = want.loc[r.k].to_numpy()[np.triu_indices(10, 1)]
        assert r.n_pairs == 45 and r["mean"] == pytest.approx(c.mean(), abs=1e-9) and r["std"] == pytest.approx(c.std(), abs=1e-9)


def test_correlations_with_missing_repeated_and_odd_values(spark):
    rows = [(1, s, c, float((s * (c + 2)) % 7)) for s in range(20) for c in range(3) if (s + c) % 4]
    rows += [(1, 0, 0, None), (1, 3, None, 2.0), (1, 5, None, 4.0), (1, 6, None, 1.0), (2, 0, 0, 1.0), (3, 0, 0, float("nan")), (3, 0, 1, 2.0), (3, 1, 0, 1.0), (3, 1, 1, 5.0), (4, 0, 0, 2.0), (4, 0, 0, 3.0), (4, 1, 0, 1.0), (4, 1, 0, 7.0)]
    found = {r.k: r for r in features.connectivity(spark.createDataFrame(rows, "k int, s int, c int, v double"), "k", "s", "c", "v").collect()}
    by: dict = {}
    for k, s, c, v in rows:
        if k == 1 and v is not None:
            by.setdefault(c, {})[s] = v
    pairs = []
    for a, b in ((None, 0), (None, 1), (None, 2), (0, 1), (0, 2), (1, 2)):
        both = [(by[a][s], by[b][s]) for s in by[a] if s in by[b]]
        if len(both) > 1 and all(np.std([p[i] for p in both]) > 1e-4 for i in (0, 1)):
            pairs.append(np.corrcoef(np.array(both).T)[0, 1])
    assert found[1].n_pairs == len(pairs) and found[1]["mean"] == pytest.approx(np.mean(pairs), abs=1e-9)
    assert 2 not in found and math.isnan(found[3]["mean"])
    assert found[4].n_pairs == 1 and found[4]["mean"] == pytest.approx(-1.0 if (2 - 1) * (3 - 7) < 0 else 1.0)
