"""Fixations and held levels of recordings that are cut into pieces, against the plain loops over whole ones."""

import numpy as np
import pytest

from quillspan.operators import gaze, scans


def plain_fixations(t, x, y, dispersion=0.025, least=80.0, gap=75.0):
    out, begin = [], 0
    for i in range(1, len(t) + 1):
        if i < len(t) and t[i] - t[i - 1] <= gap and np.ptp(x[begin : i + 1]) <= dispersion and np.ptp(y[begin : i + 1]) <= dispersion:
            continue
        if i - begin >= 2 and t[i - 1] - t[begin] >= least:
            out.append((t[begin], t[i - 1], x[begin:i].mean(), y[begin:i].mean(), i - begin))
        begin = i
    return out


def recordings():
    """One without a gap, one with many, one that never moves, and a short one."""
    rng = np.random.default_rng(9)
    for name, n, gaps, still in (("whole", 900, 0.0, 0.1), ("gaps", 600, 0.05, 0.1), ("still", 300, 0.0, 0.0), ("few", 5, 0.0, 0.1)):
        t = np.cumsum(np.where(rng.random(n) < gaps, 200.0, 10.0))
        jump = np.cumsum(rng.random(n) < still)
        x, y = (0.5 + 0.1 * (jump * k % 5) + 0.004 * rng.random(n) for k in (1, 3))
        yield name, t, x, y


@pytest.mark.parametrize("piece", [1 << 16, 40])
def test_fixations_of_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(scans, "CHUNK", piece)
    monkeypatch.setattr(gaze, "PIECE", piece)
    rows = [(name, float(a), float(b), float(c)) for name, t, x, y in recordings() for a, b, c in zip(t, x, y)]
    df = spark.createDataFrame(rows + [("few", 1.0, None, 0.5)], "recording string, time_ms double, x double, y double").repartition(3)
    found = sorted(map(tuple, gaze.fixations(df, ["recording"], "time_ms").collect()))
    want = sorted((name, *f) for name, t, x, y in recordings() for f in plain_fixations(t, x, y))
    assert len(found) == len(want) > 40
    for a, b in zip(found, want):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:])


def plain_levels(v, step, frames):
    level, out = v[0], []
    for i in range(len(v)):
        ahead = v[i : i + frames]
        if abs(v[i] - level) >= step and len(ahead) == frames and (abs(ahead - v[i]) < step).all():
            level = v[i]
        out.append(level)
    return out


@pytest.mark.parametrize("piece", [1 << 16, 16])
def test_levels_of_chunks(spark, monkeypatch, piece):
    monkeypatch.setattr(scans, "CHUNK", piece)
    monkeypatch.setattr(gaze, "PIECE", piece)
    rng = np.random.default_rng(3)
    tracks = {
        "noisy": np.repeat(rng.integers(0, 6, 60) / 10, 8) + 0.02 * rng.random(480), "ramp": np.linspace(0, 1, 300), "flat": np.full(100, 0.5),
        "slow": np.repeat(np.arange(40) * 0.03, 6), "short": np.array([0.1, 0.9]), "jumps": rng.integers(0, 3, 200) / 2.0,
    }
    rows = [(k, i, float(x)) for k, v in tracks.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, frame int, v double").repartition(3)
    found = {(r.k, r.frame): r.level for r in gaze.held_levels(df, "k", "frame", "v", 0.05).collect()}
    assert len(found) == len(rows)
    for k, v in tracks.items():
        assert [found[k, i] for i in range(len(v))] == plain_levels(v, 0.05, 5)


@pytest.mark.parametrize("piece", [1 << 16, 25])
def test_velocities_of_pieces(spark, monkeypatch, piece):
    """Against parabolas fitted sample by sample; the edges read those of the first and the last whole window."""
    monkeypatch.setattr(scans, "CHUNK", piece)
    monkeypatch.setattr(gaze, "PIECE", piece)
    rng = np.random.default_rng(1)
    series = {"long": np.cumsum(rng.normal(size=203)), "even": np.cumsum(rng.normal(size=50)), "one": rng.normal(size=9), "none": rng.normal(size=8)}
    df = spark.createDataFrame([(k, 10.0 * i, float(x)) for k, v in series.items() for i, x in enumerate(v)], "k string, t double, v double").repartition(3)
    found = {(r.k, r.t): r.velocity for r in gaze.smoothed_velocity(df, "k", "t", "v", 9).collect()}
    for k, v in series.items():
        for i in range(len(v)):
            got = found[k, 10.0 * i]
            if len(v) < 9:
                assert np.isnan(got)
                continue
            c = min(max(i, 4), len(v) - 5)
            a, b, _ = np.polyfit(np.arange(-4, 5), v[c - 4 : c + 5], 2)
            assert got == pytest.approx((b + 2 * a * (i - c)) / 0.01)
