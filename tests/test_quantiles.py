"""Exact places of an order, found by ranges."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import quantiles


@pytest.mark.parametrize("few", [1 << 14, 3])
def test_values_at_any_place(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "RANGES", 8)
    rng = random.Random(7)
    for values in ([rng.gauss(0, 1e3) for _ in range(999)], [0.5] * 600 + [rng.random() for _ in range(40)], [float(i % 3) for i in range(50)], [1e300, -1e300, 0.0, None], [2.5]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        known = sorted(v for v in values if v is not None)
        ranks = [0, len(known) // 3, len(known) // 2, len(known) - 1]
        assert quantiles.values_at(df, "v", ranks) == [known[r] for r in ranks]
        assert quantiles.median(df, "v") == pytest.approx(df.agg(F.median("v")).first()[0])
    assert quantiles.median(spark.createDataFrame([(None,)], "v double"), "v") is None
