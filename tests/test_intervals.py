"""Interval joins of very unlike lengths, and permutations of labels by a bijection."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import joins, resample


@pytest.mark.parametrize("closed", [True, False])
def test_intervals_of_all_lengths(spark, closed):
    """Lengths over six orders of magnitude: two rows an interval at most, and the pairs of a plain loop."""
    rng = random.Random(5)
    samples = [(rng.choice("ab"), round(rng.uniform(-50, 20_000), 2)) for _ in range(500)] + [("a", 100.0), ("c", 1.0), ("a", None)]
    spans = []
    for i in range(80):
        start, length = round(rng.uniform(-100, 15_000), 2), round(10 ** rng.uniform(-2, 4), 2)
        spans.append((rng.choice("ab"), i, start, start + length))
    spans += [("a", 90, 100.0, 100.0), ("a", 91, 100.0, 90.0), ("a", 92, None, 5.0), ("a", 93, -1e6, 1e6)]
    s = spark.createDataFrame(samples, "k string, t double")
    v = spark.createDataFrame(spans, "k string, i int, f double, u double")
    found = sorted((r.k, r.t, r.i) for r in joins.window_join(s, v, "k", "t", "f", "u", 0.5, closed).collect())
    want = sorted((k, t, i) for k, t in samples if t is not None for g, i, f, u in spans if g == k and f is not None and f <= t and (t <= u if closed else t < u))
    assert found == want and len(found) > 500
    per = joins.leveled(v, "f", "u", 0.5).groupBy("i").count()
    assert per.agg(F.max("count")).first()[0] <= 2 and per.count() == 82


def test_permutations_keep_shares_and_move_everything(spark):
    t = spark.createDataFrame([("f" if i < 60 else "g", i, int(i % 3 == 0 if i < 60 else i == 60)) for i in range(97)], "fold string, subject int, label int").repartition(3)
    found = resample.permute_labels(t, ["fold"], "subject", 200)
    shares = found.groupBy("fold", "replicate").agg(F.sum("label").alias("n"), F.count("*").alias("rows"), F.count_distinct("subject").alias("subjects")).collect()
    assert len(shares) == 400 and all((r.n, r.rows, r.subjects) == ((20, 60, 60) if r.fold == "f" else (1, 37, 37)) for r in shares)
    often = {(r.fold, r.subject): r.share for r in found.groupBy("fold", "subject").agg(F.avg("label").alias("share")).collect()}
    assert all(abs(v - 1 / 3) < 0.15 for (f, _), v in often.items() if f == "f") and all(v < 0.12 for (f, _), v in often.items() if f == "g")
    drawn = found.filter("fold = 'f' AND label = 1").groupBy("replicate").agg(F.array_join(F.array_sort(F.collect_list("subject")), ",").alias("who"))
    assert drawn.select("who").distinct().count() == 200


def test_places_are_a_bijection(spark):
    for n in (1, 2, 7, 100):
        t = spark.range(n).select(resample.permuted_place(F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long")).alias("p"))
        assert sorted(r.p for r in t.collect()) == list(range(n))


def test_many_places_take_a_fixed_number_of_operations_each(spark):
    """The rounds against plain integers, and 100,000 places of 300,000; with nested expressions these took minutes."""
    import time

    import numpy as np

    def plain(place, n, replicate):
        def noise(x, turn):
            v = (x + turn * 48271 + replicate * 1640531527) % resample.PRIME
            v = (v * v + 12345 + x) % resample.PRIME
            return (v * v + turn) % resample.PRIME

        for turn in range(1, resample.ROUNDS + 1):
            partner = (noise(0, turn) - place) % n
            place = partner if noise(max(place, partner), turn) // 1024 % 2 == 1 else place
        return place

    began = time.time()
    for n, some in ((1, 1), (13, 13), (300_000, 100_000)):
        t = spark.range(some).select(resample.permuted_place(F.col("id"), F.lit(n).cast("long"), F.lit(100).cast("long")).alias("p"))
        found = np.array([r.p for r in t.collect()])
        assert len(set(found.tolist())) == some
        assert found[:200].tolist() == [plain(i, n, 100) for i in range(min(some, 200))]
    assert time.time() - began < 20


def test_counts_of_permutations_are_those_of_the_permuted_rows(spark, monkeypatch):
    rows = [(f, i, i % 3 // 2, None if i % 11 == 0 else i % 7 / 10) for f in (0, 1) for i in range(40 + 30 * f)]
    t = spark.createDataFrame(rows, "fold int, subject long, label int, probability double")
    for cells in (1, 20, 1 << 17):
        monkeypatch.setattr(resample, "CELLS", cells)
        found = resample.permuted_counts(t, ["fold"], "subject", 30, ["fold", "probability"])
        want = resample.permute_labels(t, ["fold"], "subject", 30).groupBy("fold", "probability", "replicate", "label").agg(F.count("*").alias("weight"))
        assert found.exceptAll(want.select(*found.columns)).count() == want.select(*found.columns).exceptAll(found).count() == 0
    # few rows are dealt to more tasks than one
    assert resample.permute_labels(t, ["fold"], "subject", 30).rdd.getNumPartitions() > 1


def test_rows_are_permuted_once_for_a_null_distribution(spark, tmp_path):
    from quillspan.plans.evaluation import QUERIES

    t = spark.range(0, 40)
    t.selectExpr("id AS doc_id", "'en' AS lang", "7 * id AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    t.selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    found = QUERIES["e24_permutation_null"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert found.count() == 1
