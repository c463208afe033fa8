"""Means whose sign is rounding: samples are added in their order, in any partitions."""

import random

from quillspan.operators import gaze


def test_agreement_adds_in_order_in_any_partitions(spark):
    rng = random.Random(3)
    rows = []
    for recording in range(400):
        values = [rng.choice([0.07, 0.13, 0.29, 0.41, 0.6, 0.77]) for _ in range(4)]
        # as much above the middle as below it
        values += [1 - v for v in values]
        rng.shuffle(values)
        rows += [(recording, i, 0, 1, v) for i, v in enumerate(values)]
    want = {}
    for recording, _, _, _, v in rows:
        want[recording] = want.get(recording, 0.0) + (v - 0.5)
    want = {k: float(v > 0) for k, v in want.items()}
    assert 40 < sum(want.values()) < 360
    rng.shuffle(rows)
    for parts in (1, 7):
        t = spark.createDataFrame(rows, "recording int, sample int, segment int, expected int, x double").repartition(parts)
        found = {r.recording: r.agreement for r in gaze.direction_agreement(t, ["recording", "segment"], 3, "sample").collect()}
        assert found == want


def test_bootstrap_draws_go_down_one_level_for_any_number_of_subjects(spark):
    """As in the SQL of e13; from 16,385 subjects on there was a second level, with other draws."""
    import numpy as np
    from pyspark.sql import functions as F

    from quillspan.functions.clean import stable_number
    from quillspan.operators import bootstrap

    n = 20_000
    t = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("subject"))
    found = {r.subject: np.frombuffer(r.weights, np.uint8) for r in bootstrap.subject_weights(t, ["g"], "subject", 2).collect()}
    group = t.select((stable_number(0, F.col("g")) % bootstrap.PRIME).alias("v")).first().v
    order = [(r.h, r.subject) for r in t.select("subject", stable_number(0, F.col("g"), F.col("subject")).alias("h")).collect()]
    order.sort()
    children = [[s for h, s in order if h >> 28 == c] for c in range(16)]

    def draw(node, b, i):
        p = bootstrap.PRIME
        a = (group + 16807 * node + i) % p
        v = (a + b * 1640531527) % p
        y = (v * v + 12345 + a) % p
        z = (y * y + b) % p
        return (z * z + i) % p

    for b in (1, 2):
        counts = [0] * 16
        ends = np.cumsum([len(c) for c in children])
        for i in range(n):
            counts[int(np.searchsorted(ends, draw(0, b, i) * n // bootstrap.PRIME, "right"))] += 1
        want = dict.fromkeys(range(n), 0)
        for child, subjects in enumerate(children):
            for i in range(counts[child]):
                want[subjects[draw(1 + child, b, i) * len(subjects) // bootstrap.PRIME]] += 1
        assert {s: int(w[b - 1]) for s, w in found.items()} == want


def test_role_files_keep_no_rows_of_a_group(spark):
    """One row a role by aggregation; before, a window sorted all rows of a group in one task."""
    from quillspan.operators import audit

    t = spark.createDataFrame([(1, "b.bdf"), (1, "a.bdf"), (1, "a.evt"), (None, "z.bdf"), (None, "y.bdf"), (2, "x.txt")], "subject int, path string")
    found = audit.role_files(t, "subject", "path", {"data": r"\.bdf$", "event": r"\.evt$"})
    assert sorted(map(str, map(tuple, found.collect()))) == ["(1, 'data', 'a.bdf', 2)", "(1, 'event', 'a.evt', 1)", "(None, 'data', 'y.bdf', 2)"]
    assert "Window" not in found._jdf.queryExecution().toString()


def test_bootstrap_of_a_group_whose_subjects_lie_in_one_range(spark):
    import numpy as np

    from quillspan.operators import bootstrap

    t = spark.createDataFrame([("a", 7), ("b", 8)], "g string, subject long")
    found = bootstrap.subject_weights(t, ["g"], "subject", 130).collect()
    assert sorted((r.g, r.subject) for r in found) == [("a", 7), ("b", 8)]
    assert all((np.frombuffer(r.weights, np.uint8) == 1).all() and len(r.weights) == 130 for r in found)


def test_draws_in_blocks_are_those_of_the_formula(monkeypatch):
    import numpy as np

    from quillspan.operators import bootstrap

    monkeypatch.setattr(bootstrap, "DRAWS", 100)
    p = bootstrap.PRIME
    for group, node, replicate in ((0, 0, 1), (p - 1, 16, 1000), (123456789, 3, 77)):
        want = []
        for i in range(1010):
            a = (group + 16807 * node + i) % p
            y = (((a + replicate * 1640531527) % p) ** 2 + 12345 + a) % p
            want.append((((y * y + replicate) % p) ** 2 + i) % p)
        found = [int(v) for x in bootstrap.draws(group, node, replicate, 1010) for v in x]
        assert found == want
        below = np.array([5, 1, 300, 2, 702])
        ends = np.cumsum(below)
        assert bootstrap.dealt(group, node, replicate, 1010, below).tolist() == np.bincount([int(np.searchsorted(ends, v * 1010 // p, "right")) for v in want], minlength=5).tolist()
        assert bootstrap.subject_counts(group, node, replicate, 1010, 37).tolist() == np.bincount([v * 37 // p for v in want], minlength=37).tolist()
