"""Hand-worked cases of the cohort, event and evaluation operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import clean
from quillspan.operators import audit, bootstrap, features, gaze, joins, metrics, resample, splits, windows


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_nback_labels_do_not_cross_blocks(spark):
    t = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (1, 2, "a"), (1, 3, "b")], "block int, trial int, stimulus string")
    found = windows.nback_condition(t, ["block"], ["trial"]).orderBy("trial")
    assert [r[0] for r in rows(found, "condition")] == ["block_initial", "match", "block_initial", "non_match"]


def test_auroc_and_average_precision_with_ties(spark):
    t = spark.createDataFrame([(0, 0.2), (1, 0.2), (0, 0.5), (1, 0.5), (1, 0.9)], "label int, probability double")
    assert metrics.auroc(t, []).first()[0] == pytest.approx(0.666667, abs=1e-6)
    assert metrics.average_precision(t, []).first()[0] == pytest.approx(0.755556, abs=1e-6)
    one_class = metrics.auroc(t.filter("label = 1"), []).first()[0]
    assert one_class is None


def test_confusion_and_balanced_accuracy(spark):
    t = spark.createDataFrame([(0, 0.1), (0, 0.6), (1, 0.8), (1, 0.4)], "label int, probability double")
    c = metrics.threshold_metrics(metrics.confusion(t, [], F.lit(0.5))).first()
    assert (c.tp, c.fp, c.tn, c.fn, c.balanced_accuracy) == (1, 1, 1, 1, 0.5)
    assert metrics.auroc(t, []).first()[0] == 0.75


def test_score_on_a_bin_edge(spark):
    t = spark.createDataFrame([(1, 0.3)], "label int, probability double")
    assert metrics.calibration_bins(t, []).first().bin == 2


@pytest.mark.parametrize("p, expected", [([0.001, 0.008, 0.039, 0.041, 0.9], [True, True, False, False, False]), ([0.001, 0.03, 0.04, 0.05], [True] * 4), ([0.4, 0.6, 0.8], [False] * 3)])
def test_benjamini_hochberg(spark, p, expected):
    t = spark.createDataFrame([("g", x) for x in p], "g string, p double")
    assert [r[0] for r in rows(resample.benjamini_hochberg(t, ["g"]).orderBy("p"), "rejected")] == expected


@pytest.mark.parametrize("leaf", [1024, 5])
def test_bootstrap_draws_are_multinomial(spark, monkeypatch, leaf):
    monkeypatch.setattr(bootstrap, "LEAF", leaf)
    t = spark.range(400).select(F.when(F.col("id") < 300, "g").otherwise("h").alias("g"), F.col("id").alias("subject"))
    w = bootstrap.subject_weights(t.unionByName(t), ["g"], "subject", 410)
    found = {(r.g, r.subject): np.frombuffer(r.weights, np.uint8) for r in w.collect()}
    assert len(found) == 400
    rows, other = (np.array([found[k] for k in sorted(found) if k[0] == g]).astype(float) for g in "gh")
    assert rows.shape == (300, 410) and (rows.sum(0) == 300).all() and (other.sum(0) == 100).all()
    assert rows.var() == pytest.approx(1 - 1 / 300, abs=0.02)
    assert (rows == 0).mean() == pytest.approx((1 - 1 / 300) ** 300, abs=0.005) and abs(rows.mean(1) - 1).max() < 0.25
    # neither subjects nor replicates go together
    assert abs(np.corrcoef(rows) - np.eye(300)).max() < 0.3 and abs(np.corrcoef(rows.T) - np.eye(410)).max() < 0.35


@pytest.mark.parametrize(("large", "step"), [(1 << 16, 512), (10, 7)])
def test_bootstrap_metrics_of_all_replicates(spark, monkeypatch, large, step):
    """Against metrics taken replicate by replicate; in ranges of the score, with many ties and one score that most rows have."""
    for name, value in (("LARGE", large), ("RANGES", 6), ("ROWS", step)):
        monkeypatch.setattr(bootstrap, name, value)
    rng = np.random.default_rng(4)
    n = 240
    score, label = np.where(rng.random(n) < 0.5, 0.03, rng.integers(0, 40, n) / 40), rng.integers(0, 2, n)
    data = [("g", f, i, int(label[i]), float(score[i] if f == "a" else rng.random())) for i in range(n) for f in "ab"] + [("g", "a", 0, 1, None)]
    t = spark.createDataFrame(data, "g string, feature_set string, subject int, label int, probability double").repartition(3)
    w = {r.subject: np.frombuffer(r.weights, np.uint8).astype(float) for r in bootstrap.subject_weights(t, ["g"], "subject", 30).collect()}
    w = np.array([w[i] for i in range(n)])
    draws = bootstrap.bootstrap_all(t, ["g"], ["feature_set"], "subject", 30, {"fixed": F.lit(0.3), "own": F.col("probability")}).filter("feature_set = 'a'").toPandas()
    assert len(draws) == 60
    for _, r in draws.iterrows():
        v = w[:, r.replicate - 1]
        pos, neg = v * (label == 1), v * (label == 0)
        wins = (pos[:, None] * neg[None, :] * ((score[:, None] > score[None, :]) + 0.5 * (score[:, None] == score[None, :]))).sum()
        assert r.auroc == pytest.approx(wins / (pos.sum() * neg.sum()))
        tp, fp = (np.array([x[score >= s].sum() for s in score]) for x in (pos, neg))
        assert r.auprc == pytest.approx((pos * tp / np.maximum(tp + fp, 1)).sum() / pos.sum())
        assert r.brier == pytest.approx((v * (score - label) ** 2).sum() / n)
        called = score >= 0.3 if r.threshold_type == "fixed" else np.ones(n, bool)
        assert (r.tp, r.fp, r.tn, r.fn) == ((pos * called).sum(), (neg * called).sum(), (neg * ~called).sum(), (pos * ~called).sum())
        assert r.accuracy == pytest.approx((r.tp + r.tn) / n) and r.positive_rate == pytest.approx((r.tp + r.fp) / n)
        bins = [score >= b * 0.1 for b in range(10)] + [np.zeros(n, bool)]
        gaps = [abs((v * m * (score - label)).sum()) for m in (bins[b] & ~bins[b + 1] for b in range(10))]
        assert r.ece == pytest.approx(sum(gaps) / n)


def test_signal_detection_of_the_oddball_case(spark):
    t = spark.createDataFrame([(1, 2, 1, 8)], "hits long, targets long, alarms long, others long")
    found = features.signal_detection(*[F.col(c) for c in t.columns])
    r = t.select(*[v.alias(k) for k, v in found.items()]).first()
    assert (r.hit_rate, r.false_alarm_rate) == (0.5, 0.125)
    assert r.d_prime == pytest.approx(0.967422, abs=1e-6)


def test_reaction_time_skew(spark):
    t = spark.createDataFrame([(0.3,), (0.4,), (0.5,), (1.0,)], "rt double")
    r = t.agg(*features.describe_rt("rt")).first()
    assert r["mean"] == pytest.approx(0.55) and r["skew"] == pytest.approx(0.598904, abs=1e-6)


def test_choice_pairs_stay_inside_blocks(spark):
    t = spark.createDataFrame([(1, b, i, "1", "win") for b in (0, 1) for i in (2 * b, 2 * b + 1)], "subject int, block int, trial int, response string, feedback string")
    t = t.withColumn("rt_sec", F.lit(0.5))
    assert windows.after_outcome(t, "subject", ["subject", "block"], ["trial"]).first().n_win_pairs == 2


def test_fixations_around_a_gap(spark):
    data = [(1, float(t), None if 500 <= t < 520 else (0.4 if t < 500 else 0.6), 0.5) for t in range(0, 1100, 10)]
    t = spark.createDataFrame(data, "recording int, time_ms double, x double, y double")
    found = gaze.fixations(t, ["recording"], "time_ms").orderBy("start").collect()
    assert len(found) == 2 and found[0].end == 490
    path = windows.scanpath(spark.createDataFrame(found), "recording").first()
    assert path.scanpath == pytest.approx(0.2)


def test_gap_counts(spark):
    data = [(1, i * 10, 0 if 10 <= i < 20 or 100 <= i < 150 else 1) for i in range(200)]
    t = spark.createDataFrame(data, "recording int, time_ms int, valid int")
    r = windows.gap_summary(t, "recording", "time_ms", F.col("valid") == 1).first()
    assert (r.n_gaps, r.gap_ms) == (1, 490)


def test_regions_first_match_wins(spark):
    points = spark.createDataFrame([("m", 0.5, 0.56), ("m", 0.5, 0.42), ("m", 0.1, 0.1), ("m", None, 0.1)], "media string, x double, y double")
    rect = spark.createDataFrame([("m", 0.4, 0.3, 0.6, 0.7, 0.43, 0.37, 0.57, 0.47, 0.44, 0.52, 0.56, 0.61)], ", ".join(["media string", *[f"{r}_{c} double" for r in ("face", "eyes", "mouth") for c in ("x0", "y0", "x1", "y1")]]))
    assert [r[0] for r in rows(joins.assign_region(points, rect, "media", ("eyes", "mouth", "face")), "region")] == ["mouth", "eyes", "off_face", None]


def test_block_windows(spark):
    t = spark.createDataFrame([(30.0,)], "onset double")
    found = windows.block_windows(t, "onset", 4, 15.0, 5.0, 10.0).orderBy("block").collect()
    assert [r.task_start for r in found] == [30, 45, 60, 75] and found[-1].task_end == 90


def test_beer_lambert_recovers_concentrations(spark):
    from quillspan.operators.signals import beer_lambert

    # 2 and -1 micromol/l at age 13, 30 mm apart; each wavelength has its own path
    factor = {690: 5.810526, 695: 5.802882, 830: 5.168526}
    for pair in ((690, 830), (695, 830)):
        t = spark.createDataFrame([(1, w, (clean.COEFFICIENTS[w][0] * 2e-6 + clean.COEFFICIENTS[w][1] * -1e-6) * 3.0 * factor[w]) for w in pair], "r int, wavelength int, density double")
        r = beer_lambert(t, ["r"], pair, F.lit(30.0), F.lit(13.0)).first()
        assert (r.hbo, r.hbr) == (pytest.approx(2, rel=1e-3), pytest.approx(-1, rel=1e-3))


def test_hash_ranks_equal_a_plain_window(spark):
    from pyspark.sql import Window

    t = spark.range(500).select("id", F.when(F.col("id") % 5 < 4, F.lit("a")).when(F.col("id") % 2 == 0, F.lit("b")).alias("g"))
    digest = splits.hash_order(3, "id")
    got = {(r.id, r.g): (r["_k"], r["_n"]) for r in splits.hash_ranks(t, ["g"], digest, "id").collect()}
    w = Window.partitionBy("g")
    assert got == {(r.id, r.g): (r.k, r.n) for r in t.select("*", F.row_number().over(w.orderBy(digest, "id")).alias("k"), F.count("*").over(w).alias("n")).collect()}


def test_ranking_metrics_with_scores_outside_the_unit_range(spark):
    rng = np.random.default_rng(1)
    score, label = np.round(rng.normal(0, 30, 400), 1), rng.integers(0, 2, 400)
    t = spark.createDataFrame([(float(s), int(y)) for s, y in zip(score, label)], "probability double, label int").withColumn("k", F.lit(1))
    pos, neg = score[label == 1], score[label == 0]
    want = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert metrics.auroc(t, ["k"]).first().auroc == pytest.approx(want)
    assert metrics.auroc(t.drop("k"), []).first().auroc == pytest.approx(want)
    step = sum((label[score == s]).sum() * label[score >= s].sum() / (score >= s).sum() for s in np.unique(score)) / label.sum()
    assert metrics.average_precision(t, ["k"]).first().auprc == pytest.approx(step)


def test_outer_folds_take_any_name_of_the_fold_column(spark):
    t = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id int, fold int")
    found = {(r.fold, r.id): r.part for r in splits.outer_folds(t, "id", "fold").collect()}
    assert found == {(0, 1): "val", (0, 2): "train", (1, 1): "train", (1, 2): "val"}


def test_pathlength_factor(spark):
    r = spark.range(1).select(clean.pathlength_factor(F.lit(690.0), F.lit(13.0)), clean.pathlength_factor(F.lit(830.0), F.lit(None).cast("double"))).first()
    assert (r[0], r[1]) == (pytest.approx(5.810526, abs=1e-5), pytest.approx(5.168526, abs=1e-5))


def test_duplicate_takes(spark):
    t = spark.createDataFrame([("d", 1, "a", 0, 12), ("d", 1, "b", 1, 110), ("d", None, "c", 1, 1)], "device string, subject int, path string, complete int, n int")
    found = {r.path: (r.reason, r.kept_path) for r in audit.resolve_duplicates(t, ["device", "subject"], [F.desc("complete"), F.desc("n")]).collect()}
    assert found == {"b": (None, "b"), "a": ("duplicate_take", "b"), "c": ("missing_key", None)}


def test_inner_splits_are_disjoint_and_cover(spark):
    t = spark.range(120).select(F.col("id").alias("s"), (F.col("id") % 2).alias("label"), (F.col("id") % 3).cast("int").alias("f"))
    found = splits.inner_splits(t, "s", "label", "f", 3, 0.15)
    assert found.groupBy("fold", "inner_fold", "s").count().filter("count > 1").isEmpty()
    assert found.groupBy("fold", "inner_fold").count().filter("count <> 80").isEmpty()
    assert found.filter("part = 'val'").groupBy("fold", "s").count().filter("count <> 1").isEmpty()


def test_group_folds_keep_groups_whole(spark):
    t = spark.range(300).select(F.col("id").alias("s"), (F.col("id") % 17).alias("g"), (F.col("id") % 3 == 0).cast("int").alias("label"), (F.col("id") % 10 == 0).cast("int").alias("locked"))
    found = splits.group_folds(t, "g", "label", "locked", 4)
    assert found.filter("locked = 0").groupBy("g").agg(F.count_distinct("robustness_fold").alias("n")).filter("n <> 1").isEmpty()
    assert found.filter("locked = 1 AND robustness_fold IS NOT NULL").isEmpty()


def test_window_join_closed_and_half_open(spark):
    s = spark.createDataFrame([(1, 10), (1, 20), (2, 15)], "r int, t int")
    i = spark.createDataFrame([(1, 10, 20)], "r int, a int, b int")
    assert joins.window_join(s, i, "r", "t", "a", "b", 7).count() == 2
    assert joins.window_join(s, i, "r", "t", "a", "b", 7, closed=False).count() == 1


def test_forbidden_columns(spark):
    t = spark.createDataFrame([(1, 2)], "Label int, n_x int")
    assert sorted(rows(audit.check_leakage({"t": t}, ["label"], ["^n_"]), "column_name", "rule")) == [("Label", "exact"), ("n_x", "pattern")]


def test_repeated_keys_are_an_error(spark):
    with pytest.raises(ValueError):
        audit.assert_unique(spark.createDataFrame([(1,), (1,)], "a int"), ["a"])


def test_saccade_levels(spark):
    t = spark.createDataFrame([(1, i, 0.5 if i < 10 else 0.8) for i in range(20)], "r int, frame int, v double")
    found = gaze.steps(gaze.held_levels(t, "r", "frame", "v", 0.05), "r", "frame").collect()
    assert [(r.frame, r.direction, r.outward) for r in found] == [(10, 1.0, True)]


def test_velocity_of_a_line(spark):
    t = spark.createDataFrame([(1, i * 10.0, 0.02 * i) for i in range(40)], "r int, t double, v double")
    found = gaze.smoothed_velocity(t, "r", "t", "v", 15).collect()
    assert all(r.velocity == pytest.approx(2.0) for r in found)


def test_flexible_text(spark):
    from quillspan.sources.readers import decode_flexible

    t = spark.createDataFrame([(bytearray("中文".encode("gb18030")),), (bytearray("﻿né".encode()),)], "c binary")
    assert [r[0] for r in t.select(decode_flexible(F.col("c"))).collect()] == ["中文", "né"]


def test_job_files_and_results_round_trip(spark, tmp_path):
    from quillspan.sources import readers

    a = spark.createDataFrame([("standard", 1, "x")], "cv_protocol string, n int, device string")
    b = spark.createDataFrame([("group", 2)], "cv_protocol string, n int")
    readers.write_union([a, b], str(tmp_path / "jobs" / "all"))
    jobs = readers.read_jobs(spark, str(tmp_path / "jobs"))
    assert sorted((r.cv_protocol, r.n, r.device) for r in jobs.collect()) == [("group", "2", ""), ("standard", "1", "x")]
    readers.write_result(jobs, str(tmp_path / "result"))
    assert {r.cv_protocol for r in spark.read.parquet(str(tmp_path / "result")).collect()} == {"group", "standard"}


def test_feature_names_by_role(spark):
    from quillspan.sources import readers

    t = spark.createDataFrame([(1, 1.0, 2.0, "x")], "s int, signal_a double, signal_contrast_b double, signal_text string")
    assert readers.columns_by_role(t, ["signal_"], ["signal_contrast_"]) == ["signal_a"]
    assert readers.prefix_features(t, "signal", "nback").columns == ["s", "signal_nback_a", "signal_contrast_nback_b", "signal_nback_text"]


def test_every_outer_fold_is_scored(spark, monkeypatch):
    from quillspan.operators import models
    from quillspan.plans import modelling

    t = spark.createDataFrame([(i, i // 3 % 2, i % 3, 1.0 * i, 20.0, 1.0, "f") for i in range(24)], "subject long, label int, fold int, balance double, age double, has_eeg double, sex string").cache()
    fits = []
    monkeypatch.setattr(modelling, "dataset", lambda spark, d: t)
    monkeypatch.setattr(models, "fit", lambda *a, **k: fits.append(1))
    monkeypatch.setattr(models, "score", lambda model, df, keep: df.select(*keep, F.lit(0.5).alias("probability")))
    assert sorted(r.subject for r in modelling.k04(spark, "").collect()) == list(range(24))
    assert len(fits) == 3 * (2 * 3 + 1)  # a fit for each parameter and inner fold, and one for the outer fold
    for query, n in ((modelling.k08, 2), (modelling.k09, 3)):
        fits.clear()
        query(spark, "")
        assert len(fits) == 3 * n


def test_visual_pca_reads_the_whole_vector(spark, monkeypatch):
    from quillspan.plans import modelling

    # the label lies in the last place of the vector alone
    rows = [(i, 9 * (i // 2 % 2), [float(i * k % 7) / 100 for k in range(63)] + [50.0 * (i // 2 % 2)]) for i in range(40)]
    monkeypatch.setattr(modelling, "table", lambda spark, d, name: spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"))
    found = modelling.k05(spark, "").collect()
    # both folds are scored, each at both dimensions
    assert len(found) == 40 and {r.fold for r in found} == {0, 1}
    assert all((r.probability > 0.5) == (r.label == 1) for r in found)


def test_sequence_examples_of_sparse_subjects(spark, monkeypatch):
    from quillspan.plans import features as plans

    t = spark.createDataFrame([(15 + 7 * s, float(o), o, f"s{o}") for s in range(12) for o in range(2)], "subject long, onset_sec double, trial int, stimulus string")
    monkeypatch.setattr(plans, "trials", lambda spark, d: t)
    assert rows(plans.a14(spark, ""), "subject", "codes") == [(15 + 7 * s, "s0 s1") for s in range(10)]


def test_streamed_trials_equal_the_batch(spark, tmp_path):
    """Repeated and late trials over three files, against the same rows at once; windows past the watermark are final."""
    import datetime as dt

    from quillspan.streaming.trials import windowed_trials

    day = dt.datetime(2024, 1, 1)
    rows = [(i % 3, day + dt.timedelta(hours=7 * i), i, float(i % 5), "" if i % 4 == 0 else "1") for i in range(60)]
    schema = "subject int, at timestamp, trial long, rt double, response string"
    parts = [rows[:25] + rows[:3], rows[27:45] + rows[20:27], rows[45:] + [(9, day + dt.timedelta(days=60), 999, 1.0, "1")]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = (
            windowed_trials(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "subject", "at", "trial", "rt", "response")
            .writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, windowed_trials(spark.createDataFrame(rows, schema), "subject", "at", "trial", "rt", "response").collect()))
    assert got == want


def test_block_summaries_by_hand(spark):
    from quillspan.operators import blocks

    t = spark.createDataFrame([("s", 0, "left", 1.0), ("s", 0, "right", 3.0), ("s", 1, "left", 2.0), ("s", 1, "right", 8.0)], "u string, block int, region string, response double")
    t = t.withColumns({c: F.col("response") for c in ("peak", "time_to_peak", "area", "recovery")})
    r = blocks.block_summary(t, ["u"], "block", "region").first()
    assert (r.response_mean, r.n_blocks, r.response_left, r.response_right, r.lateralisation) == (3.5, 2, 1.5, 5.5, 4.0)
    assert (r.consistency_std, r.first_minus_last) == (1.5, -3.0)


def test_spectral_regions_of_two_sines(spark):
    from quillspan.operators import blocks, signals

    at = np.arange(256) / 64.0
    rows = [("s", c, i, float(v)) for c, (f, size) in enumerate(((10.0, 1.0), (10.0, 2.0), (20.0, 1.0))) for i, v in enumerate(size * np.sin(2 * np.pi * f * at))]
    density = signals.welch(spark.createDataFrame(rows, "u string, channel int, i int, v double"), ["u", "channel"], "i", "v", 64.0, 64)
    bands = blocks.band_table(density, ["u", "channel"]).withColumn("region", F.when(F.col("channel") == 0, "left").when(F.col("channel") == 1, "right"))
    shares = {(r.channel, r.band): r.relative for r in bands.collect()}
    assert shares[0, "alpha"] > 0.99 and shares[2, "beta"] > 0.99
    r = blocks.spectral_regions(bands, ["u"], "region").first()
    assert r.asymmetry_alpha == pytest.approx(math.log(4), abs=1e-3)  # twice the amplitude, four times the power
    assert r.right_alpha_log - r.left_alpha_log == pytest.approx(math.log10(4), abs=1e-6)
    assert r.theta_alpha_ratio < 1e-3 < r.beta_alpha_ratio


def test_model_jobs_on_a_small_table(spark):
    from quillspan.operators import models

    rng = np.random.default_rng(4)
    rows = [(i, i % 3, int(y), float(y * 2 + rng.normal()), float(rng.normal()), *rng.normal(0, 1, 4).tolist()) for i, y in enumerate(rng.integers(0, 2, 120))]
    t = spark.createDataFrame([(i, f, y, a, b, y + e[0], *e[1:]) for i, f, y, a, b, *e in rows], "subject long, fold int, label int, a double, b double, e0 double, e1 double, e2 double, e3 double")
    found = models.crossfit(t.filter("fold > 0"), t.filter("fold = 0"), "subject", ["a", "b"], [], ("logistic", "forest")).cache()
    assert found.filter("part = 'outer'").count() == 40 and found.filter("part = 'inner'").count() == 80 and found.select("subject").distinct().count() == 120
    assert metrics.auroc(found.filter("part = 'inner'").withColumn("k", F.lit(1)), ["k"]).first().auroc > 0.8
    pca = models.visual_pca(t, "subject", "fold", ["e0", "e1", "e2", "e3"], (2, 400)).cache()
    assert pca.count() == 120 and all(1 <= r.dimension <= 4 for r in pca.select("dimension").distinct().collect())
    drawn = models.stratified_random(t, t, ["subject"], "subject")
    assert drawn.agg(F.avg("probability")).first()[0] == pytest.approx(t.agg(F.avg("label")).first()[0], abs=0.15)
