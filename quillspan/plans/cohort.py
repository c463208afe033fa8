"""Queries of the join, set and split operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import audit, joins, metrics, resample, splits
from quillspan.operators import windows as W
from quillspan.plans.base import Book
from quillspan.plans.evaluation import F4, FOLD, G, GROUP, P, auroc_sql
from quillspan.sources.tables import predictions, role, role_sql, table

book = Book()
QUERIES, SQL = book.queries, book.sql
S, T, Z, K = (f"WITH {role_sql(n)}" for n in ("subjects", "trials", "gaze", "takes"))
ST = f"WITH {role_sql('subjects', 'trials')}"
SK = f"WITH {role_sql('subjects', 'takes')}"


def subjects(spark, d):
    return role(spark, d, "subjects")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


SIGNAL = "sig AS (SELECT subject, round(avg(rt_sec), 6) AS signal_rt FROM trials GROUP BY subject), qc AS (SELECT subject, count(*) AS qc_trials FROM trials WHERE block < 5 GROUP BY subject)"


def signal_qc(spark, d):
    t = role(spark, d, "trials")
    return t.groupBy("subject").agg(F.round(F.avg("rt_sec"), 6).alias("signal_rt")), t.filter("block < 5").groupBy("subject").agg(F.count("*").alias("qc_trials"))


@book.query("j01_combine_signal_qc", f"{ST}, {SIGNAL} SELECT subject, TRY_CAST(label AS INTEGER) AS label, signal_rt, qc_trials FROM subjects JOIN sig USING (subject) JOIN qc USING (subject)")
def j01(spark, d):
    return joins.combine_signal_qc(subjects(spark, d).select("subject", "label"), *signal_qc(spark, d), "subject")


@book.query("j02_join_availability", f"{ST}, {SIGNAL} SELECT subject, coalesce(signal_rt, 0) AS signal_rt, coalesce(qc_trials, 0) AS qc_trials FROM subjects LEFT JOIN sig USING (subject) LEFT JOIN qc USING (subject)")
def j02(spark, d):
    return joins.join_availability(subjects(spark, d).select("subject"), signal_qc(spark, d), "subject", {"signal_rt": 0.0, "qc_trials": 0})


@book.query("j03_intersection_cohort", f"{ST} SELECT trial FROM trials WHERE subject IN (SELECT subject FROM trials INTERSECT SELECT subject FROM subjects WHERE has_eeg = 1 INTERSECT SELECT subject FROM subjects WHERE has_face = 1)")
def j03(spark, d):
    s = subjects(spark, d)
    return joins.intersection_cohort([role(spark, d, "trials"), s.filter("has_eeg = 1"), s.filter("has_face = 1")], "subject")[0].select("trial")


@book.query("j04_restrict_to", f"{ST} SELECT trial, subject FROM trials WHERE subject IN (SELECT subject FROM subjects WHERE label = '1')")
def j04(spark, d):
    return joins.restrict_to(role(spark, d, "trials"), subjects(spark, d).filter("label = '1'"), "subject").select("trial", "subject")


@book.query(
    "j05_reconcile",
    f"{ST}, a AS (SELECT DISTINCT subject FROM trials), b AS (SELECT subject FROM subjects WHERE has_eeg = 1) SELECT count(*) FILTER (a.subject IS NOT NULL AND b.subject IS NOT NULL) AS \"both\","
    " count(*) FILTER (b.subject IS NULL) AS found_not_flagged, count(*) FILTER (a.subject IS NULL) AS flagged_not_found FROM a FULL JOIN b USING (subject)",
)
def j05(spark, d):
    return joins.reconcile(role(spark, d, "trials"), subjects(spark, d).filter("has_eeg = 1"), "subject")


@book.query("j06_attach_subjects", f"{SK} SELECT t.path, s.a_id, s.subject IS NOT NULL AS in_manifest FROM takes t LEFT JOIN (SELECT subject, a_id FROM subjects WHERE subject % 3 > 0) s USING (subject)")
def j06(spark, d):
    return joins.attach_subjects(role(spark, d, "takes"), subjects(spark, d).filter("subject % 3 > 0").select("subject", "a_id"), "subject").select("path", "a_id", "in_manifest")


@book.query("j07_name_map_join", f"{S}, d AS (SELECT DISTINCT left(a_id, 3) AS name FROM subjects UNION SELECT 'nobody'), n AS (SELECT DISTINCT left(a_id, 3) AS name, subject FROM subjects), c AS (SELECT name, count(DISTINCT subject) AS n_subjects FROM d LEFT JOIN n USING (name) GROUP BY name) SELECT name, n_subjects, CASE n_subjects WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM c")
def j07(spark, d):
    s = subjects(spark, d).withColumn("name", F.substring("a_id", 1, 3))
    dirs = s.select("name").unionByName(spark.range(1).select(F.lit("nobody").alias("name")))
    return joins.name_map_join(dirs, s, "name", "subject")


@book.query("j08_with_protocol", f"{S} SELECT subject, balance, CAST(subject % 5 AS INTEGER) AS outer_fold, 'standard' AS cv_protocol FROM subjects WHERE subject % 10 > 0 UNION ALL SELECT subject, balance, CAST(CAST(site AS INTEGER) % 4 AS INTEGER), 'group' FROM subjects")
def j08(spark, d):
    s = subjects(spark, d)
    standard = s.select("subject", F.when(F.col("subject") % 10 > 0, F.col("subject") % 5).cast("int").alias("outer_fold"))
    group = s.select("subject", (F.col("site").cast("int") % 4).alias("outer_fold"))
    return joins.with_protocol(s.select("subject", "balance"), {"standard": standard, "group": group}, "subject")


@book.query("j09_pair_predictions", f"{P} SELECT a.cv_protocol, a.seed, a.outer_fold, a.subject, a.label, a.probability AS probability_a, b.probability AS probability_b, count(*) OVER (PARTITION BY a.cv_protocol, a.seed) AS n_pairs FROM predictions a JOIN predictions b ON a.cv_protocol = b.cv_protocol AND a.seed = b.seed AND a.subject = b.subject AND a.outer_fold = b.outer_fold WHERE a.feature_set = 'signal' AND b.feature_set = 'signal_qc' QUALIFY n_pairs >= 10")
def j09(spark, d):
    pairs = spark.createDataFrame([("signal", "signal_qc")], "feature_set_a string, feature_set_b string")
    found = resample.pair_predictions(predictions(spark, d), ["cv_protocol", "seed"], pairs, "subject", "outer_fold")
    return found.select("cv_protocol", "seed", "outer_fold", "subject", "label", "probability_a", "probability_b", "n_pairs")


@book.query("j10_attach_comparator", f"{P}, p AS (SELECT * FROM {auroc_sql(G)}) SELECT a.cv_protocol, a.seed, round(b.auroc, 6) AS comparator_auroc, CAST(coalesce(b.auroc > 0.5, false) AS INTEGER) AS above_chance FROM p a LEFT JOIN (SELECT * FROM p WHERE feature_set = 'signal' AND seed < 2) b ON a.cv_protocol = b.cv_protocol AND a.seed = b.seed WHERE a.feature_set = 'signal_qc'")
def j10(spark, d):
    pooled = metrics.auroc(predictions(spark, d), GROUP)
    base = pooled.filter("feature_set = 'signal' AND seed < 2").select("cv_protocol", "seed", F.col("auroc").alias("comparator_auroc"))
    return rounded(joins.attach_comparator(pooled.filter("feature_set = 'signal_qc'").select("cv_protocol", "seed"), base, ["cv_protocol", "seed"]), "comparator_auroc")


HOUR = 3600 * 1000
SEGMENTS = f"{Z}, s AS (SELECT recording, sample AS segment, time_ms AS start, time_ms + 20 * {HOUR} AS stop FROM gaze WHERE media = 'a')"


def segments(spark, d):
    return role(spark, d, "gaze").filter("media = 'a'").select("recording", F.col("sample").alias("segment"), F.col("time_ms").alias("start"), (F.col("time_ms") + 20 * HOUR).alias("stop"))


@book.query("j11_window_join", f"{SEGMENTS} SELECT segment, sample FROM gaze g JOIN s ON g.recording = s.recording AND time_ms BETWEEN start AND stop")
def j11(spark, d):
    return joins.window_join(role(spark, d, "gaze"), segments(spark, d), "recording", "time_ms", "start", "stop", 20 * HOUR).select("segment", "sample")


@book.query("j12_asof_prior", f"{Z}, e AS (SELECT * FROM gaze WHERE media = 'c'), m AS (SELECT recording, time_ms, sample FROM gaze WHERE media = 'a') SELECT e.sample, m.time_ms AS marker_time, m.sample AS marker_value FROM e ASOF LEFT JOIN m ON e.recording = m.recording AND e.time_ms >= m.time_ms")
def j12(spark, d):
    g = role(spark, d, "gaze").select("recording", "time_ms", "sample", "media")
    return joins.asof_prior(g.filter("media = 'c'"), g.filter("media = 'a'").drop("media"), "recording", "time_ms", "sample").select("sample", "marker_time", "marker_value")


@book.query("j13_next_match", f"{Z}, m AS (SELECT sample, recording, time_ms, media, min(CASE WHEN media = 'b' THEN time_ms END) OVER (PARTITION BY recording ORDER BY time_ms ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed_at FROM gaze) SELECT sample, closed_at FROM m WHERE media = 'a' AND closed_at IS NOT NULL")
def j13(spark, d):
    return joins.next_match(role(spark, d, "gaze"), "recording", "time_ms", F.col("media") == "a", F.col("media") == "b").select("sample", "closed_at")


RECTS = [("a", 0.2, 0.2, 0.8, 0.9, 0.3, 0.3, 0.7, 0.5, 0.35, 0.6, 0.65, 0.8), ("b", 0.1, 0.1, 0.6, 0.7, 0.2, 0.2, 0.5, 0.4, 0.25, 0.5, 0.45, 0.65)]
RECT_COLUMNS = ["media"] + [f"{r}_{c}" for r in ("face", "eyes", "mouth") for c in ("x0", "y0", "x1", "y1")]
RECT_SQL = f"rects AS (SELECT * FROM (VALUES {', '.join(str(r) for r in RECTS)}) t({', '.join(RECT_COLUMNS)}))"


def region_case(r, name):
    return f"WHEN x BETWEEN {r}_x0 AND {r}_x1 AND y BETWEEN {r}_y0 AND {r}_y1 THEN '{name}'"


REGIONS = f"{Z}, {RECT_SQL}, placed AS (SELECT g.*, CASE WHEN x IS NULL OR y IS NULL THEN NULL {region_case('eyes', 'eyes')} {region_case('mouth', 'mouth')} {region_case('face', 'face_other')} ELSE 'off_face' END AS region FROM gaze g LEFT JOIN rects USING (media))"


def regions(spark, d):
    rects = spark.createDataFrame(RECTS, ", ".join(f"{c} {'string' if c == 'media' else 'double'}" for c in RECT_COLUMNS))
    return joins.assign_region(role(spark, d, "gaze"), rects, "media", ("eyes", "mouth", "face"))


@book.query("j14_assign_region", f"{REGIONS} SELECT sample, region FROM placed")
def j14(spark, d):
    return regions(spark, d).select("sample", "region")


@book.query("j15_frame_lookup", f"{Z}, f AS (SELECT *, greatest(0, least(199, CAST(floor(time_ms * 0.1::DOUBLE / 1000) AS BIGINT) % 300)) AS frame FROM gaze), t AS (SELECT r AS recording, k AS frame, (r * 31 + k * 7) % 100 / 100.0::DOUBLE AS tx FROM (SELECT DISTINCT recording AS r FROM gaze), range(0, 200) b(k)) SELECT f.sample, f.frame, t.tx FROM f LEFT JOIN t USING (recording, frame)")
def j15(spark, d):
    g = role(spark, d, "gaze").withColumn("time_ms", (F.floor(F.col("time_ms") * 0.1 / 1000) % 300) * 1000)
    track = g.select("recording").distinct().select("recording", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("frame"))
    track = track.withColumn("tx", (F.col("recording") * 31 + F.col("frame") * 7) % 100 / 100)
    return joins.frame_lookup(g, track, "recording", "time_ms", F.lit(1.0), F.lit(200)).select("sample", "frame", "tx")


@book.query("j16_assert_disjoint", f"{S} SELECT subject FROM subjects WHERE subject % 5 = 0")
def j16(spark, d):
    s = subjects(spark, d).select("subject")
    held = s.filter("subject % 5 = 0")
    audit.assert_disjoint(s.filter("subject % 5 > 0"), held, "subject")
    return held


@book.query("j17_overlap_matrix", f"{K}, u AS (SELECT DISTINCT device, subject FROM takes WHERE subject IS NOT NULL) SELECT a.device AS a, b.device AS b, count(*) AS shared FROM u a JOIN u b ON a.subject = b.subject AND a.device < b.device GROUP BY ALL")
def j17(spark, d):
    return audit.overlap_matrix(role(spark, d, "takes"), "device", "subject")


PAIR_FILES = f"{K}, d AS (SELECT subject, min(size) AS size, max(task) AS task FROM takes WHERE complete = 1 AND subject IS NOT NULL GROUP BY subject), e AS (SELECT subject, min(size) AS size, max(task) AS task FROM takes WHERE complete = 0 AND line > 1 AND subject IS NOT NULL GROUP BY subject)"


@book.query("j18_match_event_file", f"{PAIR_FILES}, r AS (SELECT subject, CASE WHEN d.task IS NULL THEN 'no_data_file' WHEN e.task IS NULL THEN 'no_event_file' WHEN d.size <> e.size THEN 'size_mismatch' WHEN d.task <> e.task THEN 'task_mismatch' ELSE '' END AS reason FROM d FULL JOIN e USING (subject)) SELECT subject, CASE WHEN reason = '' THEN 'paired' ELSE 'blocked' END AS status, reason FROM r")
def j18(spark, d):
    t = role(spark, d, "takes").filter("subject IS NOT NULL")
    agg = lambda x: x.groupBy("subject").agg(F.min("size").alias("size"), F.max("task").alias("task"))
    return joins.match_event_file(agg(t.filter("complete = 1")), agg(t.filter("complete = 0 AND line > 1")), "subject", ["size", "task"])


@book.query("j19_epoch_join", f"{Z}, e AS (SELECT recording, time_ms AS onset FROM gaze WHERE media = 'a'), j AS (SELECT g.sample, e.onset, g.time_ms - e.onset AS relative_time, row_number() OVER (PARTITION BY e.recording, e.onset ORDER BY g.time_ms) - 1 AS k FROM gaze g JOIN e ON g.recording = e.recording AND g.time_ms BETWEEN e.onset - {HOUR} AND e.onset + 8 * {HOUR}) SELECT sample, onset, relative_time, CAST(k AS INTEGER) AS sample_index FROM j")
def j19(spark, d):
    g = role(spark, d, "gaze").select("recording", "time_ms", "sample", "media")
    events = g.filter("media = 'a'").select("recording", F.col("time_ms").alias("onset"))
    return joins.epoch_join(g, events, "recording", "time_ms", "onset", -HOUR, 8 * HOUR).select("sample", "onset", "relative_time", "sample_index")


@book.query(
    "j20_build_availability",
    f"""{SK}, f AS (SELECT subject, count(*) AS n_files FROM takes GROUP BY subject), p AS (SELECT subject, max(complete) = 1 AS readable FROM takes WHERE line < 4 GROUP BY subject),
    q AS (SELECT subject, CAST(sum(complete) AS BIGINT) AS n_valid, CAST(sum(1 - complete) AS BIGINT) AS n_rejected FROM takes WHERE line < 3 GROUP BY subject),
    j AS (SELECT subject, coalesce(n_files, 0) > 0 AS there, coalesce(n_files, 0) > 0 AND coalesce(readable, false) AS ok, coalesce(n_valid, 0) AS v, coalesce(n_rejected, 0) AS r FROM subjects LEFT JOIN f USING (subject) LEFT JOIN p USING (subject) LEFT JOIN q USING (subject))
    SELECT subject, CAST(there AS INTEGER) AS file_exists, CAST(ok AS INTEGER) AS file_readable, v + r AS n_candidates, round(r / nullif(v + r, 0), 6) AS bad_rate, CAST(ok AND v > 0 AS INTEGER) AS qc_pass,
        CASE WHEN NOT there THEN 'missing_file' WHEN NOT ok THEN 'unreadable' WHEN v = 0 THEN 'no_valid_window' ELSE '' END AS reason FROM j""",
)
def j20(spark, d):
    t = role(spark, d, "takes")
    files = t.groupBy("subject").agg(F.count("*").alias("n_files"))
    probes = t.filter("line < 4").groupBy("subject").agg((F.max("complete") == 1).alias("readable"))
    qa = t.filter("line < 3").groupBy("subject").agg(F.sum("complete").alias("n_valid"), F.sum(1 - F.col("complete")).alias("n_rejected"))
    return rounded(joins.build_availability(subjects(spark, d).select("subject"), files, probes, qa, "subject"), "bad_rate")


@book.query("j21_annotate_takes", f"{K}, l AS (SELECT device, task, stamp, CAST(sum(n_segments) AS BIGINT) AS n_media_segments FROM takes WHERE line <= 2 GROUP BY ALL) SELECT t.path, coalesce(l.n_media_segments, 0) AS n_media_segments, l.device IS NOT NULL AS timeline_found, CAST(coalesce(l.n_media_segments, 0) >= 30 AS INTEGER) AS timeline_complete FROM takes t LEFT JOIN l USING (device, task, stamp)")
def j21(spark, d):
    t = role(spark, d, "takes")
    lines = t.filter("line <= 2").groupBy("device", "task", "stamp").agg(F.sum("n_segments").alias("n_media_segments"))
    return joins.annotate_takes(t, lines, ["device", "task", "stamp"], 30).select("path", "n_media_segments", "timeline_found", "timeline_complete")


@book.query("o01_ordered_output", f"{S} SELECT subject, sha1('0|' || subject) AS place FROM subjects ORDER BY place, subject")
def o01(spark, d):
    return subjects(spark, d).select("subject", splits.hash_order(0, "subject").alias("place")).orderBy("place", "subject")


@book.query("o02_limit_per_unit", f"{K} SELECT device, task, path FROM takes QUALIFY row_number() OVER (PARTITION BY device, task ORDER BY path) <= 4")
def o02(spark, d):
    return W.top_k(role(spark, d, "takes"), ["device", "task"], ["path"], 4).select("device", "task", "path")


@book.query("o03_merge_results", f"{P}, a AS (SELECT * FROM {auroc_sql(G)}) SELECT cv_protocol, feature_set, seed, round(auroc, 6) AS auroc FROM a")
def o03(spark, d):
    rows = predictions(spark, d)
    parts = [metrics.auroc(rows.filter(F.col("cv_protocol") == p), GROUP) for p in ("standard", "group")]
    return rounded(parts[0].unionByName(parts[1]), "auroc")


@book.query("o04_common_ids", f"{ST} SELECT subject FROM trials INTERSECT SELECT subject FROM subjects WHERE has_eye = 1")
def o04(spark, d):
    return role(spark, d, "trials").select("subject").intersect(subjects(spark, d).filter("has_eye = 1").select("subject"))


@book.query("o05_set_difference", f"{ST} SELECT subject FROM subjects EXCEPT SELECT subject FROM trials")
def o05(spark, d):
    return subjects(spark, d).select("subject").join(role(spark, d, "trials"), "subject", "left_anti")


@book.query("o06_drop_duplicates", f"{K} SELECT device, subject, path FROM takes WHERE subject IS NOT NULL QUALIFY row_number() OVER (PARTITION BY device, subject ORDER BY path) = 1")
def o06(spark, d):
    return W.top_k(role(spark, d, "takes").filter("subject IS NOT NULL"), ["device", "subject"], ["path"], 1).select("device", "subject", "path")


@book.query("o07_union_aligned", f"{ST} SELECT subject, CAST(label AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS stimulus FROM subjects UNION ALL SELECT subject, NULL, stimulus FROM trials")
def o07(spark, d):
    return joins.union_aligned([subjects(spark, d).select("subject", "label"), role(spark, d, "trials").select("stimulus", "subject")], ["subject", "label", "stimulus"])


@book.query("o08_round_robin_limit", f"{S}, r AS (SELECT subject, diagnosis, CAST(row_number() OVER (PARTITION BY diagnosis ORDER BY subject) AS INTEGER) AS turn FROM subjects) SELECT * FROM r ORDER BY turn, diagnosis LIMIT 33")
def o08(spark, d):
    return joins.round_robin_limit(subjects(spark, d).select("subject", "diagnosis"), "diagnosis", ["subject"], 33)


HIERARCHY = (("label", "diagnosis", "site"), ("label", "diagnosis"), ("label",))
STRATA = f"""{S}, l AS (SELECT * FROM subjects WHERE label <> ''), c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY label, diagnosis, site) >= 8 THEN label || '|' || diagnosis || '|' || site
        WHEN count(*) OVER (PARTITION BY label, diagnosis) >= 8 THEN label || '|' || diagnosis ELSE label END AS s FROM l),
    strata AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s) >= 8 THEN s ELSE label END AS stratum FROM c)"""


def strata(spark, d):
    return splits.stratum_labels(subjects(spark, d).filter("label <> ''"), HIERARCHY, 8, "label")


@book.query("d01_stratum_labels", f"{STRATA} SELECT subject, stratum FROM strata")
def d01(spark, d):
    return strata(spark, d).select("subject", "stratum")


HOLDOUT = f"""{STRATA}, k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha1('0|' || subject), subject) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM strata),
    split AS (SELECT *, CASE WHEN k <= round_even(n * 0.2::DOUBLE, 0) THEN 'locked' ELSE 'cv' END AS split_group, CASE WHEN k > round_even(n * 0.2::DOUBLE, 0) THEN CAST((k - round_even(n * 0.2::DOUBLE, 0) - 1) % 5 AS INTEGER) END AS cv_fold FROM k)"""


def holdout(spark, d):
    return splits.holdout_split(strata(spark, d), "subject", "stratum", 0.2, 5)


@book.query("d02_holdout_split", f"{HOLDOUT} SELECT subject, split_group, cv_fold FROM split")
def d02(spark, d):
    return holdout(spark, d).select("subject", "split_group", "cv_fold")


@book.query("d03_hash_split", f"{S}, k AS (SELECT subject, row_number() OVER (PARTITION BY label ORDER BY sha1(CAST(subject AS VARCHAR)), subject) AS k, count(*) OVER (PARTITION BY label) AS n FROM subjects) SELECT subject, CASE WHEN k <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) THEN 'test' ELSE 'train' END AS part FROM k")
def d03(spark, d):
    return splits.hash_split(subjects(spark, d), "subject", "label", 0.15).select("subject", "part")


@book.query("d04_group_folds")
def d04(spark, d):
    rows = holdout(spark, d).withColumn("label", F.col("label").cast("int"))
    return splits.group_folds(rows, "site", "label", "is_locked_test", 5).select("subject", "site", "robustness_fold")


INNER = f"""{HOLDOUT}, f AS (SELECT DISTINCT cv_fold AS fold FROM split WHERE cv_fold IS NOT NULL), t AS (SELECT fold, subject, label FROM split, f WHERE cv_fold IS NOT NULL AND cv_fold <> fold),
    v AS (SELECT *, (row_number() OVER (PARTITION BY fold, label ORDER BY sha1('0|' || fold || '|' || subject), subject) - 1) % 3 AS v FROM t), i AS (SELECT v.*, CAST(i AS INTEGER) AS inner_fold FROM v, range(0, 3) r(i)),
    inn AS (SELECT *, row_number() OVER (PARTITION BY fold, inner_fold, label, v = inner_fold ORDER BY sha1('0-stop|' || fold || '|' || inner_fold || '|' || subject), subject) AS kk, count(*) OVER (PARTITION BY fold, inner_fold, label, v = inner_fold) AS nn FROM i)"""


@book.query("d05_inner_splits", f"{INNER} SELECT fold, inner_fold, subject, CASE WHEN v = inner_fold THEN 'val' WHEN kk <= round_even(nn * 0.15::DOUBLE, 0) THEN 'stopping' ELSE 'fit' END AS part FROM inn")
def d05(spark, d):
    return splits.inner_splits(holdout(spark, d), "subject", "label", "cv_fold", 3, 0.15)


@book.query("d06_outer_folds", f"{HOLDOUT}, f AS (SELECT DISTINCT cv_fold AS fold FROM split WHERE cv_fold IS NOT NULL) SELECT fold, subject, CASE WHEN cv_fold = fold THEN 'val' ELSE 'train' END AS part FROM split, f WHERE cv_fold IS NOT NULL")
def d06(spark, d):
    return splits.outer_folds(holdout(spark, d), "subject", "cv_fold")


@book.query("d07_check_split", f"{HOLDOUT} SELECT 0::BIGINT AS in_both, 0::BIGINT AS two_folds, 0::BIGINT AS locked_with_fold, count(*) AS n FROM split")
def d07(spark, d):
    return splits.check_split(holdout(spark, d), "subject", "split_group", "cv_fold")
