"""Queries of the sources and sinks, and of the gaze operators, on text and traces that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import audit, gaze as E, signals
from quillspan.operators import windows as W
from quillspan.plans.base import Book
from quillspan.plans.cohort import HOUR, K, S, T, Z
from quillspan.plans.features import SIGNAL, all_rounded, rounded, signal
from quillspan.sources import readers as R
from quillspan.sources.tables import role, role_sql, table

book = Book()
QUERIES, SQL = book.queries, book.sql


@book.query("s01_read_table", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def s01(spark, d):
    return R.read_table(spark, f"{d}/customer.parquet", required=["c_custkey", "c_name"], ids=["c_custkey"]).select("c_custkey", "c_name")


@book.query("s02_read_flexible", "SELECT doc_id, md5(text) AS digest FROM documents")
def s02(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.encode(F.concat(F.lit("﻿"), "text"), "UTF-8")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, d, "documents").select("doc_id", F.md5(R.decode_flexible(raw)).alias("digest"))


@book.query("s03_assert_unique", f"{K} SELECT device, subject, count(*) AS n FROM takes GROUP BY ALL HAVING count(*) > 1")
def s03(spark, d):
    audit.assert_unique(role(spark, d, "subjects"), ["subject"])
    return audit.duplicate_keys(role(spark, d, "takes"), ["device", "subject"])


@book.query("s04_inventory")
def s04(spark, d):
    return R.inventory(spark, d, "*.parquet", id_pattern=r"([a-z]+)\.parquet").select(F.regexp_extract("path", r"([^/]+)/?$", 1).alias("file"), "size", "ids")


@book.query("s05_role_files", f"{K}, r AS (SELECT subject, CASE WHEN path LIKE '%.bdf' THEN 'data' WHEN path LIKE '%.evt' THEN 'event' END AS role, path FROM takes) SELECT subject, role, min(path) AS path, count(*) AS n_files FROM r GROUP BY ALL")
def s05(spark, d):
    return audit.role_files(role(spark, d, "takes"), "subject", "path", {"data": r"\.bdf$", "event": r"\.evt$"})


@book.query("s06_read_trial_csv", "SELECT CAST(event_id AS VARCHAR) AS trial, CASE WHEN event_id % 7 > 0 THEN value END AS rt, event_type AS stimulus FROM events WHERE event_id % 5 > 0")
def s06(spark, d):
    raw = table(spark, d, "events").select(F.col("event_id").cast("string").alias("Trial"), F.when(F.col("event_id") % 7 > 0, F.col("value").cast("string")).otherwise("?").alias("RT"), F.concat(F.lit(" "), "event_type").alias("Stim"), F.when(F.col("event_id") % 5 > 0, "x").otherwise(" ").alias("Running"))
    return R.read_trial_csv(raw, "Running", {"trial": "Trial", "rt": "RT", "stimulus": "Stim"}, ["rt"])


LOG = r"""concat_ws('\n', 'Header: 1', '*** LogFrame Start ***', concat('Img.RESP: ', CASE WHEN event_id % 3 = 0 THEN '' ELSE '1' END), concat('Img.RT: ', CAST(event_id % 3000 AS STRING)), 'Img.RT: 9', concat('Img.OnsetTime: ', CAST(event_id * 2 AS STRING)), '*** LogFrame End ***', '*** LogFrame Start ***', 'Cue.RESP: 2', 'Cue.RT: 500', 'Cue.OnsetTime: 10', '*** LogFrame End ***')"""


@book.query("s07_parse_frame_log", "SELECT event_id, 1::INTEGER AS frame, CAST(event_id % 3000 AS VARCHAR) AS rt, 3::INTEGER AS n_fields FROM events UNION ALL SELECT event_id, 2, '500', 3 FROM events")
def s07(spark, d):
    f = R.parse_frame_log(table(spark, d, "events").select("event_id", F.expr(LOG).alias("text")), "event_id")
    return f.select("event_id", "frame", F.coalesce(F.try_element_at("fields", F.lit("Img.RT")), F.try_element_at("fields", F.lit("Cue.RT"))).alias("rt"), F.size("fields").alias("n_fields"))


@book.query("s08_frames_to_trials", "SELECT event_id, 1::INTEGER AS frame, 'Img' AS object, 0::INTEGER AS block, CASE WHEN event_id % 3 = 0 THEN '' ELSE '1' END AS response, CASE WHEN event_id % 3 > 0 THEN (event_id % 3000) / 1000.0::DOUBLE END AS rt_sec, event_id * 2 / 1000.0::DOUBLE AS onset_sec FROM events UNION ALL SELECT event_id, 2, 'Cue', 1, '2', 0.5, 0.01 FROM events")
def s08(spark, d):
    return R.frames_to_trials(R.parse_frame_log(table(spark, d, "events").select("event_id", F.expr(LOG).alias("text")), "event_id"), "event_id")


@book.query("s09_read_preamble_csv", "SELECT event_id, 0::INTEGER AS sample, 'CH1' AS \"column\", value, NULL::VARCHAR AS mark FROM events UNION ALL SELECT event_id, 0, 'Mark', NULL, 'B' FROM events UNION ALL SELECT event_id, 1, 'CH1', NULL, NULL FROM events UNION ALL SELECT event_id, 1, 'Mark', 0, '0' FROM events UNION ALL SELECT event_id, s, 'Probe1(x)', s + 1, NULL FROM events, range(0, 2) r(s)")
def s09(spark, d):
    text = F.concat_ws("\n", F.lit("Vendor,x"), F.lit("Date,2024"), F.lit("Probe1(x),CH1,Mark,,"), F.concat(F.lit("1,"), F.col("value").cast("string"), F.lit(",B,,")), F.lit("2,bad,0,,"), F.lit(""))
    return R.read_preamble_csv(table(spark, d, "events").select("event_id", text.alias("text")), "Probe1(", "event_id")


@book.query("s10_explode_timeline_json", "SELECT event_id, 'm' || (event_id % 4) AS media, 0::INTEGER AS \"index\", 0.0::DOUBLE AS start_ms, CAST(event_id AS DOUBLE) AS end_ms FROM events UNION ALL SELECT event_id, 'zz', 1, CAST(event_id + 5 AS DOUBLE), CAST(event_id + 9 AS DOUBLE) FROM events")
def s10(spark, d):
    text = F.expr("""concat('{"media": {"7": "m', event_id % 4, '"}, "segments": [{"media_id": "zz", "start": ', event_id + 5, ', "end": ', event_id + 9, '}, {"media_id": "7", "start": 0, "end": ', event_id, '}]}')""")
    return R.explode_timeline_json(table(spark, d, "events").select("event_id", text.alias("json")), "event_id", "json").select("event_id", "media", "index", "start_ms", "end_ms")


@book.query("s15_explode_vectors", "SELECT vec_id, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, unnest(embedding) AS value FROM embeddings")
def s15(spark, d):
    return signals.explode_vectors(signals.collect_vectors(signals.explode_vectors(table(spark, d, "embeddings"), "vec_id", "embedding"), "vec_id"), "vec_id", "vector")


@book.query("s16_attach_meta", f"WITH {role_sql('subjects', 'trials')}, f AS (SELECT subject, count(*) AS signal_n FROM trials GROUP BY subject) SELECT subject, label, site, signal_n FROM subjects JOIN f USING (subject)")
def s16(spark, d):
    f = role(spark, d, "trials").groupBy("subject").agg(F.count("*").alias("signal_n"))
    return R.attach_meta(f, role(spark, d, "subjects"), "subject", ["label", "site"])


def traces(spark, d):
    """Smooth traces from vectors: pairs of neighbouring dimensions as x and y, 10 ms a sample."""
    s = signal(spark, d)
    return s.select("recording", (F.col("sample") * 10.0).alias("time_ms"), (0.5 + F.floor(F.col("sample") / 16) * 0.1 + F.col("value") / 100).alias("x"), (0.5 + F.col("value") / 120).alias("y"))


TRACES = f"{SIGNAL}, tr AS (SELECT recording, sample AS i, sample * 10.0::DOUBLE AS t, 0.5 + floor(sample / 16) * 0.1::DOUBLE + value / 100 AS x, 0.5 + value / 120 AS y FROM signal)"
#: The open fixation at each sample, from the one before it; it is over where the next sample begins a new one.
FIXATIONS = """st AS (
        SELECT recording, i, t AS b, t, x AS lx, x AS hx, y AS ly, y AS hy, x AS sx, y AS sy, 1 AS n FROM tr WHERE i = 0
        UNION ALL
        SELECT recording, i, if(g, b, t), t, if(g, least(lx, x), x), if(g, greatest(hx, x), x), if(g, least(ly, y), y), if(g, greatest(hy, y), y), if(g, sx + x, x), if(g, sy + y, y), if(g, n + 1, 1)
        FROM (SELECT st.recording, tr.i, b, tr.t, x, y, lx, hx, ly, hy, sx, sy, n, tr.t - st.t <= 75 AND greatest(hx, x) - least(lx, x) <= 0.025::DOUBLE AND greatest(hy, y) - least(ly, y) <= 0.025::DOUBLE AS g
            FROM st JOIN tr ON tr.recording = st.recording AND tr.i = st.i + 1)),
    fix AS (SELECT recording, b AS start, t AS end, sx / n AS x, sy / n AS y, n FROM (SELECT *, lead(n) OVER (PARTITION BY recording ORDER BY i) AS nxt FROM st) WHERE coalesce(nxt, 1) = 1 AND n >= 2 AND t - b >= 80)"""


@book.query("w10_fixations", f'WITH RECURSIVE {TRACES}, {FIXATIONS} SELECT recording, round(start, 6) AS start, round("end", 6) AS "end", round(x, 6) AS x, round(y, 6) AS y, CAST(n AS BIGINT) AS n_samples FROM fix')
def w10(spark, d):
    return all_rounded(E.fixations(traces(spark, d), ["recording"], "time_ms"))


@book.query(
    "w12_held_levels",
    f"""WITH RECURSIVE {SIGNAL}, v AS (SELECT recording, sample AS i, 0.5 + floor(sample / 16) * 0.1::DOUBLE AS v FROM signal),
    s AS (SELECT *, count(v) OVER w = 5 AND max(v) OVER w - v < 0.05::DOUBLE AND v - min(v) OVER w < 0.05::DOUBLE AS steady FROM v WINDOW w AS (PARTITION BY recording ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    h AS (SELECT recording, i, v AS level FROM s WHERE i = 0
        UNION ALL SELECT s.recording, s.i, CASE WHEN steady AND abs(v - level) >= 0.05::DOUBLE THEN v ELSE level END FROM h JOIN s ON s.recording = h.recording AND s.i = h.i + 1),
    p AS (SELECT *, lag(level) OVER (PARTITION BY recording ORDER BY i) AS b FROM h)
    SELECT recording, i AS sample, round(sign(level - b), 6) AS direction, round(abs(level - b), 6) AS amplitude, abs(level - 0.5) > abs(b - 0.5) AS outward FROM p WHERE level <> b""",
)
def w12(spark, d):
    t = signal(spark, d).select("recording", "sample", (0.5 + F.floor(F.col("sample") / 16) * 0.1).alias("v"))
    return all_rounded(E.steps(E.held_levels(t, "recording", "sample", "v", 0.05), "recording", "sample"))


SACCADES = f"""{Z}, t AS (SELECT recording, time_ms AS onset, CASE WHEN sample % 2 = 0 THEN 1 ELSE -1 END AS expected, 0.3 AS amplitude FROM gaze WHERE media = 'a'),
    j AS (SELECT t.*, g.time_ms, sign(g.x - 0.5) AS side, abs(g.x - 0.5) AS size FROM t JOIN gaze g ON g.recording = t.recording AND g.x IS NOT NULL AND g.time_ms BETWEEN onset + {HOUR} AND onset + 20 * {HOUR} WHERE abs(g.x - 0.5) >= 0.05),
    f AS (SELECT recording, onset, arg_min(side, time_ms) AS side, min(time_ms) AS t, arg_min(size, time_ms) AS size, min(CASE WHEN side = expected THEN time_ms END) AS right_at FROM j GROUP BY recording, onset),
    scored AS (SELECT t.recording, t.onset, t.expected, f.t - t.onset AS latency, f.side = t.expected AS correct, f.side <> t.expected AND f.right_at > f.t AS corrected, f.size / t.amplitude AS gain FROM t LEFT JOIN f USING (recording, onset))"""


def scored(spark, d):
    g = role(spark, d, "gaze")
    t = g.filter("media = 'a'").select("recording", F.col("time_ms").alias("onset"), F.when(F.col("sample") % 2 == 0, 1).otherwise(-1).alias("expected"), F.lit(0.3).alias("amplitude"))
    return E.score_saccades(g, t, "recording", "time_ms", HOUR, 20 * HOUR, 0.05)


@book.query("w14_score_saccades", f"{SACCADES} SELECT recording, onset, expected, latency, CAST(correct AS INTEGER) AS correct, coalesce(corrected, false) AS corrected, round(gain, 6) AS gain FROM scored")
def w14(spark, d):
    return rounded(scored(spark, d), "gain")


@book.query("a40_saccade_block", f"{SACCADES} SELECT recording, round(avg(CAST(latency IS NOT NULL AS DOUBLE)), 6) AS response_rate, round(avg(CAST(NOT correct AS DOUBLE)), 6) AS error_rate, round(avg(CASE WHEN NOT correct THEN CAST(coalesce(corrected, false) AS DOUBLE) END), 6) AS corrected_rate, median(latency) FILTER (correct) AS latency_median, quantile_cont(latency, 0.75) FILTER (correct) - quantile_cont(latency, 0.25) FILTER (correct) AS latency_iqr, round(median(gain) FILTER (correct), 6) AS gain_median FROM scored GROUP BY recording")
def a40(spark, d):
    return rounded(E.saccade_block(scored(spark, d), ["recording"]), "response_rate", "error_rate", "corrected_rate", "gain_median")


def velocities(spark, d):
    s = signal(spark, d)
    eye = E.smoothed_velocity(s.select("recording", (F.col("sample") * 10.0).alias("time_ms"), "value"), "recording", "time_ms", "value", 15)
    target = F.lit(1.0) + F.col("recording") % 3
    return eye.select("recording", "time_ms", F.col("velocity").alias("eye_velocity"), target.alias("target_velocity"))


_J = range(-7, 8)
VELOCITIES = f"""{SIGNAL}, f AS (SELECT recording, sample AS i, sample * 10.0::DOUBLE AS time_ms, ({" + ".join(f"({j}) * lead(value, {j}) OVER w" if j > 0 else f"({j}) * lag(value, {-j}) OVER w" for j in _J if j)}) / 280.0::DOUBLE AS b1,
        ({" + ".join(f"({j * j} - 56.0::DOUBLE / 3) * lag(value, {-j}) OVER w" if j <= 0 else f"({j * j} - 56.0::DOUBLE / 3) * lead(value, {j}) OVER w" for j in _J)}) / {sum((j * j - 56 / 3) ** 2 for j in _J)!r}::DOUBLE AS b2 FROM signal WINDOW w AS (PARTITION BY recording ORDER BY sample)),
    e AS (SELECT recording, max(b1) FILTER (i = 7) AS p1, max(b2) FILTER (i = 7) AS p2, max(b1) FILTER (i = 56) AS q1, max(b2) FILTER (i = 56) AS q2 FROM f GROUP BY recording),
    vel AS (SELECT recording, time_ms, CASE WHEN i < 7 THEN p1 + 2 * p2 * (i - 7) WHEN i > 56 THEN q1 + 2 * q2 * (i - 56) ELSE b1 END / 0.01::DOUBLE AS eye_velocity, 1.0::DOUBLE + recording % 3 AS target_velocity FROM f JOIN e USING (recording))"""


@book.query("w15_smoothed_velocity", f"WITH {VELOCITIES} SELECT recording, time_ms, round(eye_velocity, 6) AS eye_velocity, target_velocity FROM vel")
def w15(spark, d):
    return all_rounded(velocities(spark, d))


@book.query(
    "w15_velocity_gain",
    f"""WITH {VELOCITIES}, fast AS (SELECT *, CAST(abs(eye_velocity - target_velocity) > 1 AS INT) AS ok FROM vel),
    isl AS (SELECT *, sum(1 - ok) OVER (PARTITION BY recording ORDER BY time_ms) AS island FROM fast),
    rn AS (SELECT recording, count(*) AS n_runs FROM (SELECT recording, island FROM isl WHERE ok = 1 GROUP BY ALL HAVING max(time_ms) - min(time_ms) >= 10) GROUP BY ALL),
    g AS (SELECT recording, median(eye_velocity / target_velocity) AS gain, count(*) AS n_used, (max(time_ms) - min(time_ms)) / 1000 AS seconds FROM vel WHERE abs(target_velocity) >= 0.5 GROUP BY ALL)
    SELECT recording, round(gain, 6) AS velocity_gain, n_used, coalesce(n_runs, 0) AS n_runs, round(coalesce(n_runs, 0) / seconds, 6) AS rate FROM g LEFT JOIN rn USING (recording)""",
)
def w15_gain(spark, d):
    v = velocities(spark, d)
    return all_rounded(E.velocity_gain(v, "recording", 0.5).join(E.catch_up_rate(v, "recording", "time_ms", 1.0, 10), "recording"))


@book.query("a38_viewing_features", f"{T} SELECT subject, " + ", ".join(f"round(avg(rt_sec) FILTER (stimulus = '{v}'), 6) AS {v}_mean, round(stddev_samp(rt_sec) FILTER (stimulus = '{v}'), 6) AS {v}_sd" for v in ("view", "click", "signup")) + ", round(CASE WHEN count(rt_sec) >= 3 THEN regr_slope(rt_sec, trial) * 1000 END, 5) AS trend, " + ", ".join(f"round(avg(rt_sec) FILTER (stimulus = '{v}') - avg(rt_sec) FILTER (stimulus = 'view'), 6) AS contrast_{v}" for v in ("click", "signup")) + " FROM trials GROUP BY subject")
def a38(spark, d):
    t = E.viewing_features(role(spark, d, "trials"), "subject", "stimulus", "rt_sec", "trial", ["view", "click", "signup"])
    return all_rounded(t.withColumn("trend", F.round(F.col("trend") * 1000, 5)))


@book.query("a39_viewing_trials", f"{Z}, c AS (SELECT recording, time_ms AS start, time_ms + 20 * {HOUR} AS stop, avg(pupil) OVER (PARTITION BY recording ORDER BY time_ms RANGE BETWEEN {5 * HOUR} PRECEDING AND CURRENT ROW) AS base FROM gaze), t AS (SELECT c.* FROM c JOIN gaze g ON g.recording = c.recording AND g.time_ms = c.start WHERE g.media = 'a') SELECT t.recording, t.start, count(*) AS n, round(avg(g.valid), 6) AS valid_share, round(avg(g.pupil) - max(t.base), 6) AS pupil_change FROM t JOIN gaze g ON g.recording = t.recording AND g.time_ms BETWEEN t.start AND t.stop GROUP BY ALL")
def a39(spark, d):
    from pyspark.sql import Window

    from quillspan.operators.joins import window_join

    g = role(spark, d, "gaze")
    before = Window.partitionBy("recording").orderBy("time_ms").rangeBetween(-5 * HOUR, 0)
    t = g.withColumn("base", F.avg("pupil").over(before)).filter("media = 'a'").select("recording", F.col("time_ms").alias("start"), (F.col("time_ms") + 20 * HOUR).alias("stop"), "base")
    j = window_join(g, t, "recording", "time_ms", "start", "stop", 20 * HOUR)
    return rounded(j.groupBy("recording", "start").agg(F.count("*").alias("n"), F.avg("valid").alias("valid_share"), (F.avg("pupil") - F.max("base")).alias("pupil_change")), "valid_share", "pupil_change")


#: Rectangles of the regions of a face, windows of a trial in ms, and how much of the cross before it is its baseline.
RECTS = {"eyes": (0.49, 0.49, 0.61, 0.502), "mouth": (0.5, 0.496, 0.75, 0.6), "face": (0.4, 0.4, 0.8, 0.6)}
WINDOWS, BASELINE_MS = {"early": (0, 120), "late": (120, 240)}, 50
VALENCES, CONTRASTS = ["sad", "happy", "neutral"], [("sad", "neutral"), ("happy", "neutral"), ("sad", "happy")]


def viewed(spark, d):
    """Two crosses and two faces in each recording of 640 ms; four recordings make a subject."""
    x = traces(spark, d).join(signal(spark, d).select("recording", (F.col("sample") * 10.0).alias("time_ms"), F.col("value").alias("pupil")), ["recording", "time_ms"])
    off = (F.col("recording") + (F.col("time_ms") / 10).cast("long")) % 11 == 0
    samples = x.select("recording", "time_ms", F.when(~off, F.col("x")).alias("x"), F.when(~off, F.col("y")).alias("y"), "pupil")
    parts = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("trial"), F.lit(float(a)).alias("start"), F.lit(float(b)).alias("end")) for k, a, b in ((None, 0, 80), (1, 80, 320), (None, 320, 400), (2, 400, 640))])).alias("p")
    valence = F.element_at(F.array(*map(F.lit, VALENCES)), ((F.col("recording") + F.coalesce("p.trial", F.lit(0))) % 3 + 1).cast("int"))
    segments = table(spark, d, "embeddings").select(F.col("vec_id").alias("recording"), parts).select("recording", "p.trial", valence.alias("valence"), "p.start", "p.end")
    return E.viewing_windows(samples, segments, "recording", "time_ms", WINDOWS, RECTS, BASELINE_MS)


def _rect(name):
    x0, y0, x1, y1 = RECTS[name]
    return f"x BETWEEN {x0}::DOUBLE AND {x1}::DOUBLE AND y BETWEEN {y0}::DOUBLE AND {y1}::DOUBLE"


VIEWED = f"""{TRACES.replace("tr AS (", "whole AS (")}, sm AS (SELECT w.recording, i, t, CASE WHEN (w.recording + i) % 11 <> 0 THEN x END AS x, CASE WHEN (w.recording + i) % 11 <> 0 THEN y END AS y, value AS pupil FROM whole w JOIN signal s ON s.recording = w.recording AND s.sample = i),
    sp AS (SELECT vec_id AS rec, trial, ['sad', 'happy', 'neutral'][(vec_id + trial) % 3 + 1] AS valence, w, a + o AS f, a + o + 120 AS u, a AS cross_end FROM embeddings, (VALUES (1, 80), (2, 400)) q(trial, a), (VALUES ('early', 0), ('late', 120)) z(w, o)),
    seen AS (SELECT sp.*, sm.*, CASE WHEN x IS NULL THEN NULL WHEN {_rect("eyes")} THEN 'eyes' WHEN {_rect("mouth")} THEN 'mouth' WHEN {_rect("face")} THEN 'face_other' ELSE 'off_face' END AS region FROM sp JOIN sm ON sm.recording = rec AND t >= f AND t < u),
    tr AS (SELECT (rec * 10 + trial) * 2 + CASE w WHEN 'late' THEN 1 ELSE 0 END AS recording, row_number() OVER (PARTITION BY rec, trial, w ORDER BY t) - 1 AS i, t, x, y FROM seen WHERE x IS NOT NULL), {FIXATIONS},
    fp AS (SELECT *, sqrt(power(x - lag(x) OVER v, 2) + power(y - lag(y) OVER v, 2)) AS step FROM fix WINDOW v AS (PARTITION BY recording ORDER BY start)),
    fx AS (SELECT recording AS id, count(*) AS n_fix, avg("end" - start) AS dur, coalesce(sum(step), 0) AS path, min(start) AS s1, arg_min(x, start) AS x, arg_min(y, start) AS y FROM fp GROUP BY recording),
    ms AS (SELECT rec, trial, valence, w, f, count(*) AS n_samples, avg(CAST(x IS NOT NULL AS INT)) AS valid_share, {", ".join(f"avg(CAST(region = '{r}' AS INT)) AS {r}_share" for r in ("eyes", "mouth", "face_other", "off_face"))}, median(pupil) AS pupil,
        CASE WHEN count(x) >= 3 THEN 2 * -ln(1 - 0.68::DOUBLE) * pi() * stddev_samp(x) * stddev_samp(y) * sqrt(greatest(1 - power(coalesce(CASE WHEN var_pop(x) > 1e-9 AND var_pop(y) > 1e-9 THEN corr(x, y) END, 0), 2), 0)) END AS bcea FROM seen GROUP BY rec, trial, valence, w, f),
    bs AS (SELECT rec, trial, median(pupil) AS base FROM (SELECT DISTINCT rec, trial, cross_end FROM sp) JOIN sm ON recording = rec AND t >= cross_end - {BASELINE_MS} AND t < cross_end GROUP BY rec, trial),
    vw AS (SELECT rec AS recording, trial, valence, w AS "window", n_samples, valid_share, eyes_share, mouth_share, face_other_share, off_face_share, CAST(coalesce(n_fix, 0) AS DOUBLE) AS n_fixations, dur AS mean_fixation_ms, coalesce(path, 0) AS scanpath, bcea, pupil - base AS pupil_delta,
        CASE WHEN w = 'early' THEN s1 - f END AS first_fixation_ms, CASE WHEN w = 'early' THEN CAST({_rect("eyes")} AS DOUBLE) END AS first_fixation_on_eyes
        FROM ms LEFT JOIN fx ON id = (rec * 10 + trial) * 2 + CASE w WHEN 'late' THEN 1 ELSE 0 END LEFT JOIN bs USING (rec, trial))"""
VIEW_NUMBERS = ("valid_share", "eyes_share", "mouth_share", "face_other_share", "off_face_share", "mean_fixation_ms", "scanpath", "bcea", "pupil_delta", "first_fixation_ms")


@book.query("a39_viewing_windows", f"""WITH RECURSIVE {VIEWED} SELECT recording, CAST(trial AS BIGINT) AS trial, valence, "window", n_samples, n_fixations, first_fixation_on_eyes, {", ".join(f"round({c}, 6) AS {c}" for c in VIEW_NUMBERS)} FROM vw""")
def a39_windows(spark, d):
    return all_rounded(viewed(spark, d))


_LONG = "CASE WHEN starts_with(measure, 'first_') THEN {} ELSE {} END"


@book.query(
    "a38_viewing_summary",
    f"""WITH RECURSIVE {VIEWED}, lg AS (SELECT recording % 25 AS subject, recording * 10 + trial AS trial, valence, "window" AS w, unnest({list((*E.MEASURES, "first_fixation_ms", "first_fixation_on_eyes"))}) AS measure, unnest([{", ".join((*E.MEASURES, "first_fixation_ms", "first_fixation_on_eyes"))}]) AS value FROM vw),
    kept AS (SELECT * FROM lg WHERE NOT starts_with(measure, 'first_') OR value IS NOT NULL),
    mn AS (SELECT subject, w, valence, measure, avg(value) AS value, stddev_samp(value) AS sd, {_LONG.format("measure || '_' || valence", "w || '_' || valence || '_' || measure")} AS name FROM kept GROUP BY ALL),
    wd AS (SELECT subject, w, measure, {", ".join(f"max(value) FILTER (valence = '{v}') AS {v}" for v in VALENCES)} FROM mn WHERE measure IN ({", ".join(f"'{m}'" for m in (*E.CONTRASTED, "first_fixation_ms", "first_fixation_on_eyes"))}) GROUP BY ALL),
    ct AS ({" UNION ALL ".join(f"SELECT subject, {_LONG.format(f"'contrast_{a}_minus_{b}_' || measure", f"'contrast_' || w || '_{a}_minus_{b}_' || measure")} AS feature, {a} - {b} AS value FROM wd" for a, b in CONTRASTS)}),
    td AS (SELECT subject, 'trend_' || measure AS feature, CASE WHEN count(value) >= 3 THEN regr_slope(value, trial) END AS value FROM kept WHERE w = 'late' AND measure IN ('eyes_share', 'n_fixations', 'pupil_delta') GROUP BY ALL)
    SELECT subject, feature, round(value, 6) + 0 AS value FROM (SELECT subject, name AS feature, value FROM mn UNION ALL SELECT subject, name || '_sd', sd FROM mn WHERE measure IN ('eyes_share', 'pupil_delta') UNION ALL SELECT * FROM ct UNION ALL SELECT * FROM td)""",
)
def a38_summary(spark, d):
    """All nine measures by window and valence, their spreads and contrasts, first fixations and trends."""
    t = viewed(spark, d).withColumns({"subject": F.col("recording") % 25, "trial": F.col("recording") * 10 + F.col("trial")})
    # no negative zero
    return all_rounded(E.viewing_summary(t, "subject", VALENCES, CONTRASTS)).withColumn("value", F.col("value") + 0.0)


FOLLOW = f"{Z}, p AS (SELECT recording, sample, x, (sample * 41 % 97) / 96.0::DOUBLE AS tx, CASE WHEN sample % 2 = 0 THEN 1 ELSE -1 END AS expected FROM gaze)"


def follow(spark, d):
    return role(spark, d, "gaze").select("recording", "sample", "x", ((F.col("sample") * 41 % 97) / 96.0).alias("tx"), F.when(F.col("sample") % 2 == 0, 1).otherwise(-1).alias("expected"))


@book.query("a41_pursuit_block", f"{FOLLOW} SELECT recording, count(x) AS n, round(CASE WHEN count(x) >= 20 THEN corr(x, tx) END, 5) AS corr_x, round(CASE WHEN count(x) >= 20 THEN regr_slope(x, tx) END, 5) AS gain_x, round(CASE WHEN count(x) >= 20 THEN sqrt(avg(power(x - tx, 2))) END, 5) AS rmse, round(avg(CAST(x IS NOT NULL AS DOUBLE)), 5) AS valid_share FROM p GROUP BY recording")
def a41(spark, d):
    return all_rounded(E.pursuit_block(follow(spark, d), ["recording"], 20), 5)


@book.query("a42_direction_agreement", f"{FOLLOW}, s AS (SELECT recording, sample % 10 AS segment, expected, avg(x - 0.5) AS m FROM p WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 3) SELECT recording, round(avg(CAST(sign(m) = expected AS DOUBLE)), 6) AS agreement, count(*) AS n_segments FROM s GROUP BY recording")
def a42(spark, d):
    t = follow(spark, d).withColumn("segment", F.col("sample") % 10)
    return rounded(E.direction_agreement(t, ["recording", "segment"], 3, "sample"), "agreement")


@book.query("a54_spectral_features")
def a54(spark, d):
    return all_rounded(signals.band_powers(signals.welch(signal(spark, d), ["recording"], "sample", "value", 64.0, 32), ["recording"]), 5)


@book.query("a55_rest_features")
def a55(spark, d):
    s = signal(spark, d).withColumn("window", F.floor(F.col("sample") / 32).cast("int"))
    power = signals.welch(s, ["recording", "window"], "sample", "value", 64.0, 16).groupBy("recording", "frequency").agg(F.avg("power").alias("power"))
    return all_rounded(signals.band_powers(power, ["recording"]), 5)
