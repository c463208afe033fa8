"""Gaze traces: validity, gaps, fixations, regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.scans import carried, long_keys
from quillspan.sources.shared import written


def valid_gaze(df: DataFrame, usable: Column, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Samples with x, y and pupil set to NULL where the sample is not usable or off the screen."""
    ok = F.coalesce(usable & F.col("x").between(low, high) & F.col("y").between(low, high), F.lit(False))
    return df.withColumns({"valid": ok, **{c: F.when(ok, F.col(c)) for c in ("x", "y", "pupil")}})


#: Dispersion on either axis, shortest fixation and longest gap in ms.
DISPERSION, SHORTEST_MS, LONGEST_GAP_MS = 0.025, 80.0, 75.0


#: Samples of a piece of a recording, which one task reads from its first to its last; not less than scans.CHUNK.
PIECE = 1 << 16
#: What is known of the fixation that is open at a sample: when it began, its last sample, its bounds, sums and number of samples.
OPEN = ("begin", "last", "low_x", "high_x", "low_y", "high_y", "sum_x", "sum_y", "n")
_OPEN_TYPE = "struct<" + ", ".join(f"{c}: double" for c in OPEN) + ">"


def _grown(state: list[float] | None, t: float, x: float, y: float, dispersion: float, most_gap_ms: float) -> list[float] | None:
    """The open fixation with one more sample, or None where the sample begins a new one."""
    if state is None or t - state[1] > most_gap_ms:
        return None
    lx, hx, ly, hy = min(state[2], x), max(state[3], x), min(state[4], y), max(state[5], y)
    if hx - lx > dispersion or hy - ly > dispersion:
        return None
    return [state[0], t, lx, hx, ly, hy, state[6] + x, state[7] + y, state[8] + 1]


def _piece_batches(keys: list[str], dispersion: float, most_gap_ms: float):
    """The fixations that end inside each piece, and the one that is open at its end (``is_open``).

    Rows come sorted by piece and time; a piece may begin with the fixation that is open where it starts.
    """
    import pyarrow as pa

    place = [*keys, "_piece", "_sub"]

    def read(batches):
        held, last, state = None, None, None

        def out(found: list, head) -> pa.RecordBatch:
            columns = [pa.array([f[0][i] for f in found], c.type) for i, c in enumerate(head)]
            states = pa.array([None if f[1] is None else dict(zip(OPEN, f[1])) for f in found], pa.struct([(c, pa.float64()) for c in OPEN]))
            return pa.RecordBatch.from_arrays([*columns, states, pa.array([f[2] for f in found], pa.bool_())], [*place, "state", "is_open"])

        for batch in batches:
            head, found = [batch.column(c) for c in place], []
            held = head
            marks, carried = list(zip(*(c.to_pylist() for c in head))), batch.column("carried").to_pylist()
            for key, t, x, y, given in zip(marks, *(batch.column(c).to_pylist() for c in ("_t", "x", "y")), carried):
                if key != last:
                    if last is not None:
                        found.append((last, state, True))
                    last, state = key, None
                if t is None:
                    state = None if given is None else [given[c] for c in OPEN]
                    continue
                grown = _grown(state, t, x, y, dispersion, most_gap_ms)
                if grown is None:
                    if state is not None:
                        found.append((key, state, False))
                    grown = [t, t, x, x, y, y, x, y, 1.0]
                state = grown
            if found:
                yield out(found, head)
        if last is not None:
            yield out([(last, state, True)], held)

    return read


def fixations(samples: DataFrame, keys: list[str], time: str, dispersion: float = DISPERSION, least_ms: float = SHORTEST_MS, most_gap_ms: float = LONGEST_GAP_MS) -> DataFrame:
    """Fixations by dispersion: a group grows while both axes stay within the dispersion and no gap is too long.

    A recording is cut where the state must end, at the first long gap after every PIECE samples, and its pieces are dealt to tasks.  A stretch
    of more than PIECE samples without such a gap is cut as well: its pieces are read once from a fresh start, then again with the
    fixation that was open at the end of the piece before, until no piece ends in another one than the round before.  A fixation is far shorter than a
    piece, so the second round as a rule changes nothing.
    """
    kept = samples.filter("x IS NOT NULL AND y IS NOT NULL").select(*keys, F.col(time).cast("double").alias("_t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    found = long_keys(kept, keys, "_t")
    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, _piece long, _sub long, state {_OPEN_TYPE}, is_open boolean"
    place = [*keys, "_piece", "_sub"]

    def read(rows: DataFrame) -> DataFrame:
        return rows.repartition(*place).sortWithinPartitions(*place, F.col("_t").asc_nulls_first()).mapInArrow(_piece_batches(keys, dispersion, most_gap_ms), schema)

    def closed(states: DataFrame) -> DataFrame:
        s = states.filter((F.col("state.n") >= 2) & (F.col("state.last") - F.col("state.begin") >= least_ms))
        mean = lambda c: F.col(f"state.sum_{c}") / F.col("state.n")
        return s.select(*keys, F.col("state.begin").alias("start"), F.col("state.last").alias("end"), mean("x").alias("x"), mean("y").alias("y"), F.col("state.n").cast("long").alias("n_samples"))

    if found is None:
        # every recording is one piece
        whole = kept.withColumns({"_piece": F.lit(0).cast("long"), "_sub": F.lit(0).cast("long"), "carried": F.lit(None).cast(_OPEN_TYPE)})
        return closed(read(whole))
    t = carried(kept, keys, ["_t"], found, before={"_before": F.col("_t")}, upto={"_at": F.lit(1).cast("long")})
    t = t.withColumn("_cut", F.when(F.col("_before").isNull() | (F.col("_t") - F.col("_before") > most_gap_ms), F.col("_at")))
    t = carried(t, keys, ["_t"], found, last={"_from": F.col("_cut")})
    t = t.withColumns({"_piece": F.floor(F.col("_from") / PIECE), "_sub": F.floor((F.col("_at") - F.col("_from")) / PIECE), "carried": F.lit(None).cast(_OPEN_TYPE)})
    t = written(t.select(*place, "_t", "x", "y", "carried"), "pieces")
    over = t.filter("_sub > 0").select(*keys, "_piece").distinct()
    long = t.join(over, [*keys, "_piece"], "left_semi")
    result = closed(read(t.join(over, [*keys, "_piece"], "left_anti")))
    if over.isEmpty():
        return result
    states = written(read(long), "open")
    ends = lambda df: df.filter("is_open").select(*place, "state")
    while True:
        given = ends(states).select(*keys, "_piece", (F.col("_sub") + 1).alias("_sub"), *[F.lit(None).cast("double").alias(c) for c in ("_t", "x", "y")], F.col("state").alias("carried"))
        given = given.join(long.select(*place).distinct(), place, "left_semi")
        again = written(read(long.unionByName(given)), "open")
        changed = ends(again).join(ends(states).withColumnRenamed("state", "was"), place).filter(~F.col("state").eqNullSafe(F.col("was")))
        states = again
        if changed.isEmpty():
            break
    last = ends(states).groupBy(*keys, "_piece").agg(F.max_by("state", "_sub").alias("state"))
    return result.unionByName(closed(states.filter("NOT is_open"))).unionByName(closed(last))


def _level_batches(key: str, frame: str, least_step: float, level: str):
    """For each chunk, from rows sorted by chunk and frame: what the level is after it, or at each of its frames.

    Without ``entering`` levels this gives the chunk's function from the level that enters to the one that leaves, as rows: from
    ``bound`` on (upwards, or downwards), the level that leaves.  A level that meets none of the bounds leaves as it entered.
    """
    import numpy as np
    import pyarrow as pa

    def groups(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, chunks = batch.column(key).to_pylist(), batch.column("_chunk").to_numpy()
            at = 0
            for i in range(1, batch.num_rows + 1):
                if i == batch.num_rows or keys[i] != keys[at] or chunks[i] != chunks[at]:
                    if held and last != (keys[at], chunks[at]):
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(at, i - at))
                    last, at = (keys[at], chunks[at]), i
        if held:
            yield pa.Table.from_batches(held)

    def leaving(v, i, known):
        """The level at the end if it is v[i] at i; every place on the way is noted."""
        way = []
        while i not in known:
            way.append(i)
            step, nxt = 1024, None
            for at in range(i + 1, len(v), step):
                far = np.flatnonzero(np.abs(v[at : at + step] - v[i]) >= least_step)
                if len(far):
                    nxt = at + int(far[0])
                    break
            if nxt is None:
                known[i] = v[i]
            else:
                i = nxt
        for j in way:
            known[j] = known[i]
        return known[i]

    def functions(batches):
        for table in groups(batches):
            v = table["v"].to_numpy()[table["_steady"].to_numpy()]
            known, rows = {}, []
            for sign in (1.0, -1.0):
                best = np.maximum.accumulate(sign * v)
                for i in np.flatnonzero(np.append(True, best[1:] > best[:-1])).tolist() if len(v) else []:
                    rows.append((sign, i, float(v[i]), float(leaving(v, i, known))))
            if rows:
                sign, at, bound, out = (pa.array(c) for c in zip(*rows))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([table[key].combine_chunks().take(pa.array([0] * n)), pa.array([table["_chunk"][0].as_py()] * n, pa.int64()), sign, at, bound, out], [key, "_chunk", "sign", "place", "bound", "leaves"])

    def levels(batches):
        for table in groups(batches):
            v, steady, now = table["v"].to_numpy(), np.flatnonzero(table["_steady"].to_numpy()), table["entering"][0].as_py()
            now = math.nan if now is None else now
            out, at = np.empty(len(v)), 0
            while True:
                # the next steady frame that is a step away
                ahead = steady[np.searchsorted(steady, at) :]
                nxt = None
                for j in range(0, len(ahead), 1024):
                    far = np.flatnonzero(np.abs(v[ahead[j : j + 1024]] - now) >= least_step)
                    if len(far):
                        nxt = int(ahead[j + int(far[0])])
                        break
                out[at : len(v) if nxt is None else nxt] = now
                if nxt is None:
                    break
                now, at = v[nxt], nxt
            yield pa.RecordBatch.from_arrays([table[key].combine_chunks(), table[frame].combine_chunks(), pa.array(out)], [key, frame, "level"])

    return levels if level == "levels" else functions


def held_levels(track: DataFrame, key: str, frame: str, value: str, least_step: float, frames: int = 5) -> DataFrame:
    """The level at each frame: a new one is taken on only if it is a step away and stays for some frames.

    A frame is steady if it and those after it, ``frames`` in all, lie within a step of it, which no level decides.  A track is cut into chunks of frames;
    a chunk's function from the level that enters to the one that leaves is a short list of bounds, and the lists of a
    track, composed in order, give the level that enters each chunk.
    """
    rows = track.select(key, frame, F.col(value).cast("double").alias("v"))
    found = long_keys(rows, [key], frame)
    t = carried(rows, [key], [frame], found, upto={"_at": F.lit(1).cast("long")}).withColumn("_chunk", F.floor((F.col("_at") - 1) / PIECE))
    # the first frames of a chunk are looked at from the chunk before as well
    inside = (F.col("_at") - 1) % PIECE
    seen = F.when((inside < frames - 1) & (F.col("_chunk") > 0), F.array(F.col("_chunk"), F.col("_chunk") - 1)).otherwise(F.array("_chunk"))
    t = t.select(key, frame, "v", "_at", F.col("_chunk").alias("_own"), F.explode(seen).alias("_chunk"))
    w = Window.partitionBy(key, "_chunk").orderBy("_at").rowsBetween(0, frames - 1)
    steady = (F.count("v").over(w) == frames) & (F.max("v").over(w) - F.col("v") < least_step) & (F.col("v") - F.min("v").over(w) < least_step)
    t = t.withColumn("_steady", steady).filter("_own = _chunk").drop("_own")
    kind = track.schema
    head = f"`{key}` {kind[key].dataType.simpleString()}"
    place = [key, "_chunk"]
    first = t.filter("_at = 1").select(key, F.col("v").alias("_first"))
    if found is None:
        entering = first.select(key, F.lit(0).cast("long").alias("_chunk"), F.col("_first").alias("entering"))
    else:
        bounds = t.filter("v IS NOT NULL").repartition(*place).sortWithinPartitions(*place, "_at").mapInArrow(_level_batches(key, frame, least_step, "functions"), f"{head}, _chunk long, sign double, place long, bound double, leaves double")
        # a short list a chunk; only those of one track meet
        lists = bounds.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("place", "sign", "bound", "leaves"))).alias("f"))
        chunks = t.select(*place).distinct().join(lists, place, "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_chunk", "f"))).alias("chunks")).join(first, key)

        def passed(now, chunk):
            hit = F.filter(chunk["f"], lambda b: b["sign"] * (b["bound"] - now["level"]) >= least_step)
            level = F.when(F.size(hit) > 0, F.element_at(hit, 1)["leaves"]).otherwise(now["level"])
            return F.struct(level.alias("level"), F.array_append(now["seen"], F.struct(chunk["_chunk"].alias("_chunk"), now["level"].alias("entering"))).alias("seen"))

        start = F.struct(F.col("_first").alias("level"), F.array().cast("array<struct<_chunk: bigint, entering: double>>").alias("seen"))
        entering = chunks.select(key, F.explode(F.aggregate("chunks", start, passed)["seen"]).alias("e")).select(key, "e.*")
    met = t.join(entering, place).repartition(*place).sortWithinPartitions(*place, "_at")
    return met.mapInArrow(_level_batches(key, frame, least_step, "levels"), f"{head}, `{frame}` {kind[frame].dataType.simpleString()}, level double")


def steps(levels: DataFrame, key: str, frame: str) -> DataFrame:
    """Frames where the level changes: direction, amplitude, and whether it moves away from the middle (0.5)."""
    before = F.lag("level").over(Window.partitionBy(key).orderBy(frame))
    t = levels.withColumn("_b", before).filter("_b IS NOT NULL AND level <> _b")
    return t.select(key, frame, F.signum(F.col("level") - F.col("_b")).alias("direction"), F.abs(F.col("level") - F.col("_b")).alias("amplitude"), (F.abs(F.col("level") - 0.5) > F.abs(F.col("_b") - 0.5)).alias("outward"))


def score_saccades(samples: DataFrame, trials: DataFrame, key: str, time: str, least_ms: float, most_ms: float, offset: float) -> DataFrame:
    """Per trial (key, onset, expected, amplitude): latency of the first sample that leaves the middle, its direction, whether it is right, a later correction, and the gain.

    trials carry ``onset``, ``expected`` (-1 or 1) and ``amplitude``.
    """
    from quillspan.operators.joins import window_join

    windows = trials.withColumns({"_from": F.col("onset") + least_ms, "_to": F.col("onset") + most_ms})
    j = window_join(samples.filter("x IS NOT NULL"), windows, key, time, "_from", "_to", most_ms)
    away = F.abs(F.col("x") - 0.5) >= offset
    side = F.signum(F.col("x") - 0.5)
    first = F.min(F.when(away, F.struct(F.col(time).alias("t"), side.alias("side"), F.abs(F.col("x") - 0.5).alias("size")))).alias("first")
    right = F.min(F.when(away & (side == F.col("expected")), F.col(time))).alias("right_at")
    found = j.groupBy(key, "onset", "expected", "amplitude").agg(first, right)
    scored = trials.join(found.drop("expected", "amplitude"), [key, "onset"], "left")
    correct = F.col("first.side") == F.col("expected")
    return scored.select(key, "onset", "expected", (F.col("first.t") - F.col("onset")).alias("latency"), correct.cast("int").alias("correct"), F.coalesce(~correct & (F.col("right_at") > F.col("first.t")), F.lit(False)).alias("corrected"), F.try_divide(F.col("first.size"), F.col("amplitude")).alias("gain"))


def smoothed_velocity(samples: DataFrame, key: str, time: str, value: str, width: int) -> DataFrame:
    """Velocity by a quadratic least-squares fit over ``width`` (odd) samples; at the ends the edge window's parabola is used; NaN for shorter series.

    The fit of evenly spaced samples is a fixed convolution over the rows around a sample.  A recording is cut into pieces of PIECE samples, and a piece is
    given the half window before and after it.
    """
    half = width // 2
    places = range(-half, half + 1)
    square = sum(j * j for j in places)
    middle = square / width
    curved = sum((j * j - middle) ** 2 for j in places)
    rows = samples.select(key, time, F.col(value).cast("double").alias("_v"))
    found = long_keys(rows, [key], time)
    t = carried(rows, [key], [time], found, upto={"_at": F.lit(1).cast("long")}, before={"_was": F.col(time).cast("double")}).withColumn("_at", F.col("_at") - 1)
    whole = t.groupBy(key).agg(F.count("*").alias("_n"), (F.median(F.col(time).cast("double") - F.col("_was")) / 1000.0).alias("_dt"))
    own, inside = F.floor(F.col("_at") / PIECE), F.col("_at") % PIECE
    seen = F.array_compact(F.array(own, F.when(inside < half, own - 1), F.when(inside >= PIECE - half, own + 1)))
    t = t.withColumn("_own", own).withColumn("_piece", F.explode(seen))
    w = Window.partitionBy(key, "_piece").orderBy("_at")
    around = {j: F.lag("_v", -j).over(w) for j in places}
    slope = sum((around[j] * (j / square) for j in places if j), F.lit(0.0))
    bend = sum((around[j] * ((j * j - middle) / curved) for j in places), F.lit(0.0))
    t = t.withColumns({"_b1": slope, "_b2": bend}).filter("_own = _piece").join(whole, key, "left")
    fit = F.struct("_b1", "_b2")
    # the fits of the first and the last whole window stand for the samples before and after their centres
    ends = t.groupBy(key).agg(F.max(F.when(F.col("_at") == half, fit)).alias("_first"), F.max(F.when(F.col("_at") == F.col("_n") - 1 - half, fit)).alias("_last"))
    t = t.join(ends, key, "left")
    before = F.col("_first._b1") + 2 * F.col("_first._b2") * (F.col("_at") - half)
    after = F.col("_last._b1") + 2 * F.col("_last._b2") * (F.col("_at") - (F.col("_n") - 1 - half))
    velocity = F.when(F.col("_at") < half, before).when(F.col("_at") >= F.col("_n") - half, after).otherwise(F.col("_b1")) / F.col("_dt")
    return t.select(key, time, F.when(F.col("_n") >= width, velocity).otherwise(F.lit(float("nan"))).alias("velocity"))


def velocity_gain(pairs: DataFrame, key: str, least_target: float) -> DataFrame:
    """Median of eye over target velocity where the target moves fast enough."""
    ratio = F.when(F.abs("target_velocity") >= least_target, F.try_divide(F.col("eye_velocity"), F.col("target_velocity")))
    return pairs.groupBy(key).agg(F.median(ratio).alias("velocity_gain"), F.count(ratio).alias("n_used"))


def catch_up_rate(pairs: DataFrame, key: str, time: str, limit: float, least_ms: float) -> DataFrame:
    """Runs of residual speed above the limit lasting ``least_ms``, per second of the recording."""
    from quillspan.operators.windows import present_blocks

    runs = present_blocks(pairs, key, time, F.coalesce(F.abs(F.col("eye_velocity") - F.col("target_velocity")) > limit, F.lit(False)), least_ms).groupBy(key).agg(F.count("*").alias("n_runs"))
    span = pairs.groupBy(key).agg(((F.max(time) - F.min(time)) / 1000.0).alias("seconds"))
    return span.join(runs, key, "left").select(key, F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.try_divide(F.coalesce("n_runs", F.lit(0)).cast("double"), F.col("seconds")).alias("rate"))


def pursuit_block(pairs: DataFrame, keys: list[str], least_samples: int) -> DataFrame:
    """Correlation, position gain (slope), RMSE and valid share of gaze against target; NULL under ``least_samples``."""
    from quillspan.operators.resample import pearson

    n = F.count(F.when(F.col("x").isNotNull() & F.col("tx").isNotNull(), 1))
    enough = lambda c: F.when(n >= least_samples, c)
    return pairs.groupBy(*keys).agg(
        n.alias("n"), enough(pearson(F.col("x"), F.col("tx"))).alias("corr_x"), enough(F.regr_slope("x", "tx")).alias("gain_x"), enough(F.sqrt(F.avg(F.pow(F.col("x") - F.col("tx"), 2)))).alias("rmse"),
        F.avg(F.col("x").isNotNull().cast("double")).alias("valid_share"),
    )


def saccade_block(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Response, error and corrected-error rates; median and IQR of latency and gain of the right ones."""
    right = F.col("correct") == 1
    return scored.groupBy(*keys).agg(
        F.avg(F.col("latency").isNotNull().cast("double")).alias("response_rate"), F.avg((~right).cast("double")).alias("error_rate"), F.avg(F.when(~right, F.col("corrected").cast("double"))).alias("corrected_rate"),
        F.median(F.when(right, F.col("latency"))).alias("latency_median"), (F.percentile(F.when(right, F.col("latency")), 0.75) - F.percentile(F.when(right, F.col("latency")), 0.25)).alias("latency_iqr"), F.median(F.when(right, F.col("gain"))).alias("gain_median"),
    )


def viewing_features(trials: DataFrame, subject: str, valence: str, value: str, order: str, valences: list[str]) -> DataFrame:
    """Mean and sample deviation per valence, the contrast of each later valence with the first, and the trend over trials."""
    per = [x for v in valences for x in (F.avg(F.when(F.col(valence) == v, F.col(value))).alias(f"{v}_mean"), F.stddev_samp(F.when(F.col(valence) == v, F.col(value))).alias(f"{v}_sd"))]
    out = trials.groupBy(subject).agg(*per, F.when(F.count(value) >= 3, F.regr_slope(value, order)).alias("trend"))
    return out.withColumns({f"contrast_{v}": F.col(f"{v}_mean") - F.col(f"{valences[0]}_mean") for v in valences[1:]})


def direction_agreement(samples: DataFrame, keys: list[str], least: int, order: str) -> DataFrame:
    """Share of segments whose mean gaze lies on the target's side of the middle.

    Where a mean is 0 but for rounding, its sign hangs on the order of the additions; so a segment's samples are added one after
    the other as ``order`` has them, whatever the partitions.
    """
    place = [*keys, "expected"]
    ordered = samples.filter("x IS NOT NULL").repartition(*place).sortWithinPartitions(*place, order)
    seg = ordered.groupBy(*place).agg(F.avg(F.col("x") - 0.5).alias("_m"), F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return seg.groupBy(*keys[:-1]).agg(F.avg((F.signum("_m") == F.col("expected")).cast("double")).alias("agreement"), F.count("*").alias("n_segments"))


#: The measures of a trial and window that are averaged by valence, and those that are compared between valences.
MEASURES = ("eyes_share", "mouth_share", "face_other_share", "off_face_share", "n_fixations", "mean_fixation_ms", "scanpath", "bcea", "pupil_delta")
CONTRASTED = ("eyes_share", "mouth_share", "off_face_share", "n_fixations", "mean_fixation_ms", "scanpath", "pupil_delta")


def viewing_windows(
    samples: DataFrame, segments: DataFrame, key: str, time: str, windows: dict[str, tuple[float, float]], rects: dict[str, tuple[float, float, float, float]], baseline_ms: float,
) -> DataFrame:
    """One row per trial and analysis window: valid share, region shares, fixations, path, area, and the pupil against the tail of the cross before.

    ``segments`` carry the key, ``trial`` (NULL: a cross), ``valence``, ``start`` and ``end``; ``rects`` are x0, y0, x1, y1 of eyes, mouth and
    face, the first that holds a point is its region.  Windows are offsets from a trial's start, cut off at its end, and half-open.
    """
    from quillspan.operators.features import bcea
    from quillspan.operators.joins import window_join

    place = [key, "trial", "window"]
    cross = F.when(F.col("trial").isNull(), F.struct("start", "end"))
    trials = carried(segments, [key], ["start"], long_keys(segments, [key], "start"), last={"_cross": cross}).filter("trial IS NOT NULL")
    spans = F.array(*[F.struct(F.lit(n).alias("window"), (F.col("start") + a).alias("from"), F.least(F.col("start") + b, F.col("end")).alias("to")) for n, (a, b) in windows.items()])
    spans = trials.select(key, "trial", "valence", F.explode(spans).alias("s")).select(key, "trial", "valence", "s.*")
    width = max(b - a for a, b in windows.values())
    seen = window_join(samples, spans, key, time, "from", "to", width, closed=False)
    valid = F.col("x").isNotNull() & F.col("y").isNotNull()
    region = F.when(~valid, F.lit(None))
    for name, (x0, y0, x1, y1) in rects.items():
        region = region.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), "face_other" if name == "face" else name)
    seen = seen.withColumn("_region", region.otherwise("off_face"))
    shares = [F.avg((F.col("_region") == r).cast("double")).alias(f"{r}_share") for r in (*("face_other" if n == "face" else n for n in rects), "off_face")]
    measured = seen.groupBy(*place).agg(F.count("*").alias("n_samples"), F.avg(valid.cast("double")).alias("valid_share"), *shares, F.median("pupil").alias("_pupil")).join(bcea(seen, place), place)
    fixed = fixations(seen, place, time)
    step = Window.partitionBy(*place).orderBy("start")
    fixed = fixed.withColumn("_step", F.hypot(F.col("x") - F.lag("x").over(step), F.col("y") - F.lag("y").over(step)))
    first = F.min(F.struct("start", "x", "y"))
    fixed = fixed.groupBy(*place).agg(F.count("*").alias("n_fixations"), F.avg(F.col("end") - F.col("start")).alias("mean_fixation_ms"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("scanpath"), first.alias("_first"))
    tails = trials.filter("_cross IS NOT NULL").select(key, "trial", F.greatest(F.col("_cross.start"), F.col("_cross.end") - baseline_ms).alias("from"), F.col("_cross.end").alias("to"))
    before = window_join(samples, tails, key, time, "from", "to", baseline_ms, closed=False).groupBy(key, "trial").agg(F.median("pupil").alias("_base"))
    out = spans.join(measured, place).join(fixed, place, "left").join(before, [key, "trial"], "left")
    x0, y0, x1, y1 = rects["eyes"]
    early = F.col("window") == next(iter(windows))
    return out.select(
        key, "trial", "valence", "window", "n_samples", "valid_share", *[c for c in measured.columns if c.endswith("_share") and c != "valid_share"], F.coalesce("n_fixations", F.lit(0)).cast("double").alias("n_fixations"),
        "mean_fixation_ms", F.coalesce("scanpath", F.lit(0.0)).alias("scanpath"), "bcea", (F.col("_pupil") - F.col("_base")).alias("pupil_delta"),
        F.when(early, F.col("_first.start") - F.col("from")).alias("first_fixation_ms"),
        F.when(early, (F.col("_first.x").between(x0, x1) & F.col("_first.y").between(y0, y1)).cast("double")).alias("first_fixation_on_eyes"),
    )


def viewing_summary(trials: DataFrame, subject: str, valences: list[str], contrasts: list[tuple[str, str]]) -> DataFrame:
    """subject, feature, value: means by window and valence, spreads, contrasts, first fixations and trends over the trials of the last window."""
    names = [*MEASURES, "first_fixation_ms", "first_fixation_on_eyes"]
    long = trials.select(subject, "trial", "valence", "window", F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])).alias("measure", "value"))
    once = F.col("measure").startswith("first_")
    long = long.filter(~once | F.col("value").isNotNull())
    head = F.when(once, F.concat_ws("_", "measure", "valence")).otherwise(F.concat_ws("_", "window", "valence", "measure"))
    means = long.groupBy(subject, "window", "valence", "measure").agg(F.avg("value").alias("value"), F.stddev_samp("value").alias("spread"))
    plain = means.select(subject, head.alias("feature"), "value")
    spread = means.filter(F.col("measure").isin("eyes_share", "pupil_delta")).select(subject, F.concat(head, F.lit("_sd")).alias("feature"), F.col("spread").alias("value"))
    of = lambda v: F.max(F.when(F.col("valence") == v, F.col("value")))
    compared = means.filter(F.col("measure").isin(*CONTRASTED) | once).groupBy(subject, "window", "measure").agg(*[of(v).alias(v) for v in valences])
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{a}_minus_{b}").alias("pair"), (F.col(a) - F.col(b)).alias("value")) for a, b in contrasts])).alias("p")
    title = F.when(once, F.concat_ws("_", F.lit("contrast"), "p.pair", "measure")).otherwise(F.concat_ws("_", F.lit("contrast"), "window", "p.pair", "measure"))
    compared = compared.select(subject, "window", "measure", pairs).select(subject, title.alias("feature"), "p.value")
    last = long.filter((F.col("window") == "late") & F.col("measure").isin("eyes_share", "n_fixations", "pupil_delta"))
    trend = last.groupBy(subject, "measure").agg(F.when(F.count("value") >= 3, F.regr_slope("value", "trial")).alias("value")).select(subject, F.concat(F.lit("trend_"), "measure").alias("feature"), "value")
    return plain.unionByName(spread).unionByName(compared).unionByName(trend)
