"""Removal of bytes inside 200-byte strings that occur twice, by suffix buckets under a cover sample.

A cover sample picks positions such that any two equal 200-byte strings have a common offset at
which both are sampled.  Here the sample is content-defined: the position of the least 48-byte
hash inside the string (the leftmost on ties), which equal strings share by construction; it takes 1.3 per cent
of the positions, where a periodic difference cover would take 9.

1. *Sample.*  Each task names the samples of its documents (a hash of the 48 bytes) and groups the
   200-byte windows that reach the same sample into a stretch; a stretch is named as a whole, too.
2. *Names.*  Stretches whose sample name occurs once hold no repeat.  A stretch that occurs twice as a whole repeats
   in every window, and nothing has to be sorted for it; copies are counted in the tasks before they are exchanged.
3. *Buckets.*  What is left goes to suffix buckets, by the sample's name: suffixes of a bucket are sorted one bucket
   at a time, by the distance to the sample and then by the name of the whole window, so that the long tie
   behind the sample is settled by names made before.  Windows that meet in one batch of documents are marked there and
   sent on once, so that a passage in very many documents does not fill a bucket; a bucket with very many
   stretches is split by window names.  A task holds a bounded run of buckets.
4. *Spans.*  The repeated windows of a document are united and their bytes taken out.

Matches never cross documents, and strings are judged on the input.

Defined cases: null counts as empty, and texts under 200 bytes repeat nothing (kept_sha256 is that of the text); the
same row twice repeats all of its 200-byte strings; occurrences may overlap in one text; a null doc_id is carried
through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents, dropped, small, stored
from quillspan.llm.textcore import _BASE, _INVERSE, _LETTER, mix, pieces, powers, text_bytes

LENGTH = 200
GRAM = 48
#: Stretches of one name up to which they are sorted as one bucket.
BUCKET_STRETCHES = 2048
#: Added to the place of a window that is sent to mark others only; places lie between -LENGTH and LENGTH.
FOREIGN = 1 << 12
#: Windows that a bucket task holds at a time.
HELD_WINDOWS = 1 << 21


def running(data: np.ndarray) -> np.ndarray:
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[data] * powers(_BASE, len(data))[: len(data)], out=total[1:])
    return total


def grams(total: np.ndarray, starts: np.ndarray | slice, length: int) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes at the starts."""
    n = len(total) - 1
    if isinstance(starts, slice):
        return mix((total[length:] - total[: n + 1 - length]) * powers(_INVERSE, n + 1)[: n + 1 - length])
    return mix((total[starts + length] - total[starts]) * powers(_INVERSE, n + 1)[starts])


def least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive keys."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, 1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def stretches(data: np.ndarray, places: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """text, lo, hi (first and last window start in the text), back (sample minus lo), name and whole of each stretch."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return {"text": none, "lo": none, "hi": none, "back": none, "name": none, "whole": none}
    total = running(data)
    names = grams(total, slice(None), gram)
    keys = (names >> np.uint64(32) << np.uint64(32)) | np.arange(len(names), dtype=np.uint64)
    sample = (least_in_window(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(sample))
    text = np.searchsorted(places, start, "right") - 1
    valid = start + length <= places[np.minimum(text + 1, len(places) - 1)]
    start, sample, text = start[valid], sample[valid], text[valid]
    if not len(start):
        return {"text": none, "lo": none, "hi": none, "back": none, "name": none, "whole": none}
    new = np.append(True, (sample[1:] != sample[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, text, sample = start[first], start[last], text[first], sample[first]
    end = hi + length
    whole = mix((total[end] - total[lo]) * powers(_INVERSE, len(total))[lo] ^ mix(((end - lo) * 4096 + sample - lo).astype(np.uint64)))
    begin = places[text]
    return {"text": text, "lo": lo - begin, "hi": hi - begin, "back": sample - lo, "name": names[sample].view(np.int64), "whole": whole.view(np.int64)}


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        key_a, key_b = batch.column("key_a").to_numpy(), batch.column("key_b").to_numpy()
        for at, to in pieces(offsets):
            s = stretches(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            row = at + s["text"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key_a[row]), pa.array(key_b[row]), *(pa.array(s[c].astype(np.int32)) for c in ("lo", "hi", "back")), pa.array(s["name"]), pa.array(s["whole"])],
                ["key_a", "key_b", "lo", "hi", "back", "name", "whole"],
            )


def _repeated(name: np.ndarray, place: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows occur twice (same sample name, distance to the sample, and name of the whole window), and the first of each kind."""
    key = mix(mix(name.view(np.uint64) ^ mix((place + 4096).astype(np.uint64))) + window)
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (name[a] == name[b]) & (place[a] == place[b]) & (window[a] == window[b])
    twice, first = np.zeros(len(key), bool), np.ones(len(key), bool)
    twice[a[same]] = twice[b[same]] = True
    first[b[same]] = False
    return twice, first


WINDOWS = ("name", "part", "key_a", "key_b", "at", "marks", "places", "windows")


def _marked(row: np.ndarray, place: np.ndarray, key_a: np.ndarray, key_b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys, start and end of the runs of neighbouring repeated windows; at is the sample's place in the text of each row."""
    new = np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    own = row[first]
    return key_a[own], key_b[own], at[own] + place[first], at[own] + place[last] + LENGTH


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window names of the asked stretches, packed by stretch and part, and the runs of windows that this batch holds twice.

    A run comes as a row whose ``marks`` holds its start and end; it passes the exchange unchanged.
    """
    for batch in batches:
        stretch, place, window = [], [], []
        own: list[tuple] = []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            for s in wanted:
                lo, hi = s["lo"], s["hi"]
                found = grams(running(data[lo : hi + LENGTH]), slice(None), LENGTH)
                stretch.append(np.full(len(found), len(own), np.int64))
                place.append(np.arange(len(found), dtype=np.int64) - s["back"])
                window.append(found)
                own.append((s["name"], s["parts"], s["key_a"], s["key_b"], lo + s["back"], s["alone"]))
        if not own:
            continue
        row, place, window = np.concatenate(stretch), np.concatenate(place), np.concatenate(window)
        name, parts, key_a, key_b, at, alone = (np.array(c) for c in zip(*own))
        twice, first = _repeated(name[row], place, window)
        mark = twice & alone[row]
        if mark.any():
            ka, kb, start, end = _marked(row[mark], place[mark], key_a, key_b, at)
            n = len(ka)
            marks = np.stack([start, end], 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ka), pa.array(np.zeros(n, np.int64)), pa.array(ka), pa.array(kb.astype(np.int32)), pa.array(np.zeros(n, np.int64)),
                 pa.array([m.tobytes() for m in marks], pa.binary()), pa.array([b""] * n, pa.binary()), pa.array([b""] * n, pa.binary())],
                list(WINDOWS),
            )
        # one of each kind goes on; to be marked later it must come with its stretch, unless it is marked already
        sent = np.flatnonzero(first)
        part = (window[sent] % parts[row[sent]].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((place[sent], part, row[sent]))
        sent, part = sent[order], part[order]
        new = np.append(True, (row[sent][1:] != row[sent][:-1]) | (part[1:] != part[:-1]))
        cut = np.append(np.flatnonzero(new), len(sent))
        # a window that is marked here is sent without a claim: its place is shifted out of the way by FOREIGN
        places = np.where(mark[sent] | ~alone[row[sent]], place[sent] + FOREIGN, place[sent]).astype(np.int16)
        names = window[sent]
        of = row[sent][cut[:-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(name[of]), pa.array(part[cut[:-1]]), pa.array(key_a[of]), pa.array(key_b[of].astype(np.int32)), pa.array(at[of].astype(np.int64)), pa.nulls(len(of), pa.binary()),
             pa.array([places[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary()), pa.array([names[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())],
            list(WINDOWS),
        )


def _runs(table: pa.Table) -> pa.RecordBatch | None:
    """Sort the windows of the held buckets and give the runs of repeated ones of each text."""
    names = table["windows"].to_pylist()
    count = np.array([len(x) // 8 for x in names], np.int64)
    row = np.repeat(np.arange(len(count)), count)
    place = np.frombuffer(b"".join(table["places"].to_pylist()), np.int16).astype(np.int64)
    claimed = place < FOREIGN // 2
    place = np.where(claimed, place, place - FOREIGN)
    twice, _ = _repeated(table["name"].to_numpy()[row], place, np.frombuffer(b"".join(names), np.uint64))
    twice &= claimed
    if not twice.any():
        return None
    row, place = row[twice], place[twice]
    found = _marked(row, place, *(table[c].to_numpy() for c in ("key_a", "key_b", "at")))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["key_a", "key_b", "start", "end"])


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One run of whole buckets at a time; rows come sorted by name and part, ready runs among them."""
    held: list[pa.Table] = []
    windows = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        ready = np.array([i for i, x in enumerate(batch.column("marks").to_pylist()) if x is not None], np.int64)
        if len(ready):
            some = table.take(pa.array(ready))
            spans = np.frombuffer(b"".join(some["marks"].to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [some["key_a"].combine_chunks(), some["key_b"].combine_chunks(), pa.array(spans[:, 0].copy(), pa.int32()), pa.array(spans[:, 1].copy(), pa.int32())], ["key_a", "key_b", "start", "end"]
            )
            table = table.filter(pa.compute.is_null(table["marks"]))
        if not table.num_rows:
            continue
        held.append(table)
        windows += table["windows"].nbytes // 8
        if windows < HELD_WINDOWS:
            continue
        table = pa.concat_tables(held)
        name, part = table["name"].to_numpy(), table["part"].to_numpy()
        cut = np.flatnonzero((name[1:] != name[:-1]) | (part[1:] != part[:-1]))
        if not len(cut):
            continue
        at = int(cut[-1]) + 1
        if (out := _runs(table.slice(0, at))) is not None:
            yield out
        held = [table.slice(at)]
        windows = held[0]["windows"].nbytes // 8
    if held and (out := _runs(pa.concat_tables(held))) is not None:
        yield out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with a 96-bit key of both; equal rows have equal keys, and equal answers."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key_a"), F.hash("doc_id", F.octet_length(text), text).alias("key_b"))


def repeated_intervals(rows: DataFrame) -> DataFrame:
    """key_a, key_b, intervals: the stretches of bytes of each text that repeated windows cover, not yet united."""
    parts = stored(
        rows.select("text", "key_a", "key_b").mapInArrow(_stretch_batches, "key_a long, key_b int, lo int, hi int, back int, name long, whole long"),
        "stretches",
    )
    # names are counted apart, so that the join reads plain exchanges, whose hot partitions can be split
    often = stored(parts.groupBy("name").count().filter("count > 1").select("name"), "often")
    again = stored(parts.join(often, "name", "left_semi"), "repeated")
    dropped(parts, often)
    # copies of a stretch are counted in the tasks first, so a stretch in very many texts is a row a task
    distinct = stored(
        again.groupBy("name", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("key_a", "key_b", "lo", "hi", "back")).alias("at")), "distinct"
    )
    crowd = distinct.groupBy("name").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("name", F.ceil(F.col("kinds") / BUCKET_STRETCHES).cast("int").alias("parts"))
    crowd = stored(crowd, "crowd")
    wanted = F.struct("at.key_a", "at.key_b", "at.lo", "at.hi", "at.back", "name", "parts", (F.col("copies") == 1).alias("alone"))
    asked = stored(distinct.join(small(crowd), "name").groupBy("at.key_a", "at.key_b").agg(F.collect_list(wanted).alias("asked")), "asked")
    some = (
        rows.join(asked, ["key_a", "key_b"]).select("text", "asked")
        .mapInArrow(_window_batches, "name long, part long, key_a long, key_b int, at long, marks binary, places binary, windows binary")
        .repartition("name", "part").sortWithinPartitions("name", "part", "key_a", "key_b")
        .mapInArrow(_bucket_batches, "key_a long, key_b int, start int, end int")
    )
    some = stored(some, "runs")
    dropped(asked, crowd)
    full = again.join(distinct.filter("copies > 1").select("name", "whole"), ["name", "whole"], "left_semi").select(
        "key_a", "key_b", F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end")
    )
    intervals = stored(full.unionByName(some).groupBy("key_a", "key_b").agg(F.collect_set(F.struct("start", "end")).alias("intervals")), "intervals")
    dropped(again, distinct, some)
    return intervals


def _cut_batches(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, sha, texts = [], [], [], [], []
            for text, intervals in zip(batch.column("text").to_pylist(), batch.column("intervals").to_pylist()):
                data = text.encode()
                kept, at, gone, n, end = [], 0, 0, 0, -1
                for start, stop in sorted((x["start"], x["end"]) for x in intervals or ()):
                    if start > end:
                        n += 1
                        kept.append(data[max(at, 0) : start])
                        end = at = start
                    if stop > end:
                        gone += stop - end
                        end = at = stop
                kept.append(data[at:])
                left = b"".join(kept)
                size.append(len(data))
                removed.append(gone)
                spans.append(n)
                sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left)
            out = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (size, removed, spans)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.binary())] * with_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return cut


def without_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs, and the kept bytes on demand."""
    rows = keyed(docs)
    intervals = repeated_intervals(rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.join(intervals, ["key_a", "key_b"], "left").select("doc_id", "text", "intervals").mapInArrow(_cut_batches(with_text), schema)


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
