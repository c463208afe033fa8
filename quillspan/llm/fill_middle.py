"""Fill-in-the-middle documents, cut by memoised content-defined chunks.

A text's units are words with the white space before them, and white space at the end.  A unit ends where a word ends
before white space, or where the text ends, so the units of a text are one more than the places where a word byte is
followed by a white space byte.

1. *Chunks.*  A rolling hash over WINDOW bytes cuts texts where its low bits are all set, and after CHUNK_MOST bytes at the
   latest; so the same passage is cut in the same way in every text that holds it.
2. *Memo.*  A chunk has a boundary summary: word ends inside it, code points, and whether its first and last bytes are white
   space.  A task keeps the summaries of the chunks that it met, by a 64-bit name; a kept one is used if the bytes kept with it
   are the same bytes, else the chunk is counted itself.  The memo is bounded by MEMO_BYTES.
3. *Cuts.*  Summaries combine from left to right (a word end more where a word byte ends a chunk and white space starts the
   next), which gives the units before every chunk of a text.  The chunk that holds a cut is found by its count, and that chunk alone is
   searched for the place.

Where a text is cut, and in which of the two forms it is written, follows from the SHA-256 of a seed and its doc_id.

Defined cases: a null text counts as empty and stays plain with no units; a null doc_id is hashed as an empty string; texts
that hold a marker stay plain, so every form can be undone; repeated rows are cut alike, each gets its row; other columns
do not take part; an empty table gives an empty result; memory holds the texts of a piece and the memo.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents
from quillspan.llm.textcore import IS_SPACE, mix, pieces, span_hashes, text_bytes

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes that the rolling hash covers, a power of two.
WINDOW = 16
#: A chunk ends where these bits of the rolling hash are all set: after 512 bytes in the mean.
CUT_BITS = np.uint32((1 << 9) - 1) << np.uint32(16)
CHUNK_MOST = 8192
#: Bytes of the chunks that a task keeps.
MEMO_BYTES = 32 << 20

_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts start; an empty text has none, and no chunk crosses a text's end.

    The hash of a place covers the WINDOW bytes up to it.  Places closer to a text's start have none, so chunks do not depend on the text before.
    """
    rolled = _GEAR[data]
    step = 1
    while step < WINDOW:
        rolled[step:] += rolled[:-step] << np.uint32(step)
        step *= 2
    cut = np.flatnonzero((rolled & CUT_BITS) == CUT_BITS) + 1
    first = offsets[np.searchsorted(offsets, cut, "right") - 1]
    starts = np.union1d(cut[cut - first >= WINDOW], offsets[:-1][np.diff(offsets) > 0])
    starts = starts[starts < len(data)]
    length = np.diff(np.append(starts, len(data)))
    more = (length - 1) // CHUNK_MOST
    if not more.any():
        return starts
    ends = np.cumsum(more + 1)
    within = np.arange(ends[-1]) - np.repeat(ends - more - 1, more + 1)
    return np.repeat(starts, more + 1) + CHUNK_MOST * within


def word_ends(data: np.ndarray) -> np.ndarray:
    """Where a white space byte follows a word byte."""
    blank = IS_SPACE[data]
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def code_points(data: np.ndarray) -> int:
    return int(((data & 0xC0) != 0x80).sum())


class Memo:
    """Boundary summaries of chunks by the name of their content, which is compared before a summary is used."""

    def __init__(self, most: int = MEMO_BYTES) -> None:
        self.most, self.held, self.hits = most, 0, 0
        self.known: dict[int, tuple[bytes, tuple[int, int, int, int]]] = {}

    def summaries(self, data: np.ndarray, starts: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
        """For each chunk: word ends inside it, code points, and whether its first and its last byte are white space."""
        ends = np.append(starts[1:], len(data))
        names = span_hashes(data, starts, ends) if names is None else names
        whole = data.tobytes()
        out = np.empty((len(starts), 4), np.int64)
        fresh: list[tuple[int, int, bytes]] = []
        for k, (a, b, name) in enumerate(zip(starts.tolist(), ends.tolist(), names.tolist())):
            own = whole[a:b]
            had = self.known.get(name)
            if had is not None and had[0] == own:
                out[k] = had[1]
                self.hits += 1
            else:
                fresh.append((k, name, own))
        if fresh:
            self._count(fresh, out)
        return out

    def _count(self, fresh: list[tuple[int, int, bytes]], out: np.ndarray) -> None:
        """Summaries of chunks that are not known yet, all in one pass over their bytes."""
        joined = np.frombuffer(b"".join(own for _, _, own in fresh), np.uint8)
        ends = np.cumsum([len(own) for _, _, own in fresh])
        starts = np.append(0, ends[:-1])
        blank = IS_SPACE[joined]
        inside = np.append(False, blank[1:] & ~blank[:-1])
        inside[starts] = False
        found = np.stack([np.add.reduceat(inside, starts, dtype=np.int64), np.add.reduceat((joined & 0xC0) != 0x80, starts, dtype=np.int64), blank[starts], blank[ends - 1]], 1)
        for (k, name, own), summary in zip(fresh, found.tolist()):
            out[k] = summary
            if self.held + len(own) > self.most:
                self.known, self.held = {}, 0
            if name not in self.known:
                self.known[name] = own, tuple(summary)
                self.held += len(own)


class Cuts:
    """The units of the texts of a piece, and the places after a number of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, memo: Memo) -> None:
        self.data, self.offsets = data, offsets
        self.starts = chunk_starts(data, offsets)
        self.ends = np.append(self.starts[1:], len(data))
        found = memo.summaries(data, self.starts)
        #: the chunks of a text are first[i] up to first[i + 1]
        self.first = np.searchsorted(self.starts, offsets)
        opens = np.zeros(len(found), bool)
        opens[1:] = (found[1:, 2] == 1) & (found[:-1, 3] == 0)
        opens[self.first[:-1][self.first[:-1] < len(found)]] = False
        self.opens = opens
        #: word ends, and code points, before each chunk and at the end
        self.before = np.append(0, np.cumsum(found[:, 0] + opens))
        self.points = np.append(0, np.cumsum(found[:, 1]))
        ends = self.before[self.first[1:]] - self.before[self.first[:-1]]
        self.units = ends + (np.diff(offsets) > 0)

    def after(self, i: int, k: int) -> tuple[int, int]:
        """The byte of the piece, and the code points of text i, after its first k units."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        if k <= 0:
            return int(self.offsets[i]), 0
        if k >= self.units[i]:
            return int(self.offsets[i + 1]), int(self.points[b] - self.points[a])
        chunk = a + int(np.searchsorted(self.before[a + 1 : b + 1] - self.before[a], k))
        rest = k - int(self.before[chunk] - self.before[a]) - int(self.opens[chunk])
        own = self.data[self.starts[chunk] : self.ends[chunk]]
        place = int(word_ends(own)[rest - 1]) if rest else 0
        return int(self.starts[chunk]) + place, int(self.points[chunk] - self.points[a]) + code_points(own[:place])


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * j : 4 * j + 4], "big") for j in range(4))


def _fill_batches(seed: int, rate: int, suffix_first: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            every, places = text_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for at, to in pieces(places):
                data, offsets = every[places[at] : places[to]], places[at : to + 1] - places[at]
                cuts, whole, own = Cuts(data, offsets, memo), data.tobytes(), ids.slice(at, to - at)
                form, prefix, middle, out = [], [], [], []
                for i, doc_id in enumerate(own.to_pylist()):
                    a, b = int(offsets[i]), int(offsets[i + 1])
                    text, n = whole[a:b], int(cuts.units[i])
                    one, two, apply, order = draws(doc_id, seed)
                    if not text or apply % 100 >= rate or any(m in text for m in marks):
                        kind, p, m, new = "plain", None, None, text
                    else:
                        low, high = sorted((one % (n + 1), two % (n + 1)))
                        (x, p), (y, upto) = cuts.after(i, low), cuts.after(i, high)
                        m = upto - p
                        x, y = x - a, y - a
                        if order % 100 < suffix_first:
                            kind, new = "spm", b"".join((marks[1], text[y:], marks[0], text[:x], marks[2], text[x:y]))
                        else:
                            kind, new = "psm", b"".join((marks[0], text[:x], marks[1], text[y:], marks[2], text[x:y]))
                    form.append(kind)
                    prefix.append(p)
                    middle.append(m)
                    out.append(new)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(cuts.units, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return transformed


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and the output text of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(_fill_batches(seed, rate, suffix_first), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; no text of a form other than plain holds a marker, so the markers are where it is split."""
    part = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    of = lambda *order: F.concat(*[part[i] for i in order])
    return F.when(form == "psm", of(1, 3, 2)).when(form == "spm", of(2, 3, 1)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
with u as (
    select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units,
           sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h
    from documents
), d as (
    select *, len(units) as n, [cast('0x' || h[i:i + 7] as bigint) for i in [1, 9, 17, 25]] as g from u
), c as (
    select *, least(g[1] % (n + 1), g[2] % (n + 1)) as low, greatest(g[1] % (n + 1), g[2] % (n + 1)) as high,
           case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or g[3] % 100 >= 50 then 'plain'
                when g[4] % 100 < 80 then 'spm' else 'psm' end as form
    from d
), p as (
    select *, array_to_string(units[1:low], '') as prefix, array_to_string(units[low + 1:high], '') as middle, array_to_string(units[high + 1:n], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""
