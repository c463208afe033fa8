"""Packing token sequences by bounded-space online best-fit.

Documents are encoded where they lie; one longer than a sequence is cut into whole sequences and
a rest.  The slim table of pieces is dealt out by a hash of the document, and each task packs its pieces as they
come into a fixed number of open bins.  The bins sit in a bitset keyed by free space, so
the tightest fit for a piece is the lowest set bit at or above its length; when a new bin is needed and all are
open, the fullest closes.  A full bin closes at once.

What is still open when a task ends is not final: those pieces go, largest first, to the next
round, which has fewer tasks, until one task is left whose input is bounded by the bins that
a round may leave open (FAN_IN * OPEN_BINS sequences, thus at most that many times SEQUENCE pieces of one token each).  So the sequences wasted do not grow with the number of tasks.

Defined cases: a null or empty text is a document of one token, the separator; a document of exactly the
sequence length is one piece; ties between bins go to the one opened last; repeated rows
are packed as separate documents; a null doc_id is carried through; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents, held, stored, without_gc

SEQUENCE = 2048
SEPARATOR = 0
OPEN_BINS = 1024
#: Pieces that one packing task takes, about.
PIECES_PER_TASK = 200_000
#: Tasks of one round whose open bins meet in one task of the next.
FAN_IN = 16
#: Entries of a task's cache of encoded words; it is emptied when full.
CACHE_ENTRIES = 600_000
#: Longer words are not kept, so that the cache is bounded in bytes as well.
KEPT_LENGTH = 64

def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


#: What the vocabulary's splitter finds in a word of the characters of PLAIN.
RUNS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
PLAIN = re.compile("[!-~\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\u024f]*")
#: Separators for str.split() that the vocabulary takes for symbols.
NOT_BLANK = re.compile("[\x1c-\x1f]")
BLANK = re.compile("[ \t\n\r]+")


class _Known(dict):
    """Makes missing values by a function and keeps them; emptied when it has CACHE_ENTRIES."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self.make(key)
        if len(key) <= KEPT_LENGTH:
            self[key] = value
        return value


class WordEncoder:
    """Token ids of whole texts, by way of their white-space separated words.

    The vocabulary drops white space, so no token spans two words and each word is encoded once
    and kept.  A word of plain Latin characters is split as the vocabulary's own
    splitter would and its parts go to the library's merge model; any other word goes through the library whole.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.words = _Known(self._word)
        self.runs = _Known(self._run)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def _run(self, run: str) -> bytes:
        letters = run if run.isascii() else run.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.runs.__getitem__, RUNS.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            text = text or ""
            words = BLANK.split(text) if NOT_BLANK.search(text) else text.split()
            yield b"".join(map(self.words.__getitem__, words))


def encoder(vocabulary: str) -> WordEncoder:
    return held(("words", vocabulary), lambda: WordEncoder(vocabulary))


def pieces_of(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and row_key of its document's row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with without_gc():
            yield from cut_with(encoder(vocabulary), batches)

    def cut_with(tokens: WordEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.uint32(SEPARATOR).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column("doc_id").to_pylist()
            keys = batch.column("row_key").to_pylist()
            for i, own in enumerate(tokens.encode(batch.column("text").to_pylist())):
                own += end
                for piece, at in enumerate(range(0, len(own), 4 * sequence)):
                    part = own[at : at + 4 * sequence]
                    rows.append((ids[i], keys[i], piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row_key"))
    return rows.mapInArrow(cut, f"doc_id {kind}, row_key long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A fixed number of open bins; their free space keys a bitset, which finds the tightest fit."""

    def __init__(self, sequence: int, most: int) -> None:
        self.sequence, self.most, self.n = sequence, most, 0
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.closed: list[int] = []

    def _put(self, free: int, number: int) -> None:
        self.by_free.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.n += 1

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            self.bits ^= 1 << free
        self.n -= 1
        return number

    def place(self, length: int, fresh: int) -> tuple[int, int]:
        """Bin and offset for a piece; ``fresh`` numbers the bin that is opened if none fits."""
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            number = self._take(free)
        else:
            free, number = self.sequence, fresh
            if self.n >= self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        left = free - length
        if left:
            self._put(left, number)
        else:
            self.closed.append(number)
        return number, self.sequence - free

    def still_open(self) -> list[int]:
        return [number for held in self.by_free.values() for number in held]


def _pack_batches(round_no: int, sequence: int, most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        names = ("doc_id", "row_key", "piece", "start", "length", "ids_crc32")
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).select(names)
        bins = OpenBins(sequence, most)
        placed = [bins.place(n, i) for i, n in enumerate(table["length"].to_pylist())]
        number, offset = np.array(placed, np.int64).T
        final = ~np.isin(number, bins.still_open())
        out = table.append_column("sequence_id", pa.array((np.int64(round_no) << 56) + (np.int64(task) << 32) + number))
        out = out.append_column("offset", pa.array(offset)).append_column("closed", pa.array(final))
        yield from out.to_batches(max_chunksize=50_000)

    return pack


def packed(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, most: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = stored(pieces_of(docs, vocabulary, sequence), "pieces")
    schema = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    columns = [c for c in pieces.columns if c != "row_key"]
    done: list[DataFrame] = []
    left, n = pieces, pieces.count()
    tasks = max(1, -(-n // per_task))
    round_no = 0
    while True:
        if round_no:
            dealt = left.repartition(tasks, F.xxhash64("sequence_id")).sortWithinPartitions(F.desc("length"), F.xxhash64("row_key", "piece"))
        else:
            key = F.xxhash64("row_key", "piece")
            dealt = left.repartition(tasks, "row_key", "piece").sortWithinPartitions(key, "row_key", "piece")
        dealt = dealt.select(*pieces.columns)
        last = tasks == 1
        result = stored(dealt.mapInArrow(_pack_batches(round_no, sequence, most), f"{schema}, sequence_id long, offset long, closed boolean"), f"packed-{round_no}")
        if last and round_no:
            done.append(result)
            break
        done.append(result.filter("closed"))
        left = result.filter("NOT closed")
        tasks = max(1, -(-tasks // FAN_IN))
        round_no += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
