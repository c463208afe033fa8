"""Byte-level BPE by prefix dynamic programming.

The encoding of a byte string ends in one token, and cutting that token off leaves the encoding of the
rest.  So it is enough to store, for every prefix, its last token: the token t that ends there, such
that the last token of the prefix before it and t stay apart when both are merged by rank.
That is true of one token only.  Two tokens stay apart if, going back through the merges that
made them, no merge across their border comes before one that closes the border.

As a prefix's entry never depends on what follows, appended bytes extend the table exactly, and after an
edit the entries before it stay while those behind it are redone until they meet the old ones again.

Defined cases: null and empty texts have no tokens (ids_sha256 and decoded_sha256 are those of empty
input); texts of any length are split into the pattern's matches, each encoded on its own; bytes outside any
match do not occur, as the pattern takes every character; repeated rows are encoded one by one; a null
doc_id is carried through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.common import documents, held, without_gc

#: Entries of a worker's cache of encoded pieces, and of known pairs of tokens; each is emptied when full.
CACHE_ENTRIES, PAIR_ENTRIES = 500_000, 4_000_000
#: Longer pieces are not kept, so that the cache is bounded in bytes as well.
KEPT_LENGTH = 64


class PrefixTable:
    """The vocabulary, the merges that it implies, and encoding by last tokens of prefixes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.rank = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        # by the last three bytes: how long the tokens are that end so, the longest first
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                ends.setdefault(token[-3:], {2, 1}).add(len(token))
        self.lengths = {end: tuple(sorted(own, reverse=True)) for end, own in ends.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """How each token is made: the last two parts that are left when it is merged without itself."""
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(token) == 1:
                continue
            parts = self._merge(token, i)
            if len(parts) == 2:
                self.halves[i] = (parts[0], parts[1])
                self.merged[parts[0], parts[1]] = i

    def _merge(self, piece: bytes, below: int) -> list[int]:
        """Plain merging by rank with the tokens of rank under ``below``; only used to learn the merges."""
        parts = [self.rank[piece[i : i + 1]] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = below, -1
            for i, pair in enumerate(zip(parts, parts[1:])):
                made = self.merged.get(pair, below)
                if made < best:
                    best, at = made, i
            if at < 0:
                break
            parts[at : at + 2] = [best]
        return parts

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, put together, are encoded as a and b."""
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= PAIR_ENTRIES:
                self.apart.clear()
            known = self.apart[a, b] = self._check_apart(a, b)
        return known

    def _check_apart(self, a: int, b: int) -> bool:
        """Undo the later of the two tokens' merges again and again.

        The parts that touch the border must never have a merge that ranks before the merge
        that took one of them up.
        """
        last_a = last_b = len(self.rank)  # rank of the merge that took up the part at the border
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < min(last_a, last_b):
                return False
            half_a, half_b = self.halves.get(a), self.halves.get(b)
            if half_a is None and half_b is None:
                return True
            if half_b is None or (half_a is not None and a > b):
                last_a, a = a, half_a[1]
            else:
                # a merge of the same rank across the border comes first, as merging goes from the left
                last_b, b = b + 1, half_b[0]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill in the last tokens of the prefixes of piece that ``last`` (one entry per prefix) lacks."""
        rank, lengths, apart = self.rank, self.lengths, self.apart
        for end in range(len(last) + 1, len(piece) + 1):
            for length in lengths.get(piece[end - 3 : end], (2, 1)) if end > 2 else range(end, 0, -1):
                if length > end:
                    continue
                start = end - length
                token = rank.get(piece[start:end])
                if token is None:
                    continue
                if not start:
                    if self._alone(token):
                        last.append(token)
                        break
                    continue
                before = last[start - 1]
                fits = apart.get((before, token))
                if fits is None:
                    fits = self.stay_apart(before, token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end}")
        return last

    def _alone(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return token in self.halves or len(self.bytes[token]) == 1

    def read(self, piece: bytes, last: list[int]) -> list[int]:
        """The tokens, by going back from the end."""
        out, end = [], len(piece)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes[token])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None and self._alone(whole):
            return [whole]
        return self.read(piece, self.extend(piece, []))

    def edit(self, piece: bytes, last: list[int], start: int, end: int, put: bytes) -> tuple[bytes, list[int]]:
        """The piece with bytes start to end replaced, and its last tokens, redone only near the edit.

        Behind the edit, entries are taken over again once as many of them as the longest token has bytes
        agree with the old ones, since no later entry looks back further.
        """
        new = piece[:start] + put + piece[end:]
        table = last[:start]
        shift = len(new) - len(piece)
        agreed = 0
        while len(table) < len(new):
            self.extend(new[: len(table) + 1], table)
            at = len(table) - 1 - shift
            agreed = agreed + 1 if len(table) > start + len(put) and at >= end and table[-1] == last[at] else 0
            if agreed >= self.longest:
                table += last[at + 1 :]
        return new, table

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


_tables: dict[str, PrefixTable] = {}


def prefix_table(path: str) -> PrefixTable:
    if path not in _tables:
        _tables[path] = PrefixTable(read_ranks(path))
    return _tables[path]


class _Pieces(dict):
    """Piece to its ids, as a list and as text, and to the bytes that they decode to; emptied when full."""

    def __init__(self, table: PrefixTable) -> None:
        self.table = table

    def __missing__(self, piece: str) -> tuple[list[int], str, bytes]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = self.table.encode(piece.encode())
        value = (ids, " ".join(map(str, ids)), self.table.decode(ids))
        if len(piece) <= KEPT_LENGTH:
            self[piece] = value
        return value


def known_pieces(path: str) -> _Pieces:
    """The pieces that this worker has encoded; its next tasks use them again."""
    return held(("pieces", path), lambda: _Pieces(prefix_table(path)))


def encoded(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and the ids on demand."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        known = known_pieces(vocabulary)
        with without_gc():
            yield from encode_with(split, known, batches)

    def encode_with(split, known, batches):
        for batch in batches:
            count, ids_sha, bytes_sha, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = list(map(known.__getitem__, split(text or "")))
                count.append(sum([len(ids) for ids, _, _ in found]))
                ids_sha.append(hashlib.sha256(" ".join([s for _, s, _ in found]).encode()).hexdigest())
                bytes_sha.append(hashlib.sha256(b"".join([b for _, _, b in found])).hexdigest())
                if with_ids:
                    kept.append([i for ids, _, _ in found for i in ids])
            out = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.list_(pa.int32()))] * with_ids, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
