"""Vectorised word and byte hashing shared by the text operators.

Everything here works on one Arrow batch inside a task and goes through the batch in
pieces of about ``PIECE`` bytes, so memory stays flat whatever the number of rows; a
single text longer than that is one piece of its own.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

#: The white space that separates words: blank and the controls 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BASE = 0x9E3779B97F4A7C15 & ~7 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = _odd(256, 17)
_COEFFICIENT = _odd(64, 99)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64, at least n of them."""
    had = _powers.get(base)
    if had is None or len(had) < n:
        size = max(PIECE + 4096, 1 << max(1, n - 1).bit_length())
        had = np.ones(size, np.uint64)
        had[1:] = np.uint64(base)
        np.cumprod(had, out=had)
        if size <= 1 << 22:
            _powers[base] = had
    return had


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of the column, and where each text starts and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``limit`` bytes each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-last byte of each word; no word crosses a text's end."""
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = AS_IS) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running polynomial over the piece."""
    n = len(data)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LETTER[fold][data] * powers(_BASE, n)[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes, over text ends as well."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * _COEFFICIENT[j]
    return mix(total + np.uint64(n))


def words_of(column: pa.Array, fold: np.ndarray = AS_IS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each piece: its first row, the hashes of its words, and each row's first word (one more at the end)."""
    data, offsets = text_bytes(column)
    for at, to in pieces(offsets):
        own, places = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends = word_bounds(own, places)
        yield at, span_hashes(own, starts, ends, fold), np.searchsorted(starts, places)


def shingle_sets(column: pa.Array, n: int = 5, fold: np.ndarray = LOWER) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text.

    A text of fewer than n words has its whole sequence as the only shingle, a text
    without words has none.
    """
    for _, words, first in words_of(column, fold):
        runs = shingles(words, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n:
                own = runs[a : b - n + 1]
                own.sort()
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif b > a:
                yield shingles(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)
