"""Quality rules run as a short-circuit cascade.

A rule names the measures that it needs and the condition under which a text fails.  ``plan_cascade``
times every rule, its measures included, on a sample of documents and counts what it rejects there, then
orders the rules by rejections per second of cost.  ``cascade`` takes the rules in that
order over a piece of texts: each rule takes its own measures, of the texts that are left, and
the texts that it rejects are cut out of the piece, so no later measure reads them.  Where words are cut and hashed for one
rule, the next ones that need them use them again.  The verdict is the same in any order, only the work and the named first rule
depend on it.

The measures that a query returns for every text are taken first; rules that need no others then cost no more than a comparison.

The two base rules are the contract's; the others are kept loose, so that they reject
texts that are junk by any reading: symbol noise, shouting, repeated lines, endless words.

Defined cases: a null or empty text has no words and fails the first base rule; a null
doc_id is carried through; repeated rows are judged one by one; an empty table gives an empty result (the
rules then keep their listed order); other columns, also ones with the operator's
names, do not take part.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents, lean
from quillspan.llm.textcore import IS_SPACE, pieces, shingles, span_hashes, text_bytes, word_bounds

#: What the base rules are about; the query returns these for every text.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
#: Sentence marks counted for the shouting rule.
MARKS = b"!?"
#: Documents of the sample on which costs and selectivities are estimated, and the bytes of the longest text in it.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 400, 1 << 17


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


_SYMBOL, _MARK = _table(SYMBOLS), _table(MARKS)
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_CODE_POINT = np.array([b & 0xC0 != 0x80 and not IS_SPACE[b] for b in range(256)], np.int64)


def _sums(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sum of values between consecutive places."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[places[1:]] - total[places[:-1]]


def _lines(data: np.ndarray, places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those of them equal to an earlier line of the text."""
    breaks = np.flatnonzero(data == 10)
    text_of_break = np.searchsorted(places, breaks, "right") - 1
    begin = np.concatenate([places[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(places) - 1), text_of_break])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.append(begin[1:] - 1, 0)
    last = np.append(owner[1:] != owner[:-1], True)
    end[last] = places[owner[last] + 1]
    full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, owner = begin[full], end[full], owner[full]
    if not len(begin):
        return np.zeros(len(places) - 1, np.int64), np.zeros(len(places) - 1, np.int64)
    lines = span_hashes(data, begin, end)
    order = np.lexsort((lines, owner))
    again = np.zeros(len(lines), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    n = len(places) - 1
    return np.bincount(owner, minlength=n), np.bincount(owner[order], again, minlength=n).astype(np.int64)


def _repeated(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: the words that lie in a three-word window found twice or more in it."""
    out = np.zeros(len(first) - 1, np.int64)
    windows = shingles(words, 3)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a < 4:
            continue
        own = windows[a : b - 2]
        order = np.argsort(own)
        ranked = own[order]
        same = ranked[1:] == ranked[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(own), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(b - a, bool)
        for j in range(3):
            covered[j : j + len(own)] |= twice
        out[i] = covered.sum()
    return out


class Piece:
    """Some texts in one run of bytes, and what was found in them so far."""

    def __init__(self, data: np.ndarray, places: np.ndarray) -> None:
        self.data, self.places = data, places
        self.n = len(places) - 1
        self._words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self._lines: tuple[np.ndarray, np.ndarray] | None = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and past-last byte of each word, and each text's first word (one more at the end)."""
        if self._words is None:
            starts, ends = word_bounds(self.data, self.places)
            self._words = starts, ends, np.searchsorted(starts, self.places)
        return self._words

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        if self._lines is None:
            self._lines = _lines(self.data, self.places, self.words()[0])
        return self._lines

    def left(self, keep: np.ndarray) -> Piece:
        """The texts marked in keep alone, with their words if these are known."""
        size = np.diff(self.places)
        out = Piece(self.data[np.repeat(keep, size)], np.append(0, np.cumsum(size[keep])))
        if self._words is not None:
            starts, ends, first = self._words
            count = np.diff(first)
            shift = np.repeat(self.places[:-1][keep] - out.places[:-1], count[keep])
            own = np.repeat(keep, count)
            out._words = starts[own] - shift, ends[own] - shift, np.append(0, np.cumsum(count[keep]))
        if self._lines is not None:
            out._lines = self._lines[0][keep], self._lines[1][keep]
        return out


def _n_repeat_words(p: Piece) -> np.ndarray:
    starts, ends, first = p.words()
    return _repeated(span_hashes(p.data, starts, ends), first)


#: How each measure is taken from a piece.
MEASURES: dict[str, Callable[[Piece], np.ndarray]] = {
    "n_words": lambda p: np.diff(p.words()[2]),
    "word_chars": lambda p: _sums(_CODE_POINT[p.data], p.places),
    "n_symbols": lambda p: _sums(_SYMBOL[p.data], p.places),
    "n_lines": lambda p: p.lines()[0],
    "n_dup_lines": lambda p: p.lines()[1],
    "n_repeat_words": _n_repeat_words,
    "n_upper": lambda p: _sums(_UPPER[p.data], p.places),
    "n_letters": lambda p: _sums(_LETTER[p.data], p.places),
    "n_marks": lambda p: _sums(_MARK[p.data], p.places),
}


@dataclass(frozen=True)
class Rule:
    """A name, the measures that the condition takes, in its order, and whether it is a base rule."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[..., np.ndarray] = field(compare=False)
    base: bool = False


RULES = (
    Rule("too_short", ("n_words",), lambda words: words < 50, True),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda again, words: 100 * again > 50 * words, True),
    Rule("symbol_noise", ("n_symbols", "n_words"), lambda symbols, words: 2 * symbols > words),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda lines, again: (lines >= 4) & (2 * again > lines)),
    Rule("long_words", ("word_chars", "n_words"), lambda chars, words: chars > 40 * words),
    Rule(
        "shouting", ("n_letters", "n_upper", "n_marks", "n_words"),
        lambda letters, upper, marks, words: (letters > 0) & (10 * upper > 8 * letters) & (2 * marks > words),
    ),
)


def taken(piece: Piece, name: str, seen: Counter | None = None) -> np.ndarray:
    if seen is not None:
        seen[name] += piece.n
    return MEASURES[name](piece).astype(np.int64)


def cascade(piece: Piece, rules: tuple[Rule, ...], have: dict[str, np.ndarray], seen: Counter | None = None) -> np.ndarray:
    """For each text the place of the first rule, in this order, that it fails, and -1 where there is none.

    ``have`` holds the measures that were taken of all texts already; ``seen`` counts the texts that each other measure reads.
    """
    verdict = np.full(piece.n, -1, np.int64)
    alive = np.arange(piece.n)
    have = dict(have)
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        for name in rule.needs:
            if name not in have:
                have[name] = taken(piece, name, seen)
        failed = rule.fails(*(have[name] for name in rule.needs))
        if failed.any():
            verdict[alive[failed]] = k
            alive, piece = alive[~failed], piece.left(~failed)
            have = {name: v[~failed] for name, v in have.items()}
    return verdict


def pieces_of(column: pa.Array) -> Iterator[tuple[int, int, Piece]]:
    """First and past-last row of each piece of a column of texts, and the piece."""
    data, offsets = text_bytes(column)
    for at, to in pieces(offsets):
        yield at, to, Piece(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])


def sample_texts(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> pa.Array:
    """Texts of the first ``sample_rows`` ids in the order of a hash, those of up to SAMPLE_TEXT_BYTES.

    The sample only sets the order of the rules, never what they decide.
    """
    some = docs.select("doc_id", "text").filter(f"doc_id IS NOT NULL AND coalesce(octet_length(text), 0) <= {SAMPLE_TEXT_BYTES}")
    ids = some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = some.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toPandas()
    return pa.array(rows["text"].tolist(), pa.string())


def plan_cascade(texts: pa.Array, rules: tuple[Rule, ...] = RULES, given: tuple[str, ...] = ()) -> list[tuple[Rule, float, float]]:
    """The rules with their rejection rate and cost on the sample, by rejections per cost.

    The cost is that of the condition and of its measures but for those ``given``.
    """
    n = len(texts)
    timed = []
    for rule in rules:
        rejected, cost = 0, 0.0
        for _, _, piece in pieces_of(texts):
            have = {name: taken(piece, name) for name in given}
            began = time.perf_counter()
            rejected += int((cascade(piece, (rule,), have) == 0).sum())
            cost += time.perf_counter() - began
        timed.append((rule, rejected / n if n else 0.0, cost))
    return sorted(timed, key=lambda x: -(x[1] / max(x[2], 1e-9))) if n else timed


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, and rejected_by of each document."""
    ordered = tuple(rule for rule, _, _ in plan_cascade(sample_texts(docs), rules, BASE))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(r.name for r in ordered), None], object)
        for batch in batches:
            for at, to, piece in pieces_of(batch.column("text")):
                have = {name: taken(piece, name) for name in BASE}
                base = np.zeros(piece.n, bool)
                for rule in ordered:
                    if rule.base:
                        base |= rule.fails(*(have[name] for name in rule.needs))
                verdict = cascade(piece, ordered, have)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), *(pa.array(have[m]) for m in BASE), pa.array(base), pa.array(verdict < 0), pa.array(names[verdict].tolist(), pa.string())],
                    ["doc_id", *BASE, "base_failed", "kept", "rejected_by"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{m} long" for m in BASE) + ", base_failed boolean, kept boolean, rejected_by string"
    return docs.select("doc_id", "text").mapInArrow(judge, schema)


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass every rule, with all their columns; no shuffle."""
    ordered = tuple(rule for rule, _, _ in plan_cascade(sample_texts(docs), rules))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = [cascade(piece, ordered, {}) < 0 for _, _, piece in pieces_of(batch.column("text"))]
            yield batch.filter(pa.array(np.concatenate(alive))) if alive else batch

    return docs.mapInArrow(lean(keep), docs.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", *BASE, "base_failed", "kept")


OP9_SQL = r"""
with d as (
    select doc_id, coalesce(text, '') as text, row_number() over () as rid from documents
), w as (
    select rid, doc_id, text, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') as words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) as lines
    from d
), m as (
    select rid, doc_id, text, words, len(words) as n_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
           len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper,
           length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) as n_letters,
           length(text) - length(regexp_replace(text, '[!?]', '', 'g')) as n_marks
    from w
), g as (
    select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
    from m, unnest(range(1, n_words - 1)) as t(i) where n_words >= 4
), r as (
    select rid, i from g qualify count(*) over (partition by rid, a, b, c) > 1
), u as (
    select rid, count(distinct i + j) as n_repeat_words from r, unnest([0, 1, 2]) as t(j) group by rid
), f as (
    select m.*, coalesce(u.n_repeat_words, 0) as n_repeat_words from m left join u using (rid)
)
select doc_id, n_words::BIGINT as n_words, word_chars::BIGINT as word_chars, n_symbols::BIGINT as n_symbols,
       n_dup_lines::BIGINT as n_dup_lines, n_repeat_words::BIGINT as n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 2 * n_symbols > n_words
            or (n_lines >= 4 and 2 * n_dup_lines > n_lines) or word_chars > 40 * n_words
            or (n_letters > 0 and 10 * n_upper > 8 * n_letters and 2 * n_marks > n_words)) as kept
from f
"""
