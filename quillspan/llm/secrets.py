"""Secret scanning: three base patterns, and guess costs for values in a credential context.

A value that follows a credential word is cut at minimum cost into words, dates, repeats, runs of neighbouring keys or
letters, and brute-force spans; the cost of a segment is the decimal logarithm of the guesses that an
attacker trying such segments needs, and the costs add up.  Dynamic programming over
the value's prefixes finds the cheapest cut; as a brute-force span may go on without the cost of a new segment, it
keeps two costs for each prefix, that of any cut and that of the cuts that end in brute force.
A value that is dear enough, and is not prose, is reported as ``guess``, whatever characters it is
made of.  That holds for the value inside an ``assign`` span as well, which tells a real
key from a placeholder such as ``changeme12345``; base spans always stay.

Words are ranked by how often they are used: first a short list of words common in passwords, then at most
``DICTIONARY_WORDS`` words of the scanned table itself, by the number of documents that hold them outside of credential contexts and of
what the base patterns hold, ``LEAST_DOCUMENTS`` at least.  So a key never becomes a word by being copied: only what is written elsewhere counts.

Defined cases: null and empty texts have no spans (base_sha256 is that of the empty string); a failing base match is dropped without a retry and still takes up its
characters; a guess that overlaps an ``access`` or ``hex`` span is left out, unless it lies inside an ``assign`` span; spans are ordered by start, then kind as listed;
a value is priced whole, however long; repeated rows are scanned one by one; a null doc_id is carried through; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents

#: Fixed patterns of the base kinds, in their order, with the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more
KINDS = ("assign", "access", "hex", "guess")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: A credential word, a link to its value, and the value.
CONTEXT = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[ _-]?key|private[ _-]?key|auth(?:orization)?)["']?"""
    r"""\x20*(?:\x20is\x20|\x20was\x20|[:=]>?)\x20*["'`]?([^\s"'`]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: Values from so many decimal digits of guesses on are reported.
LEAST_GUESSES = 8.0

#: Words that people use in passwords, the likeliest first.
WORDS = (
    "password pass admin user login welcome letmein qwerty dragon monkey master hello love secret "
    "root test guest default changeme summer winter spring autumn shadow sunshine princess football "
    "baseball superman batman trust hunter killer soccer tiger ginger cookie cheese orange purple yellow "
    "monday friday sunday january march april june july august september october november december "
    "money freedom happy angel magic star flower house server system database company office the and for you"
).split()
#: So many of the table's most frequent words are ranked behind these, of three to LONGEST_WORD letters each, each in LEAST_DOCUMENTS documents or more.
DICTIONARY_WORDS, LONGEST_WORD, LEAST_DOCUMENTS = 20_000, 20, 20
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Rows of keys, and the alphabet, along which walks are cheap.
WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "0123456789")
LEET = str.maketrans("430157@$!", "aeoistasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
#: Repeats and walks are cut after so many characters, or taken to their end.
LONGEST_RUN = 64
#: Guesses that the choice of one more segment costs.
PER_SEGMENT = math.log10(2)

_NEXT = {row[i : i + 2] for row in WALKS for i in range(len(row) - 1)}
_NEXT |= {pair[::-1] for pair in _NEXT}


def character_cost(c: str) -> float:
    """Guesses for one character by brute force, as a decimal logarithm."""
    if c.isdigit():
        return 1.0
    if c.isalpha():
        return math.log10(26) if c.isascii() else 2.0
    return math.log10(33) if c.isascii() else 2.0


def run_ends(start: int, end: int) -> Iterator[int]:
    """Where a run of at least three characters may be cut: after three to LONGEST_RUN of them, or at its end."""
    yield from range(start + 3, min(end, start + LONGEST_RUN) + 1)
    if end > start + LONGEST_RUN:
        yield end


def segments(value: str, rank: dict[str, int] = RANK) -> Iterator[tuple[int, int, float, str]]:
    """start, end, cost and kind of all segments other than brute force, by start."""
    n = len(value)
    low = value.lower()
    if len(low) != n:  # a few characters of other scripts grow in lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    same, walk = [n] * n, [n] * n  # ends of the repeat and of the walk that each place lies in
    for i in range(n - 2, -1, -1):
        same[i] = same[i + 1] if value[i] == value[i + 1] else i + 1
        walk[i] = walk[i + 1] if low[i : i + 2] in _NEXT else i + 1
    turns = [0] * n  # changes of direction up to each place
    for k in range(2, n):
        turns[k] = turns[k - 1] + ((low[k] > low[k - 1]) != (low[k - 1] > low[k - 2]))
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            place = rank.get(low[i:j]) or rank.get(plain[i:j])
            if place:
                own = value[i:j]
                changed = (own != low[i:j] and own != own.capitalize()) + (low[i:j] not in rank)
                yield i, j, math.log10(place) + 0.3 * (own != low[i:j]) + math.log10(4) * changed, "word"
        m = DATE.match(value, i)
        if m:
            yield i, m.end(), 2.1 + (2.6 if m.end() - i > 4 else 0.0), "date"
        for j in run_ends(i, same[i]):
            yield i, j, character_cost(value[i]) + math.log10(j - i), "repeat"
        for j in run_ends(i, walk[i]):
            yield i, j, math.log10(47) + math.log10(j - i) + 0.6 * (turns[j - 1] - turns[i + 1]), "walk"


def guess_cost(value: str, rank: dict[str, int] = RANK) -> tuple[float, list[tuple[str, int, int]]]:
    """The least decimal logarithm of guesses for a value, and the segments (kind, start, end) that give it."""
    n = len(value)
    best = [0.0] + [math.inf] * n  # of any cut of a prefix
    brute = [math.inf] * (n + 1)  # of the cuts that end in a brute-force span
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    begin = [0] * (n + 1)  # where the brute-force span of that cut begins

    def close(i: int) -> None:
        """Brute force up to i, once everything else that ends at i - 1 is known."""
        if brute[i - 1] <= best[i - 1] + PER_SEGMENT:
            brute[i], begin[i] = brute[i - 1] + character_cost(value[i - 1]), begin[i - 1]
        else:
            brute[i], begin[i] = best[i - 1] + PER_SEGMENT + character_cost(value[i - 1]), i - 1
        if brute[i] < best[i]:
            best[i], back[i] = brute[i], (begin[i], "brute")

    closed = 0
    for start, end, cost, kind in segments(value, rank):
        while closed < start:
            closed += 1
            close(closed)
        total = best[start] + cost + PER_SEGMENT
        if total < best[end]:
            best[end], back[end] = total, (start, kind)
    while closed < n:
        closed += 1
        close(closed)
    cuts, end = [], n
    while end:
        start, kind = back[end]
        cuts.append((kind, start, end))
        end = start
    return best[n], cuts[::-1]


def looks_like_prose(value: str) -> bool:
    """Letters only, at most the first of them a capital: a word of a sentence."""
    return value.isalpha() and (value.islower() or value.istitle() or value.isupper())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind's place in KINDS, end of the base matches, ordered."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, base: list[tuple[int, int, int]], rank: dict[str, int] = RANK) -> list[tuple[int, int, int]]:
    """Spans of values in a credential context that are dear to guess."""
    found = []
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}>")
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) < 6 or looks_like_prose(value):
            continue
        inside = any(k == 0 and a <= start and end <= b for a, k, b in base)
        if not inside and any(k and a < end and start < b for a, k, b in base):
            continue
        if guess_cost(value, rank)[0] >= LEAST_GUESSES:
            found.append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def frequent_words(docs: DataFrame, most: int = DICTIONARY_WORDS, least: int = LEAST_DOCUMENTS) -> list[str]:
    """The words of plain letters that most documents hold outside of credential contexts and base patterns, those in most documents first."""
    rest = F.col("text")
    for pattern in (f"(?i){CONTEXT.pattern}", f"(?i){ASSIGN.pattern}", ACCESS.pattern, HEX.pattern):
        rest = F.regexp_replace(rest, F.lit(pattern), F.lit(" "))
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(rest), r"[^a-z]+"))).alias("word")).filter(F.length("word").between(3, LONGEST_WORD))
    counted = words.groupBy("word").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "word").limit(most)
    return counted.select("word").toPandas()["word"].tolist()  # merged in a task: the driver is sent the chosen words alone


def ranked(words: list[str]) -> dict[str, int]:
    """Ranks of the common words and, behind them, of these."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}


def secret_spans(docs: DataFrame, rank: dict[str, int] = RANK) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans of every row of docs."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            sha, spans = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                more = guess_spans(text, base, rank)
                for k in range(4):
                    counts[k].append(sum(kind == k for _, kind, _ in base + more))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more)))
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(sha, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def scanned(docs: DataFrame) -> DataFrame:
    """``secret_spans`` with the words of the documents themselves."""
    return secret_spans(docs, ranked(frequent_words(docs)))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))
