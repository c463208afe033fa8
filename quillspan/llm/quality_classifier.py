"""Text quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words and word pairs of a text are hashed to a fixed number of weights; a text is the
sparse vector of its features, each with 1 + log(count), scaled to length one.  Words are read in two forms:
folded (letters lower-cased), and as a shape (runs of capitals, small letters,
digits and marks), so that a vocabulary that was never seen still says something.  Weights come from
FTRL-proximal updates over a bounded sample of labelled rows; scoring is a sparse dot product
in the tasks, with the weights (a fixed 2**18 floats) sent along.

Only rows whose crc32(doc_id as text) modulo 3 is not 1 are learned from; the score of a text depends
on nothing but its text.

Defined cases: null and empty texts score by the intercept alone; different labels of one document each count as a row, and of several texts of one id the
smallest is learned from; texts longer than LABELLED_BYTES are scored whole and not learned from; without
labelled rows, or with one class, all scores are those of an untrained
model (0.5) or of the class seen; repeated rows are scored one by one; a null doc_id is carried through,
and never held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import documents
from quillspan.llm.textcore import LOWER, mix, pieces, span_hashes, text_bytes, word_bounds

BITS = 18
#: At most so many labelled rows are learned from, those first in a hash order of the id, with texts of at most so many bytes.
LABELLED_ROWS, LABELLED_BYTES = 3000, 1 << 17
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SEED = 7

#: Bytes as shapes: capital, small letter, digit, byte of a longer character, mark.
SHAPE = np.full(256, ord("!"), np.uint8)
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[0x80:] = ord("a")


def shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's shape, without the lengths of its runs but with its last three bytes if they are marks."""
    shape = SHAPE[data]
    first = np.zeros(len(data), bool)
    first[0:1] = True
    first[1:] = shape[1:] != shape[:-1]
    first[starts] = True
    run_sum = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(first, mix(shape.astype(np.uint64) + np.uint64(1000)), np.uint64(0)), out=run_sum[1:])
    runs = run_sum[ends] - run_sum[starts]
    marks = np.zeros(len(starts), np.uint64)
    for j in range(1, 4):
        at = np.maximum(ends - j, starts)
        last = data[at].astype(np.uint64)
        marks = marks * np.uint64(257) + np.where((shape[at] == ord("!")) & (ends - j >= starts), last, np.uint64(0))
    return mix(runs ^ mix(marks + np.uint64(5)))


def features(column: pa.Array, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and values of each text."""
    keep = np.uint64((1 << bits) - 1)
    data, offsets = text_bytes(column)
    for at, to in pieces(offsets):
        own, places = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        starts, ends = word_bounds(own, places)
        first = np.searchsorted(starts, places).tolist()
        kinds = [span_hashes(own, starts, ends, LOWER), shape_hashes(own, starts, ends) if len(starts) else np.zeros(0, np.uint64)]
        grams = []
        for k, words in enumerate(kinds):
            salt = np.uint64(2 * k + 1)
            grams.append((mix(words + salt) & keep).astype(np.int64))
            pairs = mix(words[:-1] * np.uint64(3) + mix(words[1:] + salt)) if len(words) > 1 else np.zeros(0, np.uint64)
            grams.append((pairs & keep).astype(np.int64))
        for a, b in zip(first[:-1], first[1:]):
            if a == b:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            numbers, counts = np.unique(np.concatenate([g[a : b - i % 2] for i, g in enumerate(grams)]), return_counts=True)
            values = 1.0 + np.log(counts)
            yield numbers, values / np.sqrt(values @ values)


class Ftrl:
    """FTRL-proximal logistic regression over sparse rows."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.size = size

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, i: np.ndarray, x: np.ndarray, label: int, importance: float) -> None:
        i, x = np.append(i, self.size), np.append(x, 1.0)
        w = self.weights(i)
        g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x * importance
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / ALPHA
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def train(texts: list[str | None], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights, the intercept last; classes weigh the same, rows are taken in a fixed shuffled order."""
    model = Ftrl(1 << bits)
    rows = list(features(pa.array(texts, pa.string()), bits))
    y = np.array(labels, np.int64)
    share = np.bincount(y, minlength=2) / max(1, len(y))
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0.0)
    for epoch in range(epochs):
        for k in np.random.default_rng(SEED + epoch).permutation(len(rows)):
            model.learn(*rows[k], int(y[k]), min(5.0, float(weight[y[k]])))
    return model.weights(np.arange(model.size + 1)).astype(np.float32)


def scores_of(column: pa.Array, weights: np.ndarray) -> np.ndarray:
    bits = (len(weights) - 1).bit_length() - 1
    sums = np.array([weights[i] @ x for i, x in features(column, bits)], np.float64)
    return 1.0 / (1.0 + np.exp(-np.clip(sums + float(weights[-1]), -35, 35)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> np.ndarray:
    """Weights from at most ``most`` labelled rows that are not held out."""
    allowed = labels.filter(~held_out() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = allowed.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    some = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LABELLED_BYTES)
    # one row an id and label, however often the id is repeated
    rows = some.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values(["doc_id", "quality"])
    return train(rows["text"].tolist(), rows["quality"].tolist())


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores_of(batch.column("text"), weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
