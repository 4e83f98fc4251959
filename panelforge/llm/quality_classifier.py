"""Quality classifier: logistic regression over hashed word n-grams, fitted with follow-the-regularised-leader updates.

A word is a run of letters, of digits or of other visible characters. Words and pairs of neighbouring words are hashed
to 2**18 weights; a document's score is the logistic function of the sparse dot product of its counts, divided by the
square root of their number, with the weights. Only the text is an input.

The model is fitted on the labelled documents that come first by a hash of doc_id, at most ``sample`` of them and at most
``most_features`` indices of weights in all, two documented bounds; tasks count the features, and one learns the weights of
this bounded sample, so that only its megabyte of weights reaches the driver. Every document is scored. Defined results: null and empty texts score by the intercept alone; without any labels
scores are 0.5. Of rows that share a labelled doc_id the least text is learnt. Repeated rows get equal scores, repeated
labels count again, labels without a quality are ignored. A null doc_id is not held out. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, small_batches, texts
from .hashing import SpanHash, mix, text_groups

BITS = 18
#: Kinds of bytes: 0 space, 1 letter (and every byte of a character beyond ASCII), 2 digit, 3 other.
KIND = np.full(256, 3, np.uint8)
KIND[[32, *range(9, 14)]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2
SCORES = "doc_id long, held_out boolean, score double, predicted int"


def features(data: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """Weight indices of all words and word pairs of the texts, and the text each belongs to."""
    kind = KIND[data]
    change = np.ones(len(data) + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[offsets] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    text = np.searchsorted(offsets, starts, "right") - 1
    words = hasher(data, starts, ends)
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * np.uint64(3) + words[1:])
    same = text[1:] == text[:-1]
    return (np.concatenate([words, pairs[same]]) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([text, text[1:][same]])


class FollowTheRegularisedLeader:
    """Per-coordinate FTRL-proximal logistic regression; coordinate 2**BITS is the intercept."""

    def __init__(self, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


Example = tuple[np.ndarray, np.ndarray, int]


def fit(examples: list[Example], epochs: int = 3, seed: int = 11) -> np.ndarray:
    """Weights from examples (distinct indices of weights, their counts, label)."""
    model, random = FollowTheRegularisedLeader(), np.random.default_rng(seed)
    made = [(np.append(at, 1 << BITS), np.append(n / np.sqrt(max(1, n.sum())), 1.0), y) for at, n, y in examples]
    for _ in range(epochs):
        for k in random.permutation(len(made)):
            model.learn(*made[k])
    return model.weights(slice(None)).astype(np.float32)


def counted(text: bytes, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """The distinct indices of weights of a text and how often each occurs."""
    data = np.frombuffer(text, np.uint8)
    at, n = np.unique(features(data, np.array([0, len(data)]), hasher)[0], return_counts=True)
    return at.astype(np.int32), n.astype(np.int32)


def fitted(docs: DataFrame, labels: DataFrame, sample: int, most_features: int) -> np.ndarray:
    """Weights from the first labelled rows by a hash, none of the held-out fold, as counts of features; the labels joined are as few."""
    chosen = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    chosen = chosen.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id", "y").limit(sample)
    found = texts(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            made = [counted(x.as_buffer().to_pybytes(), hasher) for x in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(a) for a, _ in made], pa.int64()), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([n.tobytes() for _, n in made], pa.binary())], ["doc_id", "size", "at", "n"])

    small_batches(docs.sparkSession)
    made = materialize(found.mapInArrow(count, "doc_id long, size long, at binary, n binary"), "features")
    rows = made.join(F.broadcast(chosen), "doc_id")  # both sides have at most ``sample`` rows
    upto = F.sum("size").over(W.orderBy("place", "doc_id", "y").rowsBetween(W.unboundedPreceding, 0))
    taken = made.join(rows.withColumn("upto", upto).filter(F.col("upto") <= most_features).select("doc_id", "y"), "doc_id").select("doc_id", "at", "n", "y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(np.frombuffer(a.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.int32), y) for batch in batches for a, n, y in zip(batch["at"], batch["n"], batch["y"].to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([fit(examples).tobytes()], pa.binary())], ["weights"])

    found = taken.repartition(1).sortWithinPartitions("doc_id", "y").mapInArrow(learn, "weights binary").first()
    return np.frombuffer(found["weights"], np.float32) if found else fit([])


def probabilities(column: pa.StringArray, weights: np.ndarray, hasher: SpanHash) -> np.ndarray:
    """The scores of texts without nulls."""
    sums, sizes = np.zeros(len(column)), np.zeros(len(column))
    for first, data, offsets in text_groups(column):
        at, text = features(data, offsets, hasher)
        n = len(offsets) - 1
        sums[first : first + n] = np.bincount(text, weights[at], n)
        sizes[first : first + n] = np.bincount(text, minlength=n)
    return 1 / (1 + np.exp(-np.clip(float(weights[-1]) + sums / np.sqrt(np.maximum(1, sizes)), -30, 30)))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    small_batches(docs.sparkSession)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            p = probabilities(batch["text"], weights, hasher)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    return texts(docs).select("doc_id", fold, "text").mapInArrow(scores, SCORES)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 8000, most_features: int = 6_000_000) -> DataFrame:
    return score(docs, fitted(docs, labels, sample, most_features))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 8000, most_features: int = 6_000_000) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, all columns as they are."""
    weights = fitted(docs, labels, sample, most_features)
    small_batches(docs.sparkSession)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for batch in batches:
            yield batch.filter(pa.array(probabilities(batch["text"].fill_null(""), weights, hasher) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
