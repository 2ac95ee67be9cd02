"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its words, of neighbouring pairs and of pairs with one word between, each counted once.  FTRL-proximal keeps a learning rate for each
coordinate and an L1 penalty that leaves almost all weights at zero, so a model is some thousand (hash, weight) pairs,
which are broadcast; a document is scored by looking its features up.

Training: labelled documents outside the held-out fold, a bounded sample of SAMPLE of them drawn by a hash of their ids and
of SAMPLE_BYTES of text, features made in parallel, then EPOCHS passes in one task in the hash's order (the bounds make that
task's size fixed).

Defined results: null or wordless text has the bias alone; without training rows every score is 0.5; labels other than 0
and 1 and null ids are not learnt from, of contradicting labels of one ``doc_id`` the greater counts, of its rows the
smallest text; repeated rows get repeated scores; a null ``doc_id`` is scored and not held out; an empty table gives an empty
result; other columns are neither read nor kept.  Identifiers may be of any type that Spark can hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ._sample import sampled_texts
from ._words import ALNUM, GRAM_MULT, hash_words, mix, pieces, row_of

#: Labelled documents that are learnt from at most, passes over them, and least documents of a feature.
SAMPLE, EPOCHS, LEAST_DOCS = 16_000, 5, 3
#: FTRL-proximal: rate, its smoothing, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.0
#: Score from which a document is predicted toxic.
MARK = 0.7
#: Weights of a model at most, 16 bytes each; L1 leaves far fewer, and more are an error.
MOST_WEIGHTS = 1 << 20
BIAS = 0


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 63-bit feature) of every feature occurrence of a string column."""
    words, splits = hash_words(column, ALNUM)
    row = row_of(splits)
    rows, found = [row], [words]
    for gap, salt in ((1, 0x51ED), (2, 0xA3C5)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            found.append(mix(words[:-gap][same] * GRAM_MULT + words[gap:][same] + np.uint64(salt)))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(1)).astype(np.int64) | 1


@dataclass
class Model:
    """Sorted features, their weights, the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int = 20

    def __post_init__(self):
        order = np.argsort(self.keys)
        self.keys, self.weights = self.keys[order], self.weights[order]
        self.maybe = np.zeros(1 << self.bits, dtype=bool)
        self.maybe[self.keys >> (63 - self.bits)] = True

    def margins(self, row: np.ndarray, feature: np.ndarray, n_rows: int) -> np.ndarray:
        out = np.full(n_rows, self.bias)
        if len(self.keys):
            some = np.flatnonzero(self.maybe[feature >> (63 - self.bits)])
            k = np.minimum(np.searchsorted(self.keys, feature[some]), len(self.keys) - 1)
            hit = self.keys[k] == feature[some]
            once = np.unique(row[some][hit] * len(self.keys) + k[hit])
            np.add.at(out, once // len(self.keys), self.weights[once % len(self.keys)])
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def ftrl(docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray | None = None, epochs: int = EPOCHS, l1: float = L1) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) learnt from documents given as arrays of distinct features."""
    # most features are too rare; a table of bucket counts, never below a feature's own, drops them without a sort
    seen = np.zeros(1 << 22, dtype=np.uint32)
    for d in docs:
        seen[d >> 41] += 1
    docs = [d[seen[d >> 41] >= LEAST_DOCS] for d in docs]
    every = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
    keys, count = np.unique(every, return_counts=True)
    keys = keys[count >= LEAST_DOCS]
    size = len(keys) + 1  # the bias is the last coordinate, without penalty
    z, n = np.zeros(size), np.zeros(size)
    index = []
    for d in docs:
        k = np.searchsorted(keys, d)
        k = k[(k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] == d)] if len(keys) else k[:0]
        index.append(np.append(k, size - 1).astype(np.int32))
    penalty = np.append(np.full(len(keys), l1), 0.0)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= penalty[i], 0.0, -(zi - np.sign(zi) * penalty[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for d, (i, y) in enumerate(zip(index, labels, strict=True)):
            w = weights(i)
            g = (sigmoid(w.sum()) - y) * (1.0 if weight is None else weight[d])
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(size))
    used = np.flatnonzero(w[:-1])
    if len(used) > MOST_WEIGHTS:
        raise ValueError(f"{len(used)} weights, more than {MOST_WEIGHTS}: a greater L1 penalty is needed")
    return keys[used], w[used], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            row, f = features(piece.column("text"))
            order = np.lexsort((f, row))
            row, f = row[order], f[order]
            once = np.append(True, (row[1:] != row[:-1]) | (f[1:] != f[:-1])) if len(f) else np.zeros(0, dtype=bool)
            ends = np.searchsorted(row[once], np.arange(piece.num_rows + 1))
            yield pa.RecordBatch.from_arrays([piece.column("draw"), piece.column("label"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f[once]))], ["draw", "label", "features"])


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, labels = [], []
    for batch in batches:
        labels += batch.column("label").to_pylist()
        docs += [x.values.to_numpy() for x in batch.column("features")]
    if docs:
        keys, w, bias = ftrl(docs, np.array(labels, dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, BIAS)), pa.array(np.append(w, bias))], ["feature", "weight"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from ``labels`` (doc_id, label 0/1) of ``docs`` (doc_id, text), of ``sample`` documents at most."""
    known = labels.select("doc_id", F.col("label").cast("double").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = known.withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(sample)
    # at most `sample` rows of 24 bytes
    made = sampled_texts(docs, drawn).select("draw", "label", "text").mapInArrow(_featured, "draw long, label double, features array<long>")
    learnt = made.repartition(1).sortWithinPartitions("draw", "features").mapInArrow(_learnt, "feature long, weight double").collect()
    if not learnt:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
    bias = next(r.weight for r in learnt if r.feature == BIAS)
    own = [r for r in learnt if r.feature != BIAS]
    return Model(np.array([r.feature for r in own], dtype=np.int64), np.array([r.weight for r in own]), bias)


def _scored(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            row, f = features(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(sigmoid(model.margins(row, f, piece.num_rows)))], ["doc_id", "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_WEIGHTS pairs
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(lambda b: _scored(shared.value, b), schema)


def digest(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Trains outside the held-out fold on ``labels`` (doc_id, toxic) and scores all ``docs``: doc_id, held_out, score, predicted."""
    fold = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    return score(docs, train(docs, fold, sample)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= MARK).cast("int").alias("predicted"))
