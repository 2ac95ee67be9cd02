"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each of LABELLERS votes good, bad or nothing on a document.  Only how many documents have each pattern of votes matters to
the label model, at most 3**8 counts whatever the size of the corpus: expectation-maximisation on them estimates each
labeller's vote rates among good documents and among each kind of bad ones, and for each pattern the probability of a good
document.  A prior that counts as PRIOR documents, however many there are, holds the classes to their meaning where one is nearly
absent; a large corpus outweighs it.

These posterior labels, weighted by their certainty, train a linear scorer over hashed features by FTRL-proximal: words,
pairs of neighbouring words, shares of word shapes and binned measurements.  It learns from a bounded sample of SAMPLE
documents, drawn by a hash of their ids, and SAMPLE_BYTES of text; vote counts and scores cover all documents.

Defined results: null and wordless text is scored by its empty measurements (no words is a bad sign); an empty corpus
gives an empty result; repeated rows get repeated results; rows with a null ``doc_id`` are counted and scored but not learnt
from; other columns are kept by ``filtered``, whatever their names, and ignored otherwise.  Identifiers keep their type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._names import unused
from ._sample import sampled_texts
from ._store import stored
from ._words import NOT_BLANK, bounded_words, bytes_of, grams, mix, pieces, row_of
from .toxicity import BIAS, Model, ftrl, sigmoid

#: Documents that the scorer learns from at most, EM rounds, weight of the prior in documents.
SAMPLE, ROUNDS, PRIOR = 8_000, 60, 2_500
#: Documents that score lower are rejected.
MARK = 0.4
BAD, GOOD, NOTHING = 0, 1, 2

#: Each labeller: measurement, bad above (or below) this, good below (or above) that.
LABELLERS: list[tuple[str, str, float, float]] = [
    ("symbols", ">", 0.3, 0.1),
    ("capitals", ">", 0.4, 0.2),
    ("repeats", ">", 0.2, 0.05),
    ("stutter", ">", 0.25, 0.1),
    ("words", "<", 3, 10),
    ("exclaims", ">", 0.3, 0.1),
    ("letters", "<", 0.7, 0.8),
    ("plain", "<", 0.7, 0.85),
]
#: Kinds of bad documents, by the labellers that see them; each is a class of its own beside the good documents.
KINDS = [("symbols", "letters", "plain"), ("repeats", "stutter"), ("capitals", "exclaims")]
MEASURES = [name for name, *_ in LABELLERS]


def _mask(chars: str) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    m[[ord(c) for c in chars]] = True
    return m


_SYMBOL, _EXCLAIM = _mask("#*$%&|<>"), _mask("!?")
_UPPER, _LOWER = _mask("".join(map(chr, range(65, 91)))), _mask("".join(map(chr, range(97, 123))))
_LETTER = _UPPER | _LOWER | (np.arange(256) >= 0x80)
#: Byte kinds of word shapes: lower, upper, digit, beyond ASCII, full stop and comma, "!" and "?", symbols, rest.
_KIND = np.full(256, 7, dtype=np.int64)
for _k, _m in enumerate((_LOWER, _UPPER, _mask("0123456789"), np.arange(256) >= 0x80, _mask(".,"), _EXCLAIM, _SYMBOL)):
    _KIND[_m] = _k


def measure(column: pa.Array, features: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a column for each of MEASURES, row of each feature, 63-bit feature) of a string column; ``features`` may repeat in a row."""
    raw, offsets = bytes_of(column)
    words, splits, starts, ends = bounded_words(column, NOT_BLANK)
    row, n = row_of(splits), np.diff(splits)
    total = np.maximum(n, 1)

    def share(mask, of):
        c = np.append(0, np.cumsum(mask.take(raw)))
        return (c[offsets[1:]] - c[offsets[:-1]]) / np.maximum(of, 1)

    def by_row(rows):
        return np.bincount(rows, minlength=len(n))[: len(n)]

    solid = share(NOT_BLANK, 1)
    upper, lower = share(_UPPER, 1), share(_LOWER, 1)
    g = grams(words, 5)
    gram_row = row[: len(g)][row[: len(g)] == row[4:]] if len(g) else row[:0]
    distinct = np.zeros(len(n))
    if len(gram_row):
        g = g[row[: len(g)] == row[4:]]
        order = np.lexsort((g, gram_row))
        new = np.append(True, (g[order][1:] != g[order][:-1]) | (gram_row[order][1:] != gram_row[order][:-1]))
        distinct = by_row(gram_row[order][new])
    n_grams = by_row(gram_row)
    stutter = by_row(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])]) if len(words) else np.zeros(len(n))
    first, last = (_KIND[raw[starts]], _KIND[raw[ends - 1]]) if len(starts) else (starts, starts)
    plain = by_row(row[np.isin(first, (0, 1, 3)) & np.isin(last, (0, 1, 3, 4))])
    m = np.stack([share(_SYMBOL, total), upper / np.maximum(upper + lower, 1), 1 - np.where(n_grams > 0, distinct / np.maximum(n_grams, 1), 1), stutter / total, n.astype(float), share(_EXCLAIM, total), share(_LETTER, solid), plain / total], axis=1)
    if not features:
        return m, row[:0], words[:0].astype(np.int64)
    # shape of a word: kinds of its first and last bytes and whether it is long; shapes by their share of the words
    shape = (first * 8 + last) * 2 + (ends - starts > 12)
    key, count = np.unique(row * 128 + shape, return_counts=True)
    of, part = key // 128, np.floor(8 * count / total[key // 128]).astype(np.int64)
    rows, found = [of[part > 0]], [(key % 128 * 16 + part)[part > 0].astype(np.uint64)]
    bins = np.floor(np.where(np.array(MEASURES) == "words", 2 * np.log2(m + 1), np.minimum(m, 1) * 10)).astype(np.int64)
    for j in range(len(MEASURES)):
        rows.append(np.arange(len(n)))
        found.append((1 << 20 | j << 12 | bins[:, j]).astype(np.uint64))
    # words and pairs of neighbours
    rows.append(row)
    found.append(words)
    if len(words) > 1:
        same = row[1:] == row[:-1]
        rows.append(row[1:][same])
        found.append(grams(words, 2)[same])
    return m, np.concatenate(rows), (mix(np.concatenate(found)) >> np.uint64(1)).astype(np.int64) | 1


def votes(m: np.ndarray) -> np.ndarray:
    """Votes of each labeller on rows of measurements."""
    out = np.full(m.shape, NOTHING)
    for j, (_, side, bad, good) in enumerate(LABELLERS):
        out[:, j][(m[:, j] < good) if side == ">" else (m[:, j] >= good)] = GOOD
        out[:, j][(m[:, j] > bad) if side == ">" else (m[:, j] < bad)] = BAD
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(len(LABELLERS))).sum(axis=1)


def label_model(patterns: dict[int, int]) -> dict[int, float]:
    """Probability of a good document for each vote pattern, from the patterns' counts, by expectation-maximisation."""
    if not patterns:
        return {}
    codes, count = np.array(list(patterns)), np.array(list(patterns.values()), dtype=float)
    v = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    one_hot = (v[:, :, None] == np.arange(3)).astype(float)
    # class 0 is the good documents; expected rates of bad, good and no votes in each class, and of the classes
    expected = np.array([[[0.003, 0.9, 0.097]] * len(LABELLERS)] + [[[0.7, 0.2, 0.1] if name in kind else [0.1, 0.8, 0.1] for name in MEASURES] for kind in KINDS])
    share = expected_share = np.array([0.9] + [0.1 / len(KINDS)] * len(KINDS))
    rate, weight = expected, PRIOR
    for _ in range(ROUNDS):
        log = np.log(share) + np.einsum("plv,clv->pc", one_hot, np.log(rate))
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        mass = count[:, None] * p
        rate = np.einsum("pc,plv->clv", mass, one_hot) + weight * expected * expected_share[:, None, None]
        rate /= rate.sum(axis=2, keepdims=True)
        share = (mass.sum(axis=0) + weight * expected_share) / (count.sum() + weight)
    good = p[:, 0]
    return dict(zip(codes.tolist(), good.tolist(), strict=True))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            m, _, _ = measure(piece.column("text"), features=False)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(pattern(votes(m)).astype(np.int32))], ["doc_id", "pattern"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            _, row, f = measure(piece.column("text"))
            order = np.lexsort((f, row))
            row, f = row[order], f[order]
            once = np.append(True, (row[1:] != row[:-1]) | (f[1:] != f[:-1])) if len(f) else np.zeros(0, dtype=bool)
            ends = np.searchsorted(row[once], np.arange(piece.num_rows + 1))
            yield pa.RecordBatch.from_arrays([piece.column("draw"), piece.column("good"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f[once]))], ["draw", "good", "features"])


def _learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, good = [], []
    for batch in batches:
        good += batch.column("good").to_pylist()
        docs += [x.values.to_numpy() for x in batch.column("features")]
    if docs:
        p = np.array(good)
        keys, w, bias = ftrl(docs, (p >= 0.5).astype(float), weight=np.abs(2 * p - 1), l1=0.5)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, BIAS)), pa.array(np.append(w, bias))], ["feature", "weight"])


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[Model, DataFrame]:
    """(scorer, doc_id and good: the posterior of every row)"""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    voted = stored(texts.mapInArrow(_voted, T.StructType([docs.schema["doc_id"], T.StructField("pattern", T.IntegerType())])))
    counts = {r.pattern: r["count"] for r in voted.groupBy("pattern").count().collect()}  # 3**8 rows at most
    good = label_model(counts)
    known = spark.createDataFrame([(p, g) for p, g in good.items()], "pattern int, good double")
    posterior = voted.join(F.broadcast(known), "pattern").select("doc_id", "good")
    # of one doc_id's rows the smallest posterior; at most `sample` rows of 24 bytes
    drawn = posterior.where("doc_id is not null").groupBy("doc_id").agg(F.min("good").alias("good")).withColumn("draw", F.xxhash64("doc_id")).orderBy("draw", "doc_id").limit(sample)
    made = sampled_texts(texts, drawn).select("draw", "good", "text").mapInArrow(_featured, "draw long, good double, features array<long>")
    learnt = made.repartition(1).sortWithinPartitions("draw", "features").mapInArrow(_learnt, "feature long, weight double").collect()
    own = [r for r in learnt if r.feature != BIAS]
    bias = next((r.weight for r in learnt if r.feature == BIAS), 0.0)
    return Model(np.array([r.feature for r in own], dtype=np.int64), np.array([r.weight for r in own]), bias), posterior


def _scored(model: Model, text: str, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, text):
            m, row, f = measure(piece.column(text))
            scores = sigmoid(model.margins(row, f, piece.num_rows))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(pattern(votes(m)).astype(np.int32)), pa.array(scores)], [*piece.schema.names, *names])


def scored(docs: DataFrame, model: Model, names: list[str]) -> DataFrame:
    """``docs`` with a pattern of votes and a score (of a good document) added under these two ``names``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.IntegerType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(lambda b: _scored(shared.value, "text", names, b), schema)


def digest(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, votes (a pattern's digits to the base 3), score, kept."""
    docs = docs.select("doc_id", "text")
    model, _ = train(docs, sample)
    v = F.concat(*[(F.floor(F.col("pattern") / 3**j) % 3).cast("string") for j in range(len(LABELLERS))])
    return scored(docs, model, ["pattern", "score"]).select("doc_id", v.alias("votes"), "score", (F.col("score") >= MARK).alias("kept"))


def filtered(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier keeps, with the columns they came with."""
    model, _ = train(docs, sample)
    names = unused(docs.columns, "pattern", "score")
    return scored(docs, model, names).where(F.col(names[1]) >= MARK).drop(*names)
