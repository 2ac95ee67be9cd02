"""Benchmark decontamination by winnowing.

Every K-gram of words is hashed, and each run of ``WINDOW - K + 1`` neighbouring K-grams keeps its smallest hash as a
fingerprint.  Two texts that share ``WINDOW`` words share such a run, hence its fingerprint: no shared span of that
length is missed.  Training and test fingerprints are joined, and each hit is extended to the windows of ``WINDOW`` words
around it, which are joined with the benchmark's windows.  An item of fewer words is one window, its own fingerprint.

1. One pass over the documents numbers their rows and keeps, for each row, its fingerprints that the benchmark may hold,
   with the windows around them.  What it may hold is a bitmap of its fingerprints of at most 2**MOST_BITS bits, which only
   spares rows: a bit set by another fingerprint costs a row that the join drops.
2. The fingerprints that are left are joined with the benchmark's, their windows with its windows, and the words and items
   found are put together by row.  Both sides are tables written out, so that a fingerprint that very many documents hold
   can be split; the benchmark's side is broadcast only up to BROADCAST_ROWS rows.

Nothing of either table passes through the driver but the bitmap.  Windows are compared by two 64-bit hashes.

Defined results: null or wordless text has no words, no hits; an item of fewer than ``WINDOW`` words is one window; an
item without words never occurs; every document row has a result row of its own, also where ``doc_id`` is repeated or null;
rows of a repeated ``item_id`` are one item, counted once; a null ``item_id`` or an empty benchmark contributes nothing.
Identifiers may be of any type that Spark can order; other columns are ignored by ``contamination`` and kept by
``decontaminate``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._store import stored
from ._words import ALNUM, GRAM_MULT, grams, hash_words, pieces, row_of

#: Words of a fingerprinted gram, and words of a window that counts as contamination.
K, WINDOW = 5, 10
#: Bitmap of fingerprints: so many bits for each, from 2**LEAST_BITS to 2**MOST_BITS (8 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 26
#: Benchmark rows (of 24 bytes) up to which a side of a join is broadcast; beyond it is merged.
BROADCAST_ROWS = 500_000
OTHER_MULT = GRAM_MULT ^ np.uint64(0x5851F42D4C957F2C)
WINDOWS = "array<struct<start:bigint,key:bigint,key2:bigint>>"
CANDIDATES = f"array<struct<n:int,print:bigint,windows:{WINDOWS}>>"
_WINDOW = pa.struct([("start", pa.int64()), ("key", pa.int64()), ("key2", pa.int64())])
_CANDIDATE = pa.struct([("n", pa.int32()), ("print", pa.int64()), ("windows", pa.list_(_WINDOW))])


def winnow(gram: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the smallest (the first of equals) of ``window`` neighbours in the same row."""
    n = len(gram) - window + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at = gram[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, window):
        less = gram[j : j + n] < best
        best[less] = gram[j : j + n][less]
        at[less] = j
    own = row[:n] == row[window - 1 : window - 1 + n]
    chosen = np.zeros(len(gram), dtype=bool)
    chosen[(np.arange(n) + at)[own]] = True
    return np.flatnonzero(chosen)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows_of_grams(row: np.ndarray, n: int) -> np.ndarray:
    """Row of each n-gram; a negative number of its own for one that runs over a row's end."""
    first = row[: max(len(row) - n + 1, 0)]
    return np.where(first == row[n - 1 :], first, -1 - np.arange(len(first))) if len(first) else first


def _prints(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the fingerprints, the fingerprints)"""
    g = grams(words, K)
    at = winnow(g, _rows_of_grams(row, K), WINDOW - K + 1)
    return at, g[at]


def _item_rows(batches):
    """(kind, n, key, key2, item) of benchmark items: fingerprints (kind 0, without item) and windows (kind 1)."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            words, splits = hash_words(piece.column("text"), ALNUM)
            row, length = row_of(splits), np.diff(splits)
            found = []
            _, prints = _prints(words, row)
            whole = np.isin(row, np.flatnonzero(length >= WINDOW))
            prints = np.unique(prints)
            none = pa.nulls(len(prints), piece.column("item_id").type)
            found.append([np.zeros(len(prints), np.int8), np.full(len(prints), WINDOW, np.int32), _signed(prints), _signed(prints), none])
            for n in np.unique(np.minimum(length[length > 0], WINDOW)).tolist():
                g, g2 = grams(words, n), grams(words, n, OTHER_MULT)
                own = whole if n == WINDOW else np.isin(row, np.flatnonzero(length == n))
                at = np.flatnonzero(own[: len(g)] & (_rows_of_grams(row, n) >= 0))
                key, key2, item = g[at], g2[at], piece.column("item_id").take(pa.array(row[at]))
                found.append([np.ones(len(at), np.int8), np.full(len(at), n, np.int32), _signed(key), _signed(key2), item])
                if n < WINDOW:
                    found.append([np.zeros(len(at), np.int8), np.full(len(at), n, np.int32), _signed(key), _signed(key), pa.nulls(len(at), item.type)])
            for kind, n, key, key2, item in found:
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(n), key, key2, item], ["kind", "n", "key", "key2", "item"])


class Prints:
    """Bitmap of the benchmark's fingerprints, and the lengths of its windows below WINDOW."""

    def __init__(self, bits: int, buckets: dict[int, bytes], short: list[int]):
        self.bits, self.short = bits, short
        self.map = np.zeros(max(1 << bits >> 3, 4096), dtype=np.uint8)
        for bucket, part in buckets.items():
            self.map[bucket * 4096 : bucket * 4096 + 4096] = np.frombuffer(part, np.uint8)

    def may_hold(self, prints: np.ndarray) -> np.ndarray:
        bit = (prints & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return (self.map.take(bit >> 3) >> (bit & 7).astype(np.uint8) & 1).astype(bool)

    def candidates(self, words: np.ndarray, row: np.ndarray):
        """(n, fingerprints, first window of each, windows: starts, keys, second keys) of the fingerprints it may hold."""
        at, g = _prints(words, row)
        some = np.flatnonzero(self.may_hold(g))
        at, g = at[some], g[some]
        # the windows around a fingerprint are those that hold its gram
        start = at[:, None] - np.arange(WINDOW - K + 1)
        inside = (start >= 0) & (start + WINDOW <= len(words))
        safe = np.where(inside, start, 0)
        inside &= row[safe] == row[np.minimum(safe + WINDOW - 1, len(words) - 1)]
        first = np.append(0, np.cumsum(inside.sum(axis=1)))
        yield WINDOW, at, g, first, *self._keys(words, start[inside], WINDOW)
        for n in self.short:
            g = grams(words, n)
            at = np.flatnonzero(self.may_hold(g) & (_rows_of_grams(row, n) >= 0))
            yield n, at, g[at], np.arange(len(at) + 1), *self._keys(words, at, n)

    def _keys(self, words, start, n):
        local = words[start[:, None] + np.arange(n)].ravel()
        return start, grams(local, n)[::n], grams(local, n, OTHER_MULT)[::n]


def _candidates(prints: Prints, kept: list[str], batches):
    """Rows (row_id, own) to rows (row_id, own with the ``kept`` fields, n_words, candidates)."""
    for batch in batches:
        own = batch.column("own")
        fields = [own.type.field(i).name for i in range(own.type.num_fields)]
        column = lambda c: own.field(fields.index(c))
        left = pa.StructArray.from_arrays([column(c) for c in kept], fields=[own.type.field(fields.index(c)) for c in kept])
        whole = pa.RecordBatch.from_arrays([batch.column("row_id"), left, column("text")], ["row_id", "own", "text"])
        for piece in pieces(whole, "text"):
            words, splits = hash_words(piece.column("text"), ALNUM)
            row, n_rows = row_of(splits), piece.num_rows
            at, n, g, size, start, key, key2 = [], [], [], [], [], [], []
            for length, where, prints_there, first, s, k, k2 in prints.candidates(words, row):
                at.append(where)
                n.append(np.full(len(where), length, np.int32))
                g.append(prints_there)
                size.append(np.diff(first))
                start.append(s)
                key.append(k)
                key2.append(k2)
            at, n, g, size, start, key, key2 = map(np.concatenate, (at, n, g, size, start, key, key2))
            start = start - splits[row[start]]
            windows = pa.StructArray.from_arrays([pa.array(start), _signed(key), _signed(key2)], fields=list(_WINDOW))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), windows)
            found = pa.StructArray.from_arrays([pa.array(n), _signed(g), lists], fields=list(_CANDIDATE))
            order = np.argsort(row[at], kind="stable")
            ends = np.searchsorted(row[at][order], np.arange(n_rows + 1))
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([piece.column("row_id"), piece.column("own"), pa.array(np.diff(splits)), listed], ["row_id", "own", "n_words", "candidates"])


def _side(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows.hint("merge")


def _marked(docs: DataFrame, benchmark: DataFrame, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """(row_id, own: a struct of the ``kept`` columns of each row of ``docs``, n_words, candidates; row_id, windows, item_ids of the rows with hits)"""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    schema = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("n", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("key2", T.LongType()), T.StructField("item", items.schema["item_id"].dataType)])
    known = stored(items.mapInArrow(_item_rows, schema).distinct())
    prints, windows = known.where("kind = 0").select("n", F.col("key").alias("print")), known.where("kind = 1")
    held = {r.n: r["count"] for r in prints.groupBy("n").count().collect()}  # WINDOW rows at most
    n_prints, n_windows = sum(held.values()), windows.count()
    bits = min(max(LEAST_BITS, (BITS_EACH * n_prints).bit_length()), MOST_BITS)
    bit = F.col("print").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    # 4 KB for each 2**15 bits
    buckets = prints.groupBy(F.floor(bit / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(bit % 32768).alias("m")).collect()
    shared = spark.sparkContext.broadcast(Prints(bits, {r.b: bytes(r.m) for r in buckets}, sorted(n for n in held if n < WINDOW)))
    # one struct of the caller's columns beside our own, so that no names clash; stored, so that a row keeps its number
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, "text"])]).alias("own"))
    own = T.StructType([f for f in rows.schema["own"].dataType if f.name in kept])
    found = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("own", own), T.StructField("n_words", T.LongType()), T.StructField("candidates", T.DataType.fromDDL(CANDIDATES))])
    rows = stored(rows.mapInArrow(lambda batches: _candidates(shared.value, kept, batches), found))
    maybe = rows.where(F.size("candidates") > 0).select("row_id", F.explode("candidates").alias("c")).select("row_id", "c.*")
    maybe = maybe.join(_side(prints, n_prints), ["n", "print"], "left_semi").select("row_id", "n", F.explode("windows").alias("w")).select("row_id", "n", "w.*")
    maybe = stored(maybe.distinct())
    hits = maybe.join(_side(windows.select("n", "key", "key2").distinct(), n_windows), ["n", "key", "key2"], "left_semi")
    of_items = maybe.select("row_id", "n", "key", "key2").distinct().join(_side(windows.select("n", "key", "key2", "item"), n_windows), ["n", "key", "key2"]).select("row_id", "item").distinct()
    # a row's own hits are as many as its words
    spans = hits.groupBy("row_id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))).alias("windows"))
    ids = of_items.groupBy("row_id").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    return rows, stored(spans.join(ids.hint("merge"), "row_id"))


def _joined(batches):
    """Windows (start, stop) of each row as disjoint spans."""
    for batch in batches:
        spans = []
        for windows in batch.column("windows").to_pylist():
            out: list[dict] = []
            for w in sorted(windows, key=lambda w: w["start"]):
                if out and w["start"] <= out[-1]["stop"]:
                    out[-1]["stop"] = max(out[-1]["stop"], w["stop"])
                else:
                    out.append(w)
            spans.append(out)
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), batch.column("item_ids")], ["row_id", "spans", "item_ids"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document row: word spans (start, stop) that occur in benchmark items and the items they occur in.

    Columns: doc_id, n_words, spans (disjoint, ascending), item_ids (ascending).
    """
    rows, hits = _marked(docs, benchmark, ["doc_id"])
    spans = "array<struct<start:bigint,stop:bigint>>"
    ids = hits.schema["item_ids"].dataType.simpleString()
    found = hits.mapInArrow(_joined, f"row_id long, spans {spans}, item_ids {ids}")
    rows = rows.select("row_id", F.col("own.doc_id").alias("doc_id"), "n_words", (F.size("candidates") > 0).alias("some"))
    clean = rows.where("not some").select("doc_id", "n_words", F.array().cast(spans).alias("spans"), F.array().cast(ids).alias("item_ids"))
    hit = rows.where("some").join(found.hint("merge"), "row_id", "left")
    return clean.unionAll(hit.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(spans)), F.coalesce("item_ids", F.array().cast(ids))))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`contamination`."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; each row is judged by its own text, whatever its ``doc_id``."""
    rows, hits = _marked(docs, benchmark, docs.columns)
    some = rows.where(F.size("candidates") > 0).join(_side(hits.select("row_id"), hits.count()), "row_id", "left_anti")
    return rows.where(F.size("candidates") == 0).select("own.*").unionAll(some.select("own.*"))
