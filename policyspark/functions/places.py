"""Places of very many strings in texts.

Windows of a text are hashed and held against a bitmap of the strings' hashes, so that only places become rows at which one of them
is likely to stand; a join with the strings decides.  A worker holds the Arrow batch that it has been sent; all else is worked out
for CHUNK characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Bitmap: so many bits for each string (three of them set, and three for what a longer one begins with), from 2**LEAST_BITS to 2**MOST_BITS (8 MB).  Characters of longer strings that are looked
#: at first, and characters of a batch that are at once.
BITS_EACH, LEAST_BITS, MOST_BITS, SEED, CHUNK = 32, 16, 26, 8, 1 << 17
SPAN = "array<struct<start:int,stop:int,gram:string>>"
_FOUND = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("gram", pa.string())])
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE and of its inverse."""
    power = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]))
    return power(_BASE), power(_BACK)


class _Hashes:
    """Hashes of the windows of an array of code points."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(1 << len(codes).bit_length())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up[: len(codes)], dtype=np.uint64)])

    def mixed(self, at: np.ndarray, n: int, mark: int) -> np.ndarray:
        h = (self.sums[at + n] - self.sums[at]) * self.down[at] + np.uint64(mark)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _slot(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th of a hash's three bits."""
    h = h >> np.uint64((3, 32)[i]) if i < 2 else (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)
    return h.astype(np.int64) & ((1 << bits) - 1)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


class Known:
    """Bitmap and lengths of the strings."""

    def __init__(self, bits: int, buckets: dict[int, bytes], lengths: list[int]):
        self.bits, self.lengths = bits, lengths
        self.map = np.zeros(max(1 << bits >> 3, 4096), dtype=np.uint8)
        for b, m in buckets.items():
            self.map[b * 4096 : b * 4096 + len(m)] = np.frombuffer(m, np.uint8)

    def held(self, hashes: _Hashes, at: np.ndarray, n: int, mark: int) -> np.ndarray:
        """Those of the places whose n characters may be (of mark 0: begin) a string."""
        h = hashes.mixed(at, n, mark)
        for i in range(3):
            slot = _slot(h, i, self.bits)
            kept = (self.map[slot >> 3] >> (slot & 7).astype(np.uint8) & 1) > 0
            at, h = at[kept], h[kept]
        return at

    def spans(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, lengths) among the places ``first`` at which strings may stand, in order of length."""
        hashes, out = _Hashes(codes), [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        long = None
        for n in self.lengths:
            if n > SEED and long is None:
                long = self.held(hashes, first[first + SEED <= len(codes)], SEED, 0)
            at = first if long is None else long
            at = self.held(hashes, at[at + n <= len(codes)], n, n)
            out[0].append(at)
            out[1].append(np.full(len(at), n))
        return np.concatenate(out[0]), np.concatenate(out[1])


def _slots(texts: list[str], bits: int) -> pa.Array:
    """The bits of each string: of all of it, and of what a longer one begins with."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at, hashes = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)[:-1]]), _Hashes(_codes(texts))
    full = np.empty(len(texts), np.uint64)
    for size in np.unique(sizes):
        full[sizes == size] = hashes.mixed(at[sizes == size], int(size), int(size))
    both = np.concatenate([full, hashes.mixed(at[sizes > SEED], SEED, 0)])
    owner = np.concatenate([np.arange(len(texts)), np.flatnonzero(sizes > SEED)])
    order = np.argsort(owner, kind="stable")
    each = np.stack([_slot(both[order], i, bits) for i in range(3)], axis=1).ravel()
    ends = np.cumsum(3 + 3 * (sizes > SEED))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(each))


def known(keys: DataFrame, n: int, edge: str = "") -> Known:
    """Of the distinct ``key`` of ``keys``, about ``n``, with ``edge`` on both sides of each."""
    bits = min(max(LEAST_BITS, (BITS_EACH * n).bit_length()), MOST_BITS)

    @F.arrow_udf("array<bigint>")
    def slots(column: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(pa.int64())), *(_slots(texts, bits) for _, texts in _parts(column))])

    own = keys.select(F.concat(F.lit(edge), "key", F.lit(edge)).alias("key")).distinct()
    lengths = own.agg(F.collect_set(F.length("key"))).first()[0]  # a number a length
    bit = own.select(F.explode(slots("key")).alias("bit"))
    # 4 KB for each 2**15 bits
    buckets = bit.groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("m")).collect()
    return Known(bits, {r.b: bytes(r.m) for r in buckets}, sorted(lengths))


def places(text: Column, shared, edge: str = "") -> Column:
    """(start, stop, gram) of the places of a text at which one of the strings of ``shared`` (:class:`Known`, broadcast) may stand.

    With an ``edge``, a character that separates tokens, only whole tokens are looked at, and start and stop count them.
    """

    @F.arrow_udf(SPAN)
    def found(column: pa.Array) -> pa.Array:
        spans, counts = [pa.array([], _FOUND)], np.zeros(len(column), np.int64)
        for at, run in _parts(column):
            for owner, start, stop, grams in _found(run, shared.value, edge):
                spans.append(pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(grams, pa.string())], fields=list(_FOUND)))
                counts[at : at + len(run)] += np.bincount(owner, minlength=len(run))
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(spans))

    return found(text)


def keys_placed(texts: DataFrame, shared: dict[str, tuple]) -> DataFrame:
    """doc_id, form, kind, key: the strings that may stand in each text, each once, as rows that leave a worker piece by piece.

    ``texts``: doc_id, form and a column of each kind's texts; ``shared``: kind to (broadcast :class:`Known`, edge), see :func:`places`.
    """
    schema = T.StructType([texts.schema["doc_id"], *[T.StructField(c, T.StringType()) for c in ("form", "kind", "key")]])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, (mine, edge) in shared.items():
                for at, run in _parts(batch.column(kind)):
                    seen: set[tuple[int, str]] = set()
                    for owner, _, _, grams in _found(run, mine.value, edge):
                        new = set(zip(owner.tolist(), grams, strict=True)) - seen
                        seen |= new
                        rows = pa.array([at + o for o, _ in new], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("form").take(rows), pa.array([kind] * len(new), pa.string()), pa.array([g for _, g in new], pa.string())], schema.names)

    return texts.mapInArrow(found, schema)


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch, a null one as empty, in runs of about CHUNK bytes; a longer text is a run of its own."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHUNK, side="right")))
        yield start, [t or "" for t in column.slice(start, stop - start).to_pylist()]
        start = stop


def _found(texts: list[str], mine: Known, edge: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(text, start, stop, gram) of the places, CHUNK characters after CHUNK characters."""
    texts = [edge + t + edge if t else "" for t in texts]
    every, k, longest = "".join(texts), len(edge), max(mine.lengths, default=0)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = np.concatenate([np.zeros(1, np.int64), ends])
    if edge:  # edges before each text, and before the piece
        edges, before = np.concatenate([np.zeros(1, np.int64), np.cumsum([t.count(edge) for t in texts], dtype=np.int64)]), 0
    for start in range(0, len(every), CHUNK):
        codes = _codes([every[start : start + CHUNK + longest]])
        inside = min(CHUNK, len(codes))
        marks = np.flatnonzero(codes == ord(edge)) if edge else None
        at, size = mine.spans(codes, np.arange(inside) if marks is None else marks[marks < inside])
        owner = np.searchsorted(ends, at + start, side="right")
        whole = at + start + size <= ends[owner]
        if edge:
            whole &= codes[at + size - 1] == ord(edge)
        at, size, owner = at[whole], size[whole], owner[whole]
        order = np.argsort(owner, kind="stable")
        at, size, owner = at[order], size[order], owner[order]
        grams = [every[a + k : b - k] for a, b in zip((at + start).tolist(), (at + start + size).tolist(), strict=True)]
        if edge:
            first, last = (before + np.searchsorted(marks, x) - edges[owner] for x in (at, at + size - 1))
            before += int(np.searchsorted(marks, inside))
        else:
            first, last = (at + start + x - begins[owner] for x in (0, size))
        yield owner, first, last, grams
