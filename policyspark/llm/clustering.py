"""Centroid clustering (Lloyd's rounds) by Shallot search.

Every vector, turned into whole numbers, remembers its nearest and its second-nearest centroid, an upper bound of its distance
to the one and a lower bound of its distance to every other but the nearest.  After the centroids have moved, the bounds move
with them, and a vector whose upper bound is below its lower bound keeps its centroid unseen.  The others are worked out
against the two that they remember and start from the closer one: its neighbours are scanned in the order of their distance
from it, and the scan ends where that distance exceeds the sum of the vector's distance to the start and to the second-best so
far, a ball that shrinks while better ones are found.  What survives is compared in whole numbers, so that ties go to the
smaller number and rounding decides nothing.

The vectors are Parquet rows of packed blocks with their bounds.  A round reads them, writes them with the new bounds and the
block's sums, and Spark adds the sums up; two folders take turns, so the disk holds two copies whatever the number of rounds.
Only the centroids, K times the dimension numbers, pass through the driver.

Defined results: vectors that are null, have another dimension, or a null or non-finite component take no part; every other
row does, on its own, also where ``vec_id`` is repeated or null; rows that can't be told apart by the hash of their ids are
ordered by their components for the first centroids, null ids last; fewer than K vectors give as many centroids; an empty table
has no rows.  Components are whole numbers of up to 2**27 either way, larger ones are held at that, which keeps all sums of
squares of a vector below 2**63; an inertia beyond that is null.  Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import shared_dir, stored

SCALE, DIMS, K, ROUNDS, SEED = 256, 64, 40, 5, 2
MOST = float(1 << 27)
#: Vectors of a block.
BLOCK_ROWS = 8_192
#: Bounds are widened by so much, relatively, beyond what rounding can do.
MARGIN = 1e-9
STATE = "ids binary, nulls binary, parts binary, nearest binary, second binary, upper binary, lower binary, distances binary, clusters binary, sums binary"


def vectors(df: DataFrame, scale: int = SCALE, dims: int = DIMS) -> DataFrame:
    """vec_id, parts (whole numbers) of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dims)).where(finite)
    whole = lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(MOST)), F.lit(-MOST))).cast("int")
    return own.select("vec_id", F.transform("x", whole).alias("parts"))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """Components of the ``k`` rows of :func:`vectors` with the smallest hashes of ``seed:vec_id``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.select(key.alias("key"), "parts").orderBy(F.asc_nulls_last("key"), "parts").limit(k).collect()
    return np.array([r.parts for r in found], np.int64)


class Centroids:
    """A round's centroids, with how far each has moved and its neighbours by distance."""

    def __init__(self, parts: np.ndarray, before: np.ndarray | None = None):
        self.parts, self.real = parts, parts.astype(np.float64)
        distance = np.sqrt(((self.real[:, None] - self.real[None]) ** 2).sum(axis=2))
        order = np.argsort(distance, axis=1, kind="stable")
        own = order != np.arange(len(parts))[:, None]  # without itself, which isn't always the first: copies
        self.neighbours = order[own].reshape(len(parts), -1)
        self.apart = np.take_along_axis(distance, self.neighbours, axis=1)
        self.moved = np.zeros(len(parts)) if before is None else np.sqrt(((self.real - before) ** 2).sum(axis=1)) * (1 + MARGIN)

    def squared(self, vectors: np.ndarray, to: np.ndarray | int) -> np.ndarray:
        """Exact squared distances of each vector to one centroid."""
        d = vectors - self.parts[to]
        return np.einsum("ij,ij->i", d, d)


def _nearest_two(vectors: np.ndarray, c: Centroids):
    """(nearest, second, squared distances to them) by looking at all centroids."""
    best, second = np.zeros(len(vectors), np.int64), np.full(len(vectors), -1, np.int64)
    d1, d2 = c.squared(vectors, 0), np.full(len(vectors), np.iinfo(np.int64).max)
    for j in range(1, len(c.parts)):
        _offer(np.arange(len(vectors)), j, c.squared(vectors, j), best, second, d1, d2)
    return best, second, d1, d2


def _offer(rows: np.ndarray, j: int, d: np.ndarray, best, second, d1, d2) -> None:
    """Takes centroid ``j`` at squared distances ``d`` for ``rows`` into their two nearest; equal distances go to the smaller number."""
    first = (d < d1[rows]) | (d == d1[rows]) & (j < best[rows])
    r = rows[first]
    second[r], d2[r] = best[r], d1[r]
    best[r], d1[r] = j, d[first]
    next_ = ~first & ((d < d2[rows]) | (d == d2[rows]) & (j < second[rows]))
    r = rows[next_]
    second[r], d2[r] = j, d[next_]


def shallot(vectors: np.ndarray, c: Centroids, nearest: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray):
    """Assigns the vectors anew; returns (nearest, second, upper, lower, number of distances worked out)."""
    nearest, second = nearest.copy(), second.copy()
    if len(c.parts) == 1:
        return nearest, second, np.sqrt(c.squared(vectors, nearest)), np.full(len(vectors), np.inf), len(vectors)
    upper = upper + c.moved[nearest]
    # every centroid but the nearest may have come closer by the farthest move among them
    order = np.argsort(-c.moved, kind="stable")
    lower = lower - np.where(nearest == order[0], c.moved[order[1]], c.moved[order[0]])
    open_ = np.flatnonzero(~(upper * (1 + MARGIN) < lower * (1 - MARGIN)))
    worked = 2 * len(open_)
    v = vectors[open_]
    d1, d2 = c.squared(v, nearest[open_]), c.squared(v, second[open_])
    n, s = nearest[open_], second[open_]
    swap = (d2 < d1) | (d2 == d1) & (s < n)  # start from the closer one
    n, s = np.where(swap, s, n), np.where(swap, n, s)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, reach = n.copy(), np.sqrt(d1.astype(np.float64))
    other = s.copy()
    by_start = np.argsort(start, kind="stable")
    ends = np.searchsorted(start[by_start], np.arange(len(c.parts) + 1))
    for centre in range(len(c.parts)):
        rows = by_start[ends[centre] : ends[centre + 1]]
        for j, apart in zip(c.neighbours[centre].tolist(), c.apart[centre].tolist(), strict=True):
            # by the triangle inequality a centroid so far from the start is no nearer than the second-best
            rows = rows[apart * (1 - MARGIN) <= (reach[rows] + np.sqrt(d2[rows].astype(np.float64))) * (1 + MARGIN)]
            if not len(rows):
                break
            fresh = rows[other[rows] != j]
            worked += len(fresh)
            _offer(fresh, j, c.squared(v[fresh], j), n, s, d1, d2)
    nearest[open_], second[open_] = n, s
    upper[open_], lower[open_] = np.sqrt(d1.astype(np.float64)), np.sqrt(d2.astype(np.float64))
    return nearest, second, upper, lower, worked


def _begun(batches):
    """Rows (vec_id, parts) to blocks without state."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            piece = batch.slice(start, BLOCK_ROWS)
            ids, parts = piece.column("vec_id"), piece.column("parts").flatten().to_numpy()
            kind = np.int16 if np.abs(parts).max(initial=0) < 1 << 15 else np.int32
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            own = [ids.fill_null(0).to_numpy().tobytes(), nulls.tobytes(), parts.astype(kind).tobytes(), *[b""] * 7]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], [c.split()[0] for c in STATE.split(", ")])


def _round(c: Centroids, batches):
    """Blocks with the state of the round before (none at first) to blocks with this round's, and the sums of its clusters."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, dims = np.frombuffer(row["ids"], np.int64), c.parts.shape[1]
            parts = np.frombuffer(row["parts"], np.int16 if len(row["parts"]) == 2 * dims * len(ids) else np.int32).reshape(-1, dims).astype(np.int64)
            if row["nearest"]:
                kept = [np.frombuffer(row[n], t) for n, t in (("nearest", np.int32), ("second", np.int32), ("upper", np.float64), ("lower", np.float64))]
                nearest, second, upper, lower, _ = shallot(parts, c, kept[0].astype(np.int64), kept[1].astype(np.int64), kept[2].copy(), kept[3].copy())
            else:
                nearest, second, d1, d2 = _nearest_two(parts, c)
                upper, lower = np.sqrt(d1.astype(np.float64)), np.where(second < 0, np.inf, np.sqrt(d2.astype(np.float64)))
            held = np.unique(nearest)
            order = np.argsort(nearest, kind="stable")
            first = np.searchsorted(nearest[order], held)
            sums = np.add.reduceat(parts[order], first, axis=0)
            counts = np.diff(np.append(first, len(order)))
            out = [row["ids"], row["nulls"], row["parts"], nearest.astype(np.int32).tobytes(), second.astype(np.int32).tobytes(), upper.tobytes(), lower.tobytes(), c.squared(parts, nearest).tobytes()]
            out += [held.astype(np.int32).tobytes(), np.column_stack([counts, sums]).astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in out], [n.split()[0] for n in STATE.split(", ")])


def _totals(batches):
    """Sums of the blocks of a task by cluster and place (place 0: how many vectors), a row for each."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            clusters = np.frombuffer(row["clusters"], np.int32)
            for k, s in zip(clusters.tolist(), np.frombuffer(row["sums"], np.int64).reshape(len(clusters), -1), strict=True):
                total[k] = total.get(k, 0) + s
    for k, s in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)], ["cluster", "place", "total"])


def _unpacked(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(row["nearest"], np.int32)), pa.array(np.frombuffer(row["distances"], np.int64))], ["vec_id", "cluster", "distance"])


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance (squared) of every vector of ``df`` (vec_id, embedding) after ``rounds`` rounds, the centroids)"""
    spark = df.sparkSession
    rows = vectors(df, scale, dims)
    parts = first_centroids(rows, k, seed)
    if not len(parts):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), parts
    blocks = stored(rows.mapInArrow(_begun, STATE))
    folders = [shared_dir(spark), shared_dir(spark)]
    before = None
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast(Centroids(parts, before))
        blocks.mapInArrow(lambda batches, shared=shared: _round(shared.value, batches), STATE).write.mode("overwrite").parquet(folders[r % 2])
        blocks = spark.read.schema(blocks.schema).parquet(folders[r % 2])
        if r == rounds:
            break
        # K * (dims + 1) rows
        total = blocks.select("clusters", "sums").mapInArrow(_totals, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
        sums = np.zeros((len(parts), dims + 1), np.int64)
        for t in total:
            sums[t.cluster, t.place] = t.total
        before, filled = parts.astype(np.float64), sums[:, 0] > 0
        parts = parts.copy()
        parts[filled] = sums[filled, 1:] // sums[filled, :1]  # rounds down, below zero too
    return blocks.select("ids", "nulls", "nearest", "distances").mapInArrow(_unpacked, "vec_id long, cluster int, distance long"), parts


def digest(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The contract's columns from :func:`cluster`."""
    spark = found.sparkSession
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    known = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    of_cluster = found.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))  # K rows at most
    inertia = of_cluster.agg(F.try_sum("cluster_inertia").alias("inertia")).first().inertia
    facts = F.broadcast(of_cluster.join(F.broadcast(known), "cluster"))
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")
