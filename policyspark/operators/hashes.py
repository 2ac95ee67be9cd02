"""Neighbours of perceptual hashes and of embeddings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import hamming
from .neighbours import met, ranked, units

BITS, BANDS, RADIUS = 64, 4, 10
#: Queries, and rows they are held against, of a task's product.
BLOCK, BASE_BLOCK = 4_096, 16_384


def bands(h: Column, n: int) -> Column:
    """n bands of a 64-bit hash, as even as they get: array of (band, value)."""
    edges = [BITS * i // n for i in range(n + 1)]
    one = lambda a, b: F.call_function("shiftrightunsigned", h, F.lit(a)).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
    return F.array(*[F.struct(F.lit(i).alias("band"), one(a, b).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def nearest_hash(queries: DataFrame, stored: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per query (id, hash): the closest stored (label, hash) within ``radius`` bits, ties by label.

    Pigeonhole: of BANDS bands, two hashes that differ in at most ``radius`` bits differ in radius / BANDS at most in one.  A
    query looks for all values so near in each band of 16 bits (137 for 10 bits), a stored hash is there once a band.
    """
    width, near = BITS // BANDS, radius // BANDS
    masks = [sum(1 << b for b in bits) for n in range(near + 1) for bits in combinations(range(width), n)]
    q = queries.select("hash").distinct().select("hash", F.explode(bands(F.col("hash"), BANDS)).alias("b"))
    q = q.select("hash", "b.band", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"), "b.value").select("hash", "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    s = stored.groupBy(F.col("hash").alias("other")).agg(F.min("label").alias("label")).select("other", "label", F.explode(bands(F.col("other"), BANDS)).alias("b")).select("other", "label", "b.*")
    hit = q.join(s.hint("merge"), ["band", "value"]).withColumn("distance", hamming(F.col("hash"), F.col("other"))).where(F.col("distance") <= radius)
    best = hit.groupBy("hash").agg(F.min(F.struct("distance", "label")).alias("m"))
    return queries.join(best.hint("merge"), "hash", "left").select("id", F.col("m.label").alias("label"), F.col("m.distance").alias("distance"))


def nearest_vectors(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """Per query (id, vector): the k most cosine-similar rows of ``base`` (id, vector), exactly: query_id, neighbour_id, similarity, rank.

    The query set is dealt into blocks of about BLOCK.  Each meets each of the base's, of about BASE_BLOCK rows, in a task by one product
    of matrices, of which only rows that may be among the k best of that pair of blocks come out.  Pairs grow with the product of
    both sides.  Vectors that are null, hold a null, or have no length have no neighbours and are none.
    """
    q, b = units(queries), units(base)
    n, m = (max(1, -(-df.count() // size)) for df, size in ((queries, BLOCK), (base, BASE_BLOCK)))
    dealt = lambda size: F.pmod(F.xxhash64("id"), F.lit(size)).cast("int")  # noqa: E731  of the sequence's type: cogroup casts no keys, and equal ones of two types go to different partitions
    # both sides are read once and copied to the blocks of the other
    mine = q.select(F.col("id").alias("query_id"), F.col("unit").alias("q"), F.lit(-2.0).alias("floor"), dealt(n).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("bb"))
    rows = b.select("id", "unit", dealt(m).alias("bb"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("qb"))
    pairs = mine.groupBy("qb", "bb").cogroup(rows.groupBy("qb", "bb")).applyInArrow(met(k), "query_id long, neighbour_id long, raw double")
    return ranked(pairs, k)
