"""Planned in the reference: nearest neighbours of embeddings by an index with exact bounds, and a user's own labels over them.

Centres are a bounded sample of the vectors; every vector belongs to its nearest centre's cell.  On unit vectors the triangle
inequality bounds how near a cell can be to a query: a cell is looked at only if its centre's distance less its radius is at most
the query's k-th distance so far, which its own cell gives first.  Nothing is missed, so recall is 1; how much is compared depends
on how the vectors cluster, and :func:`share_compared` tells it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.joins import side
from ..functions.tables import stored

#: Centres, and rows of a cell that one task holds: a fuller cell is cut into such blocks.
CENTRES, BLOCK_ROWS = 256, 32_768
#: Similarities are ranked to 6 decimals: what is nearer than this to the k-th may be among the best.
TIE = 2e-6
ROW = "id long, unit array<double>"


def units(vectors: DataFrame) -> DataFrame:
    """id, unit of ``vectors`` (id, vector); null vectors, those with nulls and zero vectors have no direction and take no part."""
    v = vectors.select(F.col("id").cast("long").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return v.withColumn("norm", norm).where("norm > 0").select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


@dataclass
class Index:
    centres: np.ndarray
    rows: DataFrame  # cell, block, id, unit, far (distance from the centre)
    cells: DataFrame  # cell, radius, n, blocks


def fit(vectors: DataFrame, centres: int = CENTRES) -> Index:
    """The index of all ``vectors`` (id, vector); centres are the ``centres`` vectors of the smallest hashes of their ids."""
    own = units(vectors)
    found = own.orderBy(F.xxhash64("id"), "id").limit(centres).collect()
    c = np.array([r.unit for r in found])
    shared = vectors.sparkSession.sparkContext.broadcast(c)  # CENTRES vectors

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column("unit")), shared.value)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), batch.column("unit"), pa.array(d[np.arange(len(d)), cell])], ["cell", "id", "unit", "far"])

    rows = stored(own.mapInArrow(assigned, f"cell int, {ROW}, far double"))
    cells = stored(rows.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK_ROWS).cast("int")))
    dealt = rows.join(F.broadcast(cells.select("cell", "blocks")), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))  # a row a centre
    return Index(c, dealt.select("cell", "block", "id", "unit", "far"), cells)


def _asked(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, q, cell, to_centre for every query and centre."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centres)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column("unit")), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("unit"), lists], ["query_id", "q", "to"])

    return stored(units(queries).mapInArrow(measured, "query_id long, q array<double>, to array<double>"))


def met(k: int):
    def best(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and rows.num_rows:
            x, ids = _matrix(rows.column("unit").combine_chunks()), rows.column("id").to_numpy()
            for start in range(0, queries.num_rows, 256):
                piece = queries.slice(start, 256)
                q, own = _matrix(piece.column("q").combine_chunks()), piece.column("query_id").to_numpy()
                s = np.where(ids[None] == own[:, None], -np.inf, q @ x.T)
                floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                floor = np.maximum(floor, piece.column("floor").to_numpy()) - TIE
                i, j = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
                for o, v in zip(out, (own[i], ids[j], s[i, j]), strict=True):
                    o.append(v)
        join = lambda o, t: np.concatenate(o) if o else np.zeros(0, t)
        return pa.table({"query_id": join(out[0], np.int64), "neighbour_id": join(out[1], np.int64), "raw": join(out[2], np.float64)})

    return best


def _searched(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """``asked``: query_id, q, floor (similarity that is reached already), cell."""
    spread = asked.join(F.broadcast(index.cells.select("cell", "blocks")), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread.groupBy("cell", "block").cogroup(index.rows.groupBy("cell", "block")).applyInArrow(met(k), "query_id long, neighbour_id long, raw double")
    # ties to 6 decimals are kept for the ranking
    return pairs


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    r = pairs.select("query_id", "neighbour_id", F.round("raw", 6).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return r.withColumn("rank", rank).where(F.col("rank") <= k)


def _wanted(queries: DataFrame, index: Index, k: int) -> tuple[DataFrame, DataFrame]:
    """(first: each query with its own cell; then: with the other cells that may hold one of its k best)"""
    asked = _asked(queries, index)
    near = F.array_position("to", F.array_min("to")).cast("int") - 1
    first = asked.select("query_id", "q", near.alias("cell"), F.lit(-2.0).alias("floor"))
    found = stored(_searched(first, index, k))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "neighbour_id"))
    kth = found.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("raw").alias("floor"))
    known = asked.join(kth.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))).withColumn("near", near)
    each = known.select("query_id", "q", "floor", "near", F.posexplode("to").alias("cell", "to"))
    reach = F.sqrt(F.greatest(2 - 2 * F.col("floor"), F.lit(0.0))) + 1e-6
    then = each.where("cell <> near").join(F.broadcast(index.cells), "cell").where(F.col("to") - F.col("radius") <= reach)
    return found, then.select("query_id", "q", "cell", "floor", "n")


def nearest(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """query_id, neighbour_id, similarity (cosine to 6 decimals), rank: each query's (id, vector) ``k`` best but itself, exactly."""
    if not len(index.centres):
        return ranked(queries.sparkSession.createDataFrame([], "query_id long, neighbour_id long, raw double"), k)
    found, then = _wanted(queries, index, k)
    return ranked(found.unionAll(_searched(then.drop("n"), index, k)), k)


def share_compared(queries: DataFrame, index: Index, k: int) -> float:
    """Share of all pairs of a query and a row that the search compares."""
    _, then = _wanted(queries, index, k)
    own = _asked(queries, index).select((F.array_position("to", F.array_min("to")).cast("int") - 1).alias("cell")).join(F.broadcast(index.cells), "cell").agg(F.sum("n")).first()[0] or 0
    more = then.agg(F.sum("n")).first()[0] or 0
    n, q = index.rows.count(), units(queries).count()
    return (own + more) / max(n * q, 1)


def voted(neighbours: DataFrame, labels: DataFrame, overrides: DataFrame, askers: DataFrame) -> DataFrame:
    """query_id, user_id, label, votes: the commonest label of a query's neighbours (the smallest of equals) for the user who asks.

    ``labels``: id, label of all; ``overrides``: user_id, id, label, which count for that user in place of them; ``askers``: query_id,
    user_id.  Neighbours without a label have no vote.
    """
    n = neighbours.join(askers.hint("merge"), "query_id").join(labels.select(F.col("id").alias("neighbour_id"), F.col("label").alias("common")).hint("merge"), "neighbour_id", "left")
    mine = overrides.select("user_id", F.col("id").alias("neighbour_id"), F.col("label").alias("own"))
    v = n.join(side(mine), ["user_id", "neighbour_id"], "left").withColumn("label", F.coalesce("own", "common")).where("label is not null")
    c = v.groupBy("query_id", "user_id", "label").agg(F.count("*").alias("votes"))
    best = c.groupBy("query_id", "user_id").agg(F.min(F.struct((-F.col("votes")).alias("less"), "label")).alias("b"))
    return best.select("query_id", "user_id", F.col("b.label").alias("label"), (-F.col("b.less")).alias("votes"))
