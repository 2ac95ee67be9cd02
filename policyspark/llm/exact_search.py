"""Exact top-k by inner product: vectors in buckets of like length, pruned by length or by coordinates, then verified.

1. Every component x becomes floor(SCALE * x), a whole number held exactly in a double.  The vectors are dealt by ranges of
   length, longest first, and packed into blocks of at most BLOCK_ROWS; a group is at most GROUP_ROWS of one range.
2. A query's k-th best score among a seed of at most 2 * SEED_ROWS vectors (the longest ones, and some drawn by a hash) bounds
   its k-th best of all from below.  A group of queries meets a group of vectors only if the longest of them may reach a bound.
3. Within such a cell the blocks are taken longest first.  A bound over the lengths of query and bucket is the local cosine
   threshold t: above 1 the bucket is passed over; from COORDINATES on, the coordinates in which the unit query is largest
   confine the candidates (a unit vector at cosine t or more from q has its coordinate f within
   ``q_f t -+ sqrt((1 - t^2)(1 - q_f^2))``), found in the sorted coordinates of the bucket; else the vectors of length
   bound / |q| at least, a prefix of the bucket, are the candidates.  Products of the candidates are worked out exactly and the
   bound rises with what is found.
4. The k best of each cell are ranked by query.

Pruning is by floating-point bounds with a margin; scores and comparisons are whole numbers.  Ties at a bound are kept.

Defined results: null vectors, vectors with a null or non-finite component and rows without a vec_id take no part; vectors of
different dimension are multiplied over their common places, and the empty vector has score 0 with all; every row is a
candidate of its own, so a repeated row is found as often as it is there, but never under a query's own vec_id; rows of a
repeated query id put their candidates together, ranked once; a score beyond 64 bits is the nearest long; an empty table has
no rows.  Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ._store import stored

SCALE, BEST = 1024, 10
#: Vectors of a block and of a group, components of a block and of a group, queries of a block and of a group: at most.
BLOCK_ROWS, GROUP_ROWS, BLOCK_SIZE, GROUP_SIZE = 4_096, 65_536, 1 << 19, 1 << 23
QUERY_ROWS, QUERY_GROUP = 256, 16_384
SEED_ROWS = 1_024
#: Local cosine from which coordinates prune, and the number of them that is looked at.
COORDINATES, FOCUS = 0.8, 4
MARGIN = 1e-9
_LONG = 2.0**63
PACKED = "g long, n int, dims int, longest double, ids binary, lengths binary, parts binary, bounds binary"


def vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, parts (whole numbers as doubles), length of the rows that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(finite, F.lit(False)))
    # floor() of a double is a long in Spark, which large components don't fit: take the remainder off instead
    whole = lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(F.greatest(F.least(v, F.lit(1e300)), F.lit(-1e300)) * scale)
    parts = own.select("vec_id", F.transform("x", whole).alias("parts"))
    return parts.select("vec_id", "parts", F.sqrt(F.aggregate("parts", F.lit(0.0), lambda a, v: a + v * v)).alias("length"))


def _matrix(parts: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as rows, shorter ones filled up with zeros."""
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims))
    if len(sizes):
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row, place] = parts.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(block_rows: int, group_rows: int, batches):
    """Rows (vec_id, parts, length, bound) in order to blocks; whole numbers that fit are held as 16 or 32 bits."""
    group, block, held, held_size, dims = 0, [], 0, 0, 0

    def pack(rows: pa.Table, dims: int):
        m = _matrix(rows.column("parts").combine_chunks(), dims)
        most = np.abs(m).max(initial=0)
        kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64
        length = rows.column("length").to_numpy()
        g = (TaskContext.get().partitionId() << 32) + group
        return [g, rows.num_rows, dims, float(length.max(initial=0)), rows.column("vec_id").to_numpy().tobytes(), length.tobytes(), m.astype(kind).tobytes(), rows.column("bound").to_numpy().tobytes()]

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in PACKED.split(", ")]
    made = lambda row: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
    n = 0
    for batch in batches:
        sizes, start = pc.list_value_length(batch.column("parts")).to_numpy(zero_copy_only=False), 0
        for i, size in enumerate(sizes.tolist()):
            wide = max(dims, size)
            if n + i - start and (n + i - start >= block_rows or (n + i - start + 1) * wide > BLOCK_SIZE):
                rows = pa.Table.from_batches([*block, batch.slice(start, i - start)])
                yield made(pack(rows, dims))
                held, held_size = held + rows.num_rows, held_size + rows.num_rows * max(dims, 1)
                if held + block_rows > group_rows or held_size + BLOCK_SIZE > GROUP_SIZE:
                    group, held, held_size = group + 1, 0, 0
                block, n, start, wide = [], 0, i, size
            dims = wide
        block.append(batch.slice(start))
        n += batch.num_rows - start
    if n:
        yield made(pack(pa.Table.from_batches(block), dims))


def _blocks(rows: DataFrame, by: Column, many: int, parts: int, block_rows: int, group_rows: int) -> DataFrame:
    """Blocks of ``rows`` (``many`` of them) by descending ``by``, in ``parts`` ranges at least; rows alike are dealt by number."""
    parts = max(parts, -(-many // group_rows), 1)
    numbered = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("by", by)
    dealt = numbered.repartitionByRange(parts, F.desc("by"), "row").sortWithinPartitions(F.desc("by"), "vec_id").select("vec_id", "parts", "length", "bound")
    return stored(dealt.mapInArrow(lambda batches: _packed(block_rows, group_rows, batches), PACKED))


class Block:
    """A packed block, longest vectors first; coordinates are sorted when they are first asked for."""

    def __init__(self, row: dict):
        n, dims = row["n"], row["dims"]
        kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(row["parts"]) // (n * dims) if dims else 8]
        self.parts = np.frombuffer(row["parts"], kind).reshape(n, dims).astype(np.float64)
        self.ids, self.lengths, self.bounds = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lengths"]), np.frombuffer(row["bounds"])
        self.longest, self.most = row["longest"], np.abs(self.parts).max(initial=0)
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def near(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Rows that may be at ``cosine`` or more from the unit query, by its largest coordinates."""
        dims = self.parts.shape[1]
        focus = np.argsort(-np.abs(unit[:dims]), kind="stable")[:FOCUS]
        best, spans = None, []
        for f in focus.tolist():
            if f not in self._sorted:
                c = np.divide(self.parts[:, f], self.lengths, out=np.zeros(len(self.ids)), where=self.lengths > 0)
                order = np.argsort(c, kind="stable")
                self._sorted[f] = c[order], order
            values, order = self._sorted[f]
            reach = np.sqrt(max(1 - cosine * cosine, 0) * max(1 - unit[f] ** 2, 0))
            # beyond the query's own coordinate a larger one is allowed for as far as the arc reaches, a pole lies within it
            low = -1.0 if unit[f] <= -cosine else unit[f] * cosine - reach
            high = 1.0 if unit[f] >= cosine else unit[f] * cosine + reach
            a, b = np.searchsorted(values, low - MARGIN, side="left"), np.searchsorted(values, high + MARGIN, side="right")
            spans.append((f, low - MARGIN, high + MARGIN))
            if best is None or b - a < len(best):
                best = order[a:b]
        if best is None:
            return np.arange(len(self.ids))
        for f, low, high in spans:
            c = self.parts[best, f] / np.maximum(self.lengths[best], 1e-300)
            best = best[(c >= low) & (c <= high)]
        return best


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products as longs, row by column; what is beyond 64 bits is the nearest long."""
    dims = min(queries.shape[1], vectors.shape[1])
    a, b = queries[:, :dims], vectors[:, :dims]
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dims, 1)
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if most < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.frompyfunc(int, 1, 1)
    wide = np.dot(exact(a).reshape(a.shape), exact(b).reshape(b.shape).T)
    return np.array([[min(max(v, -(1 << 63)), (1 << 63) - 1) for v in r] for r in wide.tolist()], np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, queries: Block, k: int):
        self.q, self.k = queries, k
        self.at = self.score = self.id = np.zeros(0, np.int64)
        #: a score below the floor can't be among the k best; the floor is the k-th best so far
        self.floor = np.where(np.isfinite(queries.bounds), queries.bounds, -np.inf)
        self.worst = np.full(len(queries.ids), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        keep = (score > self.floor[at]) | (score == self.floor[at]) & (ids <= self.worst[at])
        keep &= ids != self.q.ids[at]
        at, score, ids = np.append(self.at, at[keep]), np.append(self.score, score[keep]), np.append(self.id, ids[keep])
        order = np.lexsort((ids, ~score, at))  # ~score falls as score rises, and never overflows
        at, score, ids = at[order], score[order], ids[order]
        place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        some = place < self.k
        self.at, self.score, self.id, place = at[some], score[some], ids[some], place[some]
        full = place == self.k - 1
        # scores of up to 2**53 are held exactly; beyond, one step down keeps the floor a lower bound
        value = self.score[full].astype(np.float64)
        big = np.abs(value) >= 2.0**53
        self.floor[self.at[full]] = np.maximum(self.floor[self.at[full]], np.where(big, np.nextafter(value, -np.inf), value))
        self.worst[self.at[full]] = np.where(big, np.iinfo(np.int64).max, self.id[full])

    def look(self, block: Block) -> None:
        """Adds what the block has."""
        reach = self.q.lengths * block.longest
        live = ~(self.floor > reach * (1 + MARGIN) + MARGIN)
        cosine = np.divide(self.floor, reach, out=np.full(len(reach), -np.inf), where=(reach > 0) & np.isfinite(self.floor))
        narrow = live & (cosine >= COORDINATES)
        for i in np.flatnonzero(narrow).tolist():
            rows = block.near(self.q.parts[i] / self.q.lengths[i], min(float(cosine[i]) * (1 - MARGIN), 1.0))
            if len(rows):
                self.add(np.full(len(rows), i), _products(self.q.parts[i : i + 1], block.parts[rows])[0], block.ids[rows])
        wide = np.flatnonzero(live & ~narrow)
        if not len(wide):
            return
        # lengths fall: vectors shorter than bound / |q| are a suffix
        least = np.divide(self.floor[wide], self.q.lengths[wide], out=np.full(len(wide), -np.inf), where=(self.q.lengths[wide] > 0) & np.isfinite(self.floor[wide]))
        rows = int(np.searchsorted(-block.lengths, -(least.min() * (1 - MARGIN) - MARGIN), side="right"))
        score = _products(self.q.parts[wide], block.parts[:rows])
        q, v = np.nonzero(score >= self.floor[wide][:, None])
        self.add(wide[q], score[q, v], block.ids[v])


def _cell(k: int):
    def found(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = sorted(blocks.drop_columns(["cell"]).to_pylist(), key=lambda r: -r["longest"])
        bests = [Best(Block(q), k) for q in queries.drop_columns(["cell"]).to_pylist()]
        for row in blocks:  # one block at a time is unpacked
            block = Block(row)
            for b in bests:
                b.look(block)
        join = lambda of: np.concatenate([of(b) for b in bests] or [np.zeros(0, np.int64)])
        return pa.table({"query_id": join(lambda b: b.q.ids[b.at]), "vec_id": join(lambda b: b.id), "score": join(lambda b: b.score)})

    return found


def _seeded(k: int, seed: list[dict], batches):
    """Rows (vec_id, parts, length, bound) with ``bound`` raised to the k-th best score among the seed's vectors."""
    seeds = [Block(r) for r in seed]
    for batch in batches:
        for start in range(0, batch.num_rows, QUERY_ROWS):
            piece = batch.slice(start, QUERY_ROWS)
            parts = piece.column("parts")
            own = piece.column("vec_id").to_numpy()
            m = _matrix(parts, max(pc.max(pc.list_value_length(parts)).as_py() or 0, 1))
            score = np.concatenate([np.where(s.ids == own[:, None], np.iinfo(np.int64).min, _products(m, s.parts)) for s in seeds] or [np.zeros((len(own), 0), np.int64)], axis=1)
            bound = np.full(len(own), -np.inf)
            if score.shape[1] >= k:
                kth = np.partition(score, -k, axis=1)[:, -k]
                # a query's own rows don't count; a float above 2**53 is stepped down
                value = np.where(np.abs(kth.astype(np.float64)) >= 2.0**53, np.nextafter(kth.astype(np.float64), -np.inf), kth.astype(np.float64))
                bound = np.where(kth == np.iinfo(np.int64).min, -np.inf, value)
            yield pa.RecordBatch.from_arrays([piece.column("vec_id"), parts, piece.column("length"), pa.array(bound)], ["vec_id", "parts", "length", "bound"])


def search(df: DataFrame, queries: DataFrame | None = None, k: int = BEST, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of ``df`` (vec_id, embedding) with the highest products with each of
    ``queries`` (the same columns; by default the rows of ``df`` whose id is divisible by 100), equal scores by ascending vec_id.
    """
    spark = df.sparkSession
    bounded = lambda rows: rows.withColumn("bound", F.lit(float("-inf")))
    all_rows = bounded(vectors(df, scale))
    asked = all_rows.where("vec_id % 100 = 0") if queries is None else bounded(vectors(queries, scale))
    width = spark.sparkContext.defaultParallelism
    blocks = _blocks(all_rows, F.col("length"), all_rows.count(), 4 * width, BLOCK_ROWS, GROUP_ROWS)
    # the seed: the longest vectors, and as many by a hash
    some = all_rows.orderBy(F.desc("length"), "vec_id").limit(SEED_ROWS).unionAll(all_rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS)).distinct()
    packed = some.coalesce(1).sortWithinPartitions(F.desc("length")).mapInArrow(lambda batches: _packed(BLOCK_ROWS, GROUP_ROWS, batches), PACKED)
    seed = spark.sparkContext.broadcast([r.asDict() for r in packed.collect()])  # 2 * SEED_ROWS vectors at most
    rows = stored(asked.mapInArrow(lambda batches: _seeded(k, seed.value, batches), "vec_id long, parts array<double>, length double, bound double"))
    # queries of like demands together: what a query asks of a vector's length
    demand = F.when((F.col("length") > 0) & (F.col("bound") > 0), F.col("bound") / F.col("length")).otherwise(0.0)
    asking = _blocks(rows, demand, rows.count(), 1, QUERY_ROWS, QUERY_GROUP)
    groups = blocks.groupBy("g").agg(F.max("longest").alias("longest"))
    # a group of queries is as demanding as its least demanding query
    least = asking.mapInArrow(_least, "g long, least double").groupBy("g").agg(F.min("least").alias("least"))
    # the grid of groups, not of rows: one row for up to 65,536 vectors, and one for up to 16,384 queries
    least = stored(least.select(F.row_number().over(Window.orderBy("g")).alias("i"), F.col("g").alias("qg"), "least"))
    many = least.count()
    every = F.explode(F.sequence(F.lit(1), F.lit(many))) if many else F.explode(F.array().cast("array<int>"))
    met = groups.select("g", "longest", every.alias("i")).join(least.hint("merge"), "i").where(F.col("least") <= F.col("longest") * (1 + MARGIN) + MARGIN)
    cells = stored(met.select("g", "qg"))
    left = asking.withColumnRenamed("g", "qg").join(cells.hint("merge"), "qg").withColumn("cell", F.struct("g", "qg")).drop("g", "qg")
    right = blocks.join(cells.hint("merge"), "g").withColumn("cell", F.struct("g", "qg")).drop("g", "qg")
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _least(batches):
    for batch in batches:
        for row in batch.to_pylist():
            bound, length = np.frombuffer(row["bounds"]), np.frombuffer(row["lengths"])
            asks = np.where((length > 0) & (bound > 0), bound / np.maximum(length, 1e-300), 0.0)
            yield pa.RecordBatch.from_pydict({"g": [row["g"]], "least": [float(asks.min(initial=np.inf))]})
