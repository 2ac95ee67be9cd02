"""Near-duplicate documents: HyperMinHash sketches find candidates, full shingle sets confirm them.

A document's set holds its distinct shingles of SHINGLE words (the whole word sequence where there are fewer).  A sketch has
REGISTERS registers; each keeps the smallest of the hashes dealt to it, compressed to the count of leading zeros and the
MANTISSA bits after the leading one.  Sets of LARGE shingles or more are dealt to as many buckets by the hashes' top bits.
Sets of SMALL or fewer would leave most buckets empty, so each of their registers sees every hash under a permutation of
its own; sizes in between have both sketches, so any two sets of similarity 0.75 have one kind in common.

BAND registers form a band; texts that agree in a whole band are candidates.  The share of equal registers, corrected for
chance collisions, must reach the wanted similarity within six standard deviations; what remains is compared on the full
sets.  A pair at a similarity of exactly 0.75 misses all 32 bands with a probability of 5e-6, at 0.8 with 5e-8.

How groups of any size stay cheap.  Texts with equal sets form a class and one document stands for it.  A bucket of
candidates isn't expanded into its pairs: all are compared with its first member and the found links are closed to
components.  A bucket whose members are then in one component is done.  The members of the others are gathered around the
largest component they touch (or by bucket), dealt to blocks of BLOCK, and each pair of blocks is compared in one task,
which emits a spanning forest of its links and no pairs.  So every pair of a bucket has been compared or joined, and a
group of copies costs about one comparison a copy.

Identifiers are whole numbers, as those of components are, or cast to them; an id that doesn't is an error.

Defined results: documents without words have an empty set, a component of their own and are kept; ``doc_id`` names a
document, so rows of one ``doc_id`` are in one component; a row with a null ``doc_id`` is linked with nothing, has a null
component and is kept; repeated rows get repeated results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ._names import unused
from ._store import stored
from ._words import NOT_BLANK, grams, hash_words, mix, pieces, row_of

SHINGLE, PERCENT = 5, 75
REGISTERS_LOG2, BAND, MANTISSA = 7, 4, 26
REGISTERS = 1 << REGISTERS_LOG2
#: Sets up to SMALL are sketched by permutations, sets from LARGE on by buckets; LARGE <= 0.75 * SMALL.
SMALL, LARGE = 256, 192
#: Chance that two different minima of a register are equal: equal leading zeros, then equal mantissas.
CHANCE = 2.0**-MANTISSA / 3
#: Documents in a block of a candidate group at most, and about so many of their shingles (8 bytes each).
BLOCK, BLOCK_SHINGLES = 256, 2_000_000
#: Up to so many rows (40 bytes each) a list of documents to fetch is broadcast; beyond it is joined by a merge.
BROADCAST_ROWS = 200_000
_TURN = np.random.default_rng(11).integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, splits = hash_words(column, NOT_BLANK)
    g = grams(h, SHINGLE)
    out = []
    for a, b in zip(splits[:-1].tolist(), splits[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - SHINGLE + 1]) if b - a >= SHINGLE else grams(h[a:b], b - a) if b > a else h[:0])
    return out


def compressed(rest: np.ndarray) -> np.ndarray:
    """Registers of hashes: leading zeros and one, then the mantissa; never 0."""
    rest = rest & np.uint64(0xFFFFFFFFFFFFF800)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    return (((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint32)


def bucket_registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers by buckets, a row for each set; 0 is an empty bucket."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint32)
    every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    if len(every):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        key = row * REGISTERS + (every >> np.uint64(64 - REGISTERS_LOG2)).astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))  # sets are sorted: a bucket's first hash is its smallest
        out.ravel()[key[first]] = compressed(every[first] << np.uint64(REGISTERS_LOG2))
    return out


def permuted_registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers by permutations, a row for each (small) set; 0s for an empty set."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint32)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = compressed((s[:, None] * _TURN).min(axis=0))
    return out


def band_keys(regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band that isn't empty."""
    bands = regs.reshape(len(regs), -1, BAND).astype(np.uint64)
    key = np.zeros(bands.shape[:2], dtype=np.uint64) + np.arange(bands.shape[1], dtype=np.uint64)
    for j in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
    row, band = np.nonzero(bands.any(axis=2))
    return row, key[row, band].view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected Jaccard estimate, registers it rests on) of register rows."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    equal = ((a == b) & (a != 0)).sum(axis=1)
    n = np.maximum(filled, 1)
    return (equal / n - CHANCE) / (1 - CHANCE), n


def plausible(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """False only where the estimate is more than six standard deviations below the wanted similarity."""
    wanted = percent / 100
    j, n = estimate(a, b)
    return j >= wanted - 6 * np.sqrt(wanted * (1 - wanted) / n)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows)])


def _register_rows(column: pa.Array) -> np.ndarray:
    """0s where there is no sketch of the kind."""
    none = bytes(4 * REGISTERS)
    return np.frombuffer(b"".join([x or none for x in column.to_pylist()]), dtype=np.uint32).reshape(-1, REGISTERS)


def _sketched(batches):
    for batch in batches:
        for piece in pieces(batch, "text"):
            sets = shingle_sets(piece.column("text"))
            size = np.array([len(s) for s in sets], dtype=np.int64)
            # a class is named by two sums over the set's hashes
            names = np.array([[np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5))), np.add.reduce(mix(s + np.uint64(0x5DEECE66D)))] for s in sets], dtype=np.uint64).reshape(-1, 2)
            names[:, 0] += mix(size.astype(np.uint64))
            names[:, 1] ^= size.astype(np.uint64)
            small, large = (size > 0) & (size <= SMALL), size >= LARGE
            a = permuted_registers([s for s, x in zip(sets, small, strict=True) if x])
            b = bucket_registers([s for s, x in zip(sets, large, strict=True) if x])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size), _binary(names), _spread(a, small), _spread(b, large)], ["doc_id", "n_shingles", "class", "small", "large"])


def _spread(rows: np.ndarray, where: np.ndarray) -> pa.Array:
    """Binary column with the rows where ``where`` is true, else null."""
    at = np.cumsum(where) - 1
    return _binary(rows).take(pa.array(at, mask=~where)) if len(rows) else pa.nulls(len(where), pa.binary())


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (equal sets have equal classes), small and large (registers of either kind, or null)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_sketched, "doc_id long, n_shingles long, class binary, small binary, large binary")


def _banded(batches):
    for batch in batches:
        for kind in ("small", "large"):
            has = pc.is_valid(batch.column(kind))
            own = batch.filter(has)
            if own.num_rows:
                row, key = band_keys(_register_rows(own.column(kind)))
                yield pa.RecordBatch.from_arrays([pa.array(key ^ (kind == "large")), own.column("rep").take(pa.array(row))], ["key", "rep"])


def _probable(percent, batches):
    for batch in batches:
        if batch.num_rows:
            regs = {c: _register_rows(batch.column(c)) for c in ("small_a", "small_b", "large_a", "large_b")}
            both = (regs["small_a"].any(axis=1) & regs["small_b"].any(axis=1))[:, None]
            keep = plausible(np.where(both, regs["small_a"], regs["large_a"]), np.where(both, regs["small_b"], regs["large_b"]), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def links(sets: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of different components, as pairs of indices."""
    n, size = len(sets), np.array([len(s) for s in sets])
    if n < 2 or (component == component[0]).all():
        return []
    every = np.concatenate(sets)
    row = np.repeat(np.arange(n), size)
    _, code, count = np.unique(every, return_inverse=True, return_counts=True)
    row, code = row[count[code] > 1], code[count[code] > 1]
    _, code = np.unique(code, return_inverse=True)
    common, order = np.zeros((n, n), dtype=np.float32), np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        lo, hi = np.searchsorted(code, [start, start + 4096])
        m = np.zeros((n, 4096), dtype=np.float32)
        m[row[lo:hi], code[lo:hi] - start] = 1
        m = m[:, : int(code[hi - 1]) - start + 1]
        common += m @ m.T
    common = common.astype(np.int64)
    a, b = np.nonzero(np.triu((100 * common >= percent * (size[:, None] + size[None, :] - common)) & (size[:, None] > 0), 1))
    root: dict[int, int] = {}

    def top(x):
        while x in root:
            x = root[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(int(component[i])), top(int(component[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def _linked(percent, batches):
    """Rows (task, doc, component, text) come sorted by task: the links of each task's documents, a forest of them."""
    task, docs, component, sets = None, [], [], []

    def found():
        return [(docs[i], docs[j]) for i, j in links(sets, np.array(component), percent)]

    for batch in batches:
        out = []
        for piece in pieces(batch, "text"):
            columns = [piece.column(c).to_pylist() for c in ("task", "doc", "component")]
            for t, d, c, s in zip(*columns, shingle_sets(piece.column("text")), strict=True):
                if t != task:
                    out += found()
                    task, docs, component, sets = t, [], [], []
                docs.append(d)
                component.append(c)
                sets.append(s)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])
    last = found()
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in last], pa.int64()), pa.array([p[1] for p in last], pa.int64())], ["a", "b"])


def compare(docs: DataFrame, tasks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the documents of each task.  ``tasks``: task, doc, component; a bounded number of rows a task."""
    needed = stored(tasks)
    few = needed.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(F.broadcast(needed) if few else needed.hint("merge"), "doc")
    ordered = texts.select("task", "doc", "component", "text").repartition("task").sortWithinPartitions("task")
    return ordered.mapInArrow(lambda x: _linked(percent, x), "a long, b long")


def confirm(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimate is plausible and whose full sets are similar enough."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("small").alias(f"small_{x}"), F.col("large").alias(f"large_{x}")).hint("merge")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "small_a", "small_b", "large_a", "large_b")
    probable = joined.mapInArrow(lambda x: _probable(percent, x), "a long, b long")
    both = F.explode(F.array("a", "b")).alias("doc")
    return compare(docs, probable.select(F.xxhash64("a", "b").alias("task"), both).select("task", "doc", F.col("doc").alias("component")), percent)


def block_tasks(members: DataFrame) -> DataFrame:
    """Tasks (task, doc, component) that bring each two of a group's members together.  ``members``: group, doc, component, n_shingles."""
    # written out: with a plain exchange on both sides, the join's hot groups can be split
    n = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    blocks = stored(members.groupBy("group").agg(n.alias("n")))
    dealt = members.join(blocks.hint("merge"), "group").withColumn("own", F.pmod(F.xxhash64("doc"), "n").cast("int"))
    pairs = dealt.select("group", "doc", "component", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    return pairs.select(F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "doc", "component")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b), the component being its smallest node.

    Alternates the large-star and small-star steps, each of them joins on minima by node, until nothing changes.  The minima
    are written out first, so that the edges of a node with very many can be split.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select("v", "v").distinct())
        state = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
        large = stored(both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        low = stored(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        edges = stored(small.where("u <> v").distinct())


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    sketches = stored(sketch(docs))
    members = sketches.where("n_shingles > 0 and doc_id is not null").select("doc_id", "class")
    classes = stored(members.groupBy("class").agg(F.min("doc_id").alias("rep")))
    reps = stored(
        sketches.where("n_shingles > 0").select("doc_id", "class", "n_shingles", "small", "large")
        .join(classes.select(F.col("rep").alias("doc_id"), "class").hint("merge"), ["doc_id", "class"]).select(F.col("doc_id").alias("rep"), "n_shingles", "small", "large")
    )
    bands = reps.select("rep", "small", "large").mapInArrow(_banded, "key long, rep long")
    # aggregates are written out before a join with the rows they stem from: else a hot key's rows could not be split
    shared = stored(bands.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", "first"))
    buckets = stored(bands.join(shared.hint("merge"), "key"))
    placed = members.join(classes.hint("merge"), "class").select("doc_id", "rep")
    # rows of one doc_id with different texts
    edges = stored(placed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b"))
    pairs = buckets.where("rep > first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    edges = edges.unionAll(stored(confirm(docs, reps, pairs, percent)))
    labels = stored(components(edges))
    sizes = stored(labels.groupBy("component").agg(F.count("*").alias("size")))
    known = labels.join(sizes.hint("merge"), "component").select(F.col("node").alias("rep"), "component", "size").hint("merge")
    within = stored(buckets.select("key", "rep").join(known, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("size", F.lit(1)).alias("size")))
    top = F.max(F.struct("size", "component"))
    unresolved = within.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), top.alias("top")).where("x < y")
    unresolved = stored(unresolved.select("key", F.when(F.col("top.size") > 1, F.xxhash64("top.component")).otherwise(F.xxhash64("key", F.lit("bucket"))).alias("group")))
    open_groups = within.join(unresolved.hint("merge"), "key").select("group", F.col("rep").alias("doc"), "component").distinct()
    open_groups = stored(open_groups.join(reps.select(F.col("rep").alias("doc"), "n_shingles").hint("merge"), "doc"))
    if not open_groups.isEmpty():
        found = stored(compare(docs, block_tasks(open_groups), percent))
        if not found.isEmpty():
            labels = stored(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found)))
    own = classes.join(labels.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    linked = F.expr("n_shingles > 0 and doc_id is not null")
    rows = sketches.where(linked).select("doc_id", "n_shingles", "class").join(stored(own).hint("merge"), "class").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = sketches.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.unionAll(alone).select("*", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the rows whose ``doc_id`` is its component's smallest, with all their columns.

    Of rows that share such a ``doc_id`` the first in text order stays; rows with a null ``doc_id`` all stay.
    """
    kept = near_duplicates(docs, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    marked = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    (n,) = unused(docs.columns, "n")
    first = marked.withColumn(n, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(n) == 1).drop(n)
    return first.unionByName(docs.where("doc_id is null"))
