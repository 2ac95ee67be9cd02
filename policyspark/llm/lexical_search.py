"""Ranked lexical search by accumulators, term at a time.

1. One pass over the documents keeps, for every block of documents, their sizes and the postings of terms that some item may
   hold: a bitmap of the items' terms of at most 2**MOST_BITS bits spares the others, a bit set by another term costs a posting
   that no item asks for.
2. Sizes and postings, written out, give the counts N, L and df over all documents; with them each item's terms get weights.
3. Groups of blocks meet groups of items, both of bounded size, in the cells of a grid.  In a cell an item's terms are taken
   rarest first.  A document gets an accumulator with its first term, until what the terms left can add at most (their
   weights times their largest impacts in the cell) is less than the k-th partial score: a document without an accumulator can't
   reach the k best any more.  From then on only the survivors are updated, exactly, and those that can't reach the k-th are
   dropped.
4. The k best of each cell are ranked by item.  Everything that is summed is an integer of 64 bits.

Defined results: null and wordless texts have no term, aren't counted in N and are never found; every document row counts and
may be found on its own, also where ``doc_id`` is repeated or null (null last among equal scores); rows of a repeated
``item_id`` are one item with the terms of all; a null ``item_id``, an item without terms or whose terms no document holds, and
empty tables yield no rows.  Identifiers may be of any type that Spark can order; other columns are ignored, whatever their
names.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ._store import stored
from ._words import ALNUM, hash_words, pieces, row_of

#: Results of an item.
BEST = 50
#: Blocks (of about 128 KB of text) in a group and items in a group, at most on average.
GROUP_BLOCKS, GROUP_ITEMS = 256, 8_192
#: Bitmap of the items' terms: so many bits for each, from 2**LEAST_BITS to 2**MOST_BITS (8 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 26


def _item_terms(batches):
    """(item_id, term) of every word of the items."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            words, splits = hash_words(piece.column("text"), ALNUM)
            rows = pa.array(row_of(splits))
            yield pa.RecordBatch.from_arrays([piece.column("item_id").take(rows), pa.array(words.view(np.int64))], ["item_id", "term"])


class Terms:
    """Bitmap of terms."""

    def __init__(self, bits: int, buckets: dict[int, bytes]):
        self.bits, self.map = bits, np.zeros(max(1 << bits >> 3, 4096), dtype=np.uint8)
        for bucket, part in buckets.items():
            self.map[bucket * 4096 : bucket * 4096 + 4096] = np.frombuffer(part, np.uint8)

    def may_hold(self, words: np.ndarray) -> np.ndarray:
        bit = (words & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        return (self.map.take(bit >> 3) >> (bit & 7).astype(np.uint8) & 1).astype(bool)

    @classmethod
    def of(cls, terms: DataFrame) -> "Terms":
        """Of a table with a column ``term``; 4 KB for each 2**15 bits come to the driver."""
        bits = min(max(LEAST_BITS, (BITS_EACH * terms.count()).bit_length()), MOST_BITS)
        bit = F.col("term").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
        parts = terms.groupBy(F.floor(bit / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(bit % 32768).alias("m")).collect()
        return cls(bits, {r.b: bytes(r.m) for r in parts})


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _blocks(terms: Terms, batches):
    """A row for each piece of the documents; term, place (of the document in the block) and tf are parallel."""
    for batch in batches:
        for piece in pieces(batch, "text"):
            words, splits = hash_words(piece.column("text"), ALNUM)
            row, size = row_of(splits), np.diff(splits)
            some = terms.may_hold(words)
            term, row = words[some], row[some]
            order = np.lexsort((term, row))
            term, row = term[order], row[order]
            first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))) if len(term) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(term)))
            ids = pa.ListArray.from_arrays(pa.array([0, piece.num_rows], pa.int32()), piece.column("doc_id"))
            lists = [_list(size, pa.int64()), _list(term[first].view(np.int64), pa.int64()), _list(row[first], pa.int32()), _list(tf, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([int((size > 0).sum())]), pa.array([len(words)]), ids, *lists], ["n_docs", "n_terms", "doc_ids", "sizes", "term", "place", "tf"])


def _counted(docs: DataFrame, terms: Terms) -> DataFrame:
    """The blocks of ``docs``, numbered and written out."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    lists = [("sizes", T.LongType()), ("term", T.LongType()), ("place", T.IntegerType()), ("tf", T.LongType())]
    schema = T.StructType([T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), *[T.StructField(c, T.ArrayType(t)) for c, t in lists]])
    blocks = docs.select("doc_id", "text").mapInArrow(lambda batches: _blocks(shared.value, batches), schema)
    return stored(blocks.withColumn("block", F.monotonically_increasing_id()))


class Cell:
    """Postings of a group of documents, by term and by document in the order of their ids."""

    def __init__(self, blocks: pa.Table, wanted: np.ndarray, n: int, total: int):
        """``wanted``: ascending terms; ``n``, ``total``: N and L of all documents."""
        flat = lambda c: pc.list_flatten(blocks.column(c)).to_numpy()
        ids, size = pc.list_flatten(blocks.column("doc_ids")), flat("sizes")
        order = pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_end").to_numpy()
        self.ids, self.n_docs = ids.take(pa.array(order)), len(order)
        place_of = np.empty(len(order), np.int64)
        place_of[order] = np.arange(len(order))
        m = 100 - 50 + (50 * size * n) // max(total, 1)
        before = np.append(0, np.cumsum(pc.list_value_length(blocks.column("doc_ids")).to_numpy()))[:-1]
        doc = flat("place").astype(np.int64) + np.repeat(before, pc.list_value_length(blocks.column("term")).to_numpy())
        term, tf = flat("term"), flat("tf")
        at = np.minimum(np.searchsorted(wanted, term), max(len(wanted) - 1, 0))
        some = wanted[at] == term if len(wanted) else np.zeros(len(term), bool)
        at, doc, tf = at[some], doc[some], tf[some]
        impact = (1_000_000_000 * tf) // (1_000 * tf + 20 * m[doc])
        doc = place_of[doc]
        order = np.lexsort((doc, at))
        self.doc, self.impact = doc[order], impact[order]
        self.first = np.searchsorted(at[order], np.arange(len(wanted) + 1))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best, highest first; ``terms`` are numbers in ``wanted``."""
        held = (self.first[terms + 1] > self.first[terms]) & (weights > 0)
        terms, weights = terms[held], weights[held]
        order = np.lexsort((terms, -weights))  # rarest first
        lists = [(self.doc[a:b], self.impact[a:b] * w) for a, b, w in zip(self.first[terms[order]], self.first[terms[order] + 1], weights[order], strict=True)]
        left = np.append(np.cumsum([int(s.max()) for _, s in lists][::-1])[::-1], 0) if lists else np.zeros(1, np.int64)
        score, creating, alive = np.zeros(self.n_docs, np.int64), True, None
        for i, (doc, gain) in enumerate(lists):
            if creating:
                score[doc] += gain
                if left[i + 1] < score.max() and i + 1 < len(lists):
                    alive = np.flatnonzero(score)
                    kth = np.partition(score[alive], -k)[-k] if len(alive) >= k else 0
                    creating = left[i + 1] >= kth
                continue
            # only the survivors, less those that what is left can't bring to the k-th partial score
            kth = np.partition(score[alive], -k)[-k]
            alive = alive[score[alive] + left[i] >= kth]
            if 8 * len(alive) < len(doc):
                at = np.minimum(np.searchsorted(doc, alive), len(doc) - 1)
                hit = doc[at] == alive
                score[alive[hit]] += gain[at[hit]]
            else:
                mine = np.zeros(self.n_docs, bool)
                mine[alive] = True
                hit = mine[doc]
                score[doc[hit]] += gain[hit]
        alive = np.flatnonzero(score) if creating else alive
        if len(alive) > k:
            got = score[alive]
            kth = np.partition(got, -k)[-k]
            above, ties = alive[got > kth], alive[got == kth]
            alive = np.append(above, ties[: k - len(above)])  # ascending: the smallest ids
        alive = alive[np.lexsort((alive, -score[alive]))]
        return alive, score[alive]


def _searched(n: int, total: int, k: int, schema: pa.Schema):
    def search(blocks: pa.Table, items: pa.Table) -> pa.Table:
        listed = items.column("terms").combine_chunks()
        pairs = listed.flatten()
        term, weight = pairs.field("term").to_numpy(), pairs.field("weight").to_numpy()
        wanted = np.unique(term)
        number, ends = np.searchsorted(wanted, term), np.append(0, np.cumsum(pc.list_value_length(listed).to_numpy()))
        if not blocks.num_rows or not len(wanted):
            return schema.empty_table()
        cell = Cell(blocks, wanted, n, total)
        found = [cell.best(number[a:b], weight[a:b], k) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(d) for d, _ in found]))
        docs = cell.ids.take(pa.array(np.concatenate([d for d, _ in found])))
        return pa.Table.from_arrays([items.column("item_id").take(rows), docs, pa.array(np.concatenate([s for _, s in found]))], schema=schema)

    return search


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of ``docs`` (doc_id, text) with the highest scores above 0 for each
    of ``items`` (item_id, text), equal scores by ascending doc_id.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    asked = items.select("item_id", "text").where("item_id is not null and text is not null")
    item_type = items.schema["item_id"].dataType
    terms = stored(asked.mapInArrow(_item_terms, T.StructType([T.StructField("item_id", item_type), T.StructField("term", T.LongType())])).distinct())
    blocks = _counted(docs, Terms.of(terms.select("term").distinct()))
    r = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total"), F.count("*").alias("blocks")).first()
    n, total = r.n or 0, r.total or 0
    # the join with counts is a merge of two tables that were written out, so that a term of very many items can be split
    df = stored(blocks.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    weight = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = stored(terms.join(df.hint("merge"), "term").groupBy("item_id").agg(F.collect_list(F.struct("term", weight.alias("weight"))).alias("terms")))
    n_items, width = weighted.count(), spark.sparkContext.defaultParallelism
    doc_groups = max(-(-r.blocks // GROUP_BLOCKS), min(r.blocks, 4 * width), 1)
    item_groups = max(-(-n_items // GROUP_ITEMS), 1)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = blocks.select("doc_ids", "sizes", "term", "place", "tf", F.pmod(F.xxhash64("block"), F.lit(doc_groups)).cast("int").alias("docs"), every(item_groups).alias("items"))
    right = weighted.select("item_id", "terms", every(doc_groups).alias("docs"), F.pmod(F.xxhash64("item_id"), F.lit(item_groups)).cast("int").alias("items"))
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    cells = left.groupBy("docs", "items").cogroup(right.groupBy("docs", "items")).applyInArrow(_searched(n, total, k, to_arrow_schema(schema)), schema)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
