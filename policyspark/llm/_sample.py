"""Texts of a bounded sample of documents, for models that are learnt in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._store import stored

#: Bytes of text that a model is learnt from at most, and of one text: what the learning task holds is bounded by them.
SAMPLE_BYTES, TEXT_BYTES = 64 << 20, 4 << 20


def sampled_texts(docs: DataFrame, drawn: DataFrame, most: int = SAMPLE_BYTES, longest: int = TEXT_BYTES) -> DataFrame:
    """``drawn`` (doc_id, draw and more; a bounded number of rows, ids distinct) with text, in the order of ``draw`` as far as
    ``most`` bytes reach; longer texts than ``longest`` bytes are passed over.  Of rows of one ``doc_id`` the smallest text counts.
    """
    own = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy(*drawn.columns).agg(F.min("text").alias("text"))
    texts = stored(own)
    sizes = texts.select("doc_id", "draw", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).where(F.col("bytes") <= longest)
    so_far = F.sum("bytes").over(Window.orderBy("draw", "doc_id"))  # as many rows as are drawn
    fits = sizes.withColumn("so_far", so_far).where(F.col("so_far") <= most).select("doc_id")
    return texts.join(F.broadcast(fits), "doc_id")
