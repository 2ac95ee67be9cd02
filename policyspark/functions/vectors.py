"""Column functions on numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def softmax2(logit0: Column, logit1: Column) -> Column:
    """Probability of the second of two logits, stable for large ones."""
    m = F.greatest(logit0, logit1)
    return F.exp(logit1 - m) / (F.exp(logit0 - m) + F.exp(logit1 - m))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def linear_head(embedding: Column, weights: tuple[list[float], list[float]], bias: tuple[float, float]) -> Column:
    """Planned in the reference: two-class linear head and softmax; another dimension is an error."""
    size = len(weights[0])
    logits = [dot(embedding, F.array(*[F.lit(float(x)) for x in w])) + F.lit(b) for w, b in zip(weights, bias, strict=True)]
    return F.when(F.size(embedding) == size, softmax2(*logits)).otherwise(F.raise_error(F.lit(f"embedding must have {size} dimensions")).cast("double"))


def difference_hash(grid: Column, width: int = 9, height: int = 8) -> Column:
    """64-bit hash of a row-major luma grid: a bit for each horizontal neighbour pair, set where the left is greater."""
    bits = F.transform(F.sequence(F.lit(0), F.lit((width - 1) * height - 1)), lambda i: (F.get(grid, (i / (width - 1)).cast("int") * width + i % (width - 1)) > F.get(grid, (i / (width - 1)).cast("int") * width + i % (width - 1) + 1)).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda h, b: F.call_function("shiftleft", h, F.lit(1)).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
