"""Exact order statistics of groups of any size, without a buffer of a group's values.

The values are never sorted as a whole.  A sketch of bounded size (Spark's ``percentile_approx``) proposes, for each rank that is
asked for, a range of values around it; the values below and within the range are counted exactly; and the search goes on within
the range, which shrinks to some hundredth each round, until it has at most ``few`` rows or one value.  Only those rows are
shuffled and ranked.  A pass reads the values and sends partial counts, whatever the groups' sizes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.joins import side
from ..functions.tables import stored

#: Rows of a range that are ranked by sorting; steps of the sketch, whose error is far below a step.
FEW, STEPS, ACCURACY = 100_000, 256, 10_000


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """The rank of the nearest-rank percentile ``q``, as ``percentile_disc``: the least whose share of the values is at least ``q``."""
    return lambda n: F.greatest(F.ceil(F.lit(q).cast("decimal(12,10)") * n).cast("long"), F.lit(1).cast("long"))


def middle(upper: bool) -> Callable[[Column], Column]:
    """The lower or the upper of the two ranks whose values' mean is the median (one and the same for an odd number)."""
    return lambda n: F.floor((n + (2 if upper else 1)) / 2).cast("long")


def selected(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], few: int = FEW) -> DataFrame:
    """The ``by`` columns and, for each name in ``ranks``, the value at that rank (from 1, ascending) of the group's values.

    A rank is a function of the number of values; one outside them gives null.  Null values don't count, NaN is the greatest; a
    group without values has no row.
    """
    own = rows.select(F.struct(*by).alias("g") if by else F.lit(1).alias("g"), F.col(value).alias("x")).where("x is not null")
    counts = own.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).alias("rank")) for name, rank in ranks.items()])).alias("w")
    asked = stored(counts.select("g", wanted, "n", "lo", "hi").select("g", "w.name", "w.rank", F.lit(0).cast("long").alias("below"), F.col("n").alias("within"), "lo", "hi", F.lit(False).alias("forced")))
    asked = asked.where((F.col("rank") >= 1) & (F.col("rank") <= F.col("within")))
    wide = (F.col("within") > few) & (F.col("lo") < F.col("hi")) & ~F.col("forced")
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    while not (open_ := asked.where(wide)).isEmpty():
        met = own.join(side(open_), "g").where(inside)
        steps = [i / STEPS for i in range(STEPS + 1)]
        sketch = met.groupBy("g", "name").agg(F.percentile_approx("x", steps, ACCURACY).alias("q"))
        at = F.floor((F.col("rank") - F.col("below")) * STEPS / F.col("within")).cast("int")
        near = open_.join(side(sketch), ["g", "name"]).select("g", "name", "rank", "below", "lo", "hi", F.coalesce(F.get("q", at - 1), "lo").alias("a"), F.coalesce(F.get("q", at + 2), "hi").alias("b"))
        # a range that is no narrower than before is sorted as it is, which ends the search whatever the sketch says
        near = stored(near)
        found = own.join(side(near), "g").where(inside).groupBy("g", "name", "rank", "below", "lo", "hi", "a", "b")
        counted = found.agg(F.count_if(F.col("x") < F.col("a")).alias("under"), F.count_if((F.col("x") >= F.col("a")) & (F.col("x") <= F.col("b"))).alias("mid"), F.count("*").alias("all"))
        start = F.col("below") + F.col("under")
        good = (F.col("rank") > start) & (F.col("rank") <= start + F.col("mid")) & (F.col("mid") < F.col("all"))
        pick = lambda new, old: F.when(good, new).otherwise(old)
        next_ = counted.select("g", "name", "rank", pick(start, F.col("below")).alias("below"), pick(F.col("mid"), F.col("all")).alias("within"), pick(F.col("a"), F.col("lo")).alias("lo"), pick(F.col("b"), F.col("hi")).alias("hi"), (~good).alias("forced"))
        asked = stored(asked.where(~wide).unionAll(next_))
    one = asked.where(F.col("lo") == F.col("hi")).select("g", "name", F.col("lo").alias("v"))
    some = own.join(side(asked.where(F.col("lo") < F.col("hi"))), "g").where(inside).groupBy("g", "name", "rank", "below", "x").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("g", "name").orderBy("x"))  # ``few`` rows at most
    ranked = some.withColumn("upto", F.col("below") + so_far).where(F.col("upto") >= F.col("rank")).groupBy("g", "name").agg(F.min("x").alias("v"))
    values = one.unionAll(ranked).groupBy("g").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])
    return values.select(*[F.col(f"g.`{c}`").alias(c) for c in by], *ranks)
