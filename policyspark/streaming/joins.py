"""Joins of two streams within a bound of time.

Each side has a watermark of its own; Spark keeps a row until the other side's watermark says that nothing more can meet it.  A
row without a partner comes out when that is certain.  Keys hold a slice of time besides, so that one busy key is spread over
tasks by its time.  What comes later than its side's watermark is dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _slice(c: Column, seconds: int) -> Column:
    return F.floor(c.cast("timestamp").cast("double") / seconds)


def suppressed_stream(verdicts: DataFrame, dismissals: DataFrame, key: str, seconds: int = 600, lateness: str = "10 minutes") -> DataFrame:
    """``verdicts`` (a unique ``key``, user_id, host, ts, verdict) with warn turned to allow within ``seconds`` of the user's dismissal of the
    host (user_id, host, ts), as ``activity.suppressed`` has it of tables; append mode.

    A verdict that isn't warn passes at once.  A dismissal counts in its own slice of ``seconds`` and in the next; several that meet a
    warning are one.
    """
    warned = verdicts.where("verdict = 'warn'").withWatermark("ts", lateness)
    v = warned.withColumn("__slice", _slice(F.col("ts"), seconds))
    d = dismissals.select(F.col("user_id").alias("__user"), F.col("host").alias("__host"), F.col("ts").alias("__at")).withWatermark("__at", lateness)
    d = d.withColumn("__of", F.explode(F.array(_slice(F.col("__at"), seconds), _slice(F.col("__at"), seconds) + 1)))
    near = F.expr(f"__at <= ts and __at >= ts - interval {seconds} seconds") & (F.unix_seconds("ts") - F.unix_seconds("__at") < seconds)
    met = v.join(d, F.col("user_id").eqNullSafe(F.col("__user")) & (F.col("host") == F.col("__host")) & (F.col("__slice") == F.col("__of")) & near, "leftOuter")
    once = met.withColumn("verdict", F.when(F.col("__at").isNotNull(), "allow").otherwise("warn")).select(*verdicts.columns).dropDuplicatesWithinWatermark([key])
    return verdicts.where("verdict is null or verdict <> 'warn'").select(*verdicts.columns).unionByName(once)


def outcome_stream(starts: DataFrame, outcomes: DataFrame, seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """``starts`` (gate_id, ts, ..) with the outcome (gate_id, ts, outcome) that follows within ``seconds``, open where none comes in time."""
    s = starts.withWatermark("ts", lateness)
    o = outcomes.select(F.col("gate_id").alias("__gate"), F.col("ts").alias("__at"), "outcome").withWatermark("__at", lateness)
    met = s.join(o, F.expr(f"gate_id = __gate and __at >= ts and __at <= ts + interval {seconds} seconds"), "leftOuter")
    return met.select(*starts.columns, F.coalesce("outcome", F.lit("open")).alias("outcome"))
