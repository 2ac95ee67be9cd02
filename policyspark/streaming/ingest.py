"""Streams into tables with commits: ingest that is exact whenever a row comes, and day totals with rolling sums.

Both write through ``sources.state_tables``: a micro-batch is one commit, which notes the stream's name and the batch's number, so
that a batch that is run again after a failure adds nothing.  Streams into one table need names of their own, and a stream that
begins anew, without its checkpoint, a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.state_tables import KeyedTable


def _seen(table: KeyedTable, name: str, n: int) -> bool:
    return (table.note() or {}).get(name, -1) >= n


def exact_ingest(events: DataFrame, table: KeyedTable, order: list[str | Column], name: str = "events"):
    """A writer that adds the stream's rows to ``table``, each key once, the first to arrive (of a batch the first by ``order``).

    Rows are held against the stored table, so there is no watermark and a duplicate that comes months later is found; a batch reads
    the buckets of its own keys.  Rows without a key are left out.
    """

    def batch(df: DataFrame, n: int) -> None:
        if _seen(table, name, n):
            return
        first = F.row_number().over(Window.partitionBy(table.key).orderBy(*order))  # a batch's copies of one key
        rows = df.where(F.col(table.key).isNotNull()).withColumn("__first", first).where("__first = 1").drop("__first")

        def change(version: int) -> tuple[DataFrame, None]:
            known = table.rows_of(rows.select(table.key), version).select(table.key)
            return rows.join(known.hint("merge"), table.key, "left_anti").select(*table.schema.names), None

        table.update(change, note={**(table.note() or {}), name: n})

    return events.writeStream.foreachBatch(batch)


DAYS = "key string, day date, verdict string, n long"


def day_table(spark: SparkSession, root: str) -> KeyedTable:
    return KeyedTable(spark, root, DAYS, "key")


def day_totals(events: DataFrame, table: KeyedTable, lateness: str = "1 day", name: str = "days"):
    """A writer that keeps the totals by day and verdict of a stream (ts, verdict) in ``table``, open days included.

    A day's total is replaced whenever it has changed; Spark forgets a day when the watermark has passed it and drops what comes later.
    """
    g = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "verdict").agg(F.count("*").alias("n"))
    day = F.col("w.start").cast("date")
    rows = g.select(F.concat_ws("|", day.cast("string"), F.coalesce("verdict", F.lit(""))).alias("key"), day.alias("day"), "verdict", "n")

    def batch(df: DataFrame, n: int) -> None:
        if not _seen(table, name, n):
            table.update(lambda version: (df, None), note={**(table.note() or {}), name: n})

    return rows.writeStream.outputMode("update").foreachBatch(batch)


def rolling(totals: DataFrame, days: int = 7) -> DataFrame:
    """day, verdict, n (of the day), rolling (of the ``days`` up to it) for every day from the first to the last and every verdict.

    ``totals``: day, verdict, n.  A total leaves the sum when it is ``days`` old; the table has a row a day.
    """
    ends = totals.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b")).alias("day")).join(F.broadcast(totals.select("verdict").distinct()))  # days by verdicts
    own = totals.select("day", F.col("verdict").alias("v"), "n")
    full = spine.join(own.hint("merge"), (spine["day"] == own["day"]) & spine["verdict"].eqNullSafe(own["v"]), "left").select(spine["day"], spine["verdict"], F.coalesce("n", F.lit(0)).alias("n"))
    back = Window.partitionBy("verdict").orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return full.select("day", "verdict", "n", F.sum("n").over(back).alias("rolling"))
