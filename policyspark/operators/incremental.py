"""The merged list kept up to date by daily changes, with retractions.

For every domain a keyed table holds its entries (source, category, whether it is an apex) with how often each occurs.  A change
adds to these counts or takes from them, so that what a source has dropped goes without the other sources being read; an entry
counts while its number is above 0, a domain while it has an entry.  A commit reads the table's buckets of changed domains and
writes a delta of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.state_tables import KeyedTable
from .domains import APEX, EXACT

ENTRY = "struct<source:string,category:string,apex:boolean,n:bigint>"
SCHEMA = f"domain string, entries array<{ENTRY}>"
#: Hash buckets of domains; a bucket of 10^9 domains over 1,024 is some 10^6 rows.
BUCKETS = 1_024


def list_table(spark: SparkSession, root: str, buckets: int = BUCKETS) -> KeyedTable:
    return KeyedTable(spark, root, SCHEMA, "domain", buckets=buckets)


def counted(done: DataFrame, sign: int = 1) -> DataFrame:
    """Classified rows (domain, source, category, scope, outcome; see domains.classified) as changes: domain, source, category, apex, n."""
    rows = done.where("outcome = 'merged'").select("domain", "source", "category", (F.col("scope") == APEX).alias("apex"))
    return rows.groupBy("domain", "source", "category", "apex").agg((sign * F.count("*")).alias("n"))


def difference(new: DataFrame, old: DataFrame) -> DataFrame:
    """The changes from a source's ``old`` classified rows to its ``new`` ones."""
    return summed(counted(new).unionAll(counted(old, -1)))


def summed(changes: DataFrame) -> DataFrame:
    """One row an entry, those that come to nothing left out."""
    return changes.groupBy("domain", "source", "category", "apex").agg(F.sum("n").alias("n")).where("n <> 0")


def apply_changes(table: KeyedTable, changes: DataFrame) -> int:
    """Commits ``changes`` (domain, source, category, apex, n; negative to retract) and returns the new version.

    More retractions of an entry than there are of it are an error: the change is of another state.
    """
    own = summed(changes)

    def change(version: int) -> tuple[DataFrame, DataFrame]:
        before = table.rows_of(own.select("domain").distinct(), version).select("domain", F.explode("entries").alias("e")).select("domain", "e.*")
        after = before.select("domain", "source", "category", "apex", "n").unionAll(own.select("domain", "source", "category", "apex", "n"))
        each = after.groupBy("domain", "source", "category", "apex").agg(F.sum("n").alias("n"))
        sound = F.when(F.col("n") < 0, F.raise_error(F.concat(F.lit("more is retracted than there is of "), "domain", F.lit(" "), "source"))).otherwise(F.col("n"))
        held = each.withColumn("n", sound.cast("bigint"))
        # an entry per source and category, so a domain's are few
        rows = held.groupBy("domain").agg(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("source", "category", "apex", "n")))).cast(f"array<{ENTRY}>").alias("entries"))
        rows = rows.withColumn("gone", F.size("entries") == 0)
        return rows.where("not gone").select("domain", "entries"), rows.where("gone").select("domain")

    return table.update(change)


def merged_of(rows: DataFrame) -> DataFrame:
    """Rows of the table as the merged list: domain, scope, sources, categories, as ``domains.merge`` gives them; nothing is shuffled."""
    names = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform("entries", lambda e: e[c]), lambda x: x.isNotNull())))
    apex: Column = F.exists("entries", lambda e: e["apex"])
    return rows.select("domain", F.when(apex, APEX).otherwise(EXACT).alias("scope"), names("source").alias("sources"), names("category").alias("categories"))


def new_keys(table: KeyedTable, since: int) -> DataFrame:
    """Domains that are listed now and weren't at version ``since``; only what was changed since then is looked at."""
    changed = table.changed_keys(since)
    return table.rows_of(changed).select("domain").join(table.rows_of(changed, since).select("domain").hint("merge"), "domain", "left_anti")


def fold_overlay(table: KeyedTable, adds: DataFrame, removes: DataFrame) -> int:
    """Commits an overlay: additions (domain, scope) that aren't listed become entries of the source ``overlay``, removals go entirely."""
    def change(version: int) -> tuple[DataFrame, DataFrame]:
        gone = removes.select("domain").distinct()
        listed = table.rows_of(adds.select("domain").distinct(), version).select("domain")
        new = adds.groupBy("domain").agg(F.max(F.col("scope") == APEX).alias("apex")).join(listed.hint("merge"), "domain", "left_anti")
        entry = F.array(F.struct(F.lit("overlay").alias("source"), F.lit("overlay").alias("category"), "apex", F.lit(1).cast("bigint").alias("n"))).cast(f"array<{ENTRY}>")
        rows = new.select("domain", entry.alias("entries"))
        # of a domain that is both added and removed, the addition stands
        return rows, gone.join(rows.select("domain").hint("merge"), "domain", "left_anti")

    return table.update(change)
