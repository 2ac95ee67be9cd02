"""Liveness of list entries from tables of DNS answers: verdicts, cache, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.domains import FILTERING_ERRORS, is_special_use
from ..sources.state_tables import KeyedTable

ALIVE, DEAD, UNKNOWN, UNCORROBORATED = "alive", "dead", "unknown", "uncorroborated_dead"
NAMED = 20


def combined(answers: DataFrame) -> DataFrame:
    """Per domain and resolver: verdict and reason of its A and AAAA answers.

    ``answers``: domain, resolver, record (A or AAAA), kind (resolved, nxdomain, unknown), reason, extended_error.  Any resolved
    answer is alive; two NXDOMAIN are dead, unless one carries a filtering error; else the first unknown's reason, A first.
    """
    kind = lambda r: F.max(F.when(F.col("record") == r, F.col("kind")))
    why = lambda r: F.max(F.when((F.col("record") == r) & (F.col("kind") == "unknown"), F.col("reason")))
    g = answers.groupBy("domain", "resolver").agg(kind("A").alias("a"), kind("AAAA").alias("b"), why("A").alias("ra"), why("AAAA").alias("rb"), F.max(F.coalesce(F.col("extended_error").isin(*FILTERING_ERRORS), F.lit(False))).alias("filtered"))
    nx = (F.col("a") == "nxdomain") & (F.col("b") == "nxdomain")
    verdict = F.when((F.col("a") == "resolved") | (F.col("b") == "resolved"), ALIVE).when(nx & ~F.col("filtered"), DEAD).otherwise(UNKNOWN)
    reason = F.when(nx & F.col("filtered"), "filtered_by_resolver").otherwise(F.coalesce("ra", "rb", F.lit("incomplete")))
    return g.select("domain", "resolver", verdict.alias("verdict"), F.when(verdict == UNKNOWN, reason).alias("reason"))


def corroborated(verdicts: DataFrame, primary: str, secondary: str) -> DataFrame:
    """Per domain of two resolvers' verdicts: either alive is alive, both dead dead, one dead uncorroborated, else the primary's reason."""
    v = lambda r, c: F.max(F.when(F.col("resolver") == r, F.col(c)))
    g = verdicts.groupBy("domain").agg(v(primary, "verdict").alias("p"), v(secondary, "verdict").alias("s"), v(primary, "reason").alias("rp"), v(secondary, "reason").alias("rs"))
    p, s = F.coalesce("p", F.lit(UNKNOWN)), F.coalesce("s", F.lit(UNKNOWN))
    verdict = F.when((p == ALIVE) | (s == ALIVE), ALIVE).when((p == DEAD) & (s == DEAD), DEAD).otherwise(UNKNOWN)
    reason = F.when((p == DEAD) | (s == DEAD), UNCORROBORATED).otherwise(F.coalesce("rp", "rs"))
    return g.select("domain", verdict.alias("verdict"), F.when(verdict == UNKNOWN, reason).alias("reason"))


def due(last_checked: Column, now: int, ttl: int) -> Column:
    """Never checked, or at least ``ttl`` seconds ago; a clock that went back isn't due."""
    return last_checked.isNull() | (F.greatest(F.lit(now) - last_checked, F.lit(0)) >= ttl)


def due_set(merged: DataFrame, cache: DataFrame, now: int, ttl: int) -> DataFrame:
    return merged.select("domain").join(cache.select("domain", "last_checked").hint("merge"), "domain", "left").where(due(F.col("last_checked"), now, ttl)).select("domain")


def canary(control: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: passed, n_mismatches and the first NAMED of them in order.  ``control``: domain, expected."""
    bad = control.join(verdicts.select("domain", "verdict").hint("merge"), "domain", "left").where(~F.col("verdict").eqNullSafe(F.col("expected")))
    first = bad.orderBy("domain").limit(NAMED).agg(F.array_sort(F.collect_list("domain")).alias("named"))
    n = bad.agg(F.count("*").alias("n_mismatches"))
    more = F.when(F.col("n_mismatches") > NAMED, F.concat(F.lit("...and "), (F.col("n_mismatches") - NAMED).cast("string"), F.lit(" more")))
    return n.crossJoin(first).select((F.col("n_mismatches") == 0).alias("passed"), "n_mismatches", "named", more.alias("remainder"))  # one row each


def updated_cache(cache: DataFrame, verdicts: DataFrame, now: int) -> DataFrame:
    """The cache after a sweep: first_dead_at is kept while dead, set on the first death, cleared otherwise."""
    v = verdicts.select("domain", F.col("verdict").alias("v"), F.col("reason").alias("r"))
    j = cache.join(v.hint("merge"), "domain", "full_outer")
    new = F.col("v").isNotNull()
    first = F.when(F.col("v") == DEAD, F.coalesce("first_dead_at", F.lit(now)))
    return j.select("domain", F.when(new, F.lit(now)).otherwise(F.col("last_checked")).cast("long").alias("last_checked"), F.when(new, F.col("v")).otherwise(F.col("verdict")).alias("verdict"), F.when(new, F.col("r")).otherwise(F.col("reason")).alias("reason"), F.when(new, first).otherwise(F.col("first_dead_at")).cast("long").alias("first_dead_at"))


CACHE = "domain string, last_checked long, verdict string, reason string, first_dead_at long"


def cache_table(spark: SparkSession, root: str) -> KeyedTable:
    """The cache as a table with commits, by month of the last check.  One that isn't there is empty; one that is damaged is an error."""
    return KeyedTable(spark, root, CACHE, "domain", month="last_checked")


def save_sweep(table: KeyedTable, verdicts: DataFrame, now: int) -> int:
    """Commits a sweep's ``verdicts`` (domain, verdict, reason): only the rows of the domains that it checked are written."""

    def change(version: int) -> tuple[DataFrame, None]:
        return updated_cache(table.rows_of(verdicts.select("domain").distinct(), version), verdicts, now), None

    return table.update(change)


def due_from(table: KeyedTable, merged: DataFrame, now: int, ttl: int) -> DataFrame:
    """``due_set`` of a stored cache: rows that were last checked ``ttl`` seconds ago or more are in the months up to then."""
    names = merged.select("domain").distinct()
    old = table.older(now - ttl).select("domain")
    known = table.load().select("domain")
    never = names.join(known.hint("merge"), "domain", "left_anti")
    unchecked = table.load().where("last_checked is null").select("domain")
    return names.join(old.unionAll(unchecked).hint("merge"), "domain", "left_semi").unionAll(never)


def prunable(cache_row: DataFrame, now: int, quarantine: int) -> Column:
    """Dead for at least ``quarantine`` seconds, and not special-use."""
    return (F.col("verdict") == DEAD) & F.col("first_dead_at").isNotNull() & (F.greatest(F.lit(now) - F.col("first_dead_at"), F.lit(0)) >= quarantine) & ~is_special_use(F.col("domain"))


def dead_now(merged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The entries to leave out without hysteresis: dead by the last sweep and not special-use."""
    dead = verdicts.where((F.col("verdict") == DEAD) & ~is_special_use(F.col("domain"))).select("domain")
    return merged.select("domain").join(dead.hint("merge"), "domain", "left_semi")


def dead_list(verdicts: DataFrame) -> DataFrame:
    """Every dead domain, and every unknown one with its reason: domain, kind."""
    kind = F.when(F.col("verdict") == DEAD, DEAD).otherwise(F.concat(F.lit("unknown:"), F.col("reason")))
    return verdicts.where(F.col("verdict") != ALIVE).select("domain", kind.alias("kind"))


def pruned_set(merged: DataFrame, cache: DataFrame, now: int, quarantine: int) -> DataFrame:
    """Of all entries, not only those just checked, the ones to leave out."""
    return merged.select("domain").join(cache.hint("merge"), "domain").where(prunable(cache, now, quarantine)).select("domain")


def negative_outcomes(verdicts: DataFrame) -> DataFrame:
    """kind (dead, or an unknown's reason), n, first and last domain; the domains themselves are the rows of ``verdicts``."""
    kind = F.when(F.col("verdict") == DEAD, DEAD).otherwise(F.concat(F.lit("unknown:"), F.col("reason")))
    bad = verdicts.where(F.col("verdict") != ALIVE).select(kind.alias("kind"), "domain")
    return bad.groupBy("kind").agg(F.count("*").alias("n"), F.min("domain").alias("first_domain"), F.max("domain").alias("last_domain"))
