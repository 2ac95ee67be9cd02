"""URL rules by a sort-merge range join, with DataFrame functions only.

A rule (host, path, action) fits its host and every subdomain where the url's path starts with the rule's.  The canonical
key of a place is its host with the labels reversed, a separator, and the path; a rule covers the interval of keys from its
own to the last key it is a prefix of.  A url is looked up at each of its host's suffixes, as a key of that suffix and the
url's path, so intervals of different hosts never mix and those of one host nest.

Lookup is one sorted sweep: keys are range-partitioned (equal keys may be dealt to several partitions, so no host is too
hot), and within a partition each key takes the top of the stack of active rules at the last interval border before it.
The stack after each border depends on rules alone and is worked out on them, each rule linked to the enclosing one.

Longest wins: of the fitting rules the one with most characters of host and path, then the longer host, then the smaller text.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule; an empty host likewise;
repeated rows get repeated results, a null ``page_id`` too; of rules with the same host and path the first ``block``
counts; empty pages or rules give an empty result or no rule; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ._store import stored

#: Between host and path of a key; no host holds a slash and every path starts with one, so keys are unambiguous.
LOW = "\x00"
#: Fixed rules of the query: action, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: Verdict where no rule fits.
DEFAULT = "allow"

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *_AZ)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(reversed_host: Column, path: Column) -> Column:
    """Keys are UTF-8 bytes, which never hold FF: a key and FF ends the interval that it opens."""
    return F.concat(reversed_host, F.lit(LOW), path).cast("binary")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "action string, host string, path string")


def borders(rules: DataFrame) -> DataFrame:
    """(key, kind, rule, verdict, weight): the innermost rule from each interval border on; null after an outermost end.

    kind 0 opens before, kind 2 closes after a url's key (kind 1) of the same text.  Rules of one host nest by path, so the
    rule around another is the longest of its host whose path is a proper prefix: an equi-join over the path's prefixes,
    whose number is the path's length and not that of the rules.
    """
    r = rules.select(F.translate("host", *_AZ).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").where("host <> ''")
    r = r.groupBy("host", "path").agg(F.when(F.max(F.col("action") == "block"), "block").otherwise("allow").alias("verdict"))
    r = r.withColumn("rule", F.concat("host", "path")).withColumn("weight", F.struct(F.length("rule").alias("n"), F.length("host").alias("h")))
    r = r.withColumn("key", _key(_reversed(F.col("host")), F.col("path")))
    inner = r.select("key", "host", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substr("path", F.lit(1), i)), lambda p: p != F.col("path"))).alias("path"))
    around = inner.join(r.drop("key").hint("merge"), ["host", "path"]).groupBy("key").agg(F.max_by(F.struct("rule", "verdict", "weight"), F.length("path")).alias("outer"))
    opens = r.select("key", F.lit(0).alias("kind"), "rule", "verdict", "weight")
    closes = r.select("key").join(around.hint("merge"), "key", "left").select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), "outer.rule", "outer.verdict", "outer.weight")
    return opens.unionAll(closes)


def matched(points: DataFrame, rules: DataFrame) -> DataFrame:
    """The innermost rule of each point.  ``points`` has key and id; the result id, rule, verdict, weight (points without one left out)."""
    border = borders(rules).select("key", "kind", F.lit(None).cast("long").alias("id"), F.struct("rule", "verdict", "weight").alias("top"))
    events = border.unionByName(points.select("key", F.lit(1).alias("kind"), "id", F.lit(None).cast(border.schema["top"].dataType).alias("top")))
    # the id splits equal keys; written once, so that the partition of a row stays the same in both uses
    dealt = stored(events.repartitionByRange("key", "kind", "id").select("*", F.spark_partition_id().alias("part")))
    ends = dealt.where("kind <> 1").groupBy("part").agg(F.max_by("top", F.struct("key", "kind")).alias("last"))
    # one row a partition that holds a border: at most as many as partitions
    parts = dealt.select("part").distinct().join(ends.hint("merge"), "part", "left")
    carry = parts.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("seen", F.last("top", ignorenulls=True).over(sweep)).where("kind = 1").select("part", "id", "seen")
    top = F.coalesce("seen", "carried")
    return swept.join(F.broadcast(carry), "part", "left").select("id", top["rule"].alias("rule"), top["verdict"].alias("verdict"), top["weight"].alias("weight")).where("rule is not null")


def judged(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict."""
    rows = stored(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("id", F.monotonically_increasing_id()))
    # no rule has more labels or a longer path than these, so longer hosts and paths are looked up no further
    most = rules.agg(F.max(F.size(F.split("host", r"\."))), F.max(F.length("path"))).first()
    labels = F.reverse(F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most[0] or 1))), lambda i: F.array_join(F.slice(labels, 1, i), "."))
    points = rows.where("host <> ''").select("id", "path", F.explode(suffixes).alias("s")).select("id", _key(F.col("s"), F.substr("path", F.lit(1), F.lit(most[1] or 0))).alias("key"))
    best = matched(points, rules).groupBy("id").agg(F.max(F.struct("weight", "rule", "verdict")).alias("best"))
    return rows.join(best.hint("merge"), "id", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
