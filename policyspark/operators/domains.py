"""Domain lists: scope, merge with provenance, gates and publication decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.domains import is_ip_literal, normalize_domain, suffixes
from ..functions.fence import fenced
from ..functions.joins import side

#: Licences from most to least permissive.
LICENSE_RANK = ("CC0-1.0", "MIT", "CC-BY-SA-4.0", "GPL-3.0")
APEX, EXACT = "apex", "exact_host"


def registrable(domains: DataFrame, public_suffix: DataFrame) -> DataFrame:
    """``domains`` (domain) with registrable: the longest public suffix and one label more; null for a suffix itself.

    ``public_suffix`` has rule: a name, ``*.name`` or ``!name``.  Without a rule the last label is the suffix.
    """
    rules = public_suffix.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("suffix"), F.col("rule").startswith("*.").alias("wild"), F.col("rule").startswith("!").alias("except"))
    names = domains.select("domain").distinct()
    hit = names.select("domain", F.explode(suffixes(F.col("domain"))).alias("s")).select("domain", "s.*").join(side(rules), "suffix")
    # labels of the public suffix: the rule's own, one more under a wildcard, one less for an exception (which wins)
    labels = F.col("depth") + F.col("wild").cast("int") - F.col("except").cast("int")
    best = hit.groupBy("domain").agg(F.max_by(labels, F.struct("except", labels)).alias("n"))
    parts = F.split("domain", r"\.")
    found = names.join(best.hint("merge"), "domain", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = found.select("domain", F.when(F.size(parts) > F.col("n"), F.array_join(F.slice(parts, F.size(parts) - F.col("n"), F.col("n") + 1), ".")).alias("registrable"))
    return domains.join(own.hint("merge"), "domain", "left")


def with_scope(entries: DataFrame, public_suffix: DataFrame, denylist: DataFrame) -> DataFrame:
    """``entries`` (domain, scope_hint) with scope: null on the denylist, apex if hinted and registrable, else exact_host."""
    deny = denylist.select(normalize_domain(F.col("value")).alias("domain")).where("domain is not null").distinct().withColumn("denied", F.lit(True))
    r = registrable(entries, public_suffix).join(side(deny), "domain", "left")
    eligible = F.col("registrable") == F.col("domain")
    return r.withColumn("scope", F.when(F.col("denied"), None).when((F.col("scope_hint") == APEX) & eligible, APEX).otherwise(EXACT)).drop("registrable", "denied")


def classified(raw: DataFrame, public_suffix: DataFrame, denylist: DataFrame) -> DataFrame:
    """Raw entries with their key and outcome: not_normal, ip_literal, denylisted or merged, in this order."""
    n = fenced(raw, domain=normalize_domain(F.col("domain")))
    n = with_scope(n, public_suffix, denylist)
    return n.withColumn("outcome", F.when(F.col("domain").isNull(), "not_normal").when(is_ip_literal(F.col("domain")), "ip_literal").when(F.col("scope").isNull(), "denylisted").otherwise("merged"))


def merge_report(done: DataFrame) -> DataFrame:
    return done.groupBy("outcome").agg(F.count("*").alias("n"))


def merge(done: DataFrame) -> DataFrame:
    """domain, scope, sources, categories: sorted unions, the widest scope, whatever the rows' order."""
    g = done.where("outcome = 'merged'").groupBy("domain").agg(F.max(F.col("scope") == APEX).alias("a"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("category")).alias("categories"))
    return g.select("domain", F.when(F.col("a"), APEX).otherwise(EXACT).alias("scope"), "sources", "categories")


def filter_by_category(merged: DataFrame, allowed: list[str]) -> DataFrame:
    return merged.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in allowed]).cast("array<string>")))


def provenance(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary: id, sources, categories, scope; keys: domain, id).  Ids follow the order of the combinations, which are few."""
    combos = merged.select("sources", "categories", "scope").distinct()
    ids = combos.withColumn("id", F.row_number().over(Window.orderBy("sources", "categories", "scope")) - 1)
    return ids.select("id", "sources", "categories", "scope"), merged.join(side(ids), ["sources", "categories", "scope"]).select("domain", "id")


def collapse_snapshots(snapshots: DataFrame) -> DataFrame:
    """Per source: license (null if the rows disagree), revision ``category=revision;...`` by category, oldest fetched_at."""
    spdx = F.lower(F.trim("license"))
    g = snapshots.groupBy("source").agg(F.countDistinct(spdx).alias("n"), F.min_by("license", "category").alias("l"), F.array_sort(F.collect_list(F.concat_ws("=", "category", "revision"))).alias("r"), F.min("fetched_at").alias("fetched_at"))
    return g.select("source", F.when(F.col("n") == 1, F.col("l")).alias("license"), F.array_join("r", ";").alias("revision"), "fetched_at")


def output_license(snapshots: DataFrame) -> DataFrame:
    """The least permissive license of all; UNKNOWN for none or one without a rank."""
    known = F.array(*[F.lit(x.lower()) for x in LICENSE_RANK])
    at = F.array_position(known, F.lower(F.trim(F.coalesce("license", F.lit("")))))
    worst = F.max(F.when(at == 0, 99).otherwise(at))
    return snapshots.agg(F.coalesce(F.get(F.array(*[F.lit(x) for x in LICENSE_RANK]), worst.cast("int") - 1), F.lit("UNKNOWN")).alias("output_license"))


# --- gates: one-row frames (gate, passed, detail) ---------------------------------------------------------------------


def _fraction(x: float) -> bool:
    return 0.0 <= x <= 1.0  # false for NaN


def _gate(name: str, passed: Column, detail: Column) -> list[Column]:
    return [F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.cast("double").alias("measured")]


def shrinkage_gate(counts: DataFrame, limit: float, floor: int) -> DataFrame:
    """``counts``: one row (previous or null, current).  The floor first, then the drop (the limit itself passes)."""
    drop = (F.col("previous") - F.col("current")) / F.col("previous")
    ok = (F.col("current") >= floor) & (F.col("previous").isNull() | (F.col("previous") == 0) | (drop <= limit)) & F.lit(_fraction(limit))
    return counts.select(*_gate("shrinkage", ok, drop))


def growth_gate(current: DataFrame, previous: DataFrame, limit: float) -> DataFrame:
    """New keys, not net growth, as a share of the previous keys."""
    new = current.select("domain").distinct().join(previous.select("domain").distinct().hint("merge"), "domain", "left_anti").agg(F.count("*").alias("new"))
    both = new.crossJoin(previous.select("domain").distinct().agg(F.count("*").alias("old")))  # one row each
    share = F.col("new") / F.when(F.col("old") > 0, F.col("old"))
    return both.select(*_gate("growth", (F.col("old") == 0) | ((share <= limit) & F.lit(_fraction(limit))), share))


def control_hits(merged: DataFrame, control: DataFrame) -> DataFrame:
    """Control names (value) in the build, repeated ones repeatedly: domain, n_sources."""
    names = control.select(normalize_domain(F.col("value")).alias("domain")).where("domain is not null")
    return names.join(merged.select("domain", F.size("sources").alias("n_sources")).hint("merge"), "domain")


def review_queue(merged: DataFrame, control: DataFrame, excluded: DataFrame) -> DataFrame:
    """Hits that fewer than two sources corroborate, without the exclusions."""
    out = excluded.select(normalize_domain(F.col("value")).alias("domain")).distinct()
    return control_hits(merged, control).where("n_sources < 2").join(side(out), "domain", "left_anti")


def false_positive_gate(merged: DataFrame, control: DataFrame, excluded: DataFrame, limit: float = 0.005, least: int = 1000) -> DataFrame:
    """Queue size over valid control names; an empty control set passes only where none is asked for."""
    queue = review_queue(merged, control, excluded).agg(F.count("*").alias("queue"))
    size = control.select(normalize_domain(F.col("value")).alias("d")).agg(F.count("d").alias("size"))
    rate = F.col("queue") / F.when(F.col("size") > 0, F.col("size"))
    ok = (F.col("size") >= least) & F.lit(_fraction(limit)) & (rate.isNull() | (rate <= limit))
    return queue.crossJoin(size).select(*_gate("false_positive", ok, rate))  # one row each


def size_gate(n_bytes: DataFrame, limit: int) -> DataFrame:
    return n_bytes.agg(F.sum("bytes").alias("b")).select(*_gate("size", F.coalesce("b", F.lit(0)) <= limit, F.col("b")))


def license_gate(merged: DataFrame, snapshots: DataFrame, allowed: DataFrame) -> DataFrame:
    """Duplicate snapshots, then sources without one, then licences that aren't allowed: measured counts the first kind found."""
    spdx = lambda c: F.lower(F.trim(c))
    twice = snapshots.groupBy("source").count().where("count > 1").agg(F.count("*").alias("twice"))
    missing = merged.select(F.explode("sources").alias("source")).distinct().join(snapshots.select("source").hint("merge"), "source", "left_anti").agg(F.count("*").alias("missing"))
    bad = snapshots.select(spdx(F.coalesce("license", F.lit(""))).alias("l")).join(side(allowed.select(spdx(F.col("value")).alias("l")).distinct()), "l", "left_anti").agg(F.count("*").alias("bad"))
    one = twice.crossJoin(missing).crossJoin(bad)  # one row each
    first = F.when(F.col("twice") > 0, F.col("twice")).when(F.col("missing") > 0, F.col("missing")).otherwise(F.col("bad"))
    return one.select(*_gate("license", first == 0, first))


def build_report(merged: DataFrame, n_bytes: DataFrame) -> DataFrame:
    """One row: entry_count, combinations of provenance, bytes and bytes an entry of a published list (``n_bytes``: bytes)."""
    counts = merged.agg(F.count("*").alias("entry_count"), F.countDistinct("sources", "categories", "scope").alias("combinations"))
    return counts.crossJoin(n_bytes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))).select("*", (F.col("bytes") / F.when(F.col("entry_count") > 0, F.col("entry_count"))).alias("bytes_per_entry"))  # one row each


def all_gates(gates: list[DataFrame]) -> DataFrame:
    every = gates[0]
    for g in gates[1:]:
        every = every.unionByName(g)
    return every


def fold_overlay(merged: DataFrame, adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Planned in the reference: overlay additions joined in, removals taken out."""
    return merged.join(removes.select("domain").distinct().hint("merge"), "domain", "left_anti").unionByName(adds.join(merged.select("domain").hint("merge"), "domain", "left_anti"))


def sorted_keys(merged: DataFrame, partitions: int) -> DataFrame:
    """The list in key order over range partitions, for sorted output files without a single task."""
    return merged.repartitionByRange(partitions, "domain").sortWithinPartitions("domain")
