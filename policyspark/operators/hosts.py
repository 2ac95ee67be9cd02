"""Host and address policy: suffix rules, list lookups, precedence, longest-prefix match."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.domains import ip_key, suffixes
from ..functions.joins import side
from .domains import APEX

BLOCK, ALLOW, PROXY = "block", "allow", "proxy"


def suffix_explode(hosts: DataFrame) -> DataFrame:
    """host, suffix, depth of each distinct host and its parents."""
    return hosts.select("host").where("host is not null").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("s")).select("host", "s.*")


def most_specific(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, action of the deepest rule (seq, domain, action) that is the host or a parent; of equal rules the last."""
    hit = suffix_explode(hosts).join(side(rules.select("seq", F.col("domain").alias("suffix"), "action")), "suffix")
    return hit.groupBy("host").agg(F.max_by("action", F.struct("depth", "seq")).alias("action"))


def listed(hosts: DataFrame, merged: DataFrame) -> DataFrame:
    """host and the deepest list entry (domain) that blocks it: an apex that is the host or a parent, or the very host."""
    hit = suffix_explode(hosts).join(side(merged.select(F.col("domain").alias("suffix"), "scope")), "suffix").where((F.col("scope") == APEX) | (F.col("suffix") == F.col("host")))
    return hit.groupBy("host").agg(F.max_by("suffix", "depth").alias("domain"))


def allowlisted(hosts: DataFrame, allowlist: DataFrame) -> DataFrame:
    """The hosts of which they or a parent are on the list (domain)."""
    return suffix_explode(hosts).join(side(allowlist.select(F.col("domain").alias("suffix")).distinct()), "suffix", "left_semi").select("host").distinct()


def policy_rows(allowlist: DataFrame, rules: DataFrame, merged: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """A policy as one table: suffix, kind (allowlist, rule, overlay or list), seq, act, apex (whether it covers subdomains).

    ``overlay`` has domain and change (add or remove): a removal ends the search with the default.
    """
    own = lambda df, kind, seq, action, apex: df.select(F.col("domain").alias("suffix"), F.lit(kind).alias("kind"), seq.alias("seq"), action.alias("act"), apex.alias("apex"))
    zero, yes = F.lit(0).cast("long"), F.lit(True)
    every = own(allowlist, "allowlist", zero, F.lit(ALLOW), yes).unionAll(own(rules, "rule", F.col("seq").cast("long"), F.col("action"), yes)).unionAll(own(merged, "list", zero, F.lit(BLOCK), F.col("scope") == APEX))
    if overlay is not None:
        every = every.unionAll(own(overlay, "overlay", F.monotonically_increasing_id(), F.when(F.col("change") == "add", BLOCK).otherwise(PROXY), yes))
    return every


def decided(hosts: DataFrame, policy: DataFrame) -> DataFrame:
    """Per distinct host: action and decided_by after :func:`policy_rows`.  Allowlist, then explicit rule, then (planned) overlay, then
    list; else proxy, also for a null host.
    """
    h = hosts.select("host").distinct()
    hit = suffix_explode(h).join(side(policy), "suffix").where(F.col("apex") | (F.col("suffix") == F.col("host")))
    # the first kind that has a hit decides, by its deepest and then its last rule
    rank = F.array_position(F.array(*[F.lit(k) for k in ("list", "overlay", "rule", "allowlist")]), F.col("kind"))
    best = hit.groupBy("host").agg(F.max_by(F.struct("act", "kind"), F.struct(rank, "depth", "seq")).alias("b"))
    return h.join(best.hint("merge"), "host", "left").select("host", F.coalesce("b.act", F.lit(PROXY)).alias("action"), F.coalesce("b.kind", F.lit("default")).alias("decided_by"))


def resolve(hosts: DataFrame, allowlist: DataFrame, rules: DataFrame, merged: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """Per distinct host: action and decided_by."""
    return decided(hosts, policy_rows(allowlist, rules, merged, overlay))


def provenance_of(blocked: DataFrame, keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Why the listed hosts (host, domain) are blocked: sources, categories, scope."""
    return blocked.join(keys.hint("merge"), "domain").join(side(dictionary), "id").drop("id")


def ip_key_any(address: Column) -> Column:
    """An IPv4 or IPv6 address as 32 lower hex digits; only addresses with a colon go to Python."""

    @F.pandas_udf("string")
    def v6(s: pd.Series) -> pd.Series:
        import ipaddress

        def one(x):
            try:
                return None if x is None else f"{int(ipaddress.IPv6Address(x)):032x}"
            except ValueError:
                return None

        return s.map(one)

    colon = F.contains(address, F.lit(":"))
    return F.coalesce(ip_key(address), F.when(colon, v6(F.when(colon, address))))


def _masked(key: Column, length: Column) -> Column:
    """The first ``length`` bits of a hex key: its whole digits, then the rest of a digit."""
    whole, rest = (length / 4).cast("int"), length % 4
    digit = F.conv(F.substr(key, whole + 1, F.lit(1)), 16, 10).cast("int")
    return F.concat(F.substr(key, F.lit(1), whole), F.when(rest > 0, F.call_function("shiftright", digit, (F.lit(4) - rest).cast("int")).cast("string")).otherwise(""))


def cidr_rules(rules: DataFrame) -> DataFrame:
    """``rules`` (seq, cidr, action) with key, bits (of 128) and raw (the length as written, which is what precedence goes by).

    A bare address is a host route; ``/0`` matches every address of both families.
    """
    p = F.split("cidr", "/")
    v4 = ~F.contains("cidr", F.lit(":"))
    raw = F.coalesce(F.get(p, F.lit(1)).try_cast("int"), F.when(v4, 32).otherwise(128))
    bits = F.when(raw == 0, 0).when(v4, raw + 96).otherwise(raw)
    return rules.select("seq", "action", ip_key_any(F.get(p, F.lit(0))).alias("key"), raw.alias("raw"), bits.alias("bits")).where("key is not null")


def longest_prefix(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Per distinct address: action of the longest matching prefix (the first rule of equal ones), else proxy.

    One equi-join: an address is looked up once for each prefix length that occurs.
    """
    r = cidr_rules(rules)
    r = r.select("seq", "action", "raw", "bits", _masked(F.col("key"), F.col("bits")).alias("prefix"))
    lengths = [x.bits for x in r.select("bits").distinct().collect()]  # 129 at most
    a = addresses.select("address").distinct().withColumn("key", ip_key_any(F.col("address")))
    probes = a.where("key is not null").select("address", "key", F.explode(F.array(*[F.lit(b) for b in lengths]).cast("array<int>")).alias("bits"))
    hit = probes.select("address", "bits", _masked(F.col("key"), F.col("bits")).alias("prefix")).join(side(r), ["bits", "prefix"])
    best = hit.groupBy("address").agg(F.max_by("action", F.struct("raw", -F.col("seq"))).alias("action"))
    return a.select("address").join(best.hint("merge"), "address", "left").select("address", F.coalesce("action", F.lit(PROXY)).alias("action"))


def flow_actions(flows: DataFrame, host_actions: DataFrame, ip_actions: DataFrame) -> DataFrame:
    """``flows`` (.., host, address, port): the host's action where TLS names one, else the address's; other ports are allowed."""
    h = host_actions.select("host", F.col("action").alias("by_host"))
    i = ip_actions.select("address", F.col("action").alias("by_ip"))
    act = F.when(~F.col("port").isin(443, 80), ALLOW).otherwise(F.coalesce("by_host", "by_ip", F.lit(PROXY)))
    return flows.join(h.hint("merge"), "host", "left").join(i.hint("merge"), "address", "left").withColumn("action", act).drop("by_host", "by_ip")
