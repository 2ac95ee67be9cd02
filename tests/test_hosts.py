"""Host and address rules, precedence, liveness: golden cases, invariance, plans."""

import ipaddress
import random

import pytest

from policyspark.functions import joins
from policyspark.operators import hosts as hs, liveness as lv


def hosts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "host string")


def specific(spark, rules, *names):
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rules)], "seq int, domain string, action string")
    return {x.host: x.action for x in hs.most_specific(hosts(spark, *names), r).collect()}


def test_most_specific_rule(spark):
    assert specific(spark, [("evil.com", "block")], "deep.sub.evil.com") == {"deep.sub.evil.com": "block"}
    assert specific(spark, [("example.com", "block"), ("safe.example.com", "allow")], "safe.example.com", "evil.example.com") == {"safe.example.com": "allow", "evil.example.com": "block"}
    assert specific(spark, [("cdn.example.com", "block")], "example.com") == {}
    assert specific(spark, [("adult", "block")], "site.adult") == {"site.adult": "block"}
    assert specific(spark, [("a.com", "block"), ("a.com", "allow")], "a.com") == {"a.com": "allow"}


def test_list_lookup(spark):
    m = spark.createDataFrame([("www.example.com", "exact_host"), ("apex.com", "apex")], "domain string, scope string")
    got = {r.host: r.domain for r in hs.listed(hosts(spark, "www.example.com", "example.com", "x.www.example.com", "deep.sub.apex.com", "apexzzz.com", "apex.com", None), m).collect()}
    assert got == {"www.example.com": "www.example.com", "deep.sub.apex.com": "apex.com", "apex.com": "apex.com"}


def test_precedence(spark):
    m = spark.createDataFrame([("bad.com", "apex")], "domain string, scope string")
    allow = spark.createDataFrame([("ok.bad.com",)], "domain string")
    rules = spark.createDataFrame([(1, "x.bad.com", "proxy")], "seq int, domain string, action string")
    overlay = spark.createDataFrame([("gone.bad.com", "remove"), ("new.com", "add")], "domain string, change string")
    names = ("a.ok.bad.com", "x.bad.com", "y.bad.com", "gone.bad.com", "new.com", "good.com", None)
    got = {r.host: (r.action, r.decided_by) for r in hs.resolve(hosts(spark, *names), allow, rules, m, overlay).collect()}
    assert got == {"a.ok.bad.com": ("allow", "allowlist"), "x.bad.com": ("proxy", "rule"), "y.bad.com": ("block", "list"), "gone.bad.com": ("proxy", "overlay"), "new.com": ("block", "overlay"), "good.com": ("proxy", "default"), None: ("proxy", "default")}


def test_no_nested_loops(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    m = spark.createDataFrame([("bad.com", "apex")], "domain string, scope string")
    plan = hs.listed(hosts(spark, "a.bad.com"), m)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def prefixes(spark, rules, addresses, parts=2):
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rules)], "seq int, cidr string, action string").repartition(parts)
    a = spark.createDataFrame([(x,) for x in addresses], "address string").repartition(parts)
    return {x.address: x.action for x in hs.longest_prefix(a, r).collect()}


def test_longest_prefix(spark):
    rules = [("192.168.0.0/16", "block"), ("192.168.1.0/24", "allow"), ("9.9.9.9", "block"), ("2001:db8::/33", "block")]
    got = prefixes(spark, rules, ["192.168.1.5", "192.168.2.5", "9.9.9.9", "9.9.9.8", "2001:db8::1", "2001:db8:8000::1", "::ffff:192.168.1.9", "rubbish", None])
    assert got == {"192.168.1.5": "allow", "192.168.2.5": "block", "9.9.9.9": "block", "9.9.9.8": "proxy", "2001:db8::1": "block", "2001:db8:8000::1": "proxy", "::ffff:192.168.1.9": "allow", "rubbish": "proxy", None: "proxy"}
    assert prefixes(spark, [("0.0.0.0/0", "block")], ["1.2.3.4", "::1"]) == {"1.2.3.4": "block", "::1": "block"}


@pytest.mark.parametrize("parts", [1, 5])
def test_longest_prefix_equals_brute_force(spark, parts):
    rng = random.Random(3)
    rules = [(f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}/{rng.choice([8, 12, 15, 16, 19, 22, 24, 27, 31, 32])}", rng.choice(["block", "allow"])) for _ in range(60)]
    ips = [f"10.{rng.randrange(3)}.{rng.randrange(4)}.{rng.randrange(256)}" for _ in range(200)]

    def plain(ip):
        fit = [(ipaddress.ip_network(c, strict=False).prefixlen, -i, a) for i, (c, a) in enumerate(rules) if ipaddress.ip_address(ip) in ipaddress.ip_network(c, strict=False)]
        return max(fit)[2] if fit else "proxy"

    assert prefixes(spark, rules, ips, parts) == {ip: plain(ip) for ip in ips}


def verdict(spark, rows):
    a = spark.createDataFrame([("d", *r) for r in rows], "domain string, resolver string, record string, kind string, reason string, extended_error int")
    r = lv.corroborated(lv.combined(a), "p", "s").first()
    return r.verdict, r.reason


def nx(resolver, error=None):
    return [(resolver, "A", "nxdomain", None, error), (resolver, "AAAA", "nxdomain", None, None)]


def unknown(resolver, why):
    return [(resolver, "A", "unknown", why, None), (resolver, "AAAA", "nxdomain", None, None)]


def test_liveness(spark):
    up = lambda r: [(r, "A", "unknown", "x", None), (r, "AAAA", "resolved", None, None)]
    assert verdict(spark, nx("p") + nx("s")) == ("dead", None)
    assert verdict(spark, up("p") + nx("s")) == ("alive", None)
    assert verdict(spark, nx("p") + unknown("s", "timeout")) == ("unknown", "uncorroborated_dead")
    assert verdict(spark, unknown("p", "refused") + unknown("s", "timeout")) == ("unknown", "refused")
    assert verdict(spark, nx("p", 15) + nx("s", 15)) == ("unknown", "filtered_by_resolver")


def test_due_prune_and_cache(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",), ("n",)], "domain string")
    cache = spark.createDataFrame([("a", 1000, "dead", None, 100), ("b", 1001, "alive", None, None), ("c", 10000, "dead", None, None)], "domain string, last_checked long, verdict string, reason string, first_dead_at long")
    assert sorted(r.domain for r in lv.due_set(m, cache, 1300, 300).collect()) == ["a", "n"]
    new = spark.createDataFrame([("a", "dead", None), ("b", "dead", None), ("c", "unknown", "timeout"), ("n", "alive", None)], "domain string, verdict string, reason string")
    after = {r.domain: (r.last_checked, r.verdict, r.first_dead_at) for r in lv.updated_cache(cache, new, 2000).collect()}
    assert after == {"a": (2000, "dead", 100), "b": (2000, "dead", 2000), "c": (2000, "unknown", None), "n": (2000, "alive", None)}
    names = spark.createDataFrame([("x.onion", 5, "dead", None, 0), ("x.com", 5, "dead", None, 0), ("y.com", 5, "dead", None, None)], cache.schema)
    assert [r.domain for r in lv.pruned_set(names.select("domain"), names, 100, 100).collect()] == ["x.com"]


def test_canary(spark):
    control = spark.createDataFrame([(f"d{i:02}", "alive") for i in range(25)], "domain string, expected string")
    r = lv.canary(control, spark.createDataFrame([("d00", "alive")], "domain string, verdict string")).first()
    assert not r.passed and r.n_mismatches == 24 and len(r.named) == 20 and r.remainder == "...and 4 more"
