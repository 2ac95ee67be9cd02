"""Queries on domain lists, hosts and addresses, on list lines and rules derived from ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.domains import host_of_url, looks_like_personal_name, normalize_domain
from ..operators import domains as dm, hosts as hs, liveness as lv
from ..sources import lists as ls
from ..sources.state_tables import Published
from ..streaming import gates as sg
from .tables import local_table, scratch_dir, table

SUFFIXES = ["com", "net", "org", "co.uk", "blogspot.com"]
DENIED = ["Blog.ththan.example.net."]
_VALUE = """CASE page_id % 11 WHEN 0 THEN '# note' WHEN 1 THEN '   ' WHEN 2 THEN concat('*.', host) WHEN 3 THEN '10.0.0.1'
  WHEN 4 THEN concat(upper(host), '. # seen') WHEN 5 THEN concat('*.', regexp_extract(host, '([a-z]+[.][a-z]+)$', 1)) WHEN 6 THEN concat('a..', host) ELSE host END"""
_LINES = f"""SELECT concat('src', page_id % 3) AS source, CASE page_id % 4 WHEN 0 THEN 'adult' WHEN 1 THEN 'gambling' ELSE 'social' END AS category,
  CASE WHEN page_id % 3 = 0 THEN 'hosts' ELSE 'plain' END AS format,
  CASE WHEN page_id % 3 = 0 AND page_id % 11 > 1 AND page_id % 13 > 0 THEN concat('0.0.0.0 ', {_VALUE}) ELSE {_VALUE} END AS value, page_id AS line_no FROM hosted"""
_HOSTED_SQL = "hosted AS (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host FROM pages)"
_LINES_SQL = f"{_HOSTED_SQL}, line AS ({_LINES})"
_PARSED_SQL = (
    _LINES_SQL
    + r""", cut AS (SELECT *, trim(regexp_replace(value, '(?s)#.*', '')) AS t FROM line),
field AS (SELECT *, CASE WHEN format = 'hosts' THEN string_split_regex(t, '\s+')[2] ELSE string_split_regex(t, '\s+')[1] END AS f FROM cut),
tagged AS (SELECT *, CASE WHEN f LIKE '*._%' THEN substr(f, 3) ELSE f END AS domain, CASE WHEN f LIKE '*._%' THEN 'apex' ELSE 'none' END AS hint,
  CASE WHEN t = '' THEN 'blank' WHEN f IS NULL THEN 'malformed' WHEN regexp_matches(f, '^\d+\.\d+\.\d+\.\d+$') THEN 'ip_literal' ELSE 'entry' END AS outcome FROM field)"""
)
_MERGE_SQL = (
    _PARSED_SQL
    + r""", norm AS (SELECT source, category, hint, CASE WHEN k <> '' AND NOT regexp_matches(k, '[\x00-\x20/:@]') AND len(list_filter(string_split(k, '.'), lambda x: length(x) NOT BETWEEN 1 AND 63)) = 0 THEN k END AS domain
  FROM (SELECT *, lower(regexp_replace(domain, '\.$', '')) AS k FROM tagged WHERE outcome = 'entry')),
done AS (SELECT *, CASE WHEN domain IS NULL THEN 'not_normal' WHEN domain = 'blog.ththan.example.net' THEN 'denylisted' ELSE 'merged' END AS outcome,
  CASE WHEN hint = 'apex' AND regexp_matches(domain, '^[^.]+\.(com|net|org)$') THEN 'apex' ELSE 'exact_host' END AS scope FROM norm),
merged AS (SELECT domain, CASE WHEN bool_or(scope = 'apex') THEN 'apex' ELSE 'exact_host' END AS scope, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(DISTINCT source) AS n_sources FROM done WHERE outcome = 'merged' GROUP BY domain)"""
)


def hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", host_of_url(F.col("url")).alias("host"))


def list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_LINES.replace("FROM hosted", "FROM {hosted}"), hosted=hosted(spark, sf_dir))


def _param(spark: SparkSession, values: list[str], name: str = "value") -> DataFrame:
    return local_table(spark, [(v,) for v in values], f"{name} string")


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.classified(ls.raw_entries(list_lines(spark, sf_dir)), _param(spark, SUFFIXES, "rule"), _param(spark, DENIED))


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dm.merge(done(spark, sf_dir))


def parse_report(spark, sf_dir):
    return ls.parse_report(list_lines(spark, sf_dir))


def merge_report(spark, sf_dir):
    return dm.merge_report(done(spark, sf_dir))


def merged_list(spark, sf_dir):
    return merged(spark, sf_dir).select("domain", "scope", F.array_join("sources", ",").alias("sources"), F.array_join("categories", ",").alias("categories"))


def provenance_lookup(spark, sf_dir):
    m = merged(spark, sf_dir)
    dictionary, keys = dm.provenance(m)
    blocked = hs.listed(hosted(spark, sf_dir), m)
    return hs.provenance_of(blocked, keys, dictionary).select("host", "domain", "scope", F.array_join("sources", ",").alias("sources"))


def category_filter(spark, sf_dir):
    return dm.filter_by_category(merged(spark, sf_dir), ["adult"]).select("domain")


def personal_names(spark, sf_dir):
    return hosted(spark, sf_dir).select("host").distinct().select("host", looks_like_personal_name(F.substring_index("host", ".", 1)).alias("flagged"))


def corroboration_profile(spark, sf_dir):
    return merged(spark, sf_dir).groupBy(F.size("sources").alias("n_sources")).agg(F.count("*").alias("n"))


def build_gates(spark, sf_dir):
    m = merged(spark, sf_dir)
    old = hosted(spark, sf_dir).where("page_id % 2 = 0").select(F.col("host").alias("domain")).distinct()
    control = hosted(spark, sf_dir).where("page_id % 5 = 0").select(F.col("host").alias("value"))
    counts = m.agg(F.count("*").alias("current")).crossJoin(old.agg(F.count("*").alias("previous")))  # one row each
    snaps = local_table(spark, [("src0", "MIT"), ("src1", " mit "), ("src2", "GPL-3.0")], "source string, license string")
    gates = [
        dm.shrinkage_gate(counts, 0.1, 5), dm.growth_gate(m, old, 0.1), dm.false_positive_gate(m, control, _param(spark, ["nothing.example"]), 0.005, 10),
        dm.license_gate(m, snaps, _param(spark, ["MIT"])),
    ]
    return dm.all_gates(gates).withColumn("measured", F.round("measured", 6))


BUILD_GATES_SQL = (
    "WITH "
    + _MERGE_SQL
    + r""", old AS (SELECT DISTINCT host AS domain FROM hosted WHERE page_id % 2 = 0), n AS (SELECT (SELECT count(*) FROM merged) AS cur, (SELECT count(*) FROM old) AS prev),
grown AS (SELECT count(*) AS c FROM merged WHERE domain NOT IN (SELECT domain FROM old)),
control AS (SELECT host FROM hosted WHERE page_id % 5 = 0),
queue AS (SELECT count(*) AS c FROM control JOIN merged ON host = domain WHERE n_sources < 2)
SELECT 'shrinkage' AS gate, cur >= 5 AND (prev - cur) / prev <= 0.1 AS passed, round((prev - cur) / prev, 6)::DOUBLE AS measured FROM n
UNION ALL SELECT 'growth', c / prev <= 0.1, round(c / prev, 6) FROM grown, n
UNION ALL SELECT 'false_positive', (SELECT count(*) FROM control) >= 10 AND c / (SELECT count(*) FROM control) <= 0.005, round(c / (SELECT count(*) FROM control), 6) FROM queue
UNION ALL SELECT 'license', false, 1.0"""
)


def review_queue(spark, sf_dir):
    control = hosted(spark, sf_dir).where("page_id % 5 = 0").select(F.col("host").alias("value"))
    return dm.review_queue(merged(spark, sf_dir), control, _param(spark, ["tionsh.example.net"]))


RULES = [(1, "example.com", "block"), (2, "blog.ththan.example.com", "allow"), (3, "example.net", "proxy"), (4, "org", "block"), (5, "tionsh.example.net", "block"), (6, "example.net", "block")]
ALLOWED = ["m.therou.example.com", "example.org"]
OVERLAY = [("m.ththth.example.net", "remove"), ("therha.example.com", "add")]


def rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, RULES, "seq int, domain string, action string")


def host_rules(spark, sf_dir):
    h = hosted(spark, sf_dir)
    return h.select("page_id", "host").join(hs.most_specific(h, rules(spark)).hint("merge"), "host", "left").select("page_id", "host", "action")


_VALUES_RULES = ", ".join(map(str, RULES))
HOST_RULES_SQL = f"""WITH {_HOSTED_SQL}, r(seq, domain, action) AS (VALUES {_VALUES_RULES}),
b AS (SELECT page_id, first(action ORDER BY length(domain) DESC, seq DESC) AS action FROM hosted JOIN r ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id)
SELECT page_id, host, action FROM hosted LEFT JOIN b USING (page_id)"""


def host_list(spark, sf_dir):
    return hs.listed(hosted(spark, sf_dir), merged(spark, sf_dir))


def host_policy(spark, sf_dir):
    allow = _param(spark, ALLOWED, "domain")
    few = rules(spark).where("seq in (2, 3)")
    overlay = local_table(spark, OVERLAY, "domain string, change string")
    return hs.resolve(hosted(spark, sf_dir), allow, few, merged(spark, sf_dir), overlay)


HOST_POLICY_SQL = (
    "WITH "
    + _MERGE_SQL
    + f""", h AS (SELECT DISTINCT host FROM hosted), r(seq, domain, action) AS (VALUES {", ".join(str(x) for x in RULES if x[0] in (2, 3))}),
o(domain, change) AS (VALUES {", ".join(map(str, OVERLAY))}),
j AS (SELECT host, EXISTS (SELECT 1 FROM (VALUES ('{ALLOWED[0]}'), ('{ALLOWED[1]}')) a(d) WHERE host = d OR ends_with(host, '.' || d)) AS al,
  (SELECT first(action ORDER BY length(domain) DESC) FROM r WHERE host = domain OR ends_with(host, '.' || domain)) AS ra,
  (SELECT first(change ORDER BY length(domain) DESC) FROM o WHERE host = domain OR ends_with(host, '.' || domain)) AS oc,
  EXISTS (SELECT 1 FROM merged m WHERE host = m.domain OR (m.scope = 'apex' AND ends_with(host, '.' || m.domain))) AS li FROM h)
SELECT host, CASE WHEN al THEN 'allow' WHEN ra IS NOT NULL THEN ra WHEN oc = 'add' THEN 'block' WHEN oc = 'remove' THEN 'proxy' WHEN li THEN 'block' ELSE 'proxy' END AS action,
  CASE WHEN al THEN 'allowlist' WHEN ra IS NOT NULL THEN 'rule' WHEN oc IS NOT NULL THEN 'overlay' WHEN li THEN 'list' ELSE 'default' END AS decided_by FROM j"""
)

def stream_host_policy(spark, sf_dir):
    """host_policy of a stream of pages, by a policy that has been published."""
    root = scratch_dir(spark)
    policy = Published(spark, f"{root}/policy")
    overlay = local_table(spark, OVERLAY, "domain string, change string")
    policy.publish(hs.policy_rows(_param(spark, ALLOWED, "domain"), rules(spark).where("seq in (2, 3)"), merged(spark, sf_dir), overlay), 1)
    pages = spark.readStream.schema(table(spark, sf_dir, "pages").schema).parquet(f"{sf_dir}/pages.parque[t]")
    flows = pages.select("page_id", host_of_url(F.col("url")).alias("host"))
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")  # noqa: E731  a batch that is run again takes its own place
    sg.policy_stream(flows, policy, write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/rows").drop("batch", "policy_version")


STREAM_POLICY_SQL = HOST_POLICY_SQL.replace("SELECT host, CASE WHEN al", "SELECT page_id, j.host, CASE WHEN al").replace("AS decided_by FROM j", "AS decided_by FROM j JOIN hosted p ON j.host IS NOT DISTINCT FROM p.host")

def host_forms(spark, sf_dir):
    """Hosts spoofed by full-width letters and stops, in capitals and with a root dot, as their keys; umlauts give punycode."""
    h = hosted(spark, sf_dir).where("host is not null")
    odd = F.when(F.col("page_id") % 3 == 0, F.translate("host", "abcde.", "ａｂｃｄｅ。")).when(F.col("page_id") % 3 == 1, F.concat(F.upper("host"), F.lit("."))).otherwise(F.concat(F.lit("Bücher."), F.col("host")))
    return h.select("page_id", normalize_domain(odd).alias("domain"))


HOST_FORMS_SQL = f"WITH {_HOSTED_SQL} SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'xn--bcher-kva.' || host ELSE host END AS domain FROM hosted WHERE host IS NOT NULL"

CIDRS = [(1, "10.0.0.0/8", "block"), (2, "10.1.0.0/16", "allow"), (3, "10.1.2.3", "block"), (4, "10.1.2.0/23", "proxy"), (5, "2001:db8::/32", "block"), (6, "10.1.0.0/16", "block"), (7, "10.3.0.0/20", "allow")]
_IP = "concat('10.', cast(event_id % 5 as {s}), '.', cast(event_id % 29 as {s}), '.', cast(event_id % 7 as {s}))"


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(_IP.format(s="string")).alias("address"))


def cidr_policy(spark, sf_dir):
    return hs.longest_prefix(addresses(spark, sf_dir), local_table(spark, CIDRS, "seq int, cidr string, action string"))


CIDR_SQL = f"""WITH a AS (SELECT DISTINCT {_IP.format(s='varchar')} AS address, event_id % 5 AS b, event_id % 29 AS c, event_id % 7 AS d FROM events),
n AS (SELECT address, (10 * 16777216 + b * 65536 + c * 256 + d)::BIGINT AS x FROM a),
r(seq, base, len, action) AS (VALUES (1, 167772160, 8, 'block'), (2, 167837696, 16, 'allow'), (3, 167838211, 32, 'block'), (4, 167838208, 23, 'proxy'), (6, 167837696, 16, 'block'), (7, 167968768, 20, 'allow'))
SELECT address, coalesce(first(action ORDER BY len DESC, seq) FILTER (action IS NOT NULL), 'proxy') AS action FROM n LEFT JOIN r ON x // (1 << (32 - len)) = base // (1 << (32 - len)) GROUP BY address"""


def body_routes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"), F.length("html").alias("n"))
    kind = F.when(F.col("page_id") % 4 == 0, "image/png").otherwise("text/html; charset=utf-8")
    path = F.when(F.col("page_id") % 9 == 0, F.concat("path", F.lit("/v.ts"))).otherwise(F.col("path"))
    return p.select("page_id", ls.body_route(path, kind, F.col("n"), 10_000).alias("route"))


BODY_ROUTES_SQL = "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'video_segment' WHEN length(html) > 10000 THEN 'too_large' WHEN page_id % 4 = 0 THEN 'image' ELSE 'html' END AS route FROM pages"

# --- liveness on answers derived from page numbers


_ANSWERS = """SELECT host AS domain, r AS resolver, rec AS record,
  CASE WHEN (length(host) + n) % 4 = 0 THEN 'resolved' WHEN (length(host) + n) % 4 = 3 AND rec = 'AAAA' THEN 'unknown' ELSE 'nxdomain' END AS kind,
  CASE WHEN (length(host) + n) % 4 = 3 AND rec = 'AAAA' THEN 'timeout' END AS reason, CASE WHEN length(host) % 5 = 0 AND r = 'two' THEN 15 END AS extended_error
FROM {h}, (VALUES ('one', 0), ('two', 1)) AS v(r, n), (VALUES ('A'), ('AAAA')) AS w(rec)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = hosted(spark, sf_dir).select("host").distinct()
    answers = spark.sql(_ANSWERS.replace("{h}", "{names}"), names=names)
    return lv.corroborated(lv.combined(answers), "one", "two")


def liveness_verdicts(spark, sf_dir):
    return verdicts(spark, sf_dir)


_LIVE_SQL = (
    f"WITH {_HOSTED_SQL}, names AS (SELECT DISTINCT host FROM hosted), ans AS ({_ANSWERS.format(h='names')}),"
    + r""" g AS (SELECT domain, resolver, bool_or(kind = 'resolved') AS up, bool_and(kind = 'nxdomain') AS nx, bool_or(extended_error = 15) AS filtered, max(reason) AS reason FROM ans GROUP BY ALL),
one AS (SELECT domain, resolver, CASE WHEN up THEN 'alive' WHEN nx AND NOT coalesce(filtered, false) THEN 'dead' ELSE 'unknown' END AS v,
  CASE WHEN up THEN NULL WHEN nx AND coalesce(filtered, false) THEN 'filtered_by_resolver' WHEN nx THEN NULL ELSE reason END AS r FROM g),
live AS (SELECT a.domain, CASE WHEN a.v = 'alive' OR b.v = 'alive' THEN 'alive' WHEN a.v = 'dead' AND b.v = 'dead' THEN 'dead' ELSE 'unknown' END AS verdict,
  CASE WHEN a.v = 'alive' OR b.v = 'alive' OR (a.v = 'dead' AND b.v = 'dead') THEN NULL WHEN a.v = 'dead' OR b.v = 'dead' THEN 'uncorroborated_dead' ELSE coalesce(a.r, b.r) END AS reason
  FROM one a JOIN one b ON a.domain = b.domain AND a.resolver = 'one' AND b.resolver = 'two')"""
)
_CACHE = "SELECT host AS domain, 1000 + length(host) * 10 AS last_checked, CASE WHEN length(host) % 2 = 0 THEN 'dead' ELSE 'alive' END AS verdict, cast(null as {s}) AS reason, CASE WHEN length(host) % 2 = 0 THEN 500 END AS first_dead_at FROM {h} WHERE length(host) % 3 > 0"
NOW, TTL, QUARANTINE = 1300, 100, 700  # a first death at 500 is due for pruning, one of this sweep is not


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CACHE.format(s="string", h="{names}"), names=hosted(spark, sf_dir).select("host").distinct())


def liveness_cache(spark, sf_dir):
    return lv.updated_cache(_cache(spark, sf_dir), verdicts(spark, sf_dir).where("length(domain) % 4 < 2"), NOW)


def liveness_pruned(spark, sf_dir):
    names = hosted(spark, sf_dir).select(F.col("host").alias("domain")).distinct()
    return lv.pruned_set(names, liveness_cache(spark, sf_dir), NOW, QUARANTINE)


def liveness_due(spark, sf_dir):
    names = hosted(spark, sf_dir).select(F.col("host").alias("domain")).distinct()
    return lv.due_set(names, _cache(spark, sf_dir), NOW, TTL)


def negative_outcomes(spark, sf_dir):
    return lv.negative_outcomes(verdicts(spark, sf_dir))


_CACHE_SQL = _LIVE_SQL + f""", old AS ({_CACHE.format(s='varchar', h='names')}), v AS (SELECT * FROM live WHERE length(domain) % 4 < 2),
cache AS (SELECT coalesce(o.domain, v.domain) AS domain, (CASE WHEN v.verdict IS NOT NULL THEN {NOW} ELSE last_checked END)::BIGINT AS last_checked,
  CASE WHEN v.verdict IS NOT NULL THEN v.verdict ELSE o.verdict END AS verdict, CASE WHEN v.verdict IS NOT NULL THEN v.reason ELSE o.reason END AS reason,
  (CASE WHEN v.verdict = 'dead' THEN coalesce(first_dead_at, {NOW}) WHEN v.verdict IS NOT NULL THEN NULL ELSE first_dead_at END)::BIGINT AS first_dead_at FROM old o FULL JOIN v ON o.domain = v.domain)"""

QUERIES = {
    "list_parse_report": parse_report, "list_merge_report": merge_report, "list_merged": merged_list, "list_provenance": provenance_lookup, "list_category_filter": category_filter,
    "list_personal_names": personal_names, "list_corroboration": corroboration_profile, "list_gates": build_gates, "list_review_queue": review_queue,
    "host_rules": host_rules, "host_list": host_list, "host_policy": host_policy, "stream_host_policy": stream_host_policy, "host_forms": host_forms, "cidr_policy": cidr_policy, "body_routes": body_routes,
    "liveness_verdicts": liveness_verdicts, "liveness_cache": liveness_cache, "liveness_pruned": liveness_pruned, "liveness_due": liveness_due, "liveness_negative": negative_outcomes,
}
SQL = {
    "list_parse_report": "WITH " + _PARSED_SQL + " SELECT source, outcome, count(*) AS n FROM tagged GROUP BY ALL UNION ALL SELECT source, 'wildcard', count(*) FROM tagged WHERE outcome = 'entry' AND hint = 'apex' GROUP BY source",
    "list_merge_report": "WITH " + _MERGE_SQL + " SELECT outcome, count(*) AS n FROM done GROUP BY outcome",
    "list_merged": "WITH " + _MERGE_SQL + " SELECT domain, scope, sources, categories FROM merged",
    "list_provenance": "WITH " + _MERGE_SQL + " SELECT host, first(domain ORDER BY length(domain) DESC) AS domain, first(m.scope ORDER BY length(domain) DESC) AS scope, first(sources ORDER BY length(domain) DESC) AS sources FROM (SELECT DISTINCT host FROM hosted) JOIN merged m ON host = domain OR (m.scope = 'apex' AND ends_with(host, '.' || domain)) GROUP BY host",
    "list_category_filter": "WITH " + _MERGE_SQL + " SELECT domain FROM merged WHERE categories LIKE '%adult%'",
    "list_personal_names": f"WITH {_HOSTED_SQL}, l AS (SELECT DISTINCT host, split_part(host, '.', 1) AS x FROM hosted) SELECT host, x NOT LIKE 'xn--%' AND len(list_filter(string_split_regex(x, '[-._]'), lambda t: t <> '')) BETWEEN 2 AND 4 AND regexp_matches(x, '^[A-Za-z._-]+$') AS flagged FROM l",
    "list_corroboration": "WITH " + _MERGE_SQL + " SELECT n_sources::INTEGER AS n_sources, count(*) AS n FROM merged GROUP BY n_sources",
    "list_gates": BUILD_GATES_SQL,
    "list_review_queue": "WITH " + _MERGE_SQL + " SELECT domain, n_sources::INTEGER AS n_sources FROM hosted JOIN merged ON host = domain WHERE page_id % 5 = 0 AND n_sources < 2 AND domain <> 'tionsh.example.net'",
    "host_rules": HOST_RULES_SQL,
    "host_list": "WITH " + _MERGE_SQL + " SELECT host, first(domain ORDER BY length(domain) DESC) AS domain FROM (SELECT DISTINCT host FROM hosted) JOIN merged m ON host = domain OR (m.scope = 'apex' AND ends_with(host, '.' || domain)) GROUP BY host",
    "host_policy": HOST_POLICY_SQL,
    "stream_host_policy": STREAM_POLICY_SQL,
    "host_forms": HOST_FORMS_SQL,
    "cidr_policy": CIDR_SQL,
    "body_routes": BODY_ROUTES_SQL,
    "liveness_verdicts": _LIVE_SQL + " SELECT * FROM live",
    "liveness_cache": _CACHE_SQL + " SELECT * FROM cache",
    "liveness_pruned": _CACHE_SQL + f" SELECT domain FROM cache WHERE verdict = 'dead' AND {NOW} - first_dead_at >= {QUARANTINE}",
    "liveness_due": _CACHE_SQL + f" SELECT host AS domain FROM names LEFT JOIN old ON host = old.domain WHERE last_checked IS NULL OR greatest({NOW} - last_checked, 0) >= {TTL}",
    "liveness_negative": _LIVE_SQL + " SELECT CASE WHEN verdict = 'dead' THEN 'dead' ELSE 'unknown:' || reason END AS kind, count(*) AS n, min(domain) AS first_domain, max(domain) AS last_domain FROM live WHERE verdict <> 'alive' GROUP BY 1",
}
