"""Queries on readers, writers, publication and small policy tables, on data derived from ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.domains import reversed_labels
from ..operators import domains as dm, evaluation as ev, hosts as hs, incremental as inc, liveness as lv
from ..sources import lists as ls
from ..sources.state_tables import Published
from . import lists
from .tables import events, local_table, scratch_dir, stored, table

_HOSTED = lists._HOSTED_SQL


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """A folder with <category>/domains and <category>/urls, as a category list is landed."""
    root = scratch_dir(spark)
    h = lists.hosted(spark, sf_dir)
    for k, category in enumerate(("adult", "gambling")):
        h.where(F.col("page_id") % 2 == k).select("host").write.text(f"{root}/{category}/domains")
        h.where(F.col("page_id") % 3 == k).select(F.when(F.col("page_id") % 5 == 0, F.lit("# none")).otherwise(F.concat("host", F.lit("/x"))).alias("value")).write.text(f"{root}/{category}/urls")
    return root


def category_dirs(spark, sf_dir):
    entries = ls.raw_entries(ls.read_category_dirs(spark, _landed(spark, sf_dir), "ut1"))
    return entries.groupBy("source", "category", "domain").agg(F.count("*").alias("n"))


def urls_entries(spark, sf_dir):
    return ls.count_urls_entries(ls.read_urls_entries(spark, _landed(spark, sf_dir)))


def param_list(spark, sf_dir):
    path = scratch_dir(spark)
    lists.hosted(spark, sf_dir).select(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("  "), "host", F.lit(" # why"))).when(F.col("page_id") % 4 == 1, F.lit("# note")).otherwise(F.col("host"))).write.text(path)
    return ls.read_param_list(spark, path).groupBy("value").agg(F.count("*").alias("n"))


def user_blocklist(spark, sf_dir):
    value = F.expr("case page_id % 5 when 0 then concat(upper(host), '.') when 1 then concat(host, ' # mine') when 2 then concat('http://', host) when 3 then concat('a b.', host) else host end")
    return ls.user_blocklist(lists.hosted(spark, sf_dir).select(value.alias("value"), F.col("page_id").alias("line_no")))


def tamper_log(spark, sf_dir):
    """Rows written as log lines and read back; every ninth line is torn."""
    path = scratch_dir(spark)
    detail = F.concat(F.col("event_type"), F.lit("\t"), F.repeat(F.lit("x"), (F.col("event_id") % 150).cast("int")))
    line = ls.tamper_line(F.unix_millis("ts"), F.col("event_id") * 7, F.col("event_type"), detail)
    e = events(spark, sf_dir)
    e.select(F.when(F.col("event_id") % 9 == 0, F.substr(line, F.lit(5), F.lit(4))).otherwise(line)).write.text(path)
    return ls.read_tamper_lines(spark.read.text(path)).select("elapsed_ms", "event", "detail")


def segment_kinds(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("ts", "M4S", "mp4", "m3u8", "mpd", "html", "")])
    path = F.concat(F.regexp_replace("url", r"[?#].*", ""), F.lit("."), F.get(ends, (F.col("page_id") % 7).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", ls.segment_kind(path).alias("kind"))


_SNAPS = "SELECT concat('s', page_id % 41) AS source, concat('c', page_id % 5) AS category, concat('r', page_id % 3) AS revision, CASE page_id % 7 WHEN 0 THEN ' mit ' WHEN 1 THEN 'GPL-3.0' WHEN 2 THEN 'CC0-1.0' ELSE 'MIT' END AS license, page_id AS fetched_at FROM {p}"


def _snapshots(spark, sf_dir):
    return spark.sql(_SNAPS.replace("{p}", "{pages}"), pages=table(spark, sf_dir, "pages"))


def admissions(spark, sf_dir):
    expected = spark.range(60).select(F.concat(F.lit("s"), "id").alias("source"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("r"), (F.col("id") % 3).cast("string"))).alias("revision"), F.when(F.col("id") % 2 == 0, "mit").alias("license")).where("id % 6 <> 5")
    got = ls.admission(_snapshots(spark, sf_dir), expected, lists._param(spark, ["MIT", "cc0-1.0"]))
    return got.groupBy("source", "admission").agg(F.count("*").alias("n"))


ADMISSIONS_SQL = f"""WITH s AS ({_SNAPS.format(p="pages")}), e AS (SELECT 's' || i AS source, CASE WHEN i % 4 > 0 THEN 'r' || (i % 3) END AS pinned, CASE WHEN i % 2 = 0 THEN 'mit' END AS known FROM range(60) t(i) WHERE i % 6 <> 5),
a AS (SELECT s.source, CASE WHEN pinned IS NOT NULL AND revision <> pinned THEN 'revision_mismatch' WHEN known IS NOT NULL AND lower(trim(license)) <> known THEN 'license_changed' WHEN lower(trim(license)) NOT IN ('mit', 'cc0-1.0') THEN 'license_not_allowed' ELSE 'admitted' END AS admission FROM s LEFT JOIN e USING (source))
SELECT source, admission, count(*) AS n FROM a GROUP BY ALL"""


def collapsed_snapshots(spark, sf_dir):
    return dm.collapse_snapshots(_snapshots(spark, sf_dir).dropDuplicates(["source", "category", "revision", "license", "fetched_at"]))


COLLAPSED_SQL = f"""WITH s AS ({_SNAPS.format(p="pages")})
SELECT source, CASE WHEN count(DISTINCT lower(trim(license))) = 1 THEN first(license ORDER BY category) END AS license, string_agg(category || '=' || revision, ';' ORDER BY category || '=' || revision) AS revision, min(fetched_at) AS fetched_at FROM s GROUP BY source"""


def output_license(spark, sf_dir):
    return dm.output_license(_snapshots(spark, sf_dir).where("license <> 'GPL-3.0'"))


def published_build(spark, sf_dir):
    """The merged list published as two versions, a third refused, the second read back with its digest checked."""
    root = scratch_dir(spark)
    m = lists.merged(spark, sf_dir)
    build = Published(spark, root)
    build.publish(m.where("scope = 'apex'"), 1)
    build.publish(dm.sorted_keys(m, 4), 3)
    try:
        build.publish(m, 2)
        refused = False
    except ValueError:
        refused = True
    _, back = build.load()
    return back.select("domain", "scope", reversed_labels(F.col("domain")).alias("key"), F.lit(refused).alias("refused"))


def stored_liveness(spark, sf_dir):
    """The liveness cache saved as three commits, compacted after the second, and loaded: the same as the full outer merge."""
    cache = lv.cache_table(spark, scratch_dir(spark))
    cache.commit(lists._cache(spark, sf_dir))
    found = lists.verdicts(spark, sf_dir).where("length(domain) % 4 < 2")
    lv.save_sweep(cache, found.where("length(domain) % 4 = 0"), lists.NOW)
    cache.compact()
    lv.save_sweep(cache, found.where("length(domain) % 4 = 1"), lists.NOW)
    return cache.load()


def stored_liveness_due(spark, sf_dir):
    """Due domains from the stored cache after a sweep of those with an even length at their due time."""
    cache = lv.cache_table(spark, scratch_dir(spark))
    cache.commit(lists._cache(spark, sf_dir))
    lv.save_sweep(cache, lists.verdicts(spark, sf_dir).where("length(domain) % 2 = 0"), lists.NOW)
    names = lists.hosted(spark, sf_dir).select(F.col("host").alias("domain")).distinct()
    return lv.due_from(cache, names, lists.NOW, lists.TTL)


STORED_DUE_SQL = lists._LIVE_SQL + f""", old AS ({lists._CACHE.format(s='varchar', h='names')})
SELECT host AS domain FROM names LEFT JOIN old ON host = old.domain
WHERE length(host) % 2 = 1 AND (last_checked IS NULL OR greatest({lists.NOW} - last_checked, 0) >= {lists.TTL})"""


def _daily(spark, sf_dir):
    """Classified entries with the day from which they are listed and that from which they are no longer."""
    d = lists.done(spark, sf_dir).select("domain", "source", "category", "scope", "outcome")
    return d.withColumn("since", F.pmod(F.length("domain"), F.lit(3))).withColumn("until", F.when(F.pmod(F.length("domain") + F.length("category"), F.lit(4)) == 0, 2).otherwise(9))


def incremental_merge(spark, sf_dir):
    """The merged list after three daily changes with retractions, from a table that holds counts of entries."""
    rows = stored(_daily(spark, sf_dir))
    at = lambda day: rows.where((F.col("since") <= day) & (F.col("until") > day))
    kept = inc.list_table(spark, scratch_dir(spark), 16)
    inc.apply_changes(kept, inc.counted(at(0)))
    for day in (1, 2):
        inc.apply_changes(kept, inc.difference(at(day), at(day - 1)))
    return inc.merged_of(kept.load()).select("domain", "scope", F.array_join("sources", ",").alias("sources"), F.array_join("categories", ",").alias("categories"))


#: Day 2: what is listed from days 0 to 2 on and not taken out by then.
INCREMENTAL_SQL = (
    "WITH "
    + lists._MERGE_SQL
    + """, live AS (SELECT * FROM done WHERE outcome = 'merged' AND (length(domain) + length(category)) % 4 <> 0)
SELECT domain, CASE WHEN bool_or(scope = 'apex') THEN 'apex' ELSE 'exact_host' END AS scope, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM live GROUP BY domain"""
)


def new_list_keys(spark, sf_dir):
    """Domains listed by the last daily change that weren't before it."""
    rows = stored(_daily(spark, sf_dir))
    at = lambda day: rows.where((F.col("since") <= day) & (F.col("until") > day))
    kept = inc.list_table(spark, scratch_dir(spark), 16)
    before = inc.apply_changes(kept, inc.counted(at(0)))
    inc.apply_changes(kept, inc.difference(at(1), at(0)))
    return inc.new_keys(kept, before)


NEW_KEYS_SQL = "WITH " + lists._MERGE_SQL + " SELECT DISTINCT domain FROM done WHERE outcome = 'merged' AND length(domain) % 3 = 1"


def corpus_scores(spark, sf_dir):
    """Pages landed as files of 50, scanned back as a corpus and scored by a caller's function, their size in MB."""
    root = scratch_dir(spark)
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 50).alias("k"), "html")
    pages.repartition("k").write.partitionBy("k").text(root)
    found = ev.score_corpus(ls.binary_corpus(spark, root, (".txt",)), lambda content: F.octet_length(content) / 1e6, "pages")
    return found.select("corpus", F.regexp_extract("item", "k=([0-9]+)/", 1).cast("long").alias("item"), F.round("score", 6).alias("score"))


CORPUS_SQL = "SELECT 'pages' AS corpus, page_id // 50 AS item, round(sum(strlen(html) + 1) / 1e6, 6)::DOUBLE AS score FROM pages GROUP BY 2"


def build_report(spark, sf_dir):
    m = lists.merged(spark, sf_dir)
    return dm.build_report(m, m.select(F.octet_length("domain").alias("bytes"))).withColumn("bytes_per_entry", F.round("bytes_per_entry", 6))


def size_gate(spark, sf_dir):
    m = lists.merged(spark, sf_dir).select(F.octet_length("domain").alias("bytes"))
    return dm.all_gates([dm.size_gate(m, 100), dm.size_gate(m, 1 << 30)])


def folded_overlay(spark, sf_dir):
    m = lists.merged(spark, sf_dir).select("domain", "scope")
    h = lists.hosted(spark, sf_dir)
    adds = h.where("page_id % 3 = 0").select(F.concat(F.lit("new."), "host").alias("domain"), F.lit("apex").alias("scope")).distinct()
    return dm.fold_overlay(m, adds, h.where("page_id % 4 = 0").select(F.col("host").alias("domain")))


def flow_actions(spark, sf_dir):
    """A flow an event: every third without a host, ports of three kinds."""
    address = F.expr(lists._IP.format(s="string"))
    e = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 > 0, F.concat(F.col("event_type"), F.lit(".example.com"))).alias("host"), address.alias("address"), F.get(F.array(F.lit(443), F.lit(80), F.lit(53)), (F.col("event_id") % 3).cast("int")).alias("port"))
    by_host = local_table(spark, [("click.example.com", "block"), ("view.example.com", "allow")], "host string, action string")
    return hs.flow_actions(e, by_host, lists.cidr_policy(spark, sf_dir)).select("event_id", "action")


FLOW_SQL = f"""WITH ip AS ({lists.CIDR_SQL}), f AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, {lists._IP.format(s="varchar")} AS address, event_id % 3 AS p FROM events)
SELECT event_id, CASE WHEN p = 2 THEN 'allow' WHEN kind = 'click' THEN 'block' WHEN kind = 'view' THEN 'allow' ELSE coalesce(action, 'proxy') END AS action FROM f LEFT JOIN ip USING (address)"""


def canary(spark, sf_dir):
    v = lists.verdicts(spark, sf_dir)
    control = v.select("domain", F.when(F.length("domain") % 2 == 0, "alive").otherwise("dead").alias("expected"))
    c = lv.canary(control, v)
    return c.select("passed", "n_mismatches", F.array_join("named", ",").alias("named"), "remainder")


CANARY_SQL = (
    lists._LIVE_SQL
    + """, bad AS (SELECT domain FROM live WHERE verdict <> CASE WHEN length(domain) % 2 = 0 THEN 'alive' ELSE 'dead' END), n AS (SELECT count(*) AS n FROM bad)
SELECT n = 0 AS passed, n AS n_mismatches, (SELECT string_agg(domain, ',' ORDER BY domain) FROM (SELECT domain FROM bad ORDER BY domain LIMIT 20)) AS named, CASE WHEN n > 20 THEN '...and ' || (n - 20) || ' more' END AS remainder FROM n"""
)


def dead_list(spark, sf_dir):
    return lv.dead_list(lists.verdicts(spark, sf_dir))


def pruned_at_once(spark, sf_dir):
    return lv.dead_now(_with_special(lists.hosted(spark, sf_dir).select("host").distinct()), _special_verdicts(spark, sf_dir))


def _with_special(names: DataFrame) -> DataFrame:
    """Names and, of each, one below a special-use name."""
    return names.select(F.explode(F.array("host", F.concat("host", F.lit(".test")))).alias("domain"))


def _special_verdicts(spark, sf_dir):
    return lists.verdicts(spark, sf_dir).select(F.explode(F.array("domain", F.concat("domain", F.lit(".test")))).alias("domain"), "verdict", "reason")


def pruned_after_quarantine(spark, sf_dir):
    names = lists.hosted(spark, sf_dir).select("host").distinct()
    cache = _with_special(names).select("domain", F.lit(1000).alias("last_checked"), F.when(F.length("domain") % 3 > 0, "dead").otherwise("alive").alias("verdict"), F.lit(None).cast("string").alias("reason"), F.when(F.length("domain") % 3 > 0, (F.length("domain") * 20).cast("long")).alias("first_dead_at"))
    return lv.pruned_set(_with_special(names), cache, 1000, 600)


QUERIES = {
    "category_dirs": category_dirs, "urls_entries": urls_entries, "param_list": param_list, "user_blocklist": user_blocklist, "tamper_log": tamper_log, "segment_kinds": segment_kinds, "admissions": admissions,
    "collapsed_snapshots": collapsed_snapshots, "output_license": output_license, "published_build": published_build, "corpus_scores": corpus_scores, "stored_liveness": stored_liveness, "stored_liveness_due": stored_liveness_due, "incremental_merge": incremental_merge, "new_list_keys": new_list_keys, "build_report": build_report, "size_gate": size_gate, "folded_overlay": folded_overlay,
    "flow_actions": flow_actions, "canary": canary, "dead_list": dead_list, "pruned_at_once": pruned_at_once, "pruned_after_quarantine": pruned_after_quarantine,
}
SQL = {
    "category_dirs": f"WITH {_HOSTED} SELECT 'ut1' AS source, CASE page_id % 2 WHEN 0 THEN 'adult' ELSE 'gambling' END AS category, host AS domain, count(*) AS n FROM hosted GROUP BY ALL",
    "urls_entries": "SELECT count(*) AS n_urls FROM pages WHERE page_id % 3 < 2 AND page_id % 5 > 0",
    "param_list": f"WITH {_HOSTED} SELECT host AS value, count(*) AS n FROM hosted WHERE page_id % 4 <> 1 GROUP BY host",
    "user_blocklist": f"WITH {_HOSTED} SELECT host AS domain, min(page_id) AS line_no FROM hosted WHERE page_id % 5 NOT IN (2, 3) GROUP BY host",
    "tamper_log": "SELECT event_id * 7 AS elapsed_ms, event_type AS event, left(event_type || ' ' || repeat('x', (event_id % 150)::INTEGER), 120) AS detail FROM events WHERE event_id % 9 > 0",
    "segment_kinds": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'transport_stream' WHEN 1 THEN 'fragmented_mp4' WHEN 2 THEN 'fragmented_mp4' WHEN 3 THEN 'playlist' WHEN 4 THEN 'playlist' END AS kind FROM pages",
    "admissions": ADMISSIONS_SQL,
    "collapsed_snapshots": COLLAPSED_SQL,
    "output_license": "SELECT 'MIT' AS output_license",
    "corpus_scores": CORPUS_SQL, "stored_liveness": lists._CACHE_SQL + " SELECT * FROM cache", "stored_liveness_due": STORED_DUE_SQL, "incremental_merge": INCREMENTAL_SQL, "new_list_keys": NEW_KEYS_SQL,
    "published_build": "WITH " + lists._MERGE_SQL + " SELECT domain, scope, array_to_string(list_reverse(string_split(domain, '.')), '.') AS key, true AS refused FROM merged",
    "build_report": "WITH " + lists._MERGE_SQL + " SELECT count(*) AS entry_count, count(DISTINCT (sources, categories, scope)) AS combinations, sum(strlen(domain))::BIGINT AS bytes, round(sum(strlen(domain)) / count(*), 6) AS bytes_per_entry FROM merged",
    "size_gate": "WITH " + lists._MERGE_SQL + " SELECT 'size' AS gate, sum(strlen(domain)) <= l AS passed, sum(strlen(domain))::DOUBLE AS measured FROM merged, (VALUES (100), (1073741824)) v(l) GROUP BY l",
    "folded_overlay": "WITH " + lists._MERGE_SQL + " SELECT domain, scope FROM merged WHERE domain NOT IN (SELECT host FROM hosted WHERE page_id % 4 = 0) UNION ALL SELECT DISTINCT 'new.' || host, 'apex' FROM hosted WHERE page_id % 3 = 0 AND 'new.' || host NOT IN (SELECT domain FROM merged)",
    "flow_actions": FLOW_SQL,
    "canary": CANARY_SQL,
    "dead_list": lists._LIVE_SQL + " SELECT domain, CASE WHEN verdict = 'dead' THEN 'dead' ELSE 'unknown:' || reason END AS kind FROM live WHERE verdict <> 'alive'",
    "pruned_at_once": lists._LIVE_SQL + " SELECT domain FROM live WHERE verdict = 'dead'",
    "pruned_after_quarantine": f"WITH {_HOSTED} SELECT DISTINCT host AS domain FROM hosted WHERE length(host) % 3 > 0 AND 1000 - length(host) * 20 >= 600",
}
