"""Streams into tables: exact ingest, day totals, and host policies with versions."""

import random

from pyspark.sql import functions as F

from policyspark.operators import hosts as hs
from policyspark.sources.state_tables import KeyedTable, Published
from policyspark.streaming import gates as sg, ingest as si

EVENT = "k string, ts long, v string"


def put(spark, path, *batches):
    for b in batches:
        spark.createDataFrame(b, EVENT).coalesce(1).write.mode("append").parquet(path)


def ingest(spark, path, table, state, name):
    read = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)
    si.exact_ingest(read, table, ["ts"], name).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, table.load().collect()))


def test_duplicates_of_any_age_and_batches_run_twice(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "k string, v string", "k", buckets=4)
    day = 86_400
    put(spark, f"{tmp_path}/in", [("a", 1, "first"), ("a", 0, "earlier"), ("b", 2, "b"), (None, 3, "none")], [("b", 400 * day, "months later"), ("c", 5, "c")])
    want = [("a", "earlier"), ("b", "b"), ("c", "c")]
    assert ingest(spark, f"{tmp_path}/in", table, f"{tmp_path}/s1", "one") == want
    version = table.version()
    # the same stream from its beginning, as if the checkpoint had been lost after the commit: its batches have been noted
    assert ingest(spark, f"{tmp_path}/in", table, f"{tmp_path}/s2", "one") == want and table.version() == version
    # and as another stream: held against the table row by row
    assert ingest(spark, f"{tmp_path}/in", table, f"{tmp_path}/s3", "two") == want
    put(spark, f"{tmp_path}/in", [("a", -5, "too late to be first"), ("d", 1, "d")])
    table.compact()
    assert ingest(spark, f"{tmp_path}/in", table, f"{tmp_path}/s1", "one") == sorted([*want, ("d", "d")])


def test_rolling_counts(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.choice([0, 1, 2, 9, 10, 11, 20]) * 86_400 + rng.randrange(86_400), rng.choice(["block", "warn"])) for _ in range(90)]
    for k in range(0, 90, 30):
        spark.createDataFrame(sorted(events)[k : k + 30], "at long, verdict string").withColumn("ts", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = si.day_table(spark, f"{tmp_path}/t")
    read = spark.readStream.schema("at long, verdict string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    si.day_totals(read, table).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
    got = {(F_day.toordinal() - 719_163, v): (n, r) for F_day, v, n, r in map(tuple, si.rolling(table.load()).collect())}
    want = {}
    for day in range(21):
        for v in ("block", "warn"):
            n = lambda a, b: sum(x == v and a <= at // 86_400 <= b for at, x in events)  # noqa: B023, E731
            want[day, v] = (n(day, day), n(day - 6, day))
    assert got == want and sum(got[20, v][0] for v in ("block", "warn")) > 0  # the last day is there
    assert si.rolling(spark.createDataFrame([], "day date, verdict string, n long")).count() == 0


def test_policy_versions_on_a_stream(spark, tmp_path):
    table = lambda schema, *r: spark.createDataFrame(list(r), schema)
    published = Published(spark, f"{tmp_path}/policy")
    rules = table("seq int, domain string, action string", (1, "rule.example.com", "proxy"))
    merged = lambda *d: table("domain string, scope string", *d)
    allow = table("domain string", ("ok.example.com",))
    published.publish(hs.policy_rows(allow, rules, merged(("example.com", "apex"), ("exact.org", "exact_host"))), 1)
    hosts = ["a.b.example.com", "x.ok.example.com", "y.rule.example.com", "exact.org", "sub.exact.org", "Example.COM.", "bad..host", None, "notexample.com"]
    put(spark, f"{tmp_path}/in", [(h, 0, "") for h in hosts])
    seen = []

    def run():
        read = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in").select(F.col("k").alias("host"))
        sg.policy_stream(read, published, lambda df, n: seen.extend((r.policy_version, r.host, r.action, r.decided_by) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()

    run()
    first = {h: (a, by) for v, h, a, by in seen}
    assert {v for v, *_ in seen} == {1} and len(seen) == len(hosts)
    assert first == {
        "a.b.example.com": ("block", "list"), "x.ok.example.com": ("allow", "allowlist"), "y.rule.example.com": ("proxy", "rule"), "exact.org": ("block", "list"), "sub.exact.org": ("proxy", "default"),
        "Example.COM.": ("block", "list"), "bad..host": ("proxy", "default"), None: ("proxy", "default"), "notexample.com": ("proxy", "default"),
    }
    published.publish(hs.policy_rows(allow, rules, merged(("exact.org", "apex"))), 2)
    seen.clear()
    put(spark, f"{tmp_path}/in", [(h, 0, "") for h in hosts])
    run()
    assert {v for v, *_ in seen} == {2}
    second = {h: a for _, h, a, _ in seen}
    assert second["a.b.example.com"] == "proxy" and second["sub.exact.org"] == "block" and second["x.ok.example.com"] == "allow"
