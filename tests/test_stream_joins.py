"""Joins of two streams give what the tables give, in any micro-batches within the lateness."""

import random

from pyspark.sql import functions as F

from policyspark.operators import activity as ac
from policyspark.streaming import joins as sj

SCHEMA = "event_id long, user_id long, host string, ts timestamp, verdict string, outcome string"
END = 40_000_000


def events(n=400):
    rng, at, rows = random.Random(8), 1_000_000, []
    for i in range(n):
        at += rng.choice([0, 0.5, 20, 60, 300])
        rows.append([i, rng.randrange(3) if i % 20 else None, rng.choice(["h", "g"]), at, rng.choice(["warn", "warn", "block", "override", "allow"]), rng.choice(["left", "stayed"])])
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r[:3], float(r[3]), *r[4:]) for r in rows], SCHEMA.replace("ts timestamp", "ts double")).withColumn("ts", F.timestamp_seconds("ts"))


def files(spark, path, rows, late_s):
    rng = random.Random(9)
    rows = sorted(rows, key=lambda r: r[3] + rng.random() * late_s)
    for k in range(0, len(rows), 100):
        table(spark, rows[k : k + 100]).coalesce(1).write.mode("append").parquet(path)
    ends = [[-1, -1, "", END, v, None] for v in ("warn", "override")]
    table(spark, ends).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, of):
    stream = of(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{out}/rows").collect() if r[0] >= 0), key=str)


def test_warnings_and_dismissals(spark, tmp_path):
    rows = events()
    files(spark, f"{tmp_path}/in", rows, 100)
    sides = lambda e: (e.select("event_id", "user_id", "host", "ts", "verdict"), e.where("verdict = 'override'").select("user_id", "host", "ts"))
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda e: sj.suppressed_stream(*sides(e), "event_id", 600, "2 minutes"))
    want = ac.suppressed(*sides(table(spark, rows)), 600)
    assert got == sorted(map(tuple, want.select("event_id", "user_id", "host", "ts", "verdict").collect()), key=str)
    before = {r[0]: r[4] for r in rows}
    turned = [r for r in got if before[r[0]] == "warn" and r[4] == "allow"]
    assert len(turned) > 20 and len(got) == len(rows)


def test_gates_and_outcomes(spark, tmp_path):
    rows = events()
    files(spark, f"{tmp_path}/in", rows, 100)
    sides = lambda e: (e.where("verdict = 'warn'").select(F.col("event_id").alias("gate_id"), "ts"), e.where("verdict = 'override'").select((F.col("event_id") - 2).alias("gate_id"), "ts", "outcome"))
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda e: sj.outcome_stream(*sides(e), 120, "2 minutes"))
    want = ac.gate_outcomes(*sides(table(spark, rows)), 120)
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert {r[2] for r in got} == {"open", "left", "stayed"}


def test_a_dismissal_later_in_the_same_second(spark, tmp_path):
    """It comes after the warning, so the warning stays: in the queries and in the SQL that states them."""
    import duckdb

    from policyspark.plans import activity as plans

    rows = [(1, "2024-01-02 10:00:00.250", 1, "signup"), (2, "2024-01-02 10:00:00.750", 1, "purchase"), (3, "2024-01-02 10:00:00.900", 1, "signup")]
    rows += [(4, "2024-01-02 10:00:00.750", 2, "purchase"), (5, "2024-01-02 10:00:00.750", 2, "signup"), (6, "2024-01-02 12:00:00.100", 2, "signup"), (7, "2024-01-02 11:59:59.900", 2, "signup")]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    want = [(1, "warn"), (2, "override"), (3, "allow"), (4, "override"), (5, "allow"), (6, "warn"), (7, "allow")]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("suppressed_warnings", "stream_suppressed"):
        assert sorted(map(tuple, plans.QUERIES[name](spark, str(tmp_path)).collect())) == want
        assert sorted(con.execute(plans.SQL[name]).fetchall()) == want
