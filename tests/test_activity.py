"""Event state and streams: golden cases, and a stream gives what the table gives."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from policyspark.operators import activity as ac
from policyspark.streaming import gates as sg
from policyspark.plans import activity as plans

LOG = "device string, seq long, elapsed_ms long, event string, detail string"


def test_coalescing(spark):
    kept = lambda *rows: [r.seq for r in ac.coalesced(spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], LOG)).orderBy("seq").collect()]
    assert kept((0, "e", "x"), (500, "e", "x")) == [0]
    assert kept((0, "e", "x"), (10_000, "e", "x")) == [0, 1]
    assert kept((0, "e", "x"), (500, "e", "y")) == [0, 1]
    assert kept((5000, "e", "x"), (10, "e", "x")) == [0, 1]
    assert kept((0, "e", "x"), (6000, "e", "x"), (12_000, "e", "x")) == [0, 2]  # against the last kept row


def test_session_starts(spark):
    def start(now, *rows):
        log = spark.createDataFrame([("d", i, e, ev) for i, (e, ev) in enumerate(rows)], "device string, seq long, elapsed_ms long, event string")
        return ac.session_starts(log, spark.createDataFrame([("d", now)], "device string, now_elapsed long")).first().start

    on, off = "service_connected", "service_disconnected"
    assert start(10) == "first_run" and start(10, (5, "blocked")) == "first_run"
    assert start(9000, (1, on), (2, off), (3, "guard_unprotected")) == "clean_restart"
    assert start(9000, (1, on), (2, "blocked")) == "unclean_stop"
    assert start(8000, (500_000, on)) == "after_reboot"
    assert start(9000, (5000, off), (10, "x"), (20, "y")) == "after_reboot"
    assert start(9000, (5000, on), (10, on), (20, off)) == "clean_restart"  # an older boot is no excuse


def test_phases(spark):
    rows = [("a", False, 0, 0, 1), ("b", True, None, None, 1), ("c", True, 0, None, 899_999), ("d", True, 0, None, 900_000), ("e", True, 0, None, 1_200_000), ("f", True, 0, 950_000, 1_000_000), ("g", True, 10, None, 5), ("h", True, 950_000, 100, 1_000_000)]
    got = {r.device: (r.phase, r.left_ms) for r in ac.protection_phase(spark.createDataFrame(rows, "device string, armed boolean, requested_at long, disarmed_at long, now long")).collect()}
    assert got == {"a": ("off", None), "b": ("armed", None), "c": ("pending", 1), "d": ("ready", 300_000), "e": ("armed", None), "f": ("disarmed", 550_000), "g": ("armed", None), "h": ("pending", 850_000)}


FRAMES = "device string, seq long, at_ms long, hash long"


def frames(spark, *rows):
    return [r.outcome for r in sg.gated_batch(spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], FRAMES), sg.FRAME_GATE).orderBy("seq").collect()]


def test_frame_gate(spark):
    assert frames(spark, (0, 0), (40, -1)) == ["analyse", "too_soon"]
    for bits, want in ((3, "unchanged"), (6, "analyse"), (9, "analyse")):
        assert frames(spark, (0, 0), (2000, (1 << bits) - 1)) == ["analyse", want]
    assert frames(spark, (0, -1), (2000, 0)) == ["analyse", "analyse"]


def test_screen_gate(spark):
    rows = [(0, "a", "x"), (100, "a", "x"), (200, "a", "y"), (400, "a", "y"), (410, "b", "y"), (420, "me", "z"), (430, "b", ""), (440, "b", "q")]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows)], "device string, seq long, at_ms long, package string, text string")
    got = [r.outcome for r in sg.gated_batch(df, sg.screen_gate("me")).orderBy("seq").collect()]
    assert got == ["scanned", "duplicate", "debounced", "scanned", "scanned", "self_package", "no_text", "debounced"]


def test_burst_gate(spark):
    rows = [("d", i, t, 0) for i, t in enumerate([0, 500, 1300, 2600, 3900, 9000])]
    got = [r.outcome for r in sg.gated_batch(spark.createDataFrame(rows, FRAMES), sg.BURST_GATE).orderBy("seq").collect()]
    assert got == ["fired", "refire", "fired", "fired", "limited", "fired"]


@pytest.fixture(scope="module")
def table_dir(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    rows = [(i, f"2024-01-{1 + i // 100:02} 00:{i % 60:02}:00", i % 7, ["error", "click", "view"][i * i % 5 % 3], float(i % 50), "{}") for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(3).write.parquet(f"{out}/events.parquet")
    return str(out)


def test_streams_equal_batches(spark, table_dir):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(plans.stream_screen_gate(spark, table_dir)) == rows(plans.screen_gate(spark, table_dir))
    e = plans.events(spark, table_dir)
    assert rows(plans.stream_coalesced(spark, table_dir)) == rows(sg.gated_batch(plans._frames(e), sg.REPEAT_GATE))
    assert rows(plans._streamed(spark, table_dir, lambda s: sg.gated_stream(plans._frames(s), sg.FRAME_GATE), True)) == rows(sg.gated_batch(plans._frames(e), sg.FRAME_GATE))
    assert rows(plans._streamed(spark, table_dir, lambda s: sg.gated_stream(plans._frames(s), sg.BURST_GATE), True)) == rows(sg.gated_batch(plans._frames(e), sg.BURST_GATE))
    assert plans.stream_idempotent(spark, table_dir).count() == 134


def test_windowed_streams(spark, table_dir):
    counts = plans._streamed(spark, table_dir, lambda s: sg.live_counts(s.withColumn("verdict", F.col("event_type"))))
    assert counts.agg(F.sum("n")).first()[0] == 200  # the watermark, an hour behind, closes the first two days
    counts = plans._streamed(spark, table_dir, lambda s: sg.live_counts(s.withColumn("verdict", F.col("event_type"))), True)
    assert counts.agg(F.sum("n")).first()[0] == 400  # a row at the end closes them all
    policy = spark.createDataFrame([("error", "block")], "host string, action string")
    acted = plans._streamed(spark, table_dir, lambda s: sg.host_stream(s.select(F.col("event_type").alias("host")), policy))
    assert {r.host: r.action for r in acted.distinct().collect()} == {"error": "block", "click": "proxy"}


def test_small_rules(spark):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    df = spark.createDataFrame([("body", hmac.new(b"k", b"body", hashlib.sha256).hexdigest(), "pending"), ("body", "bad", "accepted"), (None, None, None)], "b string, s string, st string")
    r = df.select(ac.signed(F.col("b"), F.col("s"), b"k").alias("ok"), ac.fresh(now, F.lit("2024-01-01 00:05:00").cast("timestamp")).alias("f"), ac.effective_status(F.col("st"), F.lit("2023-01-01").cast("timestamp"), now).alias("e")).collect()
    assert [x.ok for x in r] == [True, False, False] and all(x.f for x in r) and [x.e for x in r] == ["expired", "accepted", None]
    im = spark.createDataFrame([(0, 5), (95, 500), (100, 900), (100, 800)], "w int, h int").select(ac.image_admissible(F.col("w"), F.col("h")).alias("a")).collect()
    assert [x.a for x in im] == ["empty", "too_small", "too_elongated", "admissible"]
    starts = spark.createDataFrame([(1,), (2,)], "gate_id int")
    assert {x.gate_id: x.outcome for x in ac.gate_outcomes(starts, spark.createDataFrame([(1, "left")], "gate_id int, outcome string")).collect()} == {1: "left", 2: "open"}
    flags = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    routed = ac.deferral(flags, spark.createDataFrame([("a", 0.5), ("b", 0.99)], "item string, score double")).collect()
    assert {x.item: x.route for x in routed} == {"a": "accept", "b": "human", "c": "accept"}
    q = spark.createDataFrame([(2, None), (1, None), (3, 5)], "created_at int, delivered_at int")
    assert [x.created_at for x in ac.undelivered(q).collect()] == [1, 2]


def test_cooldown_gate(spark, table_dir):
    rows = [(0, "tick"), (1000, "request"), (900_999, "tick"), (901_000, "tick"), (1_000_000, "disarm"), (1_500_000, "tick"), (1_600_000, "tick"), (2_000_000, "request"), (5, "tick")]
    df = spark.createDataFrame([("d", i, *r) for i, r in enumerate(rows[:-1])] + [("e", 0, 5, "request"), ("e", 1, 1_200_005, "tick")], "device string, seq long, at_ms long, event string")
    got = {(r.device, r.seq): r.outcome for r in sg.gated_batch(df, sg.COOLDOWN_GATE).collect()}
    assert [got["d", i] for i in range(8)] == ["armed", "pending", "pending", "ready", "disarmed", "disarmed", "armed", "pending"]
    assert got["e", 1] == "armed"
    e = plans.events(spark, table_dir)
    kind = lambda f: f.withColumn("event", F.when(F.col("event") == "error", "request").when(F.col("event") == "view", "disarm").otherwise("tick")).withColumn("at_ms", F.when(F.col("seq") < 0, 10**7).otherwise(F.col("seq")) * 60_000)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(plans._streamed(spark, table_dir, lambda s: sg.gated_stream(kind(plans._frames(s)), sg.COOLDOWN_GATE), True)) == rows(sg.gated_batch(kind(plans._frames(e)), sg.COOLDOWN_GATE))


def test_guard_status(spark):
    df = spark.createDataFrame([("d", i, a, s, p, r) for i, (a, s, p, r) in enumerate([(False, False, "off", True), (True, False, "pending", True), (True, False, "armed", True), (True, True, "ready", True), (True, True, "armed", False), (True, True, "armed", True), (True, False, "armed", True)])], "device string, seq int, active boolean, on boolean, phase string, known boolean")
    df = df.withColumn("health", ac.guard_health(F.col("active"), F.col("on"))).withColumn("message", ac.status_message(F.col("health"), F.col("phase"), F.col("known")))
    assert [r.message for r in df.orderBy("seq").collect()] == ["idle", "guard_not_running", "guard_not_running", "disarm_ready", "device_unverified", "protecting", "guard_not_running"]
    assert [r.seq for r in ac.unprotected_notices(df, ["seq"]).orderBy("seq").collect()] == [1, 6]
    kept, dropped = ac.trimmed(df, "device", [F.desc("seq")], 5)
    assert sorted(r.seq for r in kept.collect()) == [2, 3, 4, 5, 6] and dropped.first().dropped == 2


def test_rate_limits_by_slices_and_whole_queues(spark):
    times = [0, 1, 1, 9, 10, 11, 19, 20, 35, 1000]
    df = spark.createDataFrame([(k, i, t) for k in ("a", None) for i, t in enumerate(times)], "k string, i int, t long").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.k, r.i): (r.in_window, r.limited) for r in ac.rate_limited(df, "k", 10, 3).collect()}
    for k, i in got:
        n = sum(times[i] - 9 <= t <= times[i] for t in times)
        assert got[k, i] == (n, n > 3)
    queue = spark.createDataFrame([(i, 250 - i, None if i % 3 else 1) for i in range(250)], "i int, created_at int, delivered_at int")
    assert [r.i for r in ac.undelivered(queue).collect()] == [i for i in range(249, -1, -1) if i % 3]
    for key in (b"k", b"k" * 64, b"k" * 100):
        ok = spark.createDataFrame([("body é", hmac.new(key, "body é".encode(), hashlib.sha256).hexdigest())], "b string, s string").select(ac.signed(F.col("b"), F.col("s"), key).alias("ok"))
        assert ok.first().ok
