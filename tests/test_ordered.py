"""State in the order of event time: any micro-batches give the table's rows, timers bring phases, and state ends."""

import random

import pytest
from pyspark.sql import functions as F

from policyspark.streaming import gates as sg, ordered

SCHEMA = "device string, seq long, at_ms long, event string, detail string, hash long, package string, text string"
FAR = 1 << 45


def log(n=300, seed=3):
    rng, at, rows = random.Random(seed), 1_000_000, []
    for i in range(n):
        at += rng.choice([0, 200, 900, 30_000, 400_000])
        rows.append((rng.choice("ab") if i % 17 else None, i, at, rng.choice(["request", "disarm", "tick", "tick", "tick"]), "", rng.choice([0, 1, 255]), rng.choice(["p", "q", "me"]), rng.choice(["x", "y", ""])))
    return rows


def files(spark, path, rows, size, late_ms, seed=5):
    """Rows in files, one a micro-batch, each row at most ``late_ms`` behind the latest before it."""
    rng = random.Random(seed)
    dealt = sorted(rows, key=lambda r: r[2] + rng.randrange(late_ms))
    for k in range(0, len(dealt), size):
        spark.createDataFrame(dealt[k : k + size], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("end", None, FAR, None, None, None, None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, out, of):
    stream = of(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
    stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("gate", [sg.screen_gate("me"), sg.FRAME_GATE, sg.REPEAT_GATE, sg.BURST_GATE], ids=["screen", "frame", "repeat", "burst"])
def test_shuffled_batches_give_the_table(spark, tmp_path, gate):
    files(spark, f"{tmp_path}/in", log(120), 40, 60_000)
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda s: sg.gated_stream(s, gate, "1 minute"))
    assert rows_of(got) == rows_of(sg.gated_batch(spark.createDataFrame(log(120), SCHEMA), gate))


def test_phases_by_timers(spark, tmp_path):
    """Shuffled micro-batches give the phases of the table, those that only time brings among them; then the state is gone."""
    rows = log(200)
    files(spark, f"{tmp_path}/in", rows, 50, 60_000)
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda s: sg.phase_stream(s, sg.COOLDOWN_GATE, "1 minute"))
    want = sg.phase_changes(spark.createDataFrame(rows, SCHEMA), sg.COOLDOWN_GATE, 5)
    assert rows_of(got) == rows_of(want)
    assert got.where("seq is null").count() > 10
    left = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/out/state")
    assert left("kept").count() == 0


def test_a_request_becomes_ready_and_armed_without_a_row(spark, tmp_path):
    m = 60_000
    rows = [("d", 1, 100 * m, "request", "", 0, "", ""), ("d", 2, 116 * m, "tick", "", 0, "", ""), ("e", 3, 100 * m, "request", "", 0, "", ""), ("e", 4, 117 * m, "disarm", "", 0, "", ""), ("f", 5, 100 * m, "tick", "", 0, "", "")]
    want = [
        ("d", 100 * m, 1, "pending"), ("d", 115 * m, None, "ready"), ("d", 116 * m, 2, "ready"), ("d", 120 * m, None, "armed"),
        ("e", 100 * m, 3, "pending"), ("e", 115 * m, None, "ready"), ("e", 117 * m, 4, "disarmed"), ("e", 127 * m, None, "armed"), ("f", 100 * m, 5, "armed"),
    ]
    assert rows_of(sg.phase_changes(spark.createDataFrame(rows, SCHEMA), sg.COOLDOWN_GATE)) == sorted(want, key=str)
    files(spark, f"{tmp_path}/in", rows, 2, 1)
    assert rows_of(run(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda s: sg.phase_stream(s, sg.COOLDOWN_GATE, "1 minute"))) == sorted(want, key=str)


def test_silent_devices_begin_anew_and_late_rows_are_dropped(spark, tmp_path):
    row = lambda d, seq, at: (d, seq, at, "e", "", 0, "p", "x")
    for batch in ([row("a", 1, 1000), row("b", 2, 1000)], [row("a", 3, 90_000)], [row("a", 6, 90_500)], [row("b", 4, 5_000)], [row("a", 5, 400_000)], [row("end", None, FAR)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(spark, f"{tmp_path}/in", f"{tmp_path}/out", lambda s: sg.gated_stream(s, sg.screen_gate("me"), "10 seconds", idle_ms=200_000))
    # 4 came 75 s behind the watermark of the batch before; 5 repeats what was scanned, but its device had been forgotten
    assert rows_of(got) == [("a", 1, "scanned"), ("a", 3, "duplicate"), ("a", 5, "scanned"), ("a", 6, "duplicate"), ("b", 2, "scanned")]
    assert ordered.PROVIDER == spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert got.where(F.col("device") == "end").count() == 0


def test_waiting_rows_are_kept_in_packs():
    """2,500 rows of one device cost three values of the state, and come back whole."""
    import pickle
    from types import SimpleNamespace

    from pyspark.sql import Row, types as T

    from policyspark.streaming import gates as sg
    from policyspark.streaming.ordered import Ordered

    values = []
    waiting = SimpleNamespace(appendValue=values.append)
    handle = SimpleNamespace(getListState=lambda *a: waiting, getValueState=lambda *a: None, listTimers=lambda: iter([]), registerTimer=lambda t: None)
    o = Ordered(sg.BURST_GATE, T.StructType([T.StructField("at_ms", T.LongType()), T.StructField("seq", T.LongType())]), 1)
    o.init(handle)
    list(o.handleInputRows(("d",), (Row(device="d", seq=i, at_ms=i * 7) for i in range(2500)), None))
    assert len(values) == 3 and [r for v in values for r in pickle.loads(v[0])] == [(i * 7, i) for i in range(2500)]
