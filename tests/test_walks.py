"""Walks over stretches give what a plain walk gives, wherever a device's rows are cut."""

import random
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from policyspark.operators import activity as ac, walks
from policyspark.streaming import gates as sg

RNG = random.Random(1)
CASES = {
    "frames": (sg.FRAME_GATE, "hash long", lambda i: (RNG.choice([0, 1, 3, 7, 255, 65535]),)),
    "still frames": (sg.FRAME_GATE, "hash long", lambda i: (1 if i < 900 else 4095,)),
    "bursts": (sg.BURST_GATE, "", lambda i: ()),
    "cooldown": (sg.COOLDOWN_GATE, "event string", lambda i: (RNG.choice(["tick"] * 200 + ["request", "disarm"]),)),
    "repeats": (sg.REPEAT_GATE, "event string, detail string", lambda i: ("e", "d")),
    "changes": (sg.REPEAT_GATE, "event string, detail string", lambda i: (RNG.choice("eeeef"), None)),
    "screens": (sg.screen_gate("me"), "package string, text string", lambda i: (RNG.choice(["a", "b", "me", None]), RNG.choice(["x", "y", "z", "", None]))),
}


def plain(rows, gate):
    row, state, out = namedtuple("row", ["at_ms", *gate.columns]), {}, {}
    for device, seq, at, *more in sorted(rows, key=lambda r: (r[2], r[1])):
        out[device, seq], state[device] = gate.step(state.get(device), row(at, *more))
    return out


@pytest.mark.parametrize("name", CASES)
def test_any_cut_gives_the_plain_walk(spark, name):
    gate, schema, more = CASES[name]
    at, rows = 0, []
    for i in range(1200):
        at += 60_000 if name == "cooldown" else RNG.choice([0, 1, 100, 400, 700])
        rows.append(("d" if i % 7 else "e" if i % 2 else None, i, at, *more(i)))
    df = spark.createDataFrame(rows, "device string, seq long, at_ms long" + (schema and ", " + schema)).repartition(3)
    want = plain(rows, gate)
    for parts in (9, None):
        assert {(r.device, r.seq): r.outcome for r in sg.gated_batch(df, gate, parts).collect()} == want


def test_one_device_is_walked_by_many_tasks(spark, monkeypatch):
    """All rows are of one device: each task walks its share, and only rows before a stretch's first cut are walked again."""
    tables = []
    monkeypatch.setattr(walks, "stored", lambda df, f=walks.stored: tables.append(f(df)) or tables[-1])
    rows = [("d", i, 100 * i, "e" if i % 50 else "f", "") for i in range(2000)]
    df = spark.createDataFrame(rows, "device string, seq long, elapsed_ms long, event string, detail string")
    got = sorted(r.seq for r in ac.coalesced(df, parts=8).collect())
    last, want = None, []
    for _, i, at, e, d in rows:
        if last is None or last[0] != e or at - last[1] >= 10_000:
            last = (e, at)
            want.append(i)
    assert got == want
    sizes = [r["count"] for r in tables[0].where(F.col(walks.SUMMARY).isNull()).groupBy(walks.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 500
    assert len(tables) == 2 and tables[1].where(F.col(walks.SUMMARY).isNull()).count() < 8 * 50


def test_clock_that_falls_is_a_cut_only_beyond_the_interval(spark):
    clocks = [0, 9000, 12_000, 11_000, 8000, 2500, 2400, 30_000, 29_000, 19_000, 28_000]
    df = spark.createDataFrame([("d", i, at, "e", "x") for i, at in enumerate(clocks)], "device string, seq long, elapsed_ms long, event string, detail string")
    last, want = None, []
    for i, at in enumerate(clocks):
        if last is None or not 0 <= at - last < 10_000:
            last = at
            want.append(i)
    for parts in (1, 4, 11):
        assert sorted(r.seq for r in ac.coalesced(df, parts).collect()) == want


def test_empty_and_one_row(spark):
    schema = "device string, seq long, at_ms long, hash long"
    assert sg.gated_batch(spark.createDataFrame([], schema), sg.FRAME_GATE, 3).count() == 0
    assert [tuple(r) for r in sg.gated_batch(spark.createDataFrame([(None, 1, 5, 7)], schema), sg.FRAME_GATE, 3).collect()] == [(None, 1, "analyse")]
