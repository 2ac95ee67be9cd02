"""Commits, conflicts, compaction, and the incremental merge against full ones."""

import random

import pytest
from pyspark.sql import functions as F

from policyspark.operators import domains as dm, incremental as inc, liveness as lv
from policyspark.sources.state_tables import Conflict, KeyedTable, Log, Published

DAY = 86_400


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_deltas_deletes_and_compaction(spark, tmp_path):
    t = KeyedTable(spark, f"{tmp_path}/t", "k string, v long", "k", buckets=4)
    assert t.version() == 0 and rows(t.load()) == []
    of = lambda *r: spark.createDataFrame(list(r), "v long, k string").select("v", "k")  # noqa: E731  any order of columns
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    assert t.commit(of((1, "a"), (2, "b"), (3, "c"))) == 1
    t.commit(of((20, "b"), (4, "d")), keys("a"))
    t.commit(of((1, "a")), keys("d", "never"))
    want = [("a", 1), ("b", 20), ("c", 3)]
    assert rows(t.load()) == want
    assert rows(t.load(1)) == [("a", 1), ("b", 2), ("c", 3)] and rows(t.load(2)) == [("b", 20), ("c", 3), ("d", 4)]
    assert rows(t.rows_of(keys("b", "x"))) == [("b", 20)]
    assert sorted(r.k for r in t.changed_keys(1).collect()) == ["a", "b", "d", "never"]
    t.compact()
    assert rows(t.load()) == want and rows(t.load(2)) == [("b", 20), ("c", 3), ("d", 4)]
    with pytest.raises(ValueError):
        t.changed_keys(1)
    with pytest.raises(ValueError, match="a key needs one row"):
        t.commit(of((1, "z"), (2, "z")))
    assert rows(t.load()) == want  # what was written of it is in no manifest
    assert t.vacuum(1) == 4 and rows(t.load()) == want


def test_two_writers_and_torn_writes(spark, tmp_path):
    root = f"{tmp_path}/t"
    one, two = (KeyedTable(spark, root, "k string, v long", "k") for _ in range(2))
    df = lambda v: spark.createDataFrame([("a", v)], "k string, v long")
    at = one.version()
    one.commit(df(1), follows=at)
    with pytest.raises(Conflict):
        two.commit(df(2), follows=at)
    assert rows(two.load()) == [("a", 1)] and len(Log(spark, root).folders()) == 2
    seen = []

    def change(version):  # another commit comes between the first try's reading and its commit
        if not seen:
            one.commit(df(5))
        seen.append(version)
        return one.load(version).select("k", (F.col("v") + 10).alias("v")), None

    two.update(change)
    assert seen == [1, 2] and rows(two.load()) == [("a", 15)]
    (tmp_path / "t/log/_torn").write_text('{"segm')
    df(9).write.parquet(f"{root}/data/lost")
    assert rows(KeyedTable(spark, root, "k string, v long", "k").load()) == [("a", 15)]
    assert one.vacuum(1) >= 1 and rows(one.load()) == [("a", 15)]


def test_months_prune_and_later_rows_count(spark, tmp_path):
    t = lv.cache_table(spark, f"{tmp_path}/c")
    of = lambda *r: spark.createDataFrame([(d, at, "alive", None, None) for d, at in r], lv.CACHE)
    t.commit(of(("old", 10 * DAY), ("again", 12 * DAY), ("mid", 45 * DAY), ("new", 400 * DAY), ("none", None)))
    t.commit(of(("again", 399 * DAY)))
    found = t.older(46 * DAY)
    assert sorted(r.domain for r in found.collect()) == ["mid", "old"]
    files = found.inputFiles()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "__month" in plan and files
    names = spark.createDataFrame([(d,) for d in ("old", "again", "mid", "new", "none", "fresh", "fresh")], "domain string")
    want = rows(lv.due_set(names.distinct(), t.load(), 400 * DAY, 354 * DAY))
    assert rows(lv.due_from(t, names, 400 * DAY, 354 * DAY)) == want == [("fresh",), ("mid",), ("none",), ("old",)]


def test_sweeps_equal_the_full_merge(spark, tmp_path):
    rng = random.Random(3)
    t, full = lv.cache_table(spark, f"{tmp_path}/c"), spark.createDataFrame([], lv.CACHE)
    for day in range(3):
        found = [(f"d{i}", v := rng.choice(["dead", "dead", "alive", "unknown"]), "timeout" if v == "unknown" else None) for i in rng.sample(range(12), 7)]
        verdicts = spark.createDataFrame(found, "domain string, verdict string, reason string")
        lv.save_sweep(t, verdicts, day * 40 * DAY)
        full = spark.createDataFrame(lv.updated_cache(full, verdicts, day * 40 * DAY).collect(), lv.CACHE)
        if day == 1:
            t.compact()
    assert rows(t.load()) == rows(full)


def test_published_slots(spark, tmp_path):
    p, root = Published(spark, f"{tmp_path}/p"), tmp_path / "p"
    df = spark.createDataFrame([("a",), ("b",)], "domain string")
    assert p.load() is None and p.manifest() is None
    p.publish(df, 3)
    with pytest.raises(ValueError, match="does not follow"):
        p.publish(df, 3)
    p.publish(df.limit(1), 4)
    assert p.manifest()["version"] == 4 and p.manifest("previous")["version"] == 3
    assert (p.load()[0], p.load()[1].count(), p.load(3)[1].count()) == (4, 1, 2)
    with pytest.raises(ValueError):
        p.load(7)
    for f in (root / p.manifest()["folder"]).iterdir():  # the current build is damaged
        f.unlink()
    assert p.load()[0] == 3 and rows(p.load()[1]) == [("a",), ("b",)]


ENTRY = "domain string, source string, category string, scope string, outcome string"


def test_daily_changes_equal_full_merges(spark, tmp_path):
    rng = random.Random(6)
    df = lambda r: spark.createDataFrame(r, ENTRY)
    entry = lambda: (f"d{rng.randrange(15)}", rng.choice("stu"), rng.choice(["x", "y"]), rng.choice(["apex", "exact_host"]), rng.choice(["merged"] * 5 + ["denylisted"]))
    table, day, versions = inc.list_table(spark, f"{tmp_path}/l", 8), [], []
    for _ in range(4):
        new = [e for e in day if rng.random() < 0.6] + [entry() for _ in range(12)]
        versions.append(inc.apply_changes(table, inc.difference(df(new), df(day))))
        day = new
    want = rows(dm.merge(df(day)))
    assert rows(inc.merged_of(table.load())) == want
    table.compact()
    assert rows(inc.merged_of(table.load())) == want
    with pytest.raises(ValueError, match="compacted"):
        inc.new_keys(table, versions[-1] - 1)
    with pytest.raises(Exception, match="more is retracted"):
        inc.apply_changes(table, spark.createDataFrame([("d1", "s", "nowhere", True, -1)], "domain string, source string, category string, apex boolean, n long"))


def test_new_keys_and_overlays(spark, tmp_path):
    table = inc.list_table(spark, f"{tmp_path}/l", 4)
    done = lambda *r: spark.createDataFrame([(d, s, "x", sc, "merged") for d, s, sc in r], ENTRY)
    first = inc.apply_changes(table, inc.counted(done(("a", "s", "apex"), ("b", "s", "exact_host"), ("b", "t", "exact_host"))))
    inc.apply_changes(table, inc.difference(done(("b", "s", "exact_host"), ("c", "s", "apex")), done(("a", "s", "apex"), ("b", "s", "exact_host"))))
    assert rows(inc.new_keys(table, first)) == [("c",)]
    assert rows(inc.merged_of(table.load())) == [("b", "exact_host", ["s", "t"], ["x"]), ("c", "apex", ["s"], ["x"])]
    adds = spark.createDataFrame([("b", "apex"), ("o", "exact_host"), ("p", "apex")], "domain string, scope string")
    inc.fold_overlay(table, adds, spark.createDataFrame([("c",), ("p",), ("q",)], "domain string"))
    assert rows(inc.merged_of(table.load())) == [("b", "exact_host", ["s", "t"], ["x"]), ("o", "exact_host", ["overlay"], ["overlay"]), ("p", "apex", ["overlay"], ["overlay"])]
    old = dm.fold_overlay(spark.createDataFrame([("b",), ("c",)], "domain string"), adds.select("domain"), spark.createDataFrame([("c",), ("q",)], "domain string"))
    assert sorted(r.domain for r in old.collect()) == ["b", "o", "p"]


def test_only_changed_buckets_are_read(spark, tmp_path):
    table = inc.list_table(spark, f"{tmp_path}/l", 16)
    inc.apply_changes(table, inc.counted(spark.createDataFrame([(f"d{i}", "s", "x", "apex", "merged") for i in range(200)], ENTRY)))
    found = table.rows_of(spark.createDataFrame([("d5",)], "domain string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and "PartitionFilters: [isnotnull(__bucket" in plan
