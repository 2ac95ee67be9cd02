"""The index finds what brute force finds, compares less where vectors cluster, and a user's labels come first."""

import numpy as np
import pytest

from policyspark.operators import neighbours as nb


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "id long, vector array<double>")


def brute(rows, queries, k):
    ok = [(i, np.array(v, float) / np.linalg.norm(v)) for i, v in rows if v is not None and None not in v and np.linalg.norm(v) > 0]
    out = {}
    for q, a in ok:
        if q in queries:
            found = sorted(((-round(float(a @ b), 6), i) for i, b in ok if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


@pytest.mark.parametrize(("centres", "block"), [(16, 32_768), (16, 20), (1, 50), (500, 7)])
def test_recall_is_one(spark, monkeypatch, centres, block):
    monkeypatch.setattr(nb, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 10))
    rows = [(i, middles[i % 8] + rng.normal(size=10) * 0.05) for i in range(300)] + [(300 + i, middles[0]) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 10), (402, [None] * 10), (403, -middles[3])]
    queries = [i for i, _ in rows if i % 10 == 0]
    df = table(spark, rows)
    index = nb.fit(df, centres)
    got = {}
    for r in nb.nearest(table(spark, [r for r in rows if r[0] in queries]), index, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbour_id, r.similarity))
    want = brute(rows, set(queries), 4)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    if centres == 16:
        assert nb.share_compared(table(spark, [r for r in rows if r[0] in queries]), index, 4) < 0.6


def test_few_rows_and_none(spark):
    df = table(spark, [(0, [1.0, 0.0]), (10, [0.0, 1.0])])
    assert [tuple(r) for r in nb.nearest(df, nb.fit(df), 5).orderBy("query_id").collect()] == [(0, 10, 0.0, 1), (10, 0, 0.0, 1)]
    none = df.limit(0)
    assert nb.nearest(none, nb.fit(none), 3).count() == 0 and nb.nearest(none, nb.fit(df), 3).count() == 0


def test_a_users_own_labels_come_first(spark):
    n = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 5), (2, 9)], "query_id long, neighbour_id long")
    labels = spark.createDataFrame([(5, "bad"), (6, "bad"), (7, "fine")], "id long, label string")
    own = spark.createDataFrame([("u", 5, "fine"), ("u", 9, "odd"), ("w", 6, "fine")], "user_id string, id long, label string")
    askers = spark.createDataFrame([(1, "u"), (1, "v"), (2, "u"), (2, "v")], "query_id long, user_id string")
    got = {(r.query_id, r.user_id): (r.label, r.votes) for r in nb.voted(n, labels, own, askers).collect()}
    assert got == {(1, "u"): ("fine", 2), (1, "v"): ("bad", 2), (2, "u"): ("fine", 1), (2, "v"): ("bad", 1)}


@pytest.mark.parametrize(("block", "base"), [(4_096, 16_384), (7, 50)])
def test_blocks_give_what_brute_force_gives(spark, monkeypatch, block, base):
    """In any blocks; a vector that holds a null has no neighbours and is none."""
    from policyspark.operators import hashes as hx

    monkeypatch.setattr(hx, "BLOCK", block)
    monkeypatch.setattr(hx, "BASE_BLOCK", base)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6)) for i in range(200)] + [(200 + i, [1.0] * 6) for i in range(20)] + [(300, None), (310, [0.0] * 6), (320, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    queries = [i for i, _ in rows if i % 10 == 0]
    df = table(spark, rows)
    got = {}
    for r in hx.nearest_vectors(df.where("id % 10 = 0"), df, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.neighbour_id, r.similarity))
    assert got == brute(rows, queries, 4)


@pytest.mark.parametrize(("block", "base"), [(4_096, 16_384), (7, 50)])
def test_blocks_meet_in_any_number_of_partitions(spark, monkeypatch, block, base):
    """As with tables too large for their partitions to be put together: both sides of a pair of blocks go to the same one."""
    from policyspark.operators import hashes as hx

    monkeypatch.setattr(hx, "BLOCK", block)
    monkeypatch.setattr(hx, "BASE_BLOCK", base)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6)) for i in range(200)]
    df = table(spark, rows)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {}
        for r in hx.nearest_vectors(df.where("id % 10 = 0"), df, 4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.neighbour_id, r.similarity))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows, [i for i, _ in rows if i % 10 == 0], 4)
