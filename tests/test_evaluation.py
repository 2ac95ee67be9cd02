"""Score statistics and vectors: golden cases."""

import pytest
from pyspark.sql import functions as F

from policyspark.functions import vectors as fv
from policyspark.operators import evaluation as ev, hashes as hx


def scores(spark, values):
    return spark.createDataFrame([("c", float(v)) for v in values], "corpus string, score double")


def test_summary(spark):
    r = ev.summary(scores(spark, [0, 0.5, 1]), ["corpus"]).first()
    assert (r.n, r["mean"], r["median"]) == (3, 0.5, 0.5)
    r = ev.summary(scores(spark, [0, 1, 2, 3, 4, 5]), ["corpus"]).first()
    assert (r.p90, r.p95, r.p99, r.least, r.most) == (5, 5, 5, 0, 5)
    assert ev.summary(scores(spark, []), ["corpus"]).count() == 0


def test_sweep_is_inclusive(spark):
    at = lambda v, t: {r.threshold: r.share for r in ev.sweep(scores(spark, v), ["corpus"]).collect()}[t]
    assert at([0, 0.1, 0.4, 0.6, 0.9], 0.5) == 0.4 and at([0.5], 0.5) == 1.0


def test_ranking(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (0, 0.1)], "label int, score double")
    r = ev.ranking_quality(df).first()
    assert abs(r.roc_auc - (3 + 1.5) / 6) < 1e-9 and abs(r.pr_auc - (1 / 1 + 2 / 4) / 2) < 1e-9
    p = ev.operating_points(df, (0.0, 0.5)).collect()
    assert [(x.budget, x.threshold) for x in p] == [(0.0, 0.7), (0.5, 0.9)]


def test_ranking_keeps_close_scores_apart(spark):
    df = spark.createDataFrame([(1, 0.12346), (0, 0.12345), (1, 0.9), (0, 0.12348)], "label int, score double")
    assert ev.ranking_quality(df).first().roc_auc == 0.75
    p = ev.operating_points(df, (0.0, 0.5)).collect()
    assert [(x.threshold, x.over_block, x.miss) for x in p] == [(0.12346, 0.5, 0.0), (0.9, 0.0, 0.5)]


def test_totals_run_over_all_ranges(spark):
    rows = [(i * 7 % 3 % 2, (i * 7919 % 1009) / 1013) for i in range(3000)] + [(1, None), (0, None), (1, float("nan")), (0, float("-inf"))]
    df = spark.createDataFrame(rows, "label int, score double")
    got = ev.by_score(df)
    at = lambda x: (0, 0) if x is None else (2, 0) if x != x else (1, x)
    for r in got.collect():
        assert (r.tp, r.fp) == (sum(y == 1 and at(x) >= at(r.score) for y, x in rows), sum(y == 0 and at(x) >= at(r.score) for y, x in rows)), r
    assert got.count() == 1009 + 3 and ev.by_score(df.limit(0)).count() == 0


def test_guardrail(spark):
    one = lambda r, f: spark.createDataFrame([(r, f)], "recall double, fpr double")
    status = lambda *x: ev.guardrail(one(0.9, 0.1), one(*x)).first().status
    assert status(0.8, 0.01) == "CRITICAL" and status(0.9, 0.1) == "WARNING" and status(0.9, 0.05) == "OK"


def test_tiles_and_top(spark):
    t = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.465), (2, 0, -1.0)], "image_id int, tile int, score double")
    got = {r.image_id: (r.score, r.blocked, r.tiles) for r in ev.tile_max(t).collect()}
    assert got == {1: (0.465, True, [1]), 2: (0.0, False, [])}
    s = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.9)], "item string, score double")
    assert [r.item for r in ev.top_items(s, 2).collect()] == ["c", "b"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1000.0, -1000.0)], "v array<double>, a double, b double")
    assert df.select(fv.softmax2(F.col("a"), F.col("b"))).first()[0] == 0.0
    assert abs(df.select(fv.linear_head(F.col("v"), ([0, 0], [1, 0.5]), (0, 0))).first()[0] - 0.880797) < 1e-5
    with pytest.raises(Exception, match="dimensions"):
        df.select(fv.linear_head(F.col("v"), ([0.0], [1.0]), (0, 0))).collect()
    grid = spark.createDataFrame([([float(8 - i % 9) for i in range(72)],), ([float(i % 9) for i in range(72)],)], "g array<double>")
    assert [r[0] for r in grid.select(fv.difference_hash(F.col("g"))).collect()] == [-1, 0]


def test_nearest_hash(spark):
    q = spark.createDataFrame([(1, 0), (2, (1 << 10) - 1), (3, (1 << 11) - 1), (4, -1)], "id int, hash long")
    s = spark.createDataFrame([("zero", 0), ("also", 0), ("far", 1 << 60)], "label string, hash long")
    got = {r.id: (r.label, r.distance) for r in hx.nearest_hash(q, s).collect()}
    assert got == {1: ("also", 0), 2: ("also", 10), 3: (None, None), 4: (None, None)}


def test_trimmed_mean(spark):
    u = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "client int, vector array<double>")
    assert {r.i: r["mean"] for r in ev.trimmed_mean(u, 0.1, 10).collect()} == {0: 4.5, 1: 0.0}
    assert ev.trimmed_mean(u, 0.1, 11).count() == 0


def test_head_training_and_corpus_scores(spark):
    df = spark.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(40)], "embedding array<double>, label int")
    w, b = ev.train_head(df)
    assert w[0] > 2 and b < 0
    files = spark.createDataFrame([("p1", bytearray(b"abc"))], "path string, content binary")
    assert tuple(ev.score_corpus(files, lambda c: F.octet_length(c) / 10, "benign").first()) == ("benign", "p1", 0.3)


def test_a_head_of_three_classes(spark):
    import math
    import random

    rng = random.Random(2)
    middles = [(0, 0, 3), (3, 0, 0), (0, 3, 0)]
    rows = [([m + rng.gauss(0, 0.5) for m in middles[i % 3]], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "embedding array<double>, label int")
    weights, biases = ev.train_classes(df)
    got = df.select("embedding", "label", ev.class_scores(F.col("embedding"), weights, biases).alias("p")).collect()
    for r in got:
        z = [sum(a * b for a, b in zip(r.embedding, w)) + c for w, c in zip(weights, biases)]
        e = [math.exp(x - max(z)) for x in z]
        assert all(abs(a - b / sum(e)) < 1e-9 for a, b in zip(r.p, e))
    assert sum(r.p.index(max(r.p)) == r.label for r in got) == 150
