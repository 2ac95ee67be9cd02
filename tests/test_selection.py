"""Order statistics by refined ranges against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from policyspark.operators import evaluation as ev, selection as sl


def values(rng):
    out = []
    for i in range(1500):
        out.append(("skewed", math.exp(rng.gauss(0, 8))))
        out.append(("ties", float(rng.choice([0, 0, 0, 1, 2]))))
        out.append((None, rng.random() if i % 5 else None))
    return out + [("one", 3.0), ("nothing", None), ("same", 2.0), ("same", 2.0), ("nan", float("nan")), ("nan", 1.0)]


@pytest.mark.parametrize("few", [5, 100, sl.FEW])
def test_ranks_equal_sorted_lists(spark, few):
    rows = values(random.Random(2))
    df = spark.createDataFrame(rows, "g string, score double").repartition(5)
    got = {r.g: r for r in sl.selected(df, ["g"], "score", {"p10": sl.nearest_rank(0.1), "lo": sl.middle(False), "hi": sl.middle(True), "p99": sl.nearest_rank(0.99), "third": lambda n: F.lit(3).cast("long"), "last": lambda n: n}, few).collect()}
    assert set(got) == {"skewed", "ties", None, "one", "same", "nan"}
    for g, r in got.items():
        own = sorted((x for k, x in rows if k == g and x is not None), key=lambda x: (math.isnan(x), x))
        n = len(own)
        at = lambda k: own[k - 1] if 1 <= k <= n else None  # noqa: B023, E731
        want = [at(max(1, math.ceil(n / 10))), at((n + 1) // 2), at(n // 2 + 1), at(max(1, math.ceil(n * 99 / 100))), at(3), at(n)]
        assert str(want) == str(list(r)[1:]), g


def test_summary_and_latencies(spark):
    df = spark.createDataFrame([("b", float(x)) for x in range(1, 21)] + [("e", 0.5), ("e", None)], "corpus string, score double")
    got = {r.corpus: r for r in ev.summary(df, ["corpus"]).collect()}
    assert (got["b"].n, got["b"].median, got["b"].p90, got["b"].p95, got["b"].p99, got["b"].most) == (20, 10.5, 18.0, 19.0, 20.0, 20.0)
    assert (got["e"].n, got["e"].median, got["e"].p90) == (2, 0.5, 0.5)
    assert ev.summary(df.limit(0), ["corpus"]).count() == 0
    assert ev.latencies(df.withColumn("millis", F.col("score") * 10), ["corpus"]).where("corpus = 'b'").first()[1:] == (100.0, 190.0)


def test_trimmed_mean_by_ranges(spark, monkeypatch):
    rng = random.Random(5)
    vectors = [[rng.choice([0.0, 1.0, rng.gauss(0, 3)]), float(i % 3), 7.0] for i in range(700)]
    df = spark.createDataFrame(list(enumerate(vectors)), "client long, vector array<double>").repartition(4)
    monkeypatch.setattr(ev, "selected", lambda *a, f=ev.selected: f(*a, few=20))
    for trim in (0.0, 0.1, 0.3):
        got = {r.i: r["mean"] for r in ev.trimmed_mean(df, trim, 500).collect()}
        for i in range(3):
            own = sorted(v[i] for v in vectors)
            cut = int(len(own) * trim)
            assert abs(got[i] - sum(own[cut : len(own) - cut]) / (len(own) - 2 * cut)) < 1e-9
    assert ev.trimmed_mean(df, 0.1, 701).count() == 0
    assert ev.trimmed_mean(df, 0.5, 1).count() == 0  # nothing is left


def test_deferral_curve_keeps_exact_confidences(spark):
    rows = [(0.9001, 1), (0.9002, 0), (0.1, 1), (0.5, 0), (0.5, 1)]
    got = [tuple(r) for r in ev.deferral_curve(spark.createDataFrame(rows, "score double, label int"), 0.4).orderBy(F.desc("confidence")).collect()]
    assert [c for c, *_ in got] == [0.9002, 0.9001, 0.9, 0.5]
    assert [(round(a, 6), round(b, 6)) for _, a, b in got] == [(0.2, 1.0), (0.4, 0.5), (0.6, 0.666667), (1.0, 0.6)]
