"""Lexical search, exact top-k and clustering against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from policyspark.llm import clustering as cl, exact_search as es, lexical_search as ls

from . import brute

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k):
    """{item_id: [(doc_id, score)]}"""
    words = lambda t: WORD.findall((t or "").translate(brute.LOWER))
    rows = [(d, words(t)) for d, t in docs if words(t)]
    n, total = len(rows), sum(len(w) for _, w in rows)
    out = {}
    for item in dict(items):
        terms = {w for i, t in items if i == item for w in words(t)}
        weight = {}
        for t in terms:
            df = sum(t in w for _, w in rows)
            weight[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        found = []
        for d, w in rows:
            m = 100 - 50 + (50 * len(w) * n) // total
            s = sum(weight[t] * ((1_000_000_000 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in terms if t in w)
            if s > 0:
                found.append((d, s))
        found.sort(key=lambda x: (-x[1], x[0] is None, x[0]))
        if found:
            out[item] = found[:k]
    return out


def texts(rng, n, vocab, longest=40):
    weights = [1 / (i + 1) for i in range(len(vocab))]
    return [" ".join(rng.choices(vocab, weights, k=rng.randint(0, longest))) for _ in range(n)]


def lexical(spark, docs, items, k):
    rows = ls.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.item_id, r["rank"])):
        got.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    return got


def test_lexical_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"W{i}" if i % 3 else f"w{i}é" for i in range(60)]
    docs = list(enumerate(texts(rng, 400, vocab)))
    docs += [(5, docs[5][1]), (7, None), (None, docs[9][1]), (None, docs[9][1]), (900, "?! --"), (901, docs[2][1].upper()), (902, "w0é " * 30_000)]
    items = list(enumerate(texts(rng, 12, vocab, 15))) + [(50, None), (51, "..."), (52, "unheard of"), (53, " ".join(vocab)), (3, "w3é W4"), (None, "w0é")]
    want = ranked(docs, [(i, t) for i, t in items if i is not None], 7)
    assert lexical(spark, docs, items, 7) == want
    monkeypatch.setattr(ls, "GROUP_BLOCKS", 1)
    monkeypatch.setattr(ls, "GROUP_ITEMS", 4)
    monkeypatch.setattr(ls, "LEAST_BITS", 3)
    monkeypatch.setattr(ls, "BITS_EACH", 0)  # every bit is set: postings of other terms are passed over later
    assert lexical(spark, docs, items, 7) == want
    assert lexical(spark, [], items, 7) == {} and lexical(spark, docs, [], 7) == {}


def test_accumulators_stop_and_survivors_stay_exact():
    """In one cell, over many random term weights, the k best are those of whole sums."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n_docs, n_terms = 3000, 12
    tf = rng.integers(0, 4, (n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < rng.random(n_terms) ** 3)
    tf[1500:] = tf[:1500]  # ties
    doc, term = np.nonzero(tf)
    block = pa.table({
        "doc_ids": pa.array([list(range(n_docs))]), "sizes": pa.array([rng.integers(1, 50, n_docs).repeat(1).tolist()]),
        "term": pa.array([term.tolist()], pa.list_(pa.int64())), "place": pa.array([doc.tolist()], pa.list_(pa.int32())), "tf": pa.array([tf[doc, term].tolist()], pa.list_(pa.int64())),
    })
    cell = ls.Cell(block, np.arange(n_terms), n_docs, 80_000)
    m = 50 + (50 * np.array(block.column("sizes")[0].as_py()) * n_docs) // 80_000
    impact = np.where(tf > 0, (1_000_000_000 * tf) // np.maximum(1000 * tf + 20 * m[:, None], 1), 0)
    for _ in range(60):
        some = np.flatnonzero(rng.random(n_terms) < 0.7)
        weight = rng.integers(0, 3, len(some)) * rng.integers(0, 6000, len(some)) ** rng.integers(0, 2, len(some))
        got, score = cell.best(some, weight, 10)
        whole = impact[:, some] @ weight
        order = np.lexsort((np.arange(n_docs), -whole))
        order = order[whole[order] > 0][:10]
        assert got.tolist() == order.tolist() and score.tolist() == whole[order].tolist()


def test_string_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([("b", "x y", 1, 2), ("a", "x y", 3, 4), ("c", "z", 5, 6)], "doc_id string, text string, term int, rank int")
    items = spark.createDataFrame([("i", "x", 0.5)], "item_id string, text string, score double")
    assert [(r.item_id, r["rank"], r.doc_id) for r in ls.search(docs, items).orderBy("rank").collect()] == [("i", 1, "a"), ("i", 2, "b")]


VECTORS = "vec_id long, embedding array<double>, score int, cell string"


def top(rows, k, scale=1024):
    """{query_id: [(vec_id, score)]} of distinct rows' ids."""
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in ok:
        if q % 100 == 0:
            found = sorted(((i, sum(x * y for x, y in zip(a, b))) for i, b in ok if i != q), key=lambda x: (-x[1], x[0]))[:k]
            if found:
                out[q] = found
    return out


def searched(spark, rows, k):
    out = {}
    for r in sorted(es.search(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS), k=k).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(2000, 12)) * rng.lognormal(0, 1.5, size=(2000, 1))
    v[:150] = v[0] * np.linspace(0.9, 1, 150)[:, None]  # one direction: local cosines near 1
    v[300:500] = v[300]  # one vector, many times
    found = [(i, x.tolist()) for i, x in enumerate(v)]
    return found + [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2100, [0.0] * 12), (2101, []), (2102, [1.0] * 3), (2200, [1.0] * 20), (-100, [-0.3] * 12), (None, [9.0] * 12)]


def test_exact_search_equals_brute_force(spark, rows, monkeypatch):
    want = top(rows, 10)
    assert searched(spark, rows, 10) == want
    for name, value in (("BLOCK_ROWS", 64), ("GROUP_ROWS", 200), ("QUERY_ROWS", 4), ("QUERY_GROUP", 8), ("SEED_ROWS", 20), ("COORDINATES", 0.3)):
        monkeypatch.setattr(es, name, value)
    assert searched(spark, rows, 10) == want
    assert searched(spark, rows[:1], 10) == {} and searched(spark, [], 10) == {}


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 5) for _ in range(5)]) for i in range(300)]
    assert searched(spark, rows, 5) == top(rows, 5)
    big = es.search(spark.createDataFrame([(0, [1e30, 1.0], 0, ""), (1, [1e30, 1.0], 0, ""), (2, [-1e30, 1.0], 0, ""), (3, [0.0, 1.0], 0, ""), (4, [1e308, 1.0], 0, "")], VECTORS)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in big] == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 1024 * 1024), (2, -(2**63))]


def test_coordinates_keep_all_that_is_near():
    rng = np.random.default_rng(3)
    q = rng.normal(size=6)
    v = np.round(1000 * (q * rng.uniform(0.1, 1, (500, 1)) + rng.normal(size=(500, 6)) * rng.uniform(0, 1, (500, 1))))
    length = np.sqrt((v**2).sum(axis=1))
    order = np.argsort(-length)
    v, length = v[order], length[order]
    block = es.Block({"n": 500, "dims": 6, "longest": float(length[0]), "ids": np.arange(500).tobytes(), "lengths": length.tobytes(), "parts": v.tobytes(), "bounds": b""})
    cos = v @ (q / np.linalg.norm(q)) / length
    for t in (0.5, 0.8, 0.9, 0.99):
        assert set(np.flatnonzero(cos >= t).tolist()) <= set(block.near(q / np.linalg.norm(q), t).tolist())
    assert len(block.near(q / np.linalg.norm(q), 0.99)) < 400


def lloyd(rows, k, rounds, dims):
    """([(vec_id, cluster, distance)], centroids)"""
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(ok, key=key)[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in ok]
        c = [[sum(x) // len(mine) for x in zip(*mine)] if (mine := [v for (_, v), o in zip(ok, own) if o == j]) else m for j, m in enumerate(c)]
    return [(i, near(v)[1], near(v)[0]) for i, v in ok], c


def clustered(spark, rows, k, rounds, dims):
    found, c = cl.cluster(spark.createDataFrame([(i, v, 0, "x") for i, v in rows], VECTORS), k, rounds, dims=dims)
    return [(r.vec_id, r.cluster, r.distance) for r in found.collect()], c.tolist()


def test_clustering_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 6)) + rng.integers(-2, 3, size=(400, 1)) * 2
    v[100:250] = np.round(v[100:250])  # ties
    v[50:90] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7, [0.5] * 6), (7, [0.5] * 6), (None, [1.0] * 6), (800, None), (801, [1.0] * 5), (802, [None] * 6), (803, [float("nan")] * 6), (804, [-float("inf")] * 6)]
    key = lambda r: (r[0] is None, r)
    for size in (cl.BLOCK_ROWS, 16):
        monkeypatch.setattr(cl, "BLOCK_ROWS", size)
        for k, rounds in ((13, 5), (40, 3), (1, 2)):
            got, c = clustered(spark, rows, k, rounds, 6)
            want, centroids = lloyd(rows, k, rounds, 6)
            assert sorted(got, key=key) == sorted(want, key=key) and c == centroids
    few, c = clustered(spark, rows[:3], 40, 5, 6)
    assert (sorted(few), c) == tuple(lloyd(rows[:3], 40, 5, 6))
    assert clustered(spark, rows[-4:], 40, 5, 6) == ([], [])


def test_clustering_bounds_spare_distances():
    """The search gives what looking at all centroids gives, with fewer distances."""
    rng = np.random.default_rng(6)
    middles = rng.integers(-3000, 3000, (20, 8))
    v = middles[rng.integers(0, 20, 4000)] + rng.integers(-60, 60, (4000, 8))
    parts = v[:20].copy()
    near, second, d1, d2 = cl._nearest_two(v, cl.Centroids(parts))
    upper, lower, worked = np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float)), 0
    for _ in range(6):
        before, parts = parts, np.array([v[near == j].sum(axis=0) // max((near == j).sum(), 1) if (near == j).any() else parts[j] for j in range(20)])
        c = cl.Centroids(parts, before.astype(float))
        near, second, upper, lower, n = cl.shallot(v, c, near, second, upper, lower)
        all_ = ((v[:, None] - parts[None]) ** 2).sum(axis=2)
        assert near.tolist() == all_.argmin(axis=1).tolist()
        assert (upper * (1 + 1e-9) >= np.sqrt(all_.min(axis=1))).all() and (lower * (1 - 1e-9) <= np.sqrt(np.sort(all_, axis=1)[:, 1])).all()
        worked += n
    assert worked < 0.25 * 6 * v.shape[0] * 20


def test_clustering_digest(spark):
    rows = [(i, [float(i % 5)] * 64, 0, "") for i in range(60)]
    out = cl.digest(*cl.cluster(spark.createDataFrame(rows, VECTORS))).collect()
    assert len(out) == 60 and {r.distance for r in out} == {0} and {r.inertia for r in out} == {0}
    one = next(r for r in out if r.vec_id == 3)
    assert one.centroid_sha256 == hashlib.sha256(",".join(["768"] * 64).encode()).hexdigest()
    assert cl.digest(*cl.cluster(spark.createDataFrame([], VECTORS))).columns == out[0].__fields__
