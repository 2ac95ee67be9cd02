import random

import numpy as np
import pyarrow as pa
import pytest

from policyspark.llm import near_duplicates as nd

from . import brute

SCHEMA = "doc_id long, text string, component_id string, kept string, class string, key string, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z", None, "r") for d, t in rows], SCHEMA)


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "a b c d"), (6, "a b c"), (7, "a b c d e"), (8, "x " * 6000)], 10
    passage = [rng.choice(vocab) for _ in range(60)]
    for size in (6, 12, 40, 120, 400):
        for _ in range(4):
            base = [rng.choice(vocab) for _ in range(size)]
            for k in range(6):
                text = list(base)
                for _ in range(rng.choice([0, 0, 1, 2, size // 60 + 1, size // 20 + 1])):
                    text[rng.randrange(size)] = rng.choice(vocab)
                rows.append((n, " ".join(text) if k % 2 else " ".join(text).upper()))
                n += 1
    for _ in range(40):  # a shared passage, similarity below the mark
        rows.append((n, " ".join([rng.choice(vocab) for _ in range(rng.randint(8, 25))] + passage)))
        n += 1
    chain = [rng.choice(vocab) for _ in range(200)]
    for _ in range(25):  # each close to the next, the ends far apart
        chain = chain[8:] + [rng.choice(vocab) for _ in range(8)]
        rows.append((n, " ".join(chain)))
        n += 1
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_repeated_rows_nulls_and_empty(spark, monkeypatch):
    monkeypatch.setattr(nd, "BROADCAST_ROWS", 0)
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (5, "p q r s t u"), (9, "p q r s t u"), (None, "a b c d e f"), (4, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in nd.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 3, False)] * 3 + [(3, 3, True), (9, 3, False), (None, None, True), (4, 4, True)], key=str)
    kept = sorted(((r.doc_id, r.kept) for r in nd.deduplicated(frame(spark, rows)).collect()), key=str)
    assert kept == sorted([(3, "y"), (None, "y"), (4, "y")], key=str)
    assert nd.near_duplicates(frame(spark, rows).limit(0)).count() == 0
    assert nd.deduplicated(frame(spark, rows).limit(0)).count() == 0


def test_words_of_one_pattern_and_clashing_columns(spark):
    """Thue-Morse words and their complements are different words; columns named like our own come back as they were."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    flip = str.maketrans("ab", "ba")
    rows = [(1, word[:1024]), (2, word[:1024].translate(flip)), (3, word), (4, word.translate(flip)), (5, word)]
    docs = spark.createDataFrame([(d, t, 7, 8, 9) for d, t in rows], "doc_id long, text string, n int, __n int, N_ int")
    assert {r.doc_id: r.component_id for r in nd.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [(d, t, 7, 8, 9) for d, t in rows[:4]]


def test_blocks_are_bounded_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 100)
    members = spark.createDataFrame([(1, i, i, 50) for i in range(8)], "group long, doc long, component long, n_shingles long")
    tasks = nd.block_tasks(members).collect()
    by = {}
    for r in tasks:
        by.setdefault(r.task, set()).add(r.doc)
    assert all(any({a, b} <= docs for docs in by.values()) for a in range(8) for b in range(a))
    assert len(by) > 3


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.9):
        union = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
        cut = (1 - share) / 2
        mask = rng.random(len(union))
        a, b = union[mask > cut], union[mask < 1 - cut]
        for regs in (nd.bucket_registers([a, b]), nd.permuted_registers([a, b])):
            j, n = nd.estimate(regs[:1], regs[1:])
            assert n[0] == nd.REGISTERS and abs(j[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2


def test_registers_hold_zeros_and_mantissa():
    h = np.array([1 << 56, (3 << 57) | 5, 1 << 63], dtype=np.uint64)
    regs = nd.bucket_registers([np.sort(h)])[0]
    assert (regs > 0).sum() == len({int(x) >> (64 - nd.REGISTERS_LOG2) for x in h})
    assert (nd.bucket_registers([h[:0]]) == 0).all() and (nd.permuted_registers([h[:0]]) == 0).all()
    assert nd.compressed(np.array([1 << 63, 1 << 62], dtype=np.uint64)).tolist() == [1 << nd.MANTISSA, 2 << nd.MANTISSA]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in nd.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
