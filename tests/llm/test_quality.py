import random

import pytest
from pyspark.sql import functions as F

from policyspark.llm import quality_classifier as qc, quality_rules as qr

SCHEMA = "doc_id long, text string, ledger string, n_words string, failures string, good string, draw string, __score_ string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in enumerate(texts)], SCHEMA)


def base(text):
    """The contract's base measurements, plainly."""
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {g for g in wins if wins.count(g) > 1}
    hit = {p for i, g in enumerate(wins) if g in twice for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "one", "a b c d e f", "x " * 900, "ab\n\nab\n ab\r\nab", "# * $ % & | < >", "é ü \U0001f600 中\x0b文\x0c."]
    for _ in range(60):
        w = [rng.choice(["a", "b", "c", "dd", "e#"]) for _ in range(rng.randint(0, 60))]
        out.append(rng.choice([" ", "\n", "  "]).join(w))
    return out


def test_measurements_equal_plain_ones(spark):
    docs = texts()
    for r in qr.digest(frame(spark, docs)).collect():
        n, chars, symbols, dup, rep = base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), docs[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and not (r.base_failed and r.kept)


def test_policies_read_the_ledger(spark):
    docs = frame(spark, texts())
    led = qr.add_ledger(docs.select("doc_id", "text"), "ledger")
    rows = led.select("doc_id", "ledger.failures").collect()
    by = {r.rule: r for r in qr.ablations(led).collect()}
    assert set(by) == set(qr.POLICIES[qr.PRODUCTION].rules)
    for rule, r in by.items():
        bit = 1 << qr.BIT[rule]
        assert r.fails == sum(bool(x.failures & bit) for x in rows) and r.rejects_alone == sum(x.failures == bit for x in rows)
    kept = qr.filtered(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {x.doc_id for x in rows if not x.failures & qr.POLICIES[qr.PRODUCTION].mask}
    assert qr.digest(docs.limit(0)).count() == 0 and qr.filtered(docs.limit(0)).count() == 0


def corpus():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    good, out = [], []
    for k in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(12, 120))]
        w = [x + ("." if rng.random() < 0.1 else "") for x in w]
        kind = k % 10
        if kind == 1:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
        elif kind == 2:
            w = [x.upper() + "!!" for x in w[:12]] * 6
        elif kind == 3:
            w = [x for x in w[:15] for _ in range(8)]
        out.append(" ".join(w))
        good.append(kind not in (1, 2, 3))
    return out, good


def test_weak_labels_tell_junk_from_prose(spark):
    docs, good = corpus()
    got = qc.digest(frame(spark, docs), sample=600).collect()
    assert len(got) == len(docs)
    assert sum(r.kept == good[r.doc_id] for r in got) / len(got) > 0.98
    assert all(r.kept for r in got if good[r.doc_id])


def test_clean_corpus_is_kept(spark):
    docs, good = corpus()
    clean = [d for d, g in zip(docs, good) if g]
    kept = qc.filtered(frame(spark, clean))
    assert kept.columns == frame(spark, []).columns and kept.count() == len(clean)


def test_odd_rows(spark):
    docs = frame(spark, [None, "", " ", "word " * 50000, "same", "same"])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") == 2, None).otherwise(F.col("doc_id")))
    got = qc.digest(docs).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (4, 5)}) == 1
    assert qc.digest(docs.limit(0)).count() == 0 and qc.filtered(docs.limit(0)).count() == 0


def test_label_model_learns_rates():
    all_good, bad = qc.pattern(qc.votes(qc.measure(__import__("pyarrow").array(["plain words here and more of them to be read by all of us today", "AB!! CD## " * 30]))[0])).tolist()
    model = qc.label_model({all_good: 9000, bad: 1000})
    assert model[all_good] > 0.95 and model[bad] < 0.2
    assert qc.label_model({}) == {}


def plain_em(patterns):
    """Expectation-maximisation with the same prior, in plain loops."""
    import math

    kinds, names = [None, *qc.KINDS], qc.MEASURES
    prior_rate = [[(0.003, 0.9, 0.097) if k is None else (0.7, 0.2, 0.1) if n in k else (0.1, 0.8, 0.1) for n in names] for k in kinds]
    prior_share = [0.9] + [0.1 / len(qc.KINDS)] * len(qc.KINDS)
    total = sum(patterns.values())
    pull = qc.PRIOR
    rate, share = prior_rate, prior_share
    for _ in range(qc.ROUNDS):
        post = {}
        for p in patterns:
            v = [p // 3**j % 3 for j in range(len(names))]
            like = [share[c] * math.prod(rate[c][j][v[j]] for j in range(len(names))) for c in range(len(kinds))]
            post[p] = [x / sum(like) for x in like]
        mass = [sum(n * post[p][c] for p, n in patterns.items()) for c in range(len(kinds))]
        new = []
        for c in range(len(kinds)):
            rows = []
            for j in range(len(names)):
                seen = [sum(n * post[p][c] for p, n in patterns.items() if p // 3**j % 3 == x) + pull * prior_rate[c][j][x] * prior_share[c] for x in range(3)]
                rows.append([x / sum(seen) for x in seen])
            new.append(rows)
        rate, share = new, [(mass[c] + pull * prior_share[c]) / (total + pull) for c in range(len(kinds))]
    return {p: post[p][0] for p in patterns}


def test_label_model_equals_a_plain_one():
    rng = random.Random(12)
    patterns = {rng.randrange(3 ** len(qc.LABELLERS)): rng.randint(1, 400) for _ in range(60)}
    got, want = qc.label_model(patterns), plain_em(patterns)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_em_recovers_rates_that_differ_from_the_prior(monkeypatch):
    """Labellers that are right less often than the prior has it: with enough documents, posteriors are those of the planted rates."""
    import itertools
    import math

    names, kinds = qc.MEASURES, [None, *qc.KINDS]
    share = [0.7, 0.12, 0.08, 0.1]
    rate = [[(0.06, 0.6, 0.34) if k is None else (0.45, 0.15, 0.4) if n in k else (0.05, 0.75, 0.2) for n in names] for k in kinds]
    true, counts = {}, {}
    for v in itertools.product(range(3), repeat=len(names)):
        like = [share[c] * math.prod(rate[c][j][v[j]] for j in range(len(names))) for c in range(len(kinds))]
        code = sum(x * 3**j for j, x in enumerate(v))
        true[code] = like[0] / sum(like)
        if n := round(sum(like) * 5_000_000):
            counts[code] = n
    monkeypatch.setattr(qc, "ROUNDS", 300)
    off = lambda counts: sum(n * abs(qc.label_model(counts)[p] - true[p]) for p, n in counts.items()) / sum(counts.values())
    few = {p: n // 20_000 for p, n in counts.items() if n >= 20_000}
    got = qc.label_model(counts)
    assert sum(n * abs(got[p] - true[p]) for p, n in counts.items()) / sum(counts.values()) < 0.01
    assert off(few) > 0.05  # a few hundred documents don't outweigh it


def test_measures_equal_plain_ones():
    import re

    import pyarrow as pa

    docs = texts() + ["AB!! Cd? #x é 1,2 a a a"]
    m, _, _ = qc.measure(pa.array(docs), features=False)
    m2, row, f = qc.measure(pa.array(docs))
    assert (m == m2).all()
    for t, x, i in zip(docs, m, range(len(docs))):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        up, lo = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
        low = [re.sub("[A-Z]", lambda c: c[0].lower(), a) for a in w]
        grams = [tuple(low[j : j + 5]) for j in range(len(w) - 4)]
        want = [sum(c in "#*$%&|<>" for c in t) / max(len(w), 1), up / max(up + lo, 1), 1 - len(set(grams)) / len(grams) if grams else 0, sum(a == b for a, b in zip(low, low[1:])) / max(len(w), 1), len(w), sum(c in "!?" for c in t) / max(len(w), 1)]
        assert all(abs(a - b) < 1e-12 for a, b in zip(x, want)), t
        alone = qc.measure(pa.array([t]))[2]
        assert set(f[row == i].tolist()) == set(alone.tolist())


def test_columns_named_like_our_own(spark):
    """Stages give back a caller's columns as they were, whatever they are called."""
    names = ["__text", "__ledger", "__failures", "ledger", "_ledger", "failures", "q_text", "q_n_words", "_Q_g", "__score", "__pattern", "score", "Pattern", "_score"]
    text = "some plain words that are read by all of us on most days of the year"
    docs = spark.createDataFrame([(i, text + f" {i}", *[f"{c}{i}" for c in names]) for i in range(12)] + [(99, "bad", *names)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    want = sorted(tuple(r) for r in docs.where("doc_id < 99").collect())
    for stage in (qr.filtered, qc.filtered):
        got = stage(docs)
        assert got.columns == docs.columns
        assert [r for r in sorted(tuple(r) for r in got.collect()) if r[0] < 99] == want
    led = qr.add_ledger(docs, "ledger")
    assert led.columns == docs.columns and led.where("doc_id = 3").first()["__text"] == "__text3"


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert {r.doc_id for r in qr.digest(docs).collect()} == {r.doc_id for r in qc.digest(docs).collect()} == {"a", "b"}
