import random
import zlib

import numpy as np
import pyarrow as pa

from policyspark.llm import toxicity as tx

SCHEMA = "doc_id long, text string, score string, label string, draw string, toxic int"


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    vocab, bad = [f"plain{i}" for i in range(300)], ["vile", "rotten", "filthy"]
    rows, labels = [], []
    for d in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(3, 80))]
        toxic = d % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper())
        rows.append((d, " ".join(words) + ".", "s", "l", "d", 9))
        labels.append((d, int(toxic), "t"))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows + [(None, "vile", "", "", "", 0), (5000, None, "", "", "", 0), (5001, "", "", "", "", 0), (5002, "plain1 " * 30000, "", "", "", 0), (1, rows[1][1], "", "", "", 0)], SCHEMA)
    got = tx.digest(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()
    assert len(got) == len(rows) + 5
    truth = {d: t for d, t, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= tx.MARK)
        assert r.held_out in (True, False)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.99
    assert all(r.predicted == 0 for r in got if r.doc_id in (5000, 5001, 5002))


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t, x) for d, t, x in labels]
    schema = "doc_id long, toxic int, text string"
    a = tx.digest(docs, spark.createDataFrame(labels, schema)).collect()
    b = tx.digest(docs, spark.createDataFrame(flipped, schema)).collect()
    assert sorted((r.doc_id, r.score) for r in a) == sorted((r.doc_id, r.score) for r in b)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame(corpus(5)[0], SCHEMA)
    none = spark.createDataFrame([(None, 1, ""), (3, None, ""), (4, 7, "")], "doc_id long, toxic int, text string")
    assert {r.score for r in tx.digest(docs, none).collect()} == {0.5}
    assert tx.digest(docs.limit(0), none).count() == 0


def test_l1_leaves_few_weights():
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(1 << 41, 1 << 62, 50) | 1) for _ in range(100)]
    toxic = np.arange(100) % 2
    docs = [np.sort(np.append(d, (1 << 50) + 1)) if t else d for d, t in zip(docs, toxic)]
    keys, w, bias = tx.ftrl(docs, toxic.astype(float))
    assert keys.tolist() == [(1 << 50) + 1] and w[0] > 1 and bias < 0


def plain_ftrl(docs, labels, weights, l1):
    """FTRL-proximal as published, one coordinate at a time; the bias has no penalty."""
    import math

    often = [k for k in {k for d in docs for k in d} if sum(k in d for d in docs) >= tx.LEAST_DOCS]
    z, n = {k: 0.0 for k in [*often, "bias"]}, {k: 0.0 for k in [*often, "bias"]}

    def weight(k):
        penalty = 0.0 if k == "bias" else l1
        if abs(z[k]) <= penalty:
            return 0.0
        return -(z[k] - math.copysign(penalty, z[k])) / ((tx.BETA + math.sqrt(n[k])) / tx.ALPHA + tx.L2)

    for _ in range(tx.EPOCHS):
        for d, y, c in zip(docs, labels, weights):
            own = [k for k in d if k in z] + ["bias"]
            w = {k: weight(k) for k in own}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * c
            for k in own:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / tx.ALPHA * w[k]
                n[k] += g * g
    return {k: weight(k) for k in z if k == "bias" or weight(k)}


def test_ftrl_equals_a_plain_one():
    rng = random.Random(3)
    names = [(i << 45) + 1 for i in range(40)]
    docs = [{rng.choice(names[:10] if y else names) for _ in range(rng.randint(0, 12))} for y in [i % 2 for i in range(120)]]
    labels, weights = [i % 2 for i in range(120)], [rng.random() for _ in range(120)]
    keys, w, bias = tx.ftrl([np.array(sorted(d), dtype=np.int64) for d in docs], np.array(labels, dtype=float), np.array(weights), l1=0.7)
    want = plain_ftrl(docs, labels, weights, 0.7)
    assert abs(bias - want.pop("bias")) < 1e-9 and set(keys.tolist()) == set(want) and 3 < len(want) < 40
    assert all(abs(want[k] - x) < 1e-9 for k, x in zip(keys.tolist(), w))


def test_scores_are_sums_of_weights(spark):
    """A document's score by hand: the weights of its distinct features."""
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = tx.train(docs, spark.createDataFrame(labels, "doc_id long, label int, text string"))
    of = dict(zip(model.keys.tolist(), model.weights.tolist()))
    texts = {r[0]: r[1] for r in rows}
    for r in tx.score(docs, model).collect():
        found = set(tx.features(pa.array([texts[r.doc_id]]))[1].tolist())
        assert abs(r.score - tx.sigmoid(model.bias + sum(of.get(f, 0) for f in found))) < 1e-9


def test_learning_is_bounded_by_bytes(spark):
    from policyspark.llm._sample import sampled_texts

    docs = spark.createDataFrame([(1, "a" * 10), (2, "b" * 50), (3, "c" * 10), (3, "a"), (4, "d" * 10), (5, None)], "doc_id long, text string")
    drawn = spark.createDataFrame([(i, 10 - i) for i in range(1, 7)], "doc_id long, draw long")
    got = {r.doc_id: r.text for r in sampled_texts(docs, drawn, most=21, longest=40).collect()}
    assert got == {5: None, 4: "d" * 10, 3: "a", 1: "a" * 10}
    assert set(r.doc_id for r in sampled_texts(docs, drawn, most=12, longest=40).collect()) == {5, 4, 3}


def test_features_stay_within_their_row():
    row, f = tx.features(pa.array(["a b", None, "c", "", "b c d"]))
    alone = [set(tx.features(pa.array([t]))[1].tolist()) for t in ("a b", "", "c", "", "b c d")]
    assert [set(f[row == i].tolist()) for i in range(5)] == alone
