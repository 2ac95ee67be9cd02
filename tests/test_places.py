"""Places of very many strings: all that hold one, and hardly any others."""

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from policyspark.functions import places as pl
from policyspark.operators import text_policy as tp


def test_places_are_those_of_the_strings(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé𝒳") for _ in range(rng.randint(1, 4)))
    texts = ["\x00".join(word() for _ in range(rng.randint(0, 40))) for _ in range(120)] + [None, ""]
    keys = sorted({"\x00".join(word() for _ in range(rng.randint(1, 4))) for _ in range(300)})
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for edge in ("", "\x00"):
        known = pl.known(spark.createDataFrame([(k,) for k in keys], "key string").repartition(3), len(keys), edge)
        shared = spark.sparkContext.broadcast(known)
        got = {(r.i, *r.s) for r in rows.select("i", F.explode(pl.places(F.col("t"), shared, edge)).alias("s")).collect()}
        want = set()
        for i, t in enumerate(texts):
            for k in keys if t else []:
                if edge:
                    w, n = t.split(edge), k.count(edge) + 1
                    want |= {(i, j, j + n, k) for j in range(len(w)) if edge.join(w[j : j + n]) == k}
                else:
                    want |= {(i, j, j + len(k), k) for j in range(len(t)) if t.startswith(k, j)}
        assert want <= got and len(got) <= 1.5 * len(want) and len(want) > 200


def test_long_texts_are_looked_at_in_pieces(spark):
    text = "x" * (pl.CHUNK - 3) + "needle in hay" + "y" * 50 + "needle"
    shared = spark.sparkContext.broadcast(pl.known(spark.createDataFrame([("needle",), ("needle in hay",)], "key string"), 2))
    got = spark.createDataFrame([(text,), ("needle",)], "t string").select(F.explode(pl.places(F.col("t"), shared)).alias("s")).select("s.*").collect()
    assert sorted((r.start, r.gram) for r in got) == [(0, "needle"), (pl.CHUNK - 3, "needle"), (pl.CHUNK - 3, "needle in hay"), (pl.CHUNK + 60, "needle")]


@pytest.mark.parametrize("edge", ["", "\x00"])
def test_memory_follows_the_piece_and_not_the_batch(monkeypatch, edge):
    """8 MB of texts at once, in many short ones or one long one: codes, hashes and counts are held for a piece of them."""
    monkeypatch.setattr(pl.F, "arrow_udf", lambda _: lambda f: f)
    keys = ["needle" + edge + "in" + edge + "hay", "straw"]
    mine = pl.Known(16, {}, sorted({len(edge + k + edge) for k in keys}))
    for bit in pl._slots([edge + k + edge for k in keys], 16).flatten().to_pylist():
        mine.map[bit >> 3] |= 1 << (bit & 7)
    filler = edge.join(["straw", "needle", "in", "hay"]) + (edge or "x") + "grass" * 700
    for texts in ([filler] * 2_300, [(filler + edge) * 2_300]):
        batch = pa.array(texts)
        tracemalloc.start()
        found = pl.places(batch, SimpleNamespace(value=mine), edge)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        got = [g for t in found.to_pylist() for g in t]
        assert peak < 60e6 and sum(g["gram"] == keys[0] for g in got) == 2_300 and sum(g["gram"] == keys[1] for g in got) == 2_300
    first = [g for g in got if g["gram"] == keys[0]]
    assert (first[1]["start"], first[1]["stop"]) == ((6, 9) if edge else (first[0]["start"] + len(filler), first[0]["stop"] + len(filler)))


def test_hardly_a_place_is_no_string_s(monkeypatch):
    """5,000 strings of many lengths: what the bitmap lets through is nearly all strings'."""
    monkeypatch.setattr(pl.F, "arrow_udf", lambda _: lambda f: f)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(4, 30)))
    keys = sorted({word() for _ in range(5_000)})
    mine = pl.Known(18, {}, sorted({len(k) for k in keys}))
    for bit in pl._slots(keys, 18).flatten().to_pylist():
        mine.map[bit >> 3] |= 1 << (bit & 7)
    texts = ["".join(word() if rng.random() < 0.9 else rng.choice(keys) for _ in range(400)) for _ in range(30)]
    grams = [g["gram"] for t in pl.places(pa.array(texts), SimpleNamespace(value=mine)).to_pylist() for g in t]
    true = sum(g in set(keys) for g in grams)
    assert true > 1_000 and len(grams) < 1.2 * true + 0.01 * sum(map(len, texts))


@pytest.mark.parametrize(("inline", "broadcast", "rows"), [(2_000, 1_000, 1), (20, 1_000, 1), (20, 1, 1), (20, 1_000, 2)])
def test_terms_without_places_are_those_of_the_matches(spark, monkeypatch, inline, broadcast, rows):
    """Inline, broadcast and merged, with terms of more than one key and documents of more than one row."""
    monkeypatch.setattr(tp, "INLINE", inline)
    monkeypatch.setattr(tp, "BROADCAST_KEYS", broadcast)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aB0é") for _ in range(rng.randint(1, 3)))
    terms = [(i, f"{word()} {word()}", "c", "low", ["token_sequence", "compact"], "d", [f"{word()}-{word()}"] if rows == 2 else []) for i in range(80)]
    lex = tp.lexicon_table(spark, terms)
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None])) for i in range(40)]
    docs = docs * rows + [(100, None, "en"), (101, "", "de")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = [tuple(r) for r in tp.matched_terms(df, lex).collect()]
    want = {tuple(r) for r in tp.matches(df, lex).select("doc_id", "term_id", "mode").collect()}
    assert set(got) == want and len(got) == len(want) > 200


def test_terms_that_begin_alike_make_no_product(spark, monkeypatch):
    """4,000 terms of one beginning, 40 texts of nothing but that beginning: rows are joined once a match, not once a term."""
    monkeypatch.setattr(tp, "INLINE", 100)
    lex = spark.range(4000).select(F.col("id").cast("int").alias("term_id"), F.lit("d").alias("dictionary"), F.concat(F.lit("same beginning "), F.col("id").cast("string")).alias("phrase"), F.lit("c").alias("category"), F.lit("low").alias("severity"), F.array(F.lit("token_sequence"), F.lit("compact")).alias("modes"), F.lit(None).cast("array<string>").alias("surfaces"))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("same beginning "), 200), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"))
    seen = []
    monkeypatch.setattr(tp, "places", lambda *a: seen.append(pl.places(*a)) or seen[-1])
    found = tp.matches(docs, lex)
    assert found.where("mode = 'token_sequence'").count() == 40 and found.where("mode = 'compact'").count() == 40 + 30
    assert len(seen) == 2
