"""Views, URL chunks, matching and scores: golden cases and invariance."""

import pytest
from pyspark.sql import functions as F

from policyspark.functions import text as fx
from policyspark.operators import text_policy as tp

TEXTS = "doc_id long, text string, lang string"


def test_views(spark):
    df = spark.createDataFrame([(1, "  P-0.R_N  H U B  ", "en"), (2, "  Привіт-світе 123  ", "uk"), (3, None, "en"), (4, "ﬁne ①", None), (5, "", "en")], TEXTS)
    v = {r.doc_id: r for r in fx.views(df).collect()}
    assert v[1].normalized == "p-0.r_n h u b" and len(v[1].separator_tokens) == 7 and v[1].compact == "p0rnhub" and v[1].leet_compact == "pornhub"
    assert v[2].normalized == "Привіт-світе 123" and v[2].leet_compact == v[2].compact == "Привітсвіте123"
    assert v[3].normalized is None and v[4].normalized == "fine 1" and v[5].separator_tokens == []


@pytest.mark.parametrize("chunk,like", [("/some/path", True), ("example.com", True), ("http://localhost", True), ("notaurl", False), ("single.", False), (".hidden", False)])
def test_url_like(spark, chunk, like):
    assert spark.createDataFrame([(chunk,)], "c string").select(fx.looks_url_like(F.col("c"))).first()[0] is like


def test_url_streams(spark):
    r = spark.createDataFrame([("see (https://Example.com/Page_2?x), plain words a.b end.",)], "t string").select(fx.url_token_streams(F.col("t")).alias("s")).first()
    assert r.s == [["example", "com", "page", "2", "x"], ["a", "b"]]


def score(spark, lexicon, text, lang="en"):
    docs = spark.createDataFrame([(1, text, lang)], TEXTS)
    r = tp.verdicts(docs, tp.lexicon_table(spark, lexicon)).first()
    return r.score, r.action, r.n_terms


ALL = ["exact_phrase", "token_sequence", "compact"]


def test_scores(spark):
    assert score(spark, [(1, "bad word", "x", "medium", ["exact_phrase", "compact"])], "a bad word here") == (35, "allow", 1)
    assert score(spark, [(1, "bad", "x", "high", ["exact_phrase", "compact"])], "bad") == (80, "block", 1)
    assert score(spark, [(1, "bad", "x", "high", ["compact"])], "b-4-d") == (60, "warn", 1)
    assert score(spark, [(1, "bad", "x", "medium", ["exact_phrase", "token_sequence"])], "bad and bad") == (70, "warn", 1)
    assert score(spark, [(1, "bad", "x", "high", ALL), (2, "doctor", "medical_exception", "low", ALL)], "bad doctor") == (40, "allow", 1)
    assert score(spark, [(1, "bad", "x", "medium", ["exact_phrase"]), (2, "sad", "x", "low", ["exact_phrase"])], "bad, sad") == (50, "warn", 2)
    assert score(spark, [(1, "bad", "x", "high", ALL)], None) == (0, "allow", 0)


def test_match_modes(spark):
    lex = [(1, "of the", "x", "low", ["exact_phrase", "token_sequence"]), (2, "aa", "x", "low", ["compact"]), (3, "site com", "x", "low", ["url_token_sequence"])]
    docs = spark.createDataFrame([(1, "Of the best, of, the  rest; sof the", "en"), (2, "a-A-aa", "en"), (3, "http://site.com http://site.com/x site com", "en")], TEXTS)
    got = sorted((r.doc_id, r.term_id, r.mode) for r in tp.matches(docs, tp.lexicon_table(spark, lex)).collect())
    assert got == [(1, 1, "exact_phrase")] + [(1, 1, "token_sequence")] * 2 + [(2, 2, "compact")] * 3 + [(3, 3, "url_token_sequence")]


def test_phrases_take_the_steps_of_the_text(spark):
    lex = [(1, "Bad Haus", "x", "low", ALL), (2, "B4d", "x", "low", ["compact"]), (3, "Site com", "x", "low", ["url_token_sequence"])]
    docs = spark.createDataFrame([(1, "BAD haus b-a-d", "en"), (2, "ein Bad Haus B-4-d", "de"), (3, "bad haus bad", "de"), (4, "Bad Haus", None), (5, "http://SITE.com", "de"), (6, "Ｂａｄ  Haus", "fr")], TEXTS)
    got = sorted((r.doc_id, r.term_id, r.mode) for r in tp.matches(docs, tp.lexicon_table(spark, lex)).collect())
    every = lambda d: [(d, 1, "compact"), (d, 1, "exact_phrase"), (d, 1, "token_sequence")]
    assert got == every(1) + [(1, 2, "compact")] * 2 + every(2) + [(2, 2, "compact")] + every(4) + [(5, 3, "url_token_sequence")] + every(6)


def test_outer_characters_of_an_exact_phrase(spark):
    lex = [(1, "c++", "x", "low", ["exact_phrase"]), (2, "(bad)", "x", "low", ["exact_phrase"]), (3, "bad", "x", "low", ["exact_phrase"]), (4, "#a b!", "x", "low", ["exact_phrase"])]
    texts = ["C++", "c+", "c++!", "c++x", "(bad)", "x (bad) y", "x(bad)", "(bad)y", "((bad))", "bad)", "see #a b!", "see a b!", "#a b", "#a b!!, #a b!"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], TEXTS)
    got = sorted((r.doc_id, r.term_id) for r in tp.matches(docs, tp.lexicon_table(spark, lex)).collect())
    want = [(i, k) for i, t in enumerate(texts) for k, p, *_ in lex for j in range(len(t)) if t.lower().startswith(p, j) and not t[:j][-1:].isalnum() and not t[j + len(p) :][:1].isalnum()]
    assert got == sorted(want) and {k for _, k in want} == {1, 2, 3, 4}


def test_order_and_partitions_do_not_matter(spark):
    lex = tp.lexicon_table(spark, [(i, w, "x", "low", ALL) for i, w in enumerate(["a b", "b", "c a"])])
    rows = [(i, " ".join("abc"[(i * k) % 3] for k in range(1, 12)), "en") for i in range(30)]
    results = {tuple(sorted((r.doc_id, r.term_id, r.best_mode, r.occurrences) for r in tp.term_hits(tp.matches(spark.createDataFrame(x, TEXTS).repartition(n), lex)).collect())) for x, n in ((rows, 1), (rows[::-1], 7))}
    assert len(results) == 1


def test_lexicon_errors(spark):
    rows = [(1, " \t", "x", "low", ALL), (2, "a", "x", "low", []), (3, "a", "x", "low", ["odd"]), (4, "a", "x", "low", ALL), (4, "b", "x", "low", ALL), (5, "a", "x", "low", ALL, " "), (6, "a", "x", "low", ALL, "core", ["b", ""]), (7, "...", "x", "low", ALL)]
    lex = tp.lexicon_table(spark, rows)
    assert sorted(tuple(r) for r in tp.lexicon_errors(lex).collect()) == [(1, "empty_phrase"), (2, "no_modes"), (3, "unknown_mode"), (4, "repeated_id"), (5, "empty_dictionary"), (6, "empty_surface")]


def plain_matches(lex, text, lang):
    """(term, mode, surface, start, stop) of a text without URLs, character by character."""
    import re

    def steps(t):
        t = " ".join(t.split())
        t = t.lower() if lang == "en" else t
        bare = "".join(c for c in t if c.isalnum())
        return t, [w for w in re.split(r"[\W_]+", t) if w], bare.translate(str.maketrans("013457", "oieast")) if lang == "en" else bare

    t, tokens, leet = steps(text)
    out = set()
    for term, phrase, _, _, modes, *more in lex:
        for s in [phrase, *(more[1] if len(more) > 1 else [])]:
            p, words, bare = steps(s)
            for m in modes:
                if m == "compact" and bare:
                    out |= {(term, m, bare, i, i + len(bare)) for i in range(len(leet)) if leet.startswith(bare, i)}
                if m == "token_sequence" and words:
                    out |= {(term, m, p, i, i + len(words)) for i in range(len(tokens)) if tokens[i : i + len(words)] == words}
                if m == "exact_phrase" and p:
                    for i in range(len(t)):
                        if t.startswith(p, i) and not t[:i][-1:].isalnum() and not t[i + len(p) :][:1].isalnum():
                            at = len([w for w in re.split(r"[\W_]+", t[:i]) if w]) if words else i
                            out.add((term, m, p, at, at + (len(words) or len(p))))
    return out


@pytest.mark.parametrize("inline", [2_000, 0])
def test_matches_equal_plain_ones(spark, monkeypatch, inline):
    import random

    monkeypatch.setattr(tp, "INLINE", inline)
    monkeypatch.setattr(tp, "BROADCAST_TERMS", inline)
    rng = random.Random(2)
    lex = [(1, "ab", "x", "low", ALL, "d", ["b a", "A-b"]), (2, "aa", "x", "low", ALL), (3, "a b a b", "x", "low", ALL), (4, "#a", "x", "low", ["exact_phrase"]), (5, "Ab4", "x", "low", ["compact", "token_sequence"]), (6, "abaab", "x", "low", ["compact"]), (7, "é", "x", "low", ALL)]
    lex += [(8, "+-", "x", "low", ["exact_phrase"]), (9, "#", "x", "low", ["exact_phrase"]), (10, "- # +- ,", "x", "low", ["exact_phrase"], "d", ["+-+-+-", ","])]
    texts = ["".join(rng.choice(["a", "b", "A", " ", " ", "#", "-", "4", "+-", "é", ", "]) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    docs = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)] + [(900, None, "en")]
    got = {(r.doc_id, r.term_id, r["mode"], r.surface, r.start, r.stop) for r in tp.matches(spark.createDataFrame(docs, TEXTS), tp.lexicon_table(spark, lex)).collect()}
    want = {(d, *m) for d, t, lang in docs for m in plain_matches(lex, t or "", lang)}
    assert got == want and len({(w[1], w[2]) for w in want}) > 12


def test_evidence(spark):
    lex = tp.lexicon_table(spark, [(1, "bad word", "x", "medium", ALL, "core", ["worse"]), (2, "doctor", "medical_exception", "low", ALL), (3, "sad", "y", "high", ["compact"])])
    docs = spark.createDataFrame([(1, "the s-a-d doctor said bad word, bad worse", "en"), (2, "fine", "en")], TEXTS)
    found = tp.matches(docs, lex)
    got = sorted(tuple(r)[:-2] + (float(r.multiplier), r.occurrences) for r in tp.evidence(found, lex, "0.90").collect())
    assert got == [(1, 1, "core:bad word", "x", "medium", "exact_phrase", 6, 8, 35, 0.9, 2), (1, 3, "core:sad", "y", "high", "compact", 3, 6, 80, 0.675, 1)]
    at = [(r.term_id, r["mode"], r.start) for r in tp.ordered(found, 1).collect()]
    order = list(tp.MODES)
    assert at == sorted(at, key=lambda x: (x[0], order.index(x[1]), x[2])) and len(at) == 10
    assert tp.matches(docs, lex.limit(0)).count() == 0 and tp.matches(docs.limit(0), lex).count() == 0


def test_assemble_and_variants(spark):
    df = spark.createDataFrame([([" a ", "", None, "b\n c"], "soooo", "раypal"), ([], "x", "y"), (["word " * 1000], "x", "y"), (["z" * 5000], "x", "y")], "f array<string>, s string, h string")
    r = df.select(fx.assemble(F.col("f")).alias("t"), fx.squeeze(F.col("s")).alias("s"), fx.homoglyph_fold(F.col("h")).alias("h")).collect()
    assert r[0].t == "a b c" and r[0].s == "soo" and r[0].h == "paypal" and r[1].t is None
    assert r[2].t == ("word " * 800).strip() and r[3].t == "z" * 4000


def test_worst(spark):
    df = spark.createDataFrame([(1, "warn"), (1, "block"), (2, "allow")], "item int, action string")
    assert {r.item: r.action for r in tp.worst(df).collect()} == {1: "block", 2: "allow"}


def test_model_is_asked_in_the_warn_band_only(spark):
    done = spark.createDataFrame([(1, "warn"), (2, "warn"), (3, "allow"), (4, "block")], "doc_id long, action string")
    texts = spark.createDataFrame([(i, "x" * i, "en") for i in range(1, 5)], TEXTS)
    asked = tp.with_model(done, texts, lambda t: F.length(t) / 4, 0.5)
    assert {r.doc_id: r.action for r in asked.collect()} == {1: "warn", 2: "block", 3: "allow", 4: "block"}


def test_amplifier(spark):
    lex = tp.lexicon_table(spark, [(1, "bad", "x", "low", ["token_sequence"]), (2, "sad", "x", "low", ["token_sequence"])])
    docs = spark.createDataFrame([(1, "bad or sad", "en"), (2, "bad " + "w " * 30 + "sad", "en"), (3, "bad", "en")], TEXTS)
    got = {r.doc_id: r.points for r in tp.amplified(tp.matches(docs, lex), lex, 5).collect()}
    assert got == {1: 15, 2: 0, 3: 0}


def test_all_amplifiers(spark):
    lex = tp.lexicon_table(spark, [(1, "bad", "x", "low", ["token_sequence"]), (2, "sad", "y", "low", ["token_sequence"])])
    docs = spark.createDataFrame([(1, "bad bad sad", "en"), (2, "bad", "en"), (3, "none", "en")], TEXTS)
    images = spark.createDataFrame([(1, "y"), (1, "y"), (2, "y"), (None, "x")], "doc_id long, category string")
    out = tp.amplifiers(tp.matches(docs, lex), lex, 5, images, spark.createDataFrame([("x",)], "category string"), spark.createDataFrame([(1,), (1,), (9,)], "doc_id long"))
    assert {(r.doc_id, r.category): tuple(r)[2:] for r in out.collect()} == {(1, "x"): (15, 0, 20, 10, 45), (1, "y"): (0, 20, 0, 10, 30), (2, "x"): (0, 0, 20, 0, 20)}


def test_evidence_lists_are_in_order(spark):
    lex = tp.lexicon_table(spark, [(5, "bad", "x", "low", ["token_sequence"]), (2, "sad", "y", "low", ["token_sequence"]), (3, "doctor", "medical_exception", "low", ALL)])
    docs = spark.createDataFrame([(1, "bad doctor sad bad", "en"), (2, "doctor", "en"), (3, "sad", "en")], TEXTS)
    got = {r.doc_id: [(e.term_id, e.start, e.occurrences) for e in r.evidence] for r in tp.evidence_lists(tp.matches(docs, lex), lex).collect()}
    assert got == {1: [(2, 2, 1), (5, 0, 2)], 3: [(2, 0, 1)]}


def test_nfkc_leaves_stable_characters_to_the_jvm(spark):
    import re
    import unicodedata

    stable = re.compile(f"[{fx.NFKC_STABLE}]")
    second = {int(d.split()[1], 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and d[0] != "<" and " " in d}
    for c in filter(lambda c: stable.match(chr(c)), range(0x110000)):
        assert unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and c not in second and not 0x1160 <= c <= 0x11FF
    texts = ["plain", "Grün, «été» – naïve…", "ﬁn ｆｕｌｌ", "e\u0301", "\u1112\u1161\u11ab", None, "Ω Å ½ ① İ ß", "中文和\u3000空"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fx.nfkc(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {i: t and unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


def test_evidence_works_the_matches_out_once(spark):
    lex = tp.lexicon_table(spark, [(1, "bad", "x", "low", ALL)])
    e = tp.evidence(tp.matches(spark.createDataFrame([(1, "bad", "en")], TEXTS), lex), lex)
    assert e._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_nfkc_of_batches_of_any_size(spark):
    """More texts than are normalised at a time, with nulls; of no texts, none."""
    rows = [(i, None if i % 7 == 0 else "ﬁne ①" * (i % 5)) for i in range(2 * fx.FEW + 3)]
    df = spark.createDataFrame(rows, "i int, t string").repartition(1)
    assert sorted(tuple(r) for r in df.select("i", fx.nfkc(F.col("t"))).collect()) == [(i, t and t.replace("ﬁ", "fi").replace("①", "1")) for i, t in rows]
    assert df.where("i < 0").select(fx.nfkc(F.col("t"))).collect() == []


def test_python_of_a_task_of_texts_is_one_worker(spark):
    """Normalisation is worked out once a row, of lexicons too, and small lexicons are part of the plan."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    lex = tp.lexicon_table(spark, [(1, "bad word", "x", "low", ALL, "core", ["ﬁne"])])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (tp.patterns(lex), tp.matches(docs, lex)):
        assert plan(df).count("EvalPython") == 1 and "ExistingRDD" not in plan(df)
    v = fx.views(docs.select("doc_id", "text", "lang")).where("size(separator_tokens) > 3 and compact <> ''")
    assert plan(v).count("EvalPython") == 1
