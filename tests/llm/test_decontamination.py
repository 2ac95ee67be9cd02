import random

from policyspark.llm import decontamination as dc

from . import brute

SCHEMA = "doc_id long, text string, n_words string, spans string, item_ids string"


def tables(spark):
    rng = random.Random(2)
    vocab = [f"v{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([0, 1, 4, 9, 10, 11, 25, 40, 40])] + [(20, None), (21, "..."), (22, "Été à l'école 12 mois " * 3)]
    docs = [(0, None), (1, ""), (2, "--"), (3, text(3000))]
    for d in range(4, 90):
        w = text(rng.randint(0, 60)).split()
        if d % 2:
            src = rng.choice(items)[1] or ""
            s = src.split()
            a = rng.randint(0, max(0, len(s) - 1))
            w[len(w) // 2 : len(w) // 2] = s[a : a + rng.randint(1, 20)]
        docs.append((d, (", " if d % 3 else " ").join(w).upper() if d % 5 else " ".join(w)))
    return docs, items, spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], SCHEMA), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


def check(docs, items, rows):
    want = brute.contamination(docs, items)
    assert len(rows) == len(want)
    for r in rows:
        n, hit, found = want[r.doc_id]
        assert r.n_words == n
        assert {p for s in r.spans for p in range(s.start, s.stop)} == hit, r.doc_id
        assert sum(s.stop - s.start for s in r.spans) == len(hit)
        assert set(r.item_ids) == found


def test_hits_equal_brute_force(spark):
    docs, items, d, b = tables(spark)
    check(docs, items, dc.contamination(d, b).collect())


def test_merged_sides_and_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(dc, "BITS_EACH", 0)
    monkeypatch.setattr(dc, "LEAST_BITS", 3)  # every bit is set: all fingerprints go to the join
    docs, items, d, b = tables(spark)
    check(docs, items, dc.contamination(d, b).collect())


def test_words_of_one_pattern_are_told_apart(spark):
    """Thue-Morse words and their complements, which hashes by powers of one number modulo 2**64 can't tell apart."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (1024, 2048):
        w, other = word[:n], word[:n].translate(str.maketrans("ab", "ba"))
        rest = " ".join(f"r{i}" for i in range(9))
        docs = spark.createDataFrame([(1, f"{w} {rest}"), (2, f"{other} {rest}")], "doc_id long, text string")
        found = {r.doc_id: r.n_words * bool(r.spans) for r in dc.contamination(docs, spark.createDataFrame([(5, f"{w} {rest}")], "item_id long, text string")).collect()}
        assert found == {1: 10, 2: 0}


def test_empty_tables_and_stage(spark):
    docs, items, d, b = tables(spark)
    assert dc.digest(dc.contamination(d.limit(0), b)).count() == 0
    none = dc.digest(dc.contamination(d, b.limit(0))).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    want = brute.contamination(docs, items)
    left = dc.decontaminate(d, b)
    assert left.columns == d.columns
    assert {r.doc_id for r in left.collect()} == {k for k, v in want.items() if not v[1]}


def test_repeated_and_null_ids(spark, monkeypatch):
    a, b = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(12))
    docs = [(1, a), (1, "clean"), (1, a + " " + b), (None, b), (None, "clean too"), (None, b), (2, None)]
    items = [(9, a), (7, b), (9, a), (9, b), (None, a), (8, " ".join(f"z{i}" for i in range(12)))]
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(1, 12, 12, [9]), (1, 1, 0, []), (1, 24, 24, [7, 9]), (None, 12, 12, [7, 9]), (None, 2, 0, []), (None, 12, 12, [7, 9]), (2, 0, 0, [])], key=str)
    for rows in (dc.BROADCAST_ROWS, 0):
        monkeypatch.setattr(dc, "BROADCAST_ROWS", rows)
        out = dc.contamination(d, m)
        assert sorted(((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.spans), list(r.item_ids)) for r in out.collect()), key=str) == want, rows
        assert sorted((r.n_items for r in dc.digest(out).collect())) == [0, 0, 0, 1, 2, 2, 2], rows
        kept = dc.decontaminate(d, m)
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "clean"), (None, "clean too"), (2, None)], key=str)


def test_string_ids_and_clashing_columns(spark):
    a = " ".join(f"p{i}" for i in range(12))
    d = spark.createDataFrame([("x", a, 1, 2, 3), ("y", "clean", 4, 5, 6)], "doc_id string, text string, row_id int, own int, candidates int")
    m = spark.createDataFrame([("i10", a), ("i9", a)], "item_id string, text string")
    assert {r.doc_id: list(r.item_ids) for r in dc.contamination(d, m).collect()} == {"x": ["i10", "i9"], "y": []}
    kept = dc.decontaminate(d, m)
    assert kept.schema == d.schema and [tuple(r) for r in kept.collect()] == [("y", "clean", 4, 5, 6)]
