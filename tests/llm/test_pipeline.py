import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline

from . import brute
from .test_quality import base

public = pytest.importorskip("public_tokenizers")


def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    items = [(i, text(25)) for i in range(4)]
    rows = []
    for d in range(160):
        t = text(rng.randint(15, 80))
        if d % 8 == 1:
            t = rows[-1][1] if d % 16 == 1 else rows[-1][1] + " more"
        elif d % 8 == 3:
            t = " ".join(w + "###" for w in t.split())
        elif d % 8 == 5:
            t = t + " " + items[d % 4][1] + " " + text(5)
        elif d % 8 == 7:
            t = text(4)
        rows.append((d, t, "en", "s", len(t)))
    return [*rows, (900, None, None, None, None), (901, "", "en", "s", 0)], items


def test_stages_equal_plain_ones(spark, tmp_path):
    import sentencepiece

    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    left = []
    for d, t, *_ in rows:
        n, chars, symbols, dup, rep = base(t)
        if n >= 10 and 100 * rep <= 20 * n and 10 * symbols <= 3 * n:
            left.append((d, t))
    kept = brute.near_duplicates(left)
    left = [(d, t) for d, t in left if kept[d][2]]
    hits = brute.contamination(left, items)
    left = [(d, t) for d, t in left if not hits[d][1]]
    assert set(got) == {d for d, _ in left} and 60 < len(left) < 120
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    for d, t in left:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame(corpus()[0], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, "").columns == docs.columns
