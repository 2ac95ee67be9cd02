"""Encoding and token files against the libraries and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from policyspark.llm import piece_bpe, token_files

public = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " ", "a", "the the", "  two  blanks ", "▁mark", "a\nb\tc", "é́ß Ω 中\U0001f600", "x" * 300, "1234 5.6, 7's", "<s></s><0x0A>", "word " * 4000, "\x00 nul", "=" * 50 + " " * 40]
SCHEMA = "doc_id long, text string, n_tokens string, start string, segment string, ids string"


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i * 3, t, "x", "y", None, "z") for i, t in enumerate(texts)], SCHEMA)


def test_piece_encoding_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in piece_bpe.digest(frame(spark), public.path("piece_bpe_32k.model")).collect()}
    full = {r.doc_id: r for r in piece_bpe.encode(frame(spark), public.path("piece_bpe_32k.model")).collect()}
    assert len(rows) == len(full) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        r = rows[i * 3]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert full[i * 3].ids == ids and full[i * 3].decoded == sp.decode(ids)


def test_piece_coder_on_random_strings():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp, coder, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceCoder.of(path), random.Random(3)
    parts = ["a", "b", " ", "  ", "▁", "\n", "é", "中", "the", "ing", "1", ".", ",", "er", "tion", " t", "▁▁", "<s>", "'s", "--", "    ", "�"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == sp.encode(text), text
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(3, 32000), 0, 1, 2]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == sp.decode(ids), ids


def test_runs_of_blanks_of_any_length():
    import time

    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp, coder, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceCoder.of(path), random.Random(9)
    assert coder.period == 16
    for n in [*range(120, 420), 1000, 5001, 40_007]:
        text = rng.choice(["", "a", "x \n"]) + " " * n + rng.choice(["", "word", "zqj  ", "中", "\n", "the end. " + " " * n])
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == sp.encode(text), (n, text[:3])
    text = "ab" + " " * 1_000_000 + "c" + " " * 300_000
    start = time.process_time()  # under a second; a scan for each merge would take days
    ids = coder.encode(text)
    assert time.process_time() - start < 3 and np.frombuffer(ids, "<u4").tolist() == sp.encode(text)


def test_long_words_without_blanks():
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp, coder, rng = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.PieceCoder.of(path), random.Random(10)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCxyz0189+/=", "etaoin", "中文字é", "▁a"):
        text = "".join(rng.choice(letters) for _ in range(30_000))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == sp.encode(text), letters


def test_caches_may_overflow(monkeypatch):
    path = public.path("piece_bpe_32k.model")
    whole = piece_bpe.PieceCoder(path)
    small = piece_bpe.PieceCoder(path)
    small.known.half = small.parts.half = 3
    for text in ("one two three four five six one two", "seven one eight, nine. ten"):
        assert small.encode(text) == whole.encode(text)


@pytest.mark.parametrize("values", [[0], [5] * 700, list(range(1300)), [2**32 - 1, 0], [1, 2, 3] * 200 + [10**9], [7] * 99 + [40000]])
def test_blocks_round_trip(values):
    a = np.array(values, dtype=np.uint32)
    segment = token_files.write_segment(a, np.array([1, len(a) - 1] if len(a) > 1 else [1], dtype=np.uint32))
    ids, counts = token_files.read_segment(segment)
    assert ids.tolist() == values and counts.sum() == len(values)
    for start, stop in ((0, 1), (0, len(a)), (len(a) // 2, len(a)), (3, 600)):
        assert token_files.read_ids(segment, start, stop).tolist() == values[start:stop]


def test_outliers_go_to_the_exceptions():
    plain = token_files.pack_blocks(np.array([1] * 500, dtype=np.uint32))[0]
    patched = token_files.pack_blocks(np.array([1] * 499 + [10**6], dtype=np.uint32))[0]
    assert len(patched) == len(plain) + 6


def test_token_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = token_files.written_tokens(frame(spark).repartition(3), path, 2).orderBy("doc_id").collect()
    assert len(got) == len(TEXTS)
    start = 0
    for r, t in zip(got, TEXTS):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_many_segments(spark, monkeypatch):
    from pyspark import TaskContext

    monkeypatch.setattr(token_files, "SEGMENT_IDS", 5)
    monkeypatch.setattr(TaskContext, "get", staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, None], "text": ["a b c d", "e", None, "f g"]})
    segments = [s.to_pylist()[0] for s in token_files._segments(public.path("word_bpe_49k.json"), 2, iter([batch]))]
    assert [s["doc_ids"] for s in segments] == [[1], [2, 3, None]]
    assert [s["part_offset"] for s in segments] == [0, 5]


def test_empty_tables(spark):
    none = frame(spark).limit(0)
    assert piece_bpe.digest(none, public.path("piece_bpe_32k.model")).count() == 0
    assert token_files.written_tokens(none, public.path("word_bpe_49k.json"), 2).count() == 0


@pytest.mark.parametrize("most", [token_files.CACHE_BYTES, 2_000])
def test_word_ids_equal_the_library_on_random_texts(monkeypatch, most):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE_BYTES", most)
    path, rng = public.path("word_bpe_49k.json"), random.Random(17)
    encoder, library = token_files.Encoder(path), Tokenizer.from_file(path)
    parts = ["a", "B", "the", "Ing", " ", "\n", "\t", "  ", " ", " ", "é", "É", "é", "H̱", "İ", "ß", "Σ", "σας", "中", "12", "½", ".", ",", "'", "'s", "'S", "###", "<|", "<|endoftext|>", "<|EndOfText|>", "|>", "-", "_", "٣", "ﬁ", "\x00", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], encoder.encode(texts[at : at + 500]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("width", [0, 1, 7, 16, 17, 31, 32])
def test_packed_bits_are_least_bit_first(width):
    values = np.random.default_rng(width).integers(0, 2**32, (3, 130), dtype=np.uint64).astype(np.uint32)
    low = values & np.uint32((1 << width) - 1)
    packed = token_files._packed_bits(values, width)
    for row, body in zip(low.tolist(), packed, strict=True):
        assert int.from_bytes(body.tobytes(), "little") == sum(v << (i * width) for i, v in enumerate(row))
    assert (token_files._unpacked_bits(packed, 130, width) == low).all()


def test_rows_of_one_id_keep_text_order(spark):
    rows = [(7, f"{'same beginning of forty characters or more'} {i % 50:03}") for i in range(400)] + [(None, "n")] * 50
    got = token_files.written_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), public.path("word_bpe_49k.json"), 2)
    assert got.count() == 450 and got.where("doc_id is null").count() == 50
    starts = sorted(r.start for r in got.collect())
    assert starts[0] == 0 and len(set(starts)) == 450
