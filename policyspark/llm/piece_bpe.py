"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking over longest matches.

A BPE encoder merges, again and again, the neighbouring pieces whose union has the best score.  Its result is the one
sequence of pieces in which every two neighbours are *compatible*: merging their joint text from characters gives just
these two pieces.  So the encoder walks a text from left to right, takes the longest piece that starts here (all matches
come from one Aho-Corasick pass) and is compatible with the piece before, falls back to shorter ones, and steps back where
none is left; a bitfield of positions known to fail keeps the walk linear.

Texts are cut first where no piece of the vocabulary spans the cut (two neighbouring characters that no piece holds side
by side), as nothing can merge across; each distinct cutting is encoded once by a worker and then remembered.  Runs of
the blank mark have pieces of equal score, for which compatibility of neighbours isn't sufficient: cuttings that hold two
blank marks in a row are merged outright, by a heap of the possible merges.  A long run merges from the left into the
longest doubled piece of blanks again and again; only its last RUN marks or so differ, so these alone are merged.

Defined results: null text is the empty text, whose ids are the begin and end ids alone.  Characters outside the
vocabulary become their UTF-8 byte pieces.  Texts of any length are encoded whole; repeated rows give repeated results;
an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored.  ``doc_id`` is a whole number or
what casts to one; an id that doesn't is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLANK = "▁"
#: Bytes that a worker remembers (with ENTRY bytes for what Python adds) of texts between blanks and of parts of them, the
#: longest text remembered, and compatible pairs of pieces.
CHUNKS, PARTS, ENTRY, LONGEST, PAIRS = 160 << 20, 100 << 20, 180, 1024, 500_000
#: Characters up to which a text is merged by scanning it for each merge, and blanks of a run that are merged one by one.
SCANNED, RUN = 24, 128
#: SentencePiece's piece types.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


class _Known(dict):
    """Results of ``make`` by text, the recently used ones: a full half is set aside and its entries come back when used."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.half, self.size, self.old = make, most // 2, 0, {}

    def __missing__(self, text: str) -> bytes:
        if len(text) > LONGEST:
            return self.make(text)
        if self.size >= self.half:
            self.old, self.size = dict(self), 0
            self.clear()
        found = self.old.get(text)
        if found is None:
            found = self.make(text)
        self[text] = found
        self.size += ENTRY + len(text) + len(found)
        return found


class PieceCoder:
    """Encoder and decoder of one model file."""

    _of: dict[str, PieceCoder] = {}

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.name != "identity" or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or any(p.type == USER for p in model.pieces):
            raise ValueError(f"{path}: not a plain BPE model with identity normalisation")
        ids = SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = ids.bos_id(), ids.eos_id(), ids.unk_id()
        self.score: dict[str, float] = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id_of: dict[str, int] = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.beside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(x[1] == BLANK and x[0] != BLANK for x in self.beside):
            raise ValueError(f"{path}: pieces span blanks")
        # what each id decodes to; runs of byte ids together are UTF-8
        self.bytes_of = [b"" if p.type == CONTROL else b" \xe2\x81\x87 " if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(BLANK, " ").encode() for p in model.pieces]
        self.is_byte = [p.type == BYTE for p in model.pieces]
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        # characters that no longer piece holds stand alone; the rest of a chunk is cut pair by pair
        self.automaton = ahocorasick.Automaton()
        for piece in self.score:
            if BLANK * 2 not in piece and (len(piece) == 1 or self.merged(piece) == [piece]):
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        # runs of blanks: the longest piece made by doubling, if it is what each longer run begins with
        self.period = 1
        while BLANK * 2 * self.period in self.score:
            self.period *= 2
        runs = [self.merged(BLANK * k) for k in range(3 * RUN)]
        if any(runs[k] != [BLANK * self.period, *runs[k - self.period]] for k in range(RUN - self.period, 3 * RUN)):
            self.period = 0
        self.known = _Known(lambda word: self.cut(BLANK + word), CHUNKS)
        self.parts = _Known(self.part, PARTS)
        self.pairs: dict[tuple[str, str], bool] = {}

    @classmethod
    def of(cls, path: str) -> PieceCoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    # --- encoding

    def merged(self, text: str) -> list[str]:
        """Pieces of ``text`` by merging outright: best score first, the leftmost of equals."""
        if len(text) > SCANNED:
            return self._merged_by_heap(text)
        out, score = list(text), self.score
        while len(out) > 1:
            best, at = None, -1
            for i in range(len(out) - 1):
                s = score.get(out[i] + out[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def _merged_by_heap(self, text: str) -> list[str]:
        score, n = self.score, len(text)
        out: list[str | None] = list(text)
        before, behind = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, text[i : i + 2]) for i in range(n - 1) if (s := score.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = behind[i]
            if out[i] is None or j >= n or out[i] + out[j] != both:
                continue  # one of the two has been merged since
            out[i], out[j] = both, None
            behind[i] = k = behind[j]
            if k < n:
                before[k] = i
                if (s := score.get(both + out[k])) is not None:
                    heapq.heappush(heap, (-s, i, both + out[k]))
            h = before[i]
            if h >= 0 and (s := score.get(out[h] + both)) is not None:
                heapq.heappush(heap, (-s, h, out[h] + both))
        return [x for x in out if x is not None]

    def with_blanks(self, text: str) -> list[str]:
        """Pieces of a part with two blank marks in a row, which begin it."""
        n = len(text) - len(text.lstrip(BLANK))
        if n <= 2 * RUN or not self.period:
            return self.merged(text)
        m = (n - RUN) // self.period
        return [BLANK * self.period] * m + self.merged(text[m * self.period :])

    def compatible(self, a: str, b: str) -> bool:
        pair = (a, b)
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[pair] = (a[-1] + b[0]) not in self.beside or self.merged(a + b) == [a, b]
        return found

    def backtracked(self, text: str) -> list[str]:
        """Pieces of ``text``, which holds no two blank marks in a row and only characters of the vocabulary."""
        # mostly the longest matches fit each other as they come
        out = [piece for _, piece in self.automaton.iter_long(text)]
        if all(map(self.compatible, out, out[1:])):
            return out
        starts: list[list[str]] = [[] for _ in text]
        for end, piece in self.automaton.iter(text):
            starts[end - len(piece) + 1].append(piece)  # shorter ones end, and so come, first
        out = []
        left: list[int] = [len(starts[0])]  # how many of the matches at each piece's start are yet to try
        at, failed = 0, bytearray(len(text) // 8 + 1)
        while at < len(text):
            matches, k = starts[at], left[-1]
            while k:
                k -= 1
                piece = matches[k]
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                    left[-1] = k
                    out.append(piece)
                    at = to
                    left.append(len(starts[at]) if at < len(text) else 0)
                    break
            else:
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                failed[at >> 3] |= 1 << (at & 7)
                left.pop()
                at -= len(out.pop())
        return out

    def cut(self, chunk: str) -> bytes:
        """ids of a chunk, cut between characters that no piece holds side by side."""
        beside, parts, out, start = self.beside, self.parts, [], 0
        pairs = map(str.__add__, chunk, chunk[1:])
        for at in [i for i, pair in enumerate(pairs, 1) if pair not in beside] + [len(chunk)]:
            out.append(parts[chunk[start:at]])
            start = at
        return b"".join(out)

    def part(self, text: str) -> bytes:
        if len(text) == 1:
            found = [text]
        elif BLANK * 2 in text:
            found = self.with_blanks(text)
        else:
            found = self.backtracked(text)
        ids: list[int] = []
        for p in found:
            i = self.id_of.get(p)
            ids += [i] if i is not None else [self.byte_id[b] for b in p.encode()]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """ids of a whole text as little-endian 32-bit integers, without begin and end."""
        if not text:
            return b""
        if "  " in text or text[-1] == " " or text[0] == " " or BLANK in text:
            chunks = re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", BLANK + text.replace(" ", BLANK))
            return b"".join([self.known[c[1:]] if c[0] == BLANK else self.cut(c) for c in chunks])
        return b"".join(map(self.known.__getitem__, text.split(" ")))

    # --- decoding

    def decode(self, ids: list[int]) -> str:
        """Text of ids: control pieces are silent, the mark before the first word goes, bytes that aren't UTF-8 become U+FFFD."""
        inner = ids[ids[:1] == [self.begin] : len(ids) - (ids[-1:] == [self.end])]
        try:
            if inner.count(self.begin) or inner.count(self.end):  # bytes on both sides of these don't belong together
                text = self._decode_runs(ids)
            else:
                text = b"".join(map(self.bytes_of.__getitem__, ids)).decode()
        except UnicodeDecodeError:
            text = self._decode_runs(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first != self.unknown and not self.is_byte[first] and text.startswith(" ") else text

    def _decode_runs(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in ids:
            if self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            out += [_lenient(run), self.bytes_of[i].decode()]
            run = b""
        return "".join([*out, _lenient(run)])


def _lenient(run: bytes) -> str:
    """Valid characters of a run of bytes, U+FFFD for each other byte."""
    out, at = [], 0
    while at < len(run):
        for n in range(1, 5):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _coded(path: str, keep_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    coder = PieceCoder.of(path)
    begin, end = (np.array([i], dtype="<u4").tobytes() for i in (coder.begin, coder.end))
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            n, ids_sha, text_sha, all_ids, all_texts = [], [], [], [], []
            for text in rows.column("text").to_pylist():
                ids = begin + coder.encode(text or "") + end
                decoded = coder.decode(np.frombuffer(ids, "<u4").tolist())
                n.append(len(ids) // 4)
                if keep_text:
                    all_ids.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    all_texts.append(decoded)
                else:
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            more = [pa.array(all_ids, pa.list_(pa.int32())), pa.array(all_texts, pa.string())] if keep_text else [pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), *more], ["doc_id", "n_tokens", *(("ids", "decoded") if keep_text else ("ids_sha256", "decoded_sha256"))])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, with begin and end), decoded (their text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda batches: _coded(model_path, True, batches), "doc_id long, n_tokens long, ids array<int>, decoded string")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """As :func:`encode`, with SHA-256 digests in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda batches: _coded(model_path, False, batches), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
