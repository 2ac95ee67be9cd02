"""Token ids in binary files of patched frame-of-reference blocks.

File format.  A token file is a sequence of *segments*; a segment is the record a reader seeks to.  All integers are
little-endian.

    segment  = magic "PFB1" | u32 documents | u32 ids | u32 blocks | u32 length of the document index
               document index: blocks of the documents' id counts (same block coding as the ids)
               block starts: u32 byte offset of each block, from the first block's first byte
               blocks
    block    = u16 values (1 to BLOCK) | u8 width | u16 exceptions | u32 minimum
               packed: each value less the minimum, its low ``width`` bits, least bit first
               exceptions: u16 positions, then u32 high parts (value less minimum, shifted right by ``width``)

``width`` is the number of bits that hold at least PERCENTILE per cent of a block's values; the rest are exceptions.
A segment holds whole documents in ascending ``doc_id`` order.  The files are written by Spark as Parquet with one
segment per row (binary column ``segment``) and its place (``part``, ``seq``, ``part_offset``, ``first_doc`` ...), so
that the writer's commit protocol covers lost executors and any store Spark can reach can hold them.
``concatenated`` bytes of the rows in (part, seq) order are a valid file as they stand.

Defined results: null text is the empty text (only the end id); an empty table gives an empty result; rows of equal
``doc_id`` follow each other in text order; a null ``doc_id`` comes first.  ``doc_id`` is a whole number (the files hold it as 64
bits) or what casts to one; an id that doesn't is an error.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ._store import shared_dir
from ._words import pieces

#: Values in a block (a multiple of 64), per cent of them that the packed width must hold, and ids after which a segment is closed.
BLOCK, PERCENTILE, SEGMENT_IDS = 1024, 95, 1 << 17
#: Bytes of text encoded together, one row at least.
TEXT_BYTES = 8 << 20
MAGIC = b"PFB1"
#: Letters whose lower case is one letter too; none of them is changed by NFC.
LATIN = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha())
#: Marks that may follow a word within a chunk.
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
#: How byte-level vocabularies write bytes as characters: printable ones as themselves, the others from 0x100 on in order.
_PRINTED = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
WRITTEN = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
#: Bytes of words and ids that a worker remembers at most, with ENTRY bytes for what Python adds to each.
CACHE_BYTES, ENTRY = 160 << 20, 180


# --- blocks ---------------------------------------------------------------------------------------------------------


def _width_and_parts(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed width, high parts) of rows of one block each."""
    k = (rest.shape[1] * PERCENTILE + 99) // 100 - 1
    at = np.partition(rest, k, axis=1)[:, k]
    width = np.frexp(at.astype(np.float64))[1].astype(np.uint32)  # bits of an integer below 2**32
    return width, (rest.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype("<u4")


def _packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes: the low ``width`` bits of each row's values, least bit first."""
    rows, n = values.shape
    groups = -(-n // 64)
    v = np.zeros((rows, groups * 64), dtype=np.uint64)
    v[:, :n] = values & np.uint32((1 << width) - 1)
    v = np.ascontiguousarray(v.reshape(-1, 64).T)  # 64 values fill ``width`` words of 64 bits
    words = np.zeros((max(width, 1), v.shape[1]), dtype="<u8")
    for j in range(64):
        at, shift = divmod(j * width, 64)
        words[at] |= v[j] << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= v[j] >> np.uint64(64 - shift)
    packed = np.ascontiguousarray(words[:width].T).view(np.uint8).reshape(rows, -1)
    return packed[:, : (n * width + 7) // 8]


def _unpacked_bits(packed: np.ndarray, n: int, width: int) -> np.ndarray:
    """The inverse of :func:`_packed_bits`."""
    rows, groups = len(packed), -(-n // 64)
    if not width:
        return np.zeros((rows, n), dtype=np.uint32)
    padded = np.zeros((rows, groups * width * 8), dtype=np.uint8)
    padded[:, : packed.shape[1]] = packed
    words = np.ascontiguousarray(padded.view("<u8").reshape(-1, width).T)
    out = np.empty((64, words.shape[1]), dtype=np.uint32)
    for j in range(64):
        at, shift = divmod(j * width, 64)
        v = words[at] >> np.uint64(shift)
        if shift + width > 64:
            v |= words[at + 1] << np.uint64(64 - shift)
        out[j] = v & np.uint64((1 << width) - 1)
    return np.ascontiguousarray(out.T).reshape(rows, -1)[:, :n]


def _pack_rows(values: np.ndarray) -> list[bytes]:
    """Blocks of rows of equal length; rows of one width are packed together."""
    low = values.min(axis=1)
    rest = values - low[:, None]
    width, high = _width_and_parts(rest)
    odd_row, odd_at = np.nonzero(high)
    odd_ends = np.searchsorted(odd_row, np.arange(len(values) + 1)).tolist()
    odd_at, odd_high = odd_at.astype("<u2"), high[odd_row, odd_at]
    out: list[bytes] = [b""] * len(values)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed = _packed_bits(rest[rows], w)
        for row, minimum, body in zip(rows.tolist(), low[rows].tolist(), packed, strict=True):
            a, b = odd_ends[row], odd_ends[row + 1]
            out[row] = struct.pack("<HBHI", values.shape[1], w, b - a, minimum) + body.tobytes() + odd_at[a:b].tobytes() + odd_high[a:b].tobytes()
    return out


def pack_blocks(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(blocks of BLOCK values, the last perhaps shorter; their byte offsets) of values below 2**32."""
    values = values.astype(np.uint32)
    full = len(values) // BLOCK * BLOCK
    blocks = _pack_rows(values[:full].reshape(-1, BLOCK)) if full else []
    if full < len(values):
        blocks += _pack_rows(values[full:].reshape(1, -1))
    return b"".join(blocks), np.cumsum([0] + [len(b) for b in blocks])[:-1].astype("<u4")


def unpack_blocks(data: memoryview, at: int, count: int) -> np.ndarray:
    """Values of ``count`` blocks from offset ``at`` on."""
    heads = []
    for _ in range(count):
        n, width, n_odd, low = struct.unpack_from("<HBHI", data, at)
        heads.append((n, width, n_odd, low, at + 9))
        at += 9 + (n * width + 7) // 8 + 6 * n_odd
    sizes = np.array([h[0] for h in heads], dtype=np.int64)
    ends = np.append(0, np.cumsum(sizes))
    out = np.empty(ends[-1], dtype=np.uint32)
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (n, width, *_) in enumerate(heads):
        alike.setdefault((n, width), []).append(i)
    for (n, width), rows in alike.items():
        size = (n * width + 7) // 8
        packed = np.frombuffer(b"".join([data[heads[i][4] : heads[i][4] + size] for i in rows]), np.uint8).reshape(len(rows), size)
        out[ends[rows][:, None] + np.arange(n)] = _unpacked_bits(packed, n, width)
    odd = [(i, h[2], h[1], h[4] + (h[0] * h[1] + 7) // 8) for i, h in enumerate(heads) if h[2]]
    if odd:
        which, n_odd, widths = (np.array(x, dtype=np.int64) for x in list(zip(*odd, strict=True))[:3])
        at = np.frombuffer(b"".join([data[x : x + 2 * n] for _, n, _, x in odd]), "<u2") + np.repeat(ends[which], n_odd)
        high = np.frombuffer(b"".join([data[x + 2 * n : x + 6 * n] for _, n, _, x in odd]), "<u4")
        out[at] |= high << np.repeat(widths, n_odd).astype(np.uint32)
    out += np.repeat(np.array([h[3] for h in heads], dtype=np.uint32), sizes)
    return out


def write_segment(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """``ids`` of whole documents, ``counts`` of them in each."""
    body, starts = pack_blocks(ids.astype(np.uint32))
    index, _ = pack_blocks(counts.astype(np.uint32))
    return MAGIC + struct.pack("<IIII", len(counts), len(ids), len(starts), len(index)) + index + starts.tobytes() + body


def read_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, documents' id counts)"""
    view = memoryview(data)
    if bytes(view[:4]) != MAGIC:
        raise ValueError("not a token segment")
    docs, n_ids, n_blocks, index = struct.unpack_from("<IIII", view, 4)
    counts = unpack_blocks(view, 20, -(-docs // BLOCK))
    ids = unpack_blocks(view, 20 + index + 4 * n_blocks, n_blocks)
    if len(ids) != n_ids or len(counts) != docs or int(counts.sum()) != n_ids:
        raise ValueError("damaged token segment")
    return ids, counts


def read_ids(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a segment; only their blocks are unpacked."""
    view = memoryview(data)
    _, n_ids, n_blocks, index = struct.unpack_from("<IIII", view, 4)
    stop = min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, dtype=np.uint32)
    starts = np.frombuffer(view, "<u4", n_blocks, 20 + index)
    first, last = start // BLOCK, (stop - 1) // BLOCK
    ids = unpack_blocks(view, 20 + index + 4 * n_blocks + int(starts[first]), last - first + 1)
    return ids[start - first * BLOCK : stop - first * BLOCK]


# --- encoding -------------------------------------------------------------------------------------------------------


def _written(word: str) -> str:
    """A word's UTF-8 bytes as the characters of a byte-level vocabulary."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(WRITTEN)


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct chunk between blanks once.

    The tokenizer must treat what stands between blanks independently and give blanks themselves no ids, as one with word
    ends does that drops white space; sample texts are compared with the library, which raises where it isn't so.
    """

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0
        self.tails: dict[str, bytes | None] = {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)", re.IGNORECASE).search
        # words of LATIN letters alone go to the library's model: the steps before it lower their case and write their bytes
        self.plain = not any(map(str.isalpha, special)) and all(self._library(x) == self._model(x) for x in ("s", "re", "tion" * 9, "xqzjv", "isntdoesll", "éeuxÜ", "ñaß", *LATIN))
        for text in ("a b", "Ab  c\nd\te, f's 12 <|endoftext|> x", "é́ ß Ω H̱i", " lead and trail. ", "don't, it's. 's, ,. .,", "a<|endoftext|> İs Ünd'. it's' x###"):
            if self.encode([text])[0] != self._library(text):
                raise ValueError(f"{path}: not a tokenizer of blank-separated words")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _model(self, word: str) -> bytes:
        return np.array([t.id for t in self.tokenizer.model.tokenize(_written(word.lower()))], dtype="<u4").tobytes()

    def _tail(self, marks: str) -> bytes | None:
        """Ids of marks behind a letter, or null where they aren't a word of their own."""
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            own = self._library(marks)
            self.tails[marks] = own if self._library("a" + marks) == self._library("a") + own else None
        return self.tails[marks]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        ids, counts = self.encode_rows(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]

    def encode_rows(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, how many each row has); null is the empty text, ``end_id`` follows each row's own ids."""
        column = texts.cast(pa.large_string()).fill_null("")
        split = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        # no chunk holds a blank, so that they can be turned into Python strings all at once
        blank = [pa.scalar(x, pa.large_string()) for x in ("", " ")]
        listed = pc.binary_join_element_wise(chunks.dictionary, *blank).buffers()[2]
        found = self._ids_of(listed.to_pybytes().decode().split(" ")[: len(chunks.dictionary)] if listed else [])
        found.append(b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes())
        table = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        starts = np.cumsum(size) - size
        rows = np.diff(split.offsets.to_numpy())
        # the last entry of the table stands behind each row's chunks
        code = np.insert(chunks.indices.to_numpy(), np.cumsum(rows), len(found) - 1)
        n = size[code]
        behind = np.cumsum(n)
        ids = table[np.repeat(starts[code] - behind + n, n) + np.arange(behind[-1] if len(behind) else 0)]
        row_ends = np.append(0, behind)[np.cumsum(rows + 1)]
        return ids, np.diff(row_ends, prepend=0)

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, chunks))
        words: dict[str, str] = {}
        for c, ids in zip(chunks, found, strict=True):
            if ids is None:
                # the word before marks is what is remembered, of plain letters in lower case
                word = c.rstrip(MARKS)
                if word is not c and not (word and word[-1] in LATIN and self._tail(c[len(word) :]) is not None and not self.special(c)):
                    word = c
                words[c] = word.lower() if self.plain and word.isascii() and word.isalpha() else word
        if words:
            if self.size > CACHE_BYTES // 2:  # the older half goes, what is in use comes back from it
                self.known, self.old, self.size = {}, known, 0
            of = {w: ids for w in set(words.values()) if (ids := known.get(w)) is not None}
            of |= self._learn([w for w in set(words.values()) if w not in of])
            tails = self.tails
            found = [of[w := words[c]] + (tails[c[len(w) :]] if len(w) < len(c) else b"") if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return found

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, which are remembered."""
        new: dict[str, bytes] = {}
        rest = []
        model = self.tokenizer.model.tokenize
        ids: list[int] = []
        spans: list[tuple[str, int, int]] = []
        for w in missing:
            known = self.old.get(w)
            if known is not None:
                new[w] = known
            elif self.plain and w and LATIN.issuperset(w):
                at = len(ids)
                ids += [t.id for t in model(w if w.isascii() else _written(w.lower()))]
                spans.append((w, 4 * at, 4 * len(ids)))
            elif w:
                rest.append(w)
            else:
                new[w] = b""
        raw = np.array(ids, dtype="<u4").tobytes()
        for w, a, b in spans:
            new[w] = raw[a:b]
        for at in range(0, len(rest), 500):
            some = rest[at : at + 500]
            e = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            # ids belong to the chunk in which their text starts
            starts = np.cumsum([0] + [len(c) + 1 for c in some])
            cut = 4 * np.searchsorted(np.array(e.offsets, dtype=np.int64).reshape(-1, 2)[:, 0], starts)
            raw = np.array(e.ids, dtype="<u4").tobytes()
            for c, a, b in zip(some, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                new[c] = raw[a:b]
        self.known.update(new)
        self.size += ENTRY * len(new) + sum(map(len, new)) + sum(map(len, new.values()))
        return new


def _segments(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = Encoder.of(path)
    part, seq, before = TaskContext.get().partitionId(), 0, 0
    docs: list[int | None] = []
    parts: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def closed(n: int) -> pa.RecordBatch:
        segment = write_segment(np.concatenate(parts), np.concatenate(counts))
        row = {"part": part, "seq": seq, "part_offset": before, "n_ids": n, "doc_ids": list(docs), "segment": segment}
        return pa.RecordBatch.from_pylist([row], schema=_ARROW)

    size = 0
    for batch in batches:
        for rows in pieces(batch, "text", TEXT_BYTES):
            ids, n = encoder.encode_rows(rows.column("text"), end_id)
            ends, ids_of_rows = np.cumsum(n), rows.column("doc_id").to_pylist()
            at, taken = 0, 0
            while at < len(n):
                # up to the row that fills the segment
                stop = min(int(np.searchsorted(ends, taken + SEGMENT_IDS - size)) + 1, len(n))
                docs += ids_of_rows[at:stop]
                parts.append(ids[taken : ends[stop - 1]])
                counts.append(n[at:stop])
                size += int(ends[stop - 1]) - taken
                at, taken = stop, int(ends[stop - 1])
                if size >= SEGMENT_IDS:
                    yield closed(size)
                    seq, before, size = seq + 1, before + size, 0
                    for x in (docs, parts, counts):
                        x.clear()
    if docs:
        yield closed(size)


SEGMENTS = "part int, seq int, part_offset long, n_ids long, doc_ids array<long>, segment binary"
_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_offset", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("segment", pa.binary())])


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, out: str) -> None:
    """Encodes ``docs`` (doc_id, text), appends ``end_id`` to each and writes the token files to ``out``.

    The only shuffle is the range exchange of the texts that puts them in ``doc_id`` order; rows of one ``doc_id``, or with
    none, are dealt on by the first characters of their text and by row, so that they don't all go to one task.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange("doc_id", F.left("text", F.lit(32)), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda batches: _segments(tokenizer_path, end_id, batches), SEGMENTS).write.option("compression", "none").parquet(out)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, counts = read_segment(row["segment"])
            ids = ids.astype("<u4")
            ends = np.cumsum(counts.astype(np.int64))
            starts = ends - counts
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["start"]), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # one row per writing task: as many as there are files
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(bases), "part").select("doc_ids", "segment", (F.col("base") + F.col("part_offset")).alias("start"))
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_tokens(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """:func:`write_tokens` to the shared folder, then :func:`read_tokens`."""
    out = shared_dir(docs.sparkSession)
    write_tokens(docs, tokenizer_path, end_id, out)
    return read_tokens(docs.sparkSession, out)
