"""Vectorised word hashing over Arrow batches, shared by the operators that work on word n-grams.

A word alphabet is a table over UTF-8 bytes.  Both alphabets used here treat every byte above 0x7F alike, so words of
code points and words of bytes are the same words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hash of word hashes (modulo 2**64), and seed of the tables of bytes and places.
GRAM_MULT = np.uint64(0xC2B2AE3D27D4EB4F | 1)
SEED = 20240229

#: A batch is hashed in pieces of about so many bytes: their arrays stay in the CPU cache, and a task in bounded memory.
PIECE_BYTES = 128 << 10


def byte_table(is_word) -> np.ndarray:
    """True for the bytes of words."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
NOT_BLANK = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_CODES = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_places = np.zeros(0, dtype=np.uint64)


def _place_codes(n: int) -> np.ndarray:
    """A random odd number for each place in a word; the same for a place however many are asked for."""
    global _places
    if len(_places) < n:
        _places = mix(np.arange(1, max(n, 256) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) | np.uint64(1)
    return _places


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is the empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, size: int = PIECE_BYTES):
    """Slices of a batch of about ``size`` bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = bytes_of(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def word_bounds(raw: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte behind the last) of every word; words end where rows do."""
    inside = alphabet.take(raw)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]  # where a row ends, a word does
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    edge[cuts] = inside[cuts]
    starts = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    edge[cuts - 1] = inside[cuts - 1]
    return starts, np.flatnonzero(edge) + 1


def _hashed(column: pa.Array, alphabet: np.ndarray, heads: tuple[int, ...]):
    raw, offsets = bytes_of(column)
    n = len(raw)
    none = np.zeros(0, dtype=np.uint64)
    if not n:
        return none, np.zeros(len(offsets), dtype=np.int64), [(none.astype(np.int64), none) for _ in heads], none.astype(np.int64), none.astype(np.int64)
    starts, ends = word_bounds(raw, offsets, alphabet)
    if not len(starts):
        return none, np.zeros(len(offsets), dtype=np.int64), [(none.astype(np.int64), none) for _ in heads], starts, ends
    # a word's hash is the sum over its bytes of (code of the byte) x (random number of its place in the word): no word
    # pattern makes such a sum collide, as patterns do with the powers of one number
    first = starts[0]
    length = ends - starts
    codes = _place_codes(int(length.max()))
    place = np.arange(n - first, dtype=np.int32) - np.repeat((starts - first).astype(np.int32), np.diff(starts, append=n))
    total = np.zeros(n - first + 1, dtype=np.uint64)
    np.cumsum(_CODES[raw[first:]] * codes.take(place, mode="clip"), out=total[1:])  # what follows a word doesn't count
    begun = total[starts - first]
    h = mix((total[ends - first] - begun) ^ length.astype(np.uint64))
    found = []
    for p in heads:
        at = np.flatnonzero(length >= p)
        found.append((at, mix(total[starts[at] + p - first] - begun[at])))
    return h, np.searchsorted(starts, offsets, side="left"), found, starts, ends


def hash_words(column: pa.Array, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, A-Z as a-z; first word of each row and the total) of a string column."""
    return _hashed(column, alphabet, ())[:2]


def hash_parts(column: pa.Array, alphabet: np.ndarray, heads: tuple[int, ...]):
    """As :func:`hash_words`, and for each number of bytes in ``heads`` (words with so many, hash of their first bytes)."""
    return _hashed(column, alphabet, heads)[:3]


def bounded_words(column: pa.Array, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`hash_words`, and (first byte, byte behind the last) of each word."""
    h, splits, _, starts, ends = _hashed(column, alphabet, ())
    return h, splits, starts, ends


def grams(h: np.ndarray, k: int, mult: np.uint64 = GRAM_MULT) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions of the array have none.

    ``h`` are the words' hashes, random 64-bit numbers already, so that a polynomial of their few is enough.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out *= mult
        out += h[j : j + n]
    return mix(out + np.uint64(k))


def row_of(splits: np.ndarray) -> np.ndarray:
    """Row number of every word."""
    return np.repeat(np.arange(len(splits) - 1), np.diff(splits))
