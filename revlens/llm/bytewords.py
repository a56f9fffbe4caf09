"""Vectorised words of a batch of texts, on their UTF-8 bytes.

Every word class used here is decided by single bytes (all bytes from 0x80 on
belong to one class), so words are found on the Arrow buffer itself with
numpy, without decoding. A word is named by a 64-bit polynomial hash of its
lower-cased bytes: prefix sums of ``byte * B**i`` modulo 2**64, and a
difference of two sums times the inverse power of the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z, everything else as it is
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words: everything but space and 0x09-0x0D
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: words: digits, a-z and every byte from 0x80 on (after lower-casing)
LETTER_DIGIT = np.zeros(256, dtype=bool)
LETTER_DIGIT[0x30:0x3A] = LETTER_DIGIT[0x61:0x7B] = LETTER_DIGIT[0x80:] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SPAN = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, SPAN + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SPAN:
            _powers[key] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def buffer_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the values of a string column end to end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of all words; ``raw`` is already lower-cased."""
    n = len(raw)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offsets) - 1, dtype=np.int64)
    word = table[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE,
           inverse: np.uint64 = BASE_INVERSE) -> np.ndarray:
    """64-bit hash of each span ``raw[starts:ends]`` (spans in order, not overlapping)."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(int(np.searchsorted(ends, lo + SPAN, "right")), i + 1)
        hi = ends[j - 1]
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum((raw[lo:hi].astype(np.uint64) + np.uint64(1)) * _power(base, hi - lo)[:hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (total[e] - total[s]) * _power(inverse, hi - lo)[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def words(column: pa.Array | pa.ChunkedArray, table: np.ndarray):
    """(lower-cased bytes, starts, ends, hash of each word, words per text)."""
    raw, offsets = buffer_of(column)
    raw = LOWER[raw]
    starts, ends, per = spans(raw, offsets, table)
    return raw, starts, ends, hashes(raw, starts, ends), per


def shingles(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Distinct n-word shingles of one text, sorted; fewer words are one shingle, none is empty."""
    if not len(word_hash):
        return word_hash
    k = min(n, len(word_hash))
    out = np.full(len(word_hash) - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = out * BASE + word_hash[i:len(word_hash) - k + 1 + i]
    return np.unique(mix(out))
