"""Cut texts into segments such that equal ``length``-byte strings get equal keys.

The string that starts at a byte is keyed by its leftmost smallest
``GRAM``-byte substring (by hash). Neighbouring starts with the same such
place form a run; the run and the bytes its strings cover are a segment. Two
equal strings have equal keys and never lie in one segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from revlens.llm import bytewords as bw

GRAM = 32
U = np.uint64
_BYTE = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5), U(0x85EBCA77C2B2AE63)]
BLOCK = 1 << 20
#: bits of a hash that give way to a place in a block
PLACE = U((1 << 21) - 1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place (the last GRAM - 1 places are left out)."""
    h, width = _BYTE[raw], 1
    for step in _STEP:
        h = h[:-width] * step + h[width:]
        h ^= h >> U(29)
        width *= 2
    return bw.mix(h)


def first_min(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest (by the upper 43 bits) of each ``width`` neighbours."""
    out = (h & ~PLACE) | np.arange(len(h), dtype=U)
    have = 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    out = np.minimum(out[:len(out) - rest], out[rest:]) if rest else out
    return (out & PLACE).astype(np.int64)


def blocks(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, from byte, to byte): about BLOCK bytes of whole texts, or a part of a long one."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= BLOCK:
            j += 1
        lo, hi = int(offsets[i]), int(offsets[j])
        for a in range(lo, max(lo + 1, hi - length + 1), BLOCK):  # parts of a long text share length - 1 bytes
            yield i, j, a, min(hi, a + BLOCK + length - 1)
        i = j


def segments(raw: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For blocks of texts: (text number, start in its text, run, key, content hash) of every segment."""
    for i, j, lo, hi in blocks(offsets, length):
        if hi - lo < length:
            continue
        part = raw[lo:hi]
        h = gram_hashes(part)
        place = first_min(h, length - GRAM + 1)
        at = np.arange(len(place))
        edges = offsets[i:j + 1] - lo
        which = np.searchsorted(edges, at, "right") - 1
        ok = at + length <= edges[which + 1]
        first = ok.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~ok[:-1] | (which[1:] != which[:-1])
        start = np.flatnonzero(first)
        if len(start):
            # a run ends before the next first or the next bad start
            stop = np.flatnonzero(np.concatenate([first | ~ok, [True]]))
            end = stop[np.searchsorted(stop, start, "right")]
            total = np.zeros(len(part) + 1, dtype=U)
            np.cumsum((part.astype(U) + U(1)) * bw._power(bw.BASE, len(part))[:len(part)], out=total[1:])
            last = end + length - 1
            content = (total[last] - total[start]) * bw._power(bw.BASE_INVERSE, len(part) + 1)[start] + (last - start).astype(U) * U(0xD6E8FEB86659FD93)
            yield which[start] + i, start - edges[which[start]], end - start, h[place[start]], bw.mix(content)
