"""Word and byte kernels over Arrow text columns, in numpy.

Texts of a batch are handled in slices of bounded size, each as one byte buffer, so
memory does not follow the number of rows Arrow put into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer single text is its own slice).
SLICE_BYTES = 1 << 20

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BASE = int(_RNG.integers(1, 1 << 62, dtype=np.uint64)) | 1
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def white_space() -> np.ndarray:
    """Word characters of ``[^\\x20\\x09-\\x0D]``: byte -> is part of a word."""
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def alphanumeric() -> np.ndarray:
    """Word characters of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    keep = np.ones(256, bool)
    for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        keep[lo:hi + 1] = False
    return keep


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and ``n + 1`` offsets of a string column; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets if len(offsets) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges ``(lo, hi)`` whose texts sum to about ``limit`` bytes."""
    limit = limit or SLICE_BYTES
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


_POWERS = np.ones(1, U64)
_INVERSES = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES + 1)
        base, inverse = np.full(size, U64(_BASE)), np.full(size, U64(pow(_BASE, -1, 1 << 64)))
        base[0] = inverse[0] = 1
        _POWERS, _INVERSES = np.cumprod(base, dtype=U64), np.cumprod(inverse, dtype=U64)
    return _POWERS, _INVERSES


class Words:
    """Words of the texts ``lo..hi`` of a column: 64-bit digests and where they are.

    ``digest[i]`` is the digest of word ``i`` (lower-cased A-Z), ``start``/``end`` its
    byte range in ``raw``, ``row`` its text, and ``first[r]:first[r + 1]`` are the words of
    text ``r`` (counted from ``lo``).
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int, is_word: np.ndarray):
        a, b = int(offsets[lo]), int(offsets[hi])
        low = LOWER[raw[a:b]]
        inside = np.zeros(len(low) + 2, np.int8)
        inside[1:-1] = is_word[low]
        # texts that touch: a word ends where its text ends
        edges = np.diff(inside)
        bounds = offsets[lo:hi + 1] - a
        cut = bounds[1:-1]
        cut = cut[(cut > 0) & (cut < len(low))]
        cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])
        start = np.flatnonzero(edges == 1)
        end = np.flatnonzero(edges == -1)
        if len(cut):
            start = np.sort(np.concatenate([start, cut]))
            end = np.sort(np.concatenate([end, cut]))
        self.digest = np.zeros(len(start), U64)
        at = 0
        while at < len(start):  # pieces of whole words: 8-byte values never stand for a whole long text
            to = int(np.searchsorted(start, start[at] + SLICE_BYTES))
            p, q = int(start[at]), int(end[to - 1])
            powers, inverses = _powers(q - p + 1)
            total = np.zeros(q - p + 1, U64)
            np.cumsum(_BYTE[low[p:q]] * powers[:q - p], out=total[1:])
            s, e = start[at:to] - p, end[at:to] - p
            self.digest[at:to] = mix64((total[e] - total[s]) * inverses[s] + (e - s).astype(U64) * _MIX1)
            at = to
        self.low, self.base = low, a
        self.start, self.end = start, end
        self.first = np.searchsorted(start, bounds)
        self.row = np.repeat(np.arange(hi - lo), np.diff(self.first))

    def text(self, i: int, n: int = 1) -> bytes:
        """``n`` words from word ``i``, lower-cased, joined by one space."""
        return b" ".join(self.low[self.start[j]:self.end[j]].tobytes() for j in range(i, i + n))


def windows(digest: np.ndarray, n: int) -> np.ndarray:
    """Digest of each run of ``n`` consecutive words, in their order."""
    count = max(0, len(digest) - n + 1)
    out = np.full(count, U64(n))
    for k in range(n):
        out = mix64((out + digest[k:k + count]) * _MIX2 + U64(k + 1))
    return out
