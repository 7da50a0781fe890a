"""Vectorised word scanning of Arrow text columns: words, hashes, windows.

Texts are never turned into Python strings here: the bytes of an Arrow batch are
read in place, a few megabytes at a time, so a worker's memory is bounded by the
batch and the longest single text.  Word hashes are 64-bit polynomials over the
bytes (odd base, mixed); window hashes are polynomials over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASES = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    known = _TABLES.get(int(base))
    if known is None or len(known[0]) < n:
        known = _TABLES[int(base)] = _powers(base, max(n, 1 << 16))
    return known


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def byte_set(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for lo, hi in spans:
        out[lo : hi + 1] = True
    return out


SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
#: Everything ASCII that is neither a letter nor a digit.
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
KEEP_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE = KEEP_CASE.copy()
FOLD_CASE[0x41:0x5B] += 32


def fold_accents(b: np.ndarray) -> np.ndarray:
    """A copy with the upper-case letters of UTF-8's Latin-1 block in lower case."""
    out = b.copy()
    at = np.flatnonzero(b[:-1] == 0xC3) + 1
    at = at[(b[at] >= 0x80) & (b[at] <= 0x9E) & (b[at] != 0x97)]
    out[at] += 0x20
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the ``n + 1`` offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def pieces(batches: Iterator[pa.RecordBatch], text: int, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes in column ``text``, whatever size the reader chose."""
    for batch in batches:
        for lo, hi in groups(text_bytes(batch.column(text))[1], limit):
            yield batch.slice(lo, hi - lo)


class Words:
    """Words of some texts: byte ranges, 64-bit hashes, and the first word of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACES, fold: np.ndarray = KEEP_CASE):
        self.base = int(offsets[0])
        b = buf[self.base : int(offsets[-1])]
        at = offsets - self.base
        inside = ~sep[b]
        n = len(b)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edge = at[:-1]
            before[edge[edge < n]] = False
            edge = at[1:]
            after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, at)
        self._bytes, self._fold = b, fold
        self.hash = self._hashes(self.end)

    def stems(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes of each word (of the whole word, if it is shorter)."""
        return self._hashes(np.minimum(self.end, self.start + n))

    def _hashes(self, end: np.ndarray) -> np.ndarray:
        b, fold = self._bytes, self._fold
        out = np.empty(len(self.start), np.uint64)
        lo = 0
        while lo < len(self.start):  # long texts in pieces of whole words
            s0 = int(self.start[lo])
            hi = max(lo + 1, int(np.searchsorted(self.end, s0 + GROUP_BYTES, "right")))
            piece = b[s0 : int(self.end[hi - 1])]
            up, down = powers(_BASE, len(piece) + 1)
            total = np.zeros(len(piece) + 1, np.uint64)
            values = fold[piece].astype(np.uint64)
            values += np.uint64(1)
            values *= up[: len(piece)]
            np.cumsum(values, out=total[1:])
            s = self.start[lo:hi] - s0
            out[lo:hi] = (total[end[lo:hi] - s0] - total[s]) * down[s]
            lo = hi
        return mix(out)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For every word, how many words of its text begin here or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """Hash of the ``k`` words from each word on; only meaningful where ``left() >= k``."""
        return rolling(self.hash, k, which)


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Polynomial of ``k`` consecutive values from each place on (zeros beyond the end)."""
    n = len(h)
    if which:
        h = mix(h ^ np.uint64(0xA0761D6478BD642F))
    up, down = powers(_WORD_BASES[which], n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    hi = np.minimum(np.arange(n) + k, n)
    return mix((total[hi] - total[:n]) * down[:n])


def slide(values: np.ndarray, w: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) of ``w`` consecutive values: ``n - w + 1`` results."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out
