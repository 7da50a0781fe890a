"""Periodic runs of words: online dyadic square catching.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) that no neighbouring word extends, of at least
``max(least, 2 * q)`` words.

``Catcher`` reads a text word by word and never looks ahead.  At level ``k`` every
completed block of ``2**k`` words (from a multiple of ``2**k`` on) is a catcher for
the periods from ``2**(k+1) - 1`` to ``2**(k+2) - 2``: a square of such a period holds
a whole block in the part that repeats.  An appended word lengthens the suffixes
that are compared with the blocks: a suffix of ``2**k`` words equals a block only if
both halves equal blocks of the level below, so the comparison climbs from level
to level and ends at the first that is unknown.  At any time only two completed
blocks of a level are at fitting distances.  A suffix that equals one of them starts
a comparison at that period: it is carried left as far as it goes (less than a
block, or an earlier block would have caught it), and right by every further word.
When it breaks, its squares have merged into one run.  A period that is a multiple
of a live one which covers its block is not followed: its stretch would be the
same.  Blocks a level and recent suffixes are kept, which is linear in the text.

Null or empty text, or one without words: no words, no runs, empty kept text.
Texts of any length are read whole, one row at a time; rows are independent, so
repeated rows, ties and null ids need no rule, and other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
PERIODIC = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,kept_text:string>"


class Catcher:
    """Runs of a sequence of hashable words that grows at its end."""

    def __init__(self, least: int = 12):
        self.least = least
        self._words: list = []
        # By level: the names of completed blocks in order, the name of a pair of halves, and (by place modulo the
        # block size) where a recent suffix ended and its name.
        self._done: list[list[int]] = [[], [], []]
        self._named: list[dict[tuple, int]] = [{}, {}, {}]
        self._recent: list[dict[int, tuple[int, int]]] = [{}, {}, {}]
        self._pairs: list[int | None] = []  # names of the suffixes of two words, at every place
        self._live: dict[int, int] = {}
        self._found: dict[tuple[int, int], int] = {}

    def extend(self, words: Iterable) -> Catcher:
        """Append words one by one."""
        seen, live, pairs, done = self._words, self._live, self._pairs, self._done[1]
        _, named, fours, *_ = self._named
        j = len(seen) - 1
        for word in words:
            j += 1
            seen.append(word)
            if not j:
                pairs.append(None)
                continue
            if live:
                for p in [p for p in live if seen[j - p] != word]:
                    self._close(self._found, live.pop(p), j, p)
            before = seen[j - 1]
            if before == word:  # level 0: blocks of one word, periods 1 and 2
                live.setdefault(1, j - 1)
            elif j > 1 and seen[j - 2] == word:
                live.setdefault(2, j - 2)
            name = named.get((before, word))
            if j & 1:
                if name is None:
                    name = named[before, word] = len(named)
                done.append(name)
            pairs.append(name)
            if name is not None:
                i = (j - 4) >> 1
                if i >= 0 and (done[i] == name or i and done[i - 1] == name):
                    self._catch(1, name, j)
                left = pairs[j - 2] if j > 2 else None
                if left is not None and (j & 3 == 3 or (left, name) in fours):
                    self._climb(left, name, j)
        return self

    def _climb(self, left: int, name: int, j: int) -> None:
        """Suffixes of 4, 8, ... words, each named by its halves, as long as they equal a block."""
        level, size = 2, 4
        while True:
            if level == len(self._done):
                for tables, empty in ((self._done, []), (self._named, {}), (self._recent, {})):
                    tables.append(empty)
            named, pair = self._named[level], (left, name)
            name = named.get(pair)
            if not (j + 1) % size:
                if name is None:
                    name = named[pair] = len(named)
                self._done[level].append(name)
            if name is None:
                return
            self._catch(level, name, j)
            recent, place = self._recent[level], j % size
            at, left = recent.get(place, (-1, 0))
            recent[place] = j, name
            if at != j - size or at < 0:
                return
            level, size = level + 1, 2 * size

    def _catch(self, level: int, name: int, j: int) -> None:
        """Compare the suffix that ends at ``j`` with the two blocks of its level at fitting distances."""
        size, done, seen, live = 1 << level, self._done[level], self._words, self._live
        begin = j - size + 1
        near = (begin - 2 * size + 1) >> level
        for i in (near, near - 1):
            if i < 0 or done[i] != name:
                continue
            start = i << level
            p = begin - start
            if p in live or any(not p % q and at <= start for q, at in live.items()):
                continue
            k = start - 1
            while k >= 0 and seen[k] == seen[k + p]:
                k -= 1
            live[p] = k + 1

    def _close(self, found: dict[tuple[int, int], int], start: int, end: int, p: int) -> None:
        if end - start >= max(self.least, 2 * p):
            found[start, end - start] = min(p, found.get((start, end - start), p))

    def runs(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of the runs of what was read so far, by start, then period."""
        found = dict(self._found)
        for p, start in self._live.items():
            self._close(found, start, len(self._words), p)
        return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    gone = bytearray(len(words))
    for start, length, period in runs:
        gone[start + period : start + length] = b"\1" * (length - period)
    return [w for w, g in zip(words, gone) if not g] if runs else words


def _scan(least: int):
    def run(texts: pa.Array) -> pa.Array:
        counts, found, kept = [], [], []
        for text in texts:
            # bytes.split() cuts at the blank and at 09 to 0D, and nowhere else.
            words = (text.as_py() or "").encode().split()
            runs = Catcher(least).extend(words).runs() if len(words) >= least else []
            counts.append(len(words))
            found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            kept.append(b" ".join(collapse(words, runs)).decode())
        columns = [pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(kept, pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n_words", "runs", "kept_text"])

    return run


def periodic(text: Column, least: int = 12) -> Column:
    """``n_words, runs, kept_text`` of a text: its runs by start, and its words without their repetitions."""
    if least < 2:
        raise ValueError("a run has at least two words")
    return F.arrow_udf(_scan(least), PERIODIC)(text)
