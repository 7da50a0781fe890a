"""Benchmark decontamination with spaced seeds.

Words are runs of ASCII letters, digits and of other scripts' characters, without
regard to the case of Latin letters.  A seed is a mask over ``SPAN`` (13) consecutive words.  Each of the
13 masks ignores four positions: a translate of the perfect difference set
{0, 1, 3, 9} modulo 13, so any two positions are ignored by exactly one mask, and
a window with up to two substituted words agrees with the original under one mask
at least.  Training hashes are looked up among the benchmark's hashes; each hit
gives an item and a relative position, and the words along it are compared: every
window of 13 words with at most ``SUBSTITUTIONS`` differences is an overlap.
No item is left out:

* Items of 7 to 12 words may have one substituted word: three masks, each ignoring
  a third of the item, one of which leaves it out.  Items of 1 to 6 words count
  where all their words stand, so an item of one word is reported for every document
  with it; ``contaminated`` takes overlaps of at least ``SHORTEST`` words as reason to
  drop a document, as fewer words also stand in texts that never saw the benchmark.
* Each character of a script without blanks (Chinese, Japanese, Thai, Lao, Tibetan,
  Burmese, Khmer) is a word, and marks of other scripts divide words too.  As such a
  word says less, a window there has 26 characters and 4 substitutions, or 52 and 8
  in the alphabets among them (``SCALE``): of its blocks of 13 one has two at most,
  which the 13 masks find.  An item shorter than its window is one window, with two
  substitutions for each whole 13 characters.

Training documents stay where they are.  The benchmark is sent to the tasks in
blocks of about ``BLOCK_WORDS`` words (items are dealt by number; a pass a block,
each narrow), so what is broadcast is bounded however long the benchmark is.

Null or empty text, item or item id: nothing to find.  Repeated items report the
same places under each id.  An empty benchmark finds nothing; an empty corpus
gives an empty result.  Input columns stay, but ``contamination`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.llm.common import Stages, fresh, giving_back
from quietmark.llm.words import FOLD_CASE, NOT_ALNUM, Words, fold_accents, groups, mix, powers, text_bytes

SPAN = 13
IGNORED = (0, 1, 3, 9)
SUBSTITUTIONS = 2
#: Words of the shortest overlap that speaks against a document.
SHORTEST = 5
BLOCK_WORDS = 500_000
FILTER_BITS = 24
#: Windows of 13 for an item mostly of words, of ideographs and kana, of alphabets without blanks.
SCALE = (1, 2, 4)
#: Code points: marks outside ASCII; ideographs and kana; Thai, Lao, Tibetan, Burmese and Khmer.
MARKS = ((0xA0, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0xBF), (0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x3030, 0x3030))
MARKS += ((0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0x0F08, 0x0F14), (0x104A, 0x104F), (0x17D4, 0x17DA))
IDEOGRAPHS = ((0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
ALPHABETS = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF))
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def seed_hashes(h: np.ndarray, mask: int) -> np.ndarray:
    """Hash of the words that a mask keeps, for the window from each word on (``len(h) - 12`` values)."""
    n = len(h)
    if n < SPAN:
        return np.zeros(0, np.uint64)
    up, down = powers(_BASE, n + 1)
    terms = h * up[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    kept = total[SPAN:] - total[:-SPAN]
    last = n - SPAN + 1
    for d in IGNORED:
        p = (d + mask) % SPAN
        kept -= terms[p : p + last]
    kept *= down[:last]
    return kept * np.uint64(0x9FB21C651E98DF25) + np.uint64(mask)


def folded_words(buf: np.ndarray, at: np.ndarray) -> Words:
    return Words(fold_accents(buf[int(at[0]) : int(at[-1])]), at - at[0], NOT_ALNUM, FOLD_CASE)


def _within(code: np.ndarray, spans: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(len(code), bool)
    for lo, hi in spans:
        out |= (code >= lo) & (code <= hi)
    return out


def set_apart(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with blanks for ``MARKS`` and around characters of scripts without blanks.

    Also the number of such characters in each text: ideographs, letters of alphabets.
    """
    b, at = buf[int(at[0]) : int(at[-1])].copy(), at - at[0]
    begins, codes, lengths = [], [], []
    for n, lead, of in ((2, 0xC2, 0xFF), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        p = np.flatnonzero((b & of) == lead)
        code = b[p].astype(np.int64) & (0x7F >> n)
        for k in range(1, n):
            code = code << 6 | b[p + k] & 0x3F
        begins.append(p)
        codes.append(code)
        lengths.append(np.full(len(p), n))
    p, code, n = np.concatenate(begins), np.concatenate(codes), np.concatenate(lengths)
    mark = _within(code, MARKS)
    for k in range(4):
        b[p[mark & (n > k)] + k] = 0x20
    kinds, blanks = [], np.zeros(len(b) + 1, np.int64)
    for spans in (IDEOGRAPHS, ALPHABETS):
        some = _within(code, spans) & ~mark
        kinds.append(np.bincount(np.searchsorted(at, p[some], "right") - 1, minlength=len(at) - 1))
        np.add.at(blanks, p[some], 1)
        np.add.at(blanks, (p + n)[some], 1)
    moved = np.cumsum(blanks)
    out = np.full(len(b) + int(moved[-1]), 0x20, np.uint8)
    out[np.arange(len(b)) + moved[:-1]] = b
    return out, at + (moved - blanks)[at], np.stack(kinds)


def gapped(h: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on without those from ``lo`` to ``hi``; only meaningful where so many are left."""
    size = len(h)
    up, down = powers(_BASE, size + 1)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(h * up[:size], out=total[1:])
    at = lambda k: total[np.minimum(np.arange(size) + k, size)]
    return mix((at(n) - at(0) - at(hi) + at(lo)) * down[:size])


class Short(NamedTuple):
    """Items of one length below ``SPAN`` without their words from ``lo`` to ``hi``."""

    words: int
    lo: int
    hi: int
    keys: np.ndarray  # sorted hashes
    items: np.ndarray  # their item numbers


class Index(NamedTuple):
    ids: np.ndarray  # of items
    first: np.ndarray  # first word of each item, and the end
    words: np.ndarray  # word hashes of all items
    span: np.ndarray  # words of a window of each item
    keys: np.ndarray  # sorted seed hashes
    places: np.ndarray  # their word number
    short: list[Short]
    bits: np.ndarray  # one bit for the top bits of every key


def build_index(ids: np.ndarray, texts: pa.Array) -> Index:
    buf, at = text_bytes(texts)
    scale = np.full(len(texts), SCALE[0])
    buf, at, (ideographs, letters) = set_apart(buf, at)
    words = folded_words(buf, at)
    scale[2 * (ideographs + letters) > words.counts] = SCALE[1]
    scale[2 * letters > words.counts] = SCALE[2]
    left = words.left()
    keys, places = [], []
    for mask in range(SPAN):
        k = seed_hashes(words.hash, mask)
        ok = np.flatnonzero(left[: len(k)] >= SPAN)
        keys.append(k[ok])
        places.append(ok)
    keys, places = np.concatenate(keys), np.concatenate(places)
    order = np.argsort(keys, kind="stable")
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[keys >> np.uint64(64 - FILTER_BITS)] = True
    short = []
    for n in range(1, SPAN):
        one = (scale == 1) & bool(SUBSTITUTIONS * n // SPAN)
        for some, masks in ((~one, [(0, 0)]), (one, [(n * k // 3, n * (k + 1) // 3) for k in range(3)])):
            items = np.flatnonzero((words.counts == n) & some)
            for lo, hi in masks if len(items) else ():
                h = gapped(words.hash, n, lo, hi)[words.first[items]]
                by = np.argsort(h, kind="stable")
                short.append(Short(n, lo, hi, h[by], items[by]))
    span = np.minimum(words.counts, SPAN * scale)
    return Index(ids, words.first, words.hash, span, keys[order], places[order], short, bits)


def _pairs(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (number in ``wanted``, number in sorted ``keys``) with equal values."""
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    n = hi - lo
    which = np.repeat(np.arange(len(wanted)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def find(index: Index, words: Words) -> list[list[tuple[int, int, int]]]:
    """For every text the overlaps ``(item number, first word, end word)``, merged along each relative position."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words.counts]
    left = words.left()
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    at_word, at_item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for mask in range(SPAN if len(index.keys) else 0):
        k = seed_hashes(words.hash, mask)
        some = np.flatnonzero(index.bits[k >> np.uint64(64 - FILTER_BITS)] & (left[: len(k)] >= SPAN))
        which, entry = _pairs(index.keys, k[some])
        at_word.append(some[which])
        at_item.append(index.places[entry])
    w, p = np.concatenate(at_word), np.concatenate(at_item)
    # One comparison a text, item and relative position.
    item = np.searchsorted(index.first, p, "right") - 1
    shift = w - p
    for t, i, s in np.unique(np.stack([text[w], item, shift], 1), axis=0) if len(w) else ():
        lo = max(int(words.first[t]), int(index.first[i]) + s)
        hi = min(int(words.first[t + 1]), int(index.first[i + 1]) + s)
        span = int(index.span[i])
        same = np.concatenate([[0], np.cumsum(words.hash[lo:hi] == index.words[lo - s : hi - s])])
        good = np.flatnonzero(same[span:] - same[:-span] >= span - SUBSTITUTIONS * (span // SPAN))
        if len(good):
            cut = np.flatnonzero(np.diff(good) > span)
            base = lo - int(words.first[t])
            for a, b in zip(good[np.append(0, cut + 1)], good[np.append(cut, len(good) - 1)]):
                out[t].append((int(i), base + int(a), base + int(b) + span))
    hits = [np.zeros((0, 3), np.int64)]
    for n, lo, hi, keys, items in index.short:
        h = gapped(words.hash, n, lo, hi)
        some = np.flatnonzero(left >= n)
        which, entry = _pairs(keys, h[some])
        w, i = some[which], items[entry]
        # All but the ignored words are equal; one substitution is allowed among those.
        differ = sum((words.hash[w + k] != index.words[index.first[i] + k] for k in range(lo, hi)), np.zeros(len(w), np.int64))
        ok = differ <= 1
        hits.append(np.stack([w[ok], i[ok], np.full(ok.sum(), n)], 1))
    for at, i, n in np.unique(np.concatenate(hits), axis=0):
        s = int(at - words.first[text[at]])
        out[text[at]].append((int(i), s, s + int(n)))
    return out


OVERLAPS = "array<struct<item_id:long,first_word:int,end_word:int>>"


def _look(shared):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int32()), ("end_word", pa.int32())]))

    @F.arrow_udf(OVERLAPS)
    @giving_back
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = shared.value
        for texts in batches:
            buf, at = text_bytes(texts)
            rows = []
            for lo, hi in groups(at):
                for found in find(index, folded_words(*set_apart(buf, at[lo : hi + 1])[:2])):
                    rows.append([{"item_id": int(index.ids[i]), "first_word": s, "end_word": e} for i, s, e in sorted(found)])
            yield pa.array(rows, kind)

    return look


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", stages: Stages | None = None) -> DataFrame:
    """``docs`` with a column ``contamination``: the overlaps of each text, an empty list for a clean one."""
    stages = stages or Stages(docs.sparkSession)
    items = benchmark.select(F.col(item_col).try_cast("long").alias("id"), F.col(item_text_col).alias("text")).where("id is not null and text is not null")
    items = stages.save(items.withColumn("number", F.monotonically_increasing_id()))
    # Characters of higher code points may be words of their own.
    words = F.size(F.split("text", r"\s+")) + F.length(F.regexp_replace("text", r"[\x{0}-\x{DFF}]", ""))
    size = items.agg(F.sum(words)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_WORDS))
    found = [fresh("found") for _ in range(blocks)]
    out = docs
    for b, column in enumerate(found):
        part = items.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).select("id", "text").toArrow()
        index = build_index(part["id"].to_numpy(), part["text"].combine_chunks() if len(part) else pa.array([], pa.string()))
        out = out.withColumn(column, _look(docs.sparkSession.sparkContext.broadcast(index))(F.col(text_col)))
    return out.withColumn("contamination", F.concat(*found)).drop(*found)


def contaminated(overlaps: str = "contamination", shortest: int = SHORTEST) -> Column:
    """Whether an overlap of at least ``shortest`` words speaks against the document; false for none and for null."""
    return F.coalesce(F.exists(overlaps, lambda o: o.end_word - o.first_word >= shortest), F.lit(False))
