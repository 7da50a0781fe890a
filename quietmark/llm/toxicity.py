"""Toxic passages by maximum-scoring segment search.

Tokens are lower-cased words.  A token's log-odds compare its share of toxic
documents with the base rate; Dirichlet priors shrink the share of a word towards
that of its first bytes (its stem), and the stem's towards the base rate, so rare
words say little.  Less a constant drift, log-odds are token scores, negative on
average, and a linear scan (all maximal scoring segments) finds every passage
that stands out.

Segment scores are calibrated as extreme values: in clean text the best segment
of ``n`` tokens exceeds ``S`` with probability ``1 - exp(-K n exp(-lambda S))``.
``lambda`` solves the moment equation over the clean token scores, ``K`` is fitted
to clean learning documents.  A document adds up the evidence
``lambda S - ln(K n)`` of its significant segments; a logistic curve over this sum,
fitted with every learning document's own counts taken out, gives the score.

Word and stem counts cover all learning documents, in tables of fixed size
(hashed, ``BUCKETS`` entries); the curve is fitted on at most about ``CALIBRATION``
of them.  Null or empty text: no segment, the score of no evidence.  Rows are
judged one by one; with labels of one kind only, the score is the base rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.llm.common import packed, unpacked
from quietmark.llm.words import FOLD_CASE, NOT_ALNUM, Words, groups, text_bytes

BUCKETS = 1 << 20
STEM_BYTES = 5
PRIOR = 10.0
DRIFT = 0.5
CALIBRATION = 20_000
SIGNIFICANT = 0.05
SHARD = 1 << 14
SEED = 11
COUNTED = "kind int, shard int, one binary, many binary, n binary, bad binary, y binary"


class Counts(NamedTuple):
    """Documents and toxic documents that hold each word and each stem; of all: the last entry."""

    words: np.ndarray  # 2 x BUCKETS
    stems: np.ndarray
    documents: int
    toxic: int


class Model(NamedTuple):
    counts: Counts
    lam: float
    k: float
    slope: float
    offset: float


def _tokens(buf: np.ndarray, at: np.ndarray):
    words = Words(buf, at, NOT_ALNUM, FOLD_CASE)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return words, (words.hash >> shift).astype(np.int64), (words.stems(STEM_BYTES) >> shift).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's documents by bucket, packed: kind 0 words, 1 stems (by shard), 2 the documents themselves."""
    table = np.zeros((2, 2, BUCKETS), np.int32)
    seen = np.zeros(2, np.int64)
    for batch in batches:
        buf, at = text_bytes(batch.column(0))
        toxic = batch.column(1).to_numpy()
        seen += [len(toxic), int(toxic.sum())]
        for lo, hi in groups(at):
            words, *buckets = _tokens(buf, at[lo : hi + 1])
            text = np.repeat(np.arange(hi - lo), words.counts)
            for kind, b in enumerate(buckets):
                once = np.unique(text * BUCKETS + b)
                hit, bad = once % BUCKETS, toxic[lo + once // BUCKETS] > 0
                np.add.at(table[kind, 0], hit, 1)
                np.add.at(table[kind, 1], hit[bad], 1)
    rows = [(2, 0, b"", b"", packed(seen[:1], np.int64), b"", packed(seen[1:], np.int64))]
    for kind in (0, 1):
        for shard, (n, y) in enumerate(table[kind].reshape(2, -1, SHARD).transpose(1, 0, 2)):
            many, bad = np.flatnonzero(n > 1), np.flatnonzero(y)
            rows.append((kind, shard, packed(np.flatnonzero(n == 1), np.uint16), packed(many, np.uint16), packed(n[many], np.int32), packed(bad, np.uint16), packed(y[bad], np.int32)))
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in COUNTED.split(", ")])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard of one table, added up while its parts stream by."""
    total, key = np.zeros((2, SHARD), np.int64), None
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["kind"], r["shard"])
            if r["kind"] == 2:
                total[:, 0] += [unpacked(r["n"], np.int64)[0], unpacked(r["y"], np.int64)[0]]
                continue
            total[0, unpacked(r["one"], np.uint16)] += 1
            total[0, unpacked(r["many"], np.uint16)] += unpacked(r["n"], np.int32)
            total[1, unpacked(r["bad"], np.uint16)] += unpacked(r["y"], np.int32)
    arrays = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([packed(t, np.float32 if key[0] < 2 else np.int64)], pa.binary()) for t in total)]
    yield pa.RecordBatch.from_arrays(arrays, names=["kind", "shard", "n", "y"])


def token_scores(c: Counts, word: np.ndarray, stem: np.ndarray, own: int | None = None) -> np.ndarray:
    """Log-odds less the drift; ``own``: the label of a learning document, whose counts are taken out."""
    out_n, out_y = (0, 0) if own is None else (1, own)
    base = (c.toxic - out_y + 1.0) / (c.documents - out_n + 2.0)
    share = (c.stems[1][stem] - out_y + PRIOR * base) / (c.stems[0][stem] - out_n + PRIOR)
    share = (c.words[1][word] - out_y + PRIOR * share) / (c.words[0][word] - out_n + PRIOR)
    share = np.clip(share, 1e-9, 1 - 1e-9)
    return np.log(share / (1 - share)) - np.log(base / (1 - base)) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, score)``, in one pass over the rises of the running sum."""
    up = scores > 0
    if not up.any():
        return []
    edge = np.diff(np.concatenate([[0], up.view(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # (first, end, sum before, sum after, index of the last entry with a smaller sum before)
    for s, e in zip(first.tolist(), end.tolist()):
        low, high = float(total[s]), float(total[e])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append([s, e, low, high, j])
                break
            s, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(s, e, high - low) for s, e, low, high, _ in stack]


def evidence(found: list[tuple[int, int, float]], n: int, lam: float, k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Sum of ``lambda S - ln(K n)`` over the significant segments, and these segments."""
    if not n:
        return 0.0, []
    level = np.log(k * n)
    kept = [(s, e, lam * score - level) for s, e, score in found]
    kept = [x for x in kept if -np.expm1(-np.exp(-x[2])) <= SIGNIFICANT]
    return float(sum(x[2] for x in kept)), kept


def _measure(shared):
    """Of learning documents: label, tokens, segment scores; a batch's clean token scores are counted in its first row."""
    grid = moment_grid()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, at = text_bytes(batch.column(0))
            toxic = batch.column(1).to_numpy()
            n, scores, hist = [], [], np.zeros(len(grid) - 1, np.int64)
            for lo, hi in groups(at):
                words, word, stem = _tokens(buf, at[lo : hi + 1])
                for t in range(hi - lo):
                    a, b = words.first[t], words.first[t + 1]
                    s = token_scores(counts, word[a:b], stem[a:b], int(toxic[lo + t]))
                    n.append(b - a)
                    hist += 0 if toxic[lo + t] else np.histogram(s, grid)[0]
                    scores.append([x[2] for x in segments(s)])
            columns = [batch.column(1), pa.array(n, pa.int64()), pa.array([hist] + [None] * (len(n) - 1), pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "n", "hist", "scores"])

    return run


def moment_grid() -> np.ndarray:
    return np.concatenate([[-np.inf], np.linspace(-8, 16, 193), [np.inf]])


def decay(hist: np.ndarray) -> float:
    """The positive ``lambda`` with mean ``exp(lambda s)`` of 1 over token scores ``s``; 1 if there is none."""
    grid = moment_grid()
    middle = np.clip((np.clip(grid[:-1], -8.1, 16) + np.clip(grid[1:], -8, 16.1)) / 2, -8, 16)
    p = hist / max(hist.sum(), 1)
    if not (p[middle > 0].sum() > 0 and (p * middle).sum() < 0):
        return 1.0
    lo, hi = 1e-6, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * middle)).sum() < 1 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve by Newton steps, lightly regularised."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-3 * w
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def fit(docs: DataFrame, label: Column, text_col: str = "text") -> Model:
    """Learn from all rows whose ``label`` is 0 or 1.  The driver gets tables and a sample of fixed size."""
    known = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), label.cast("long").alias("toxic")).where("toxic in (0, 1)")
    rows = known.mapInArrow(_count, COUNTED).groupBy("kind", "shard").applyInArrow(_add, "kind int, shard int, n binary, y binary").collect()
    tables, seen = np.zeros((2, 2, BUCKETS), np.float32), np.zeros(2, np.int64)
    for r in rows:  # the two tables, in shards
        if r["kind"] == 2:
            seen = np.array([unpacked(r["n"], np.int64)[0], unpacked(r["y"], np.int64)[0]])
            continue
        at = slice(r["shard"] * SHARD, (r["shard"] + 1) * SHARD)
        tables[r["kind"], 0, at], tables[r["kind"], 1, at] = unpacked(r["n"], np.float32), unpacked(r["y"], np.float32)
    counts = Counts(tables[0], tables[1], int(seen[0]), int(seen[1]))
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # 16 MB, whatever the corpus
    share = min(1.0, CALIBRATION / max(counts.documents, 1))
    schema = "toxic long, n long, hist array<long>, scores array<double>"
    sample = known.where(F.rand(SEED) < share).mapInArrow(_measure(shared), schema).toArrow().to_pylist()
    sample.sort(key=lambda r: (r["toxic"], r["n"], r["scores"]))
    clean = [r for r in sample if not r["toxic"]]
    base = (counts.toxic + 0.5) / (counts.documents + 1)
    flat = float(np.log(base / (1 - base)))
    if not clean or len(clean) == len(sample):
        return Model(counts, 1.0, 1.0, 0.0, flat)
    lam = decay(np.sum([r["hist"] for r in sample if r["hist"]], axis=0).astype(float))
    k = 1 / max(float(np.mean([r["n"] * np.exp(-lam * max(r["scores"], default=0.0)) for r in clean])), 1e-12)
    x = np.array([np.log1p(evidence([(0, 0, s) for s in r["scores"]], r["n"], lam, k)[0]) for r in sample])
    slope, offset = logistic(x, np.array([r["toxic"] for r in sample], float))
    return Model(counts, lam, k, slope, offset)


RESULT = "struct<score:double,evidence:double,passages:array<struct<first_word:int,end_word:int,evidence:double>>>"


def score(docs: DataFrame, text: Column, model: Model) -> Column:
    """Score and significant passages (word numbers, half open) of every text; ``docs`` names the session."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("evidence", pa.float64())]))

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        m = shared.value
        buf, at = text_bytes(texts)
        total, passages = [], []
        for lo, hi in groups(at):
            words, word, stem = _tokens(buf, at[lo : hi + 1])
            scores = token_scores(m.counts, word, stem)
            for a, b in zip(words.first, words.first[1:]):
                value, kept = evidence(segments(scores[a:b]), int(b - a), m.lam, m.k)
                total.append(value)
                passages.append([{"first_word": s, "end_word": e, "evidence": v} for s, e, v in kept])
        total = np.array(total, float)
        final = 1 / (1 + np.exp(-np.clip(m.slope * np.log1p(total) + m.offset, -30, 30)))
        return pa.StructArray.from_arrays([pa.array(final), pa.array(total), pa.array(passages, kind)], ["score", "evidence", "passages"])

    return judge(text)
