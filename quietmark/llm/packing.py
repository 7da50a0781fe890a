"""Best-fit packing by a configuration linear program.

A document's ids and one end id are cut into pieces of at most ``capacity``
tokens (all but the first are full).  Only the histogram of piece lengths, at
most ``capacity`` numbers whatever the size of the corpus, decides the plan:

1. The configuration program (a pattern is a multiset of lengths that fits one
   sequence; cover every length as often as it occurs with the fewest patterns)
   is solved by multiplicative weights: lengths that lag behind their share gain
   weight, and the patterns of the largest weight, priced by an unbounded
   knapsack over the capacity, are added.
2. The fractional solution is rounded down; what is left is packed by best-fit
   decreasing on the histogram, many equal sequences at a time.

The plan is a table of rank intervals by length.  A piece's rank among those of
its length is its number within its task plus the task's offset, so nothing but
counts by task and length is aggregated, and pieces never meet in one task.

Null text: empty, one end id.  Any id, null too, is passed through; repeated
rows are packed one by one.  An empty table gives no sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietmark.llm.common import Stages, attach, giving_back
from quietmark.llm.encoding import Encoder
from quietmark.llm.words import pieces

ROUNDS = 60
#: Growth of a lagging length's weight in one round; room a pattern of the program may waste.
RATE = 0.002
WASTE = 1
#: Among full patterns, those of fewer, longer pieces are worth more: short pieces are kept to close gaps.
LONGER = 1.1
END_ID = 2


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``total`` tokens."""
    head = total % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, total, capacity))]


def _tokenize(path: str, capacity: int, end_id: int, keep_ids: bool):
    end = end_id.to_bytes(4, "little")

    def cut_up(batch: pa.RecordBatch, encode, part: int, seen: list[int]) -> pa.RecordBatch:
        owner, rows, ids = [], [], []
        for i, text in enumerate(batch.column(1)):
            raw = encode(text.as_py() or "") + end
            for k, (start, n) in enumerate(cut(len(raw) // 4, capacity)):
                own = raw[4 * start : 4 * (start + n)]
                owner.append(i)
                rows.append((k, start, n, zlib.crc32(own), part, seen[n]))
                seen[n] += 1
                if keep_ids:
                    ids.append(np.frombuffer(own, np.uint32).astype(np.int32))
        columns = zip(*rows) if rows else [[]] * 6
        out = [batch.column(0).take(pa.array(owner, pa.int64())), *map(pa.array, columns, [pa.int32()] + [pa.int64()] * 5)]
        names = ["id", "piece", "start", "length", "ids_crc32", "part", "rank"]
        if keep_ids:
            out.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names=names)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's own: a memo kept by the worker would stay in memory under every later stage.
        encode = Encoder(path).encode
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for piece in pieces(batches, 1):
            yield cut_up(piece, encode, part, seen)

    return run


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest value that fits each room ``0 .. capacity``, and the length it takes first (0: none)."""
    lengths = np.flatnonzero(values > 0)
    worth, best, took = values[lengths], np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(int(lengths[0]) if len(lengths) else capacity + 1, capacity + 1):
        fit = np.searchsorted(lengths, c, "right")
        sums = worth[:fit] + best[c - lengths[:fit]]
        k = int(sums.argmax())
        if sums[k] > best[c - 1]:
            best[c], took[c] = sums[k], lengths[k]
        else:
            best[c], took[c] = best[c - 1], took[c - 1]
    return best, took


def _pattern(first: int, took: np.ndarray, capacity: int) -> dict[int, int]:
    """The most valuable pattern that holds a piece of length ``first``."""
    out, room = {first: 1}, capacity - first
    while room > 0 and took[room]:
        s = int(took[room])
        out[s] = out.get(s, 0) + 1
        room -= s
    return out


def fractional(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Patterns and amounts that cover (nearly) ``counts[s]`` pieces of each length ``s``.

    A length's price is its share of a sequence times a weight that grows by a
    constant factor with every round in which the length falls behind.  One
    knapsack a round prices the best pattern around every open length; amounts
    never exceed what is still uncovered, so no length is covered twice.
    """
    size = np.arange(len(counts))
    left = counts.astype(float)
    weight = np.ones(len(counts))
    amounts: dict[tuple, float] = {}
    for _ in range(rounds):
        open_ = np.flatnonzero(left >= 1)
        if not len(open_):
            break
        _, took = knapsack(np.where(left >= 1, size**LONGER * weight, 0.0), capacity)
        before = left.copy()
        for s in open_[::-1]:
            pattern = _pattern(int(s), took, capacity)
            if capacity - sum(k * n for k, n in pattern.items()) > WASTE:
                continue
            amount = min(min(left[k] / n for k, n in pattern.items()), max(1.0, before[s] / 4))
            if amount >= 1:
                key = tuple(sorted(pattern.items()))
                amounts[key] = amounts.get(key, 0.0) + amount
                for k, n in pattern.items():
                    left[k] -= amount * n
        done = np.ones(len(counts))
        done[counts > 0] = 1 - left[counts > 0] / counts[counts > 0]
        if np.array_equal(left, before):
            break
        weight *= np.where(done < np.median(done[counts > 0]), 1 + RATE, 1.0)
        weight /= weight.min()
    return [(dict(k), a) for k, a in amounts.items()]


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best-fit decreasing on a histogram: the longest piece first, then the longest that still fits."""
    left, out = left.copy(), []
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        while room:
            fit = np.flatnonzero((left - pattern)[: room + 1] > 0)
            if not len(fit):
                break
            s = int(fit[-1])
            n = int(min(room // s, left[s] - pattern[s]))
            pattern[s] += n
            room -= n * s
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left -= times * pattern
        out.append((pattern, times))
    return out


def plan(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """``(length, first rank, copies, first sequence, offset)`` intervals in rank order, and the number of sequences."""
    left = counts.copy()
    chosen = [(np.bincount([capacity], minlength=capacity + 1), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    for parts, amount in fractional(left, capacity, rounds):
        pattern = np.bincount(list(parts), list(parts.values()), capacity + 1).astype(np.int64)
        times = int(amount)
        left -= times * pattern
        chosen.append((pattern, times))
    chosen += best_fit(left, capacity)
    rank, sequence, rows = np.zeros(capacity + 1, np.int64), 0, []
    for pattern, times in chosen:
        offset = 0
        for s in np.flatnonzero(pattern):
            rows.append((int(s), int(rank[s]), int(pattern[s]), sequence, offset))
            rank[s] += times * pattern[s]
            offset += int(s * pattern[s])
        sequence += times
    return sorted(rows), sequence


def _place(rows: list[tuple[int, int, int, int, int]]):
    """Sequence and offset of the piece of a given length and rank."""
    table = np.array(rows, np.int64).reshape(-1, 5)

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(), rank.to_numpy()
        row = np.zeros(len(n), np.int64)
        for s in np.unique(n):
            at = np.flatnonzero(n == s)
            lo, hi = np.searchsorted(table[:, 0], [s, s + 1])
            row[at] = lo + np.searchsorted(table[lo:hi, 1], r[at], "right") - 1
        _, first, copies, sequence, offset = table[row].T
        t = r - first
        return pa.StructArray.from_arrays([pa.array(sequence + t // copies), pa.array(offset + t % copies * n)], ["sequence_id", "offset"])

    return place


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = END_ID,
    keep_ids: bool = False,
    stages: Stages | None = None,
) -> DataFrame:
    """One row a piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    ``tokenizer_path`` names a ``tokenizers`` file that every worker can read.
    """
    stages = stages or Stages(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("piece", T.IntegerType())])
    for name in ("start", "length", "ids_crc32", "part", "rank"):
        schema = schema.add(name, T.LongType())
    if keep_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = stages.save(source.mapInArrow(_tokenize(tokenizer_path, capacity, end_id, keep_ids), schema))
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stages.save(by_task.select("part", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    rows, _ = plan(counts, capacity)
    ranked = attach(pieces, offsets.drop("n"), ["part", "length"], "inner", 32)
    placed = ranked.withColumn("at", _place(rows)("length", F.col("rank") + F.col("ahead")))
    named = placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] * keep_ids))
    return named
