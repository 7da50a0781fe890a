"""Alignment of two tokenizers over a corpus, with a same-bytes fast path.

Both tokenizers cut the same bytes (a blank and the text).  Places where a token
of A and a token of B both end cut them into groups; every A token of a group is
linked with every B token of it.  A pair's count is the number of documents that
hold it linked.

A group of one token each covers equal bytes, so its pair follows from its A id
alone: ``same_bytes[a]`` is the B id that spells the same.  Such links are kept as
A ids and counted in one vector of the length of A's vocabulary a task.  Only the
pairs of the other groups are written out, summed up within a batch, and
shuffled by pair.  (A pair of two same-bytes ids from an irregular group joins the
vector, so that a document is counted once.)

Counts come back in two ways.  What is bounded by the vocabulary (each A id's
highest count, the counts of same-bytes pairs) and the ``HOT`` most frequent other
pairs goes to every task; links of rarer pairs, none of which can be hot, are
joined with their counts by pair and summed up by document.

Null or empty texts, and texts that either tokenizer does not give back byte for
byte, have no tokens: zeros, and no groups.  Every row is a document of its own,
repeated rows and null ids included; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

from quietmark.llm.common import Stages, fresh
from quietmark.llm.encoding import _byte_letters as byte_letters

#: Pairs whose counts go to every task: 16 bytes each.
HOT = 1 << 17
#: Bytes of text, and pairs of irregular groups, that are handled at a time.
GROUP_BYTES = 1 << 20
PAIRS_AT_ONCE = 1 << 20
MEMO_ENTRIES = 600_000
#: A pair's key is the A id shifted by these bits, plus the B id.
BITS = 20
MARK = "▁"
NO_IDS = np.zeros(0, np.int64)


class ByteLevel:
    """A: a byte-level BPE file; ids of a blank and a text, in which strings of special tokens are plain text.

    The file's merges must be in the order of the ids that they make, so that ids serve as ranks.
    """

    #: Fixed value: how a byte-level BPE cuts a text into units.
    UNITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        code = {letter: byte for byte, letter in byte_letters().items()}
        spell = lambda entry: bytes(code[c] for c in entry)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        special = {t["id"]: t["content"].encode() for t in file["added_tokens"]}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if file["normalizer"] is not None or made != sorted(made):
            raise ValueError(f"{path} changes texts, or merges out of order")
        ranks = {spell(entry): i for entry, i in vocab.items() if i not in special}
        self._model = tiktoken.Encoding("a", pat_str=self.UNITS, mergeable_ranks=ranks, special_tokens={})
        self.spelled = [b""] * (1 + max(*ranks.values(), *special))
        for spelled, i in (*ranks.items(), *((s, i) for i, s in special.items())):
            self.spelled[i] = spelled

    def all(self, texts: list[str | None]) -> list[bytes]:
        encode = self._model.encode_ordinary
        return [array("I", encode(" " + t)).tobytes() if t else b"" for t in texts]


class Pieces:
    """B: a sentencepiece file; ids of a text, which begins with a blank of its own.

    No piece holds a blank after another character, so a text falls into
    independent parts before every stretch of blanks; parts are memoised, and
    the unseen ones of many texts are encoded together.
    """

    _PART = re.compile(r"(?<=[^ ]) ")

    def __init__(self, path: str):
        self._model = SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.spelled = [self._spell(i, p) for i, p in enumerate(pieces)]
        self._blank = self._model.piece_to_id(MARK)
        self._whole = any(MARK in p.lstrip(MARK) for p in pieces)
        self._memo: dict[str, bytes | None] = {}

    def _spell(self, i: int, piece: str) -> bytes:
        if self._model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self._model.is_control(i) or self._model.is_unknown(i) else piece.replace(MARK, " ").encode()

    def _parts(self, text: str) -> list[str]:
        if self._whole:
            return [text]
        parts = text.split(" ")
        return self._PART.split(text) if "" in parts else parts

    def _learn(self, parts: list[str]) -> None:
        """Ids of a blank and each part; None where they do not spell it."""
        for part, ids in zip(parts, self._model.encode(parts, num_threads=1)):
            ids = ids or [self._blank]  # the model gives an empty text no blank
            spelled = b"".join([self.spelled[i] for i in ids])
            self._memo[part] = array("I", ids).tobytes() if spelled == b" " + part.encode() else None

    def all(self, texts: list[str | None]) -> list[bytes | None]:
        cut = [self._parts(t) if t else [] for t in texts]
        unseen = {p for parts in cut for p in parts if p not in self._memo}
        if len(self._memo) + len(unseen) > MEMO_ENTRIES:
            self._memo.clear()
            unseen = {p for parts in cut for p in parts}
        if unseen:
            self._learn(list(unseen))
        memo, out = self._memo, []
        for parts in cut:
            ids = [memo[p] for p in parts]
            out.append(None if None in ids else b"".join(ids))
        return out


class Vocabularies:
    """Both tokenizers of a worker, byte lengths of their tokens, and the same-bytes B id of every A id (-1: none)."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_bytes = np.array([len(s) for s in self.a.spelled], np.int64)
        self.b_bytes = np.array([len(s) for s in self.b.spelled], np.int64)
        by_bytes: dict[bytes, int] = {}
        for i, s in enumerate(self.b.spelled):
            if s:
                by_bytes[s] = i  # byte pieces come first, so an ordinary piece of one byte wins
        self.same_bytes = np.array([by_bytes.get(s, -1) if s else -1 for s in self.a.spelled], np.int64)
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << BITS:
            raise ValueError(f"more than {1 << BITS} ids")
        # Decimal ids with the mark that may follow them in a line of groups.
        self._written = {mark: [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))] for mark in ",|;"}

    def line(self, ids: list[int], marks: str) -> str:
        """``a1,a2|b1;a3|b2``: every id with its mark, the last one's taken off."""
        w = self._written
        return "".join([w[m][i] for i, m in zip(ids, marks)])[:-1]


_KNOWN: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    """Both vocabularies, once a worker process."""
    if (a_path, b_path) not in _KNOWN:
        _KNOWN[a_path, b_path] = Vocabularies(a_path, b_path)
    return _KNOWN[a_path, b_path]


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, with the sum of its ``times``."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(times, first)


def _crossed(doc: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], ids: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``document << 2 * BITS | pair`` and occurrences of all links of some groups; ``a`` and ``b`` are first token and number."""
    (a0, m), (b0, n) = a, b
    found, times = [NO_IDS], [NO_IDS]
    size = m * n
    large = size > PAIRS_AT_ONCE
    for g in np.flatnonzero(large):  # one group of very many links: by distinct ids
        x, xs = np.unique(ids[0][a0[g] : a0[g] + m[g]], return_counts=True)
        y, ys = np.unique(ids[1][b0[g] : b0[g] + n[g]], return_counts=True)
        for i in range(len(x)):
            found.append(doc[g] << 2 * BITS | x[i] << BITS | y)
            times.append(xs[i] * ys)
    rest = np.flatnonzero(~large)
    total = np.cumsum(size[rest])
    lo = 0
    while lo < len(rest):
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + PAIRS_AT_ONCE, "right")))
        own = rest[lo:hi]
        group = np.repeat(own, size[own])
        at = np.arange(len(group)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        x = ids[0][a0[group] + at // n[group]]
        y = ids[1][b0[group] + at % n[group]]
        k, t = np.unique(doc[group] << 2 * BITS | x << BITS | y, return_counts=True)
        found.append(k)
        times.append(t)
        lo = hi
    return summed(np.concatenate(found), np.concatenate(times))


def _lists(keys: np.ndarray, times: np.ndarray, shift: int, docs: int) -> tuple[pa.Array, pa.Array]:
    """Sorted ``document << shift | value`` as a list of values and one of times a document."""
    at = np.searchsorted(keys, np.arange(docs + 1, dtype=np.int64) << shift).astype(np.int32)
    values = keys & ((1 << shift) - 1)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values)), pa.ListArray.from_arrays(pa.array(at), pa.array(times.astype(np.int64)))


def links(texts: list[str | None], vocab: Vocabularies, keep_groups: bool = False) -> dict[str, pa.Array]:
    """Token, group and link numbers of some texts, their linked pairs, and the line of their groups (or its digest)."""
    cut = list(zip(vocab.a.all(texts), vocab.b.all(texts)))
    for i, (a, b) in enumerate(cut):
        if a and (not b or vocab.a_bytes[np.frombuffer(a, np.uint32)].sum() != len(texts[i].encode()) + 1):
            cut[i] = (b"", b"")
    docs = len(texts)
    ids, doc, end = [], [], []
    for side, lengths in ((0, vocab.a_bytes), (1, vocab.b_bytes)):
        own = np.frombuffer(b"".join([c[side] if c[1] else b"" for c in cut]), np.uint32).astype(np.int64)
        ids.append(own)
        doc.append(np.repeat(np.arange(docs), [len(c[side]) // 4 if c[1] else 0 for c in cut]))
        end.append(np.cumsum(lengths[own]))
    near = np.searchsorted(end[1], end[0])
    both = end[1][near] == end[0] if len(near) else np.zeros(0, bool)
    closes = (both, np.zeros(len(ids[1]), bool))
    closes[1][near[both]] = True
    first, number = [], []
    for c in closes:
        last = np.flatnonzero(c)
        first.append(np.concatenate([[0], last[:-1] + 1]).astype(np.int64) if len(last) else NO_IDS)
        number.append(last + 1 - first[-1])
    owner = doc[0][first[0]]
    size = number[0] * number[1]
    count = lambda values, weights=None: pa.array(np.bincount(values, weights, docs).astype(np.int64))

    exact = (number[0] == 1) & (number[1] == 1) & (vocab.same_bytes[ids[0][first[0]]] == ids[1][first[1]])
    same, same_times = np.unique(owner[exact] << BITS | ids[0][first[0][exact]], return_counts=True)
    odd = ~exact
    pairs, times = _crossed(owner[odd], [first[0][odd], number[0][odd]], [first[1][odd], number[1][odd]], ids)
    also = vocab.same_bytes[pairs >> BITS & ((1 << BITS) - 1)] == pairs & ((1 << BITS) - 1)
    same, same_times = summed(np.concatenate([same, pairs[also] >> BITS]), np.concatenate([same_times, times[also]]))
    pairs, times = pairs[~also], times[~also]

    # Tokens in the order of the line: a group's A tokens, then its B tokens; the mark after each.
    group = [np.cumsum(c) - c for c in closes]
    order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    marks = np.empty(len(order), "S1")
    until = np.concatenate([[0], np.cumsum(number[1])])
    place_a = np.arange(len(ids[0])) + until[group[0]]
    place_b = np.arange(len(ids[1])) + np.cumsum(number[0])[group[1]] if len(ids[1]) else NO_IDS
    order[place_a], order[place_b] = ids[0], ids[1]
    marks[place_a], marks[place_b] = np.where(closes[0], b"|", b","), np.where(closes[1], b";", b",")
    tokens = [np.bincount(d, minlength=docs) for d in doc]
    at = np.concatenate([[0], np.cumsum(tokens[0] + tokens[1])])
    order, marks = order.tolist(), marks.tobytes().decode()
    lines = [vocab.line(order[lo:hi], marks[lo:hi]) for lo, hi in zip(at, at[1:])]
    if not keep_groups:
        lines = [line and hashlib.sha256(line.encode()).hexdigest() for line in lines]

    out = {"n_a": pa.array(tokens[0]), "n_b": pa.array(tokens[1]), "n_groups": count(owner), "n_links": count(owner, size)}
    out["groups" if keep_groups else "groups_sha256"] = pa.array(lines, pa.string())
    out["same"], out["same_times"] = _lists(same, same_times, BITS, docs)
    out["pairs"], out["pair_times"] = _lists(pairs, times, 2 * BITS, docs)
    return out


def _tokens(a_path: str, b_path: str, keep_groups: bool):
    """(text, other columns...) to the other columns, a row number, and what ``links`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, row = vocabularies(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                texts, size = [], 0
                while lo + len(texts) < batch.num_rows and size < GROUP_BYTES:
                    texts.append(batch.column(0)[lo + len(texts)].as_py())
                    size += len(texts[-1] or "")
                n = len(texts)
                found = links(texts, vocab, keep_groups)
                others = {name: batch.column(i).slice(lo, n) for i, name in enumerate(batch.schema.names) if i}
                rows = pa.array(np.arange(row, row + n))
                yield pa.RecordBatch.from_pydict({**others, "row": rows, **found})
                lo, row = lo + n, row + n

    return run


def _count(a_path: str, b_path: str):
    """(same, pairs) to documents a pair: a vector over A's ids for same-bytes pairs, sums a batch for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabularies(a_path, b_path)
        vector = np.zeros(len(vocab.a_bytes), np.int64)
        names = ["a", "b", "n", "same"]
        for batch in batches:
            vector += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=len(vector))
            keys, n = np.unique(batch.column(1).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            columns = [keys >> BITS, keys & ((1 << BITS) - 1), n, np.zeros(len(keys), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)
        a = np.flatnonzero(vector)
        columns = [a, vocab.same_bytes[a], vector[a], np.ones(len(a), bool)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run


def _known(shared):
    """Sums over the links whose counts every task has, and the others as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same_n, best, hot, hot_n = shared.value
        for batch in batches:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            docs = batch.num_rows
            sums = np.zeros((2, docs), np.int64)
            cold = {}
            for ids, times in (("same", "same_times"), ("pairs", "pair_times")):
                lists = columns.pop(ids)
                keys = lists.flatten().to_numpy(zero_copy_only=False)
                t = columns.pop(times).flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(docs), np.diff(lists.offsets.to_numpy()))
                if ids == "same":
                    a, n = keys, same_n[keys]
                else:
                    at = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
                    have = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
                    rest = doc[~have] << 2 * BITS | keys[~have]
                    cold["cold"], cold["cold_times"] = _lists(rest, t[~have], 2 * BITS, docs)
                    keys, t, doc, n = keys[have], t[have], doc[have], hot_n[at[have]] if len(hot) else NO_IDS
                    a = keys >> BITS
                np.add.at(sums[0], doc, t * n)
                np.add.at(sums[1], doc, t * (n == best[a]))
            yield pa.RecordBatch.from_pydict({**columns, "count_sum": pa.array(sums[0]), "n_best": pa.array(sums[1]), **cold})

    return run


def pair_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a, b, n, same``: how many documents hold each pair linked."""
    counted = tokens.select("same", "pairs").mapInArrow(_count(a_path, b_path), "a long, b long, n long, same boolean")
    return counted.groupBy("a", "b", "same").agg(F.sum("n").alias("n"))


def align(
    docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", keep: list[str] | None = None, keep_groups: bool = False, hot: int = HOT, stages: Stages | None = None
) -> DataFrame:
    """The columns ``keep`` (default: all but the text) of every row, and its alignment.

    New are ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups_sha256`` (or
    ``groups``, with ``keep_groups``); input columns of these or working names are
    replaced.  ``n_best`` counts links whose pair no other pair of its A id exceeds.
    """
    spark = docs.sparkSession
    stages = stages or Stages(spark)
    line = "groups" if keep_groups else "groups_sha256"
    numbers = [T.StructField(c, T.LongType()) for c in ("row", "n_a", "n_b", "n_groups", "n_links")]
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("same", "same_times", "pairs", "pair_times")]
    own = [*numbers, T.StructField(line, T.StringType()), *lists]
    taken = {f.name for f in own} | {"count_sum", "n_best", "cold", "cold_times"}
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col and c not in taken]
    source = docs.select(F.col(text_col).alias(fresh("text")), *(F.col(f"`{c}`") for c in keep))
    tokens = stages.save(source.mapInArrow(_tokens(a_path, b_path, keep_groups), T.StructType([*(docs.schema[c] for c in keep), *own])))

    counts = stages.save(pair_counts(tokens, a_path, b_path))
    best = stages.save(counts.groupBy("a").agg(F.max("n").alias("best")))
    vocab = vocabularies(a_path, b_path)
    same_n, highest = np.zeros(len(vocab.a_bytes), np.int64), np.zeros(len(vocab.a_bytes), np.int64)
    for vector, table in ((same_n, counts.where("same").select("a", "n")), (highest, best)):  # no longer than A's vocabulary
        a, n = (c.to_numpy() for c in table.toArrow().columns)
        vector[a] = n
    others = counts.where("not same").select((F.shiftleft("a", BITS) + F.col("b")).alias("key"), "a", "n")
    most = others.select("key", "n").orderBy(F.desc("n"), "key").limit(hot).toArrow() if hot else pa.table({"key": NO_IDS, "n": NO_IDS})
    keys, n = (c.to_numpy() for c in most.columns)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((same_n, highest, keys[order], n[order]))

    result = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", line]
    fields = [f for f in tokens.schema if f.name not in {x.name for x in lists}]
    sums = [T.StructField(c, T.LongType()) for c in ("count_sum", "n_best")]
    rest = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("cold", "cold_times")]
    summed_up = tokens.mapInArrow(_known(shared), T.StructType([*fields, *sums, *rest]))
    out = [*(F.col(f"`{c}`") for c in keep), *result]
    if len(keys) < hot:  # every pair was sent
        return summed_up.select(*out)
    summed_up = stages.save(summed_up)
    cold = summed_up.select("row", F.explode(F.arrays_zip("cold", "cold_times")).alias("c")).select("row", F.col("c.cold").alias("key"), F.col("c.cold_times").alias("t"))
    found = cold.join(others, "key").join(F.broadcast(best), "a")
    more = found.groupBy("row").agg(F.sum(F.col("t") * F.col("n")).alias("s"), F.sum(F.when(F.col("n") == F.col("best"), F.col("t")).otherwise(0)).alias("m"))
    both = summed_up.drop("cold", "cold_times").join(more, "row", "left")
    add = {"count_sum": F.col("count_sum") + F.coalesce("s", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("m", F.lit(0))}
    return both.withColumns(add).select(*out)
