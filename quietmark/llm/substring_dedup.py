"""Substring dedup: passages that an earlier document already holds are removed.

Level-wise doubling.  The first level looks at windows of ``base`` words, but
only at one in about ``base / 2`` of them: the window with the smallest hash
among those inside each longer window (a choice that depends on the words alone,
so equal passages choose equal windows).  Windows that occur once are done.
Only where a short window is repeated, the windows of twice that length
(clipped to ``window``) are looked at, and so on, until ``window`` is reached
or no candidate is left; the last level also finds each window's smallest id.

One level is two shuffles of packed arrays: every input batch sends each distinct
window once to the shard of its hash (copies within a batch are settled there,
so a passage in a third of all documents is one entry a batch), and the shards
send the repeated places back to the batch.  Texts are not moved unless the list
of places is too large to broadcast.  A shard holds what about 8 MB of text
produce, and one entry a batch for each very common window.

Null text: no words.  Null id, or one that is no long: the row neither owns nor loses a passage.  Rows
that share an id are one document: none of them loses words to the other.  An
empty table gives an empty result.  Other columns are passed through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.llm.common import Stages, attach, fresh, give_back_memory, giving_back, packed, row_tag, shard_count, unpacked
from quietmark.llm.words import Words, groups, pieces, rolling, slide, text_bytes

SENT = "shard int, batch long, k1 binary, k2 binary, id binary, row binary, pos binary, len binary, heads binary, known binary"
REPLY = "batch long, places binary, heads binary"
RUNS = "id long, tag long, runs array<int>"
BASE = 7
BATCH_BYTES = 12 << 20
#: Text whose windows one shard gets.
SHARD_BYTES = 8 << 20


def levels(window: int, base: int = BASE) -> list[int]:
    """Window lengths after the first, sampled level: doubled and clipped to ``window``."""
    base = min(base, (window + 1) // 2)
    out = [min(window, 2 * base - 1)]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


def _sampled(words: Words, base: int, length: int):
    """Runs of ``length``-word windows that choose the same short window: (key, text, place, count)."""
    chosen = slide(words.windows(base), length - base + 1, np.minimum)
    at = np.flatnonzero(words.left()[: len(chosen)] >= length)
    key, text = chosen[at], np.repeat(np.arange(len(words.counts)), words.counts)[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    return key[first], key[first], text[first], at[first] - words.first[text[first]], count


def _whole(words: Words, runs: list[np.ndarray], before: int, length: int):
    """Windows of ``length`` words whose first and last ``before`` words are both repeated."""
    keep = np.zeros(len(words.hash) + 1, bool)
    for text, r in enumerate(runs):
        first = words.first[text]
        for s, e in r.reshape(-1, 2):
            keep[first + s : first + e] = True
    keep = keep[:-1]
    if step := length - before:
        later = np.zeros(len(keep), bool)
        later[: max(len(keep) - step, 0)] = keep[step:]
        keep &= later
    at = np.flatnonzero(keep & (words.left() >= length))
    text = np.repeat(np.arange(len(words.counts)), words.counts)[at]
    k1, k2 = rolling(words.hash, length, 0)[at], rolling(words.hash, length, 1)[at]
    return k1, k2, text, at - words.first[text], np.ones(len(at), np.int64)


def _spans(k1: np.ndarray, k2: np.ndarray):
    """Order by key, and the first place of each key in that order."""
    order = np.lexsort((k2, k1))
    a, b = k1[order], k2[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def _repeated(k1, k2, ids, last: bool):
    """Entries that are repeated elsewhere (``last``: in a text with a smaller id), and one entry for each key with such."""
    if not len(k1):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    order, first = _spans(k1, k2)
    size = np.diff(np.append(first, len(order)))
    found = np.zeros(len(order), bool)
    if last:
        least = np.minimum.reduceat(ids[order], first)
        found[order] = ids[order] > np.repeat(least, size)
    else:
        found[order] = np.repeat(size, size) > 1
    return found, order[first[size > 1]]


def _send(shards: int, base: int, before: int, length: int, last: bool):
    """Maps batches of (id, tag, text[, runs]) to packed entries by shard."""

    def entries(batch: pa.RecordBatch):
        buf, at = text_bytes(batch.column(2))
        runs = batch.column(3) if batch.num_columns > 3 else None
        parts = []
        for lo, hi in groups(at):
            words = Words(buf, at[lo : hi + 1])
            if runs is None:
                k1, k2, text, pos, n = _sampled(words, base, length)
            else:
                some = runs.slice(lo, hi - lo)
                flat, cut = some.flatten().to_numpy(), np.concatenate([[0], np.cumsum(some.value_lengths().to_numpy())])
                k1, k2, text, pos, n = _whole(words, [flat[a:b] for a, b in zip(cut, cut[1:])], before, length)
            parts.append((k1, k2, text + lo, pos, n))
        return [np.concatenate(x) for x in zip(*parts)]

    def sent(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        key = (TaskContext.get().partitionId() << 32) + number
        k1, k2, row, pos, n = entries(batch)
        own = batch.column(0).to_numpy()
        ids = own[row]
        known, announced = _repeated(k1, k2, ids, last)
        place = np.stack([row, pos, n], 1).astype(np.int32)
        open_ = np.flatnonzero(~known)
        row = row.astype(np.int32)
        if not last:  # a key that is settled here is still told to the others, once
            row = row.copy()
            row[announced] = -1
            open_ = np.concatenate([open_, announced])
        shard = (k1[open_] >> np.uint64(20)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        mine = key % shards
        out = {f: [] for f in ("shard", "batch", "k1", "k2", "id", "row", "pos", "len", "heads", "known")}
        for s in range(shards):
            e = open_[order[cuts[s] : cuts[s + 1]]]
            if not len(e) and s != mine:
                continue
            heads = packed(np.stack([own, batch.column(1).to_numpy()]), np.int64) if s == mine else b""
            told = packed(place[known], np.int32) if s == mine else b""
            row_ = (s, key, packed(k1[e], np.uint64), b"" if not last else packed(k2[e], np.uint64), packed(ids[e], np.int64) if last else b"",
                    packed(row[e], np.int32), packed(pos[e], np.int32), packed(n[e], np.int32), heads, told)
            for f, v in zip(out, row_):
                out[f].append(v)
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 8
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(pieces(batches, 2, BATCH_BYTES)):
            yield sent(number, batch)

    return run


def _settle(last: bool):
    """Finds the repeated entries of one shard; answers by batch."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        flat = lambda f, kind: np.concatenate([np.zeros(0, kind), *(unpacked(v.as_py(), kind) for b in held for v in b.column(f))])
        k1 = flat("k1", np.uint64)
        found, _ = _repeated(k1, flat("k2", np.uint64) if last else k1, flat("id", np.int64), last)
        del k1
        at = 0
        for piece in held:  # answers leave as they are made
            col = {f: piece.column(f) for f in ("batch", "row", "pos", "len", "heads", "known")}
            out: dict[str, list] = {"batch": [], "places": [], "heads": []}
            for i in range(piece.num_rows):
                row, pos, n = (unpacked(col[f][i].as_py(), np.int32) for f in ("row", "pos", "len"))
                hit = found[at : at + len(row)] & (row >= 0)
                at += len(row)
                places = packed(np.stack([row[hit], pos[hit], n[hit]], 1), np.int32) + col["known"][i].as_py()
                heads = col["heads"][i].as_py()
                if places or heads:
                    for f, v in zip(out, (col["batch"][i].as_py(), places, heads)):
                        out[f].append(v)
            kinds = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Places of one batch as runs of window starts ``[s0, e0, s1, e1, ...]`` by text."""
    heads = unpacked(b"".join(table["heads"].to_pylist()), np.int64).reshape(2, -1)
    p = unpacked(b"".join(table["places"].to_pylist()), np.int32).reshape(-1, 3).astype(np.int64)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    start, end = (p[:, 0] << 32) + p[:, 1], (p[:, 0] << 32) + p[:, 1] + p[:, 2]
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.ones(len(p), bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    s, e = start[first], reach[np.append(first[1:], len(p)) - 1] if len(p) else reach
    rows = s >> 32
    text, cut = np.unique(rows, return_index=True)
    flat = (np.stack([s, e], 1) & 0xFFFFFFFF).reshape(-1).astype(np.int32)
    offsets = np.append(cut, len(rows)).astype(np.int32) * 2
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
    return pa.table({"id": pa.array(heads[0][text]), "tag": pa.array(heads[1][text]), "runs": runs})


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, stages: Stages | None = None) -> DataFrame:
    """``id, tag, runs``: where windows start that also start in a document with a smaller id.

    ``tag`` is ``row_tag(text)``; ``runs`` holds word numbers ``[s0, e0, s1, e1, ...]``, half open.
    Documents without such a window have no row.  Rows that are wholly equal give equal rows once.
    """
    stages = stages or Stages(docs.sparkSession)
    shards = shard_count(docs, text_col, SHARD_BYTES)
    base = min(BASE, (window + 1) // 2)
    source = docs.where(F.col(id_col).try_cast("long").isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).try_cast("long").alias("id"), row_tag(F.col(text_col)).alias("tag"), F.col(text_col).alias("text")
    )
    found, before = None, None
    lengths = [None, *levels(window, base)]
    for level, length in enumerate(lengths):
        last = level == len(lengths) - 1
        rows = source
        if found is not None:
            rows = attach(source, found, ["id", "tag"], "inner", 24 + 4 * F.size("runs"))
        step = _send(shards, base, before or 0, length or lengths[1], last)
        sent = rows.mapInArrow(step, SENT)
        told = sent.groupBy("shard").applyInArrow(_settle(last), REPLY).groupBy("batch").applyInArrow(_merge, RUNS)
        earlier, found = found, stages.save(told.dropDuplicates(["id", "tag"]))
        before = length or lengths[1]
        if earlier is not None:
            stages.drop(earlier)
        if found.isEmpty():
            break
    return found


REMOVED = "struct<n_words:long,n_removed:long,kept_text:string,kept_sha256:string>"


def removal(text: Column, runs: Column, window: int = 13) -> Column:
    """Words, removed words, what is kept (joined by one space) and its digest."""

    def kept_of(texts: pa.Array, spans: pa.Array) -> pa.Array:
        n_words, n_removed, kept, digest = [], [], [], []
        for t, r in zip(texts.cast(pa.binary()), spans):
            raw, r = t.as_py(), r.as_py()
            words = raw.split() if raw else []
            keep, at, removed = [], 0, 0
            for s, e in zip(r[::2], r[1::2]) if r else ():
                end = e + window - 1
                keep += words[at:s]
                removed += end - max(s, at)
                at = end
            keep += words[at:]
            out = b" ".join(keep)
            n_words.append(len(words))
            n_removed.append(removed)
            kept.append(out)
            digest.append(hashlib.sha256(out).hexdigest())
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
            ["n_words", "n_removed", "kept_text", "kept_sha256"],
        )

    @F.arrow_udf(REMOVED)
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = kept_of(texts, spans)
        give_back_memory()
        return out

    return cut(text, runs)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, stages: Stages | None = None) -> DataFrame:
    """``docs`` with one more column ``dedup``: see ``removal``.

    A document loses every word that lies in a window of ``window`` words which
    also starts in a document with a smaller id.  An input column named ``dedup``
    is replaced.
    """
    stages = stages or Stages(docs.sparkSession)
    runs = repeated_runs(docs, id_col, text_col, window, stages)
    key, tag, spans = fresh("id"), fresh("tag"), fresh("runs")
    runs = runs.select(F.col("id").alias(key), F.col("tag").alias(tag), F.col("runs").alias(spans))
    keyed = docs.withColumn(key, F.col(id_col).try_cast("long")).withColumn(tag, row_tag(F.col(text_col)))
    joined = attach(keyed, runs, [key, tag], "left", 24 + 4 * F.size(spans))
    return joined.withColumn("dedup", removal(F.col(text_col), F.col(spans), window)).drop(key, tag, spans)
