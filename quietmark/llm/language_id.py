"""Language identification by the nearest of several centroids a language.

A text is the vector of its hashed byte n-grams (1 to 3 bytes; ASCII letters
lower-cased, other ASCII taken as blanks), weighted ``log(1 + tf) * idf`` and
normalised.  The IDF counts every learning document.  A bounded sample of
``SAMPLE`` documents a language, drawn at random, is clustered by spherical
k-means into ``CENTROIDS`` centroids a language; languages are clustered apart,
one bounded group each.  A text gets the language of the centroid with the
largest cosine.  It is marked rejected when that cosine is lower than that of all
but ``REJECT`` of the centroid's own sample: such texts are far from all that was
learned.  The score compares the best cosine with those of the other languages.

Null text, or a text without a letter: ``und``, score 0, rejected.  With no
learning documents every text is ``und``.  Rows are judged one by one, so
repeated rows get equal answers; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietmark.llm.common import packed, unpacked
from quietmark.llm.words import byte_set, groups, text_bytes

DIM = 2048
ORDERS = 3
SAMPLE = 500
CENTROIDS = 4
ROUNDS = 10
REJECT = 0.01
SHARPNESS = 20.0
SEED = 7

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_FOLD[byte_set((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))] = 0x20


def gram_counts(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``texts x DIM`` counts of hashed n-grams; grams do not cross texts."""
    b = _FOLD[buf[int(at[0]) : int(at[-1])]].astype(np.uint32)
    ends = at - at[0]
    out = np.zeros((len(at) - 1, DIM), np.float32)
    code = np.zeros(len(b), np.uint32)
    for n in range(1, ORDERS + 1):
        code = b if n == 1 else code[:-1] * np.uint32(257) + b[n - 1 :]
        bucket = ((code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(21)).astype(np.int64)
        for t in range(len(out)):
            own = bucket[ends[t] : max(ends[t], ends[t + 1] - n + 1)]
            out[t] += np.bincount(own, minlength=DIM)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


class Model(NamedTuple):
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # cosine under which a text is rejected


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        buf, at = text_bytes(batch.column(0))
        for lo, hi in groups(at):
            total += (gram_counts(buf, at[lo : hi + 1]) > 0).sum(axis=0)
        n += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.append(n, total))], names=["bucket", "n"])


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, at = text_bytes(batch.column(1))
            rows = [packed(v, np.float32) for lo, hi in groups(at) for v in vectors(gram_counts(buf, at[lo : hi + 1]), idf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "v"])

    return run


def cluster(v: np.ndarray, k: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from mutually far starts; the centroids and each one's rejection floor."""
    starts = [int((v @ v.mean(axis=0)).argmax())]
    while len(starts) < min(k, len(v)):
        starts.append(int((v @ v[starts].T).max(axis=1).argmin()))
    c = v[starts]
    for _ in range(ROUNDS):
        own = (v @ c.T).argmax(axis=1)
        sums = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    sim = v @ c.T
    own, best = sim.argmax(axis=1), sim.max(axis=1)
    floors = np.array([np.quantile(best[own == i], REJECT) if (own == i).any() else 1.0 for i in range(len(c))])
    return c.astype(np.float32), floors


def _cluster(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    rows = np.stack([unpacked(x, np.float32) for x in sorted(table["v"].to_pylist())])
    c, floors = cluster(rows)
    return pa.table({"lang": [key[0].as_py()] * len(c), "v": pa.array([packed(x, np.float32) for x in c], pa.binary()), "floor": pa.array(floors.astype(float))})


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row of ``docs`` with a text and a language.

    To the driver come the document frequencies (``DIM`` numbers) and the
    centroids (``CENTROIDS`` a language).
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = known.select("text").mapInArrow(_document_frequency, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIM + 1)
    for r in counted:
        df[r["bucket"] + 1] = r["n"]
    idf = np.log((1 + df[0]) / (1 + df[1:])).astype(np.float32) + np.float32(1)
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(idf, [], np.zeros((0, DIM), np.float32), np.zeros(0))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, SAMPLE / n))))
    sample = known.where(F.rand(SEED) < F.try_element_at(share, F.col("lang"))).mapInArrow(_vectors(idf), "lang string, v binary")
    rows = sample.groupBy("lang").applyInArrow(_cluster, "lang string, v binary, floor double").collect()
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["v"])))
    return Model(idf, [r["lang"] for r in rows], np.stack([unpacked(r["v"], np.float32) for r in rows]), np.array([r["floor"] for r in rows]))


RESULT = "struct<lang:string,score:double,cosine:double,rejected:boolean>"


def identify(text: Column, model: Model) -> Column:
    langs = sorted(set(model.langs))
    of = [np.flatnonzero([x == lang for x in model.langs]) for lang in langs]

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        buf, at = text_bytes(texts)
        n = len(texts)
        lang, score, cosine, rejected = [None] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        letter = np.array([any(map(str.isalpha, t.as_py() or "")) for t in texts], bool)
        for lo, hi in groups(at) if langs else ():
            sim = vectors(gram_counts(buf, at[lo : hi + 1]), model.idf) @ model.centroids.T
            best = np.stack([sim[:, c].max(axis=1) for c in of], axis=1).astype(float)
            pick, near = best.argmax(axis=1), sim.argmax(axis=1)
            odds = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
            score[lo:hi] = odds.max(axis=1) / odds.sum(axis=1)
            cosine[lo:hi] = np.clip(best.max(axis=1), 0, 1)
            rejected[lo:hi] = best.max(axis=1) < model.floors[near]
            lang[lo:hi] = [langs[p] for p in pick]
        final = [x if ok and x is not None else "und" for x, ok in zip(lang, letter)]
        known = np.array([x != "und" or (ok and "und" in langs) for x, ok in zip(final, letter)], bool)
        arrays = [pa.array(final, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(np.where(known, cosine, 0.0)), pa.array(rejected | ~known)]
        return pa.StructArray.from_arrays(arrays, ["lang", "score", "cosine", "rejected"])

    return predict(text)
