"""Quality classifier by co-training on two views of a document.

The text view are shares and ratios of the whole text (case, digits, marks,
repeated words and word pairs, word and line lengths); the metadata view are the
columns beside it (hashed categories, logarithms of numbers, which are missing).
Each view has a logistic classifier.  In every round each classifier labels the
pool of unlabelled documents and hands its most confident ones, in the labels'
own proportion, to the other as pseudo-labels.  Labelled documents that were held
back calibrate both views, and a logistic curve over the two calibrated log-odds
is the final score: a view that says nothing gets no weight.

The fit uses random samples of at most about ``LABELLED`` labelled and ``POOL``
unlabelled rows (numbers only; features are made by the tasks), whatever the size
of the corpus; every row is scored.  Null or empty text is scored as the features
of an empty text; null metadata is a category of its own.  Labels of one kind
only, or none: every document has that kind's share as score.  Rows are judged
one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietmark.llm.common import give_back_memory, giving_back
from quietmark.llm.words import SPACES, Words, byte_set, groups, rolling, text_bytes

LABELLED = 12_000
POOL = 12_000
ROUNDS = 5
CONFIDENT = 0.02
CATEGORIES = 32
#: Documents with a lower score are rejected; below a half, so that doubt keeps a document.
KEEP_FROM = 0.3
SEED = 5

_UPPER, _LOWER, _DIGIT = byte_set((0x41, 0x5A)), byte_set((0x61, 0x7A)), byte_set((0x30, 0x39))
_STOP = byte_set((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x27, 0x29), (0x22, 0x22))
_MARK = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)) & ~_STOP
TEXT_FEATURES = (
    "log_words", "word_length", "upper", "digit", "stop", "mark", "other_script", "spaces", "line_ends", "distinct_words", "distinct_pairs",
    "same_again", "long_words", "one_byte_words", "marked_words", "upper_words", "most_common_byte", "repeated_lines",
)


def _share(total: np.ndarray, of: np.ndarray) -> np.ndarray:
    return total / np.maximum(of, 1)


def text_features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``texts x features``; an empty text has zeros."""
    b = buf[int(at[0]) : int(at[-1])]
    ends = at - at[0]
    n_bytes = np.diff(ends)
    words = Words(buf, at, SPACES)
    n, n_texts = words.counts, len(ends) - 1
    text = np.repeat(np.arange(n_texts), n)

    def by_byte(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag[b])])
        return total[ends[1:]] - total[ends[:-1]]

    def by_word(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return total[words.first[1:]] - total[words.first[:-1]]

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, of))
        k, o = keys[order], of[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n_texts)

    pair = rolling(words.hash, 2)
    has_next = words.left() >= 2
    again = np.zeros(len(text), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (text[1:] == text[:-1])
    length = words.end - words.start
    tail, head = (b[words.end - 1], b[words.start]) if len(text) else (b[:0], b[:0])
    lines = Words(buf, at, byte_set((0x0A, 0x0A)))
    line_of = np.repeat(np.arange(n_texts), lines.counts)
    common = np.array([np.bincount(b[s:e], minlength=256)[0x21:].max() if e > s else 0 for s, e in zip(ends, ends[1:])])
    columns = [
        np.log1p(n), _share(by_word(length), n), _share(by_byte(_UPPER), n_bytes), _share(by_byte(_DIGIT), n_bytes), _share(by_byte(_STOP), n_bytes),
        _share(by_byte(_MARK), n_bytes), _share(by_byte(byte_set((0x80, 0xFF))), n_bytes), _share(by_byte(SPACES), n_bytes), _share(by_byte(byte_set((0x0A, 0x0A))), n),
        _share(distinct(words.hash, text), n), _share(distinct(pair[has_next], text[has_next]), n), _share(by_word(again), n), _share(by_word(length > 20), n),
        _share(by_word(length == 1), n), _share(by_word(_MARK[tail]), n), _share(by_word(_UPPER[head] & _UPPER[tail] & (length > 1)), n), _share(common, n_bytes),
        1 - _share(distinct(lines.hash, line_of), lines.counts),
    ]
    return np.stack(columns, 1).astype(float)


def _is_category(c: pa.Array) -> bool:
    return pa.types.is_string(c.type) or pa.types.is_large_string(c.type)


def meta_values(columns: Sequence[pa.Array]) -> np.ndarray:
    """The metadata features before categories are spread: a number a category, and for numbers a logarithm and whether it is missing."""
    parts = []
    for c in columns:
        if _is_category(c):
            values = c.to_pylist()
            known: dict = {v: CATEGORIES if v is None else zlib.crc32(v.encode()) % CATEGORIES for v in {*values}}
            parts.append(np.array([known[v] for v in values], float).reshape(-1, 1))
        else:
            x = np.array([np.nan if v is None else float(v) for v in c.to_pylist()], float)
            missing = ~np.isfinite(x)
            x = np.where(missing, 0.0, x)
            parts.append(np.stack([np.sign(x) * np.log1p(np.abs(x)), missing], 1))
    return np.concatenate(parts, 1) if parts else np.zeros((0, 0))


def spread(values: np.ndarray, categories: Sequence[bool]) -> np.ndarray:
    """``meta_values`` with a column for each number that a category may have; ``categories``: which columns of the table are such."""
    out = np.zeros((len(values), sum(CATEGORIES + 1 if c else 2 for c in categories)))
    if not len(values):
        return out
    to = at = 0
    for c in categories:
        if c:
            out[np.arange(len(values)), to + values[:, at].astype(int)] = 1
            to, at = to + CATEGORIES + 1, at + 1
        else:
            out[:, to : to + 2] = values[:, at : at + 2]
            to, at = to + 2, at + 2
    return out


def meta_features(columns: Sequence[pa.Array]) -> np.ndarray:
    """Hashed one-hot categories, and for numbers a logarithm and whether it is missing."""
    return spread(meta_values(columns), [_is_category(c) for c in columns]) if columns else np.zeros((0, 0))


class View(NamedTuple):
    """A logistic classifier over standardised features and their squares, and its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _design(x, self.mean, self.scale) @ self.weights

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.offset


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    n, k = x.shape
    out = np.ones((n, 2 * k + 1))  # filled in place: the driver holds one table of this size, not five
    z, squares = out[:, :k], out[:, k : 2 * k]
    np.subtract(x, mean, out=z)
    np.divide(z, scale, out=z)
    np.clip(z, -6, 6, out=z)
    np.multiply(z, z, out=squares)
    np.divide(squares, 6, out=squares)
    return out


def _newton(a: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    w, weighted = np.zeros(a.shape[1]), np.empty_like(a)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = np.multiply(a, np.maximum(p * (1 - p), 1e-6)[:, None], out=weighted).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def train_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    return View(mean, scale, _newton(_design(x, mean, scale), y, 1.0))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> View:
    raw = view.raw(x)
    slope, offset = _newton(np.stack([raw, np.ones_like(raw)], 1), y, 1e-2)
    return view._replace(slope=max(float(slope), 0.0), offset=float(offset))


class Model(NamedTuple):
    text: View | None
    meta: View | None
    combine: np.ndarray  # weights of the two log-odds, and a constant


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``y``: labels of the first rows; a third of them is held back for calibration."""
    base = (y.sum() + 0.5) / (len(y) + 1)
    if not len(y) or y.min() == y.max():
        return Model(None, None, np.array([0.0, 0.0, np.log(base / (1 - base))]))
    back = np.arange(len(y)) % 3 == 0
    if len({*y[back]}) < 2 or len({*y[~back]}) < 2:
        back = np.zeros(len(y), bool)
    held = back if back.any() else ~back
    views = [text, meta]
    pools = [pool_text, pool_meta]
    sets = [(v[~back], y[~back]) for v in views]
    free = np.ones(len(pool_text), bool)
    share = max(1, int(CONFIDENT * len(pool_text)))
    for _ in range(rounds):
        trained = [train_view(*s) for s in sets]
        for giver, taker in ((0, 1), (1, 0)):
            open_ = np.flatnonzero(free)
            if len(open_) < 2 * share:
                break
            order = open_[np.argsort(trained[giver].raw(pools[giver][open_]), kind="stable")]
            bad, good = order[: max(1, round(share * (1 - base)))], order[-max(1, round(share * base)) :]
            free[bad] = free[good] = False
            x, t = sets[taker]
            sets[taker] = (np.concatenate([x, pools[taker][bad], pools[taker][good]]), np.concatenate([t, np.zeros(len(bad)), np.ones(len(good))]))
    done = [calibrate(train_view(*s), v[held], y[held]) for s, v in zip(sets, views)]
    odds = np.stack([d.log_odds(v[held]) for d, v in zip(done, views)] + [np.ones(int(held.sum()))], 1)
    return Model(done[0], done[1], _newton(odds, y[held], 1e-2))


def combined(model: Model, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Final score, and the two views' own."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    if model.text is None:
        flat = np.full(len(text), float(sigmoid(model.combine[2])))
        return flat, flat, flat
    a, b = model.text.log_odds(text), model.meta.log_odds(meta)
    return sigmoid(model.combine[0] * a + model.combine[1] * b + model.combine[2]), sigmoid(a), sigmoid(b)


@giving_back
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text, metadata...) to (label, text features, metadata values); those are spread where they are used."""
    for batch in batches:
        buf, at = text_bytes(batch.column(1))
        text = [row for lo, hi in groups(at) for row in text_features(buf, at[lo : hi + 1])]
        meta = meta_values(batch.columns[2:])
        meta = meta if meta.size else np.zeros((batch.num_rows, 1))
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, kind), pa.array(list(meta), kind)], names=["y", "text", "meta"])


def usable(docs: DataFrame, meta_cols: Sequence[str]) -> list[str]:
    """Metadata columns that are there, as strings or numbers."""
    kinds = {f.name: f.dataType for f in docs.schema}
    return [c for c in meta_cols if isinstance(kinds.get(c), (T.StringType, T.NumericType))]


def fit(docs: DataFrame, label: Column, text_col: str = "text", meta_cols: Sequence[str] = ("source", "lang", "n_chars")) -> Model:
    """``label``: 1 good, 0 bad, null unlabelled."""
    columns = [F.col(c) for c in usable(docs, meta_cols)]
    categories = [isinstance(docs.schema[c].dataType, T.StringType) for c in usable(docs, meta_cols)]
    rows = docs.select(label.cast("double").alias("y"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(c.alias(f"m{i}") for i, c in enumerate(columns)))
    rows = rows.where("y is null or y in (0, 1)")
    n, labelled = rows.agg(F.count("*"), F.count("y")).first()
    share = F.when(F.col("y").isNull(), F.lit(min(1.0, POOL / max(n - labelled, 1)))).otherwise(F.lit(min(1.0, LABELLED / max(labelled, 1))))
    got = rows.where(F.rand(SEED) < share).mapInArrow(_features, "y double, text array<double>, meta array<double>").toArrow()
    wide = lambda c: c.combine_chunks().flatten().to_numpy().reshape(len(c), -1) if len(c) else np.zeros((0, 1))
    y = got["y"].to_numpy(zero_copy_only=False).astype(float)
    text, meta = wide(got["text"]), wide(got["meta"])
    del got
    order = np.lexsort(np.concatenate([text, np.nan_to_num(y, nan=2.0)[:, None]], 1).T)  # whatever order the tasks ended in
    y, text, meta = y[order], text[order], meta[order]
    known = ~np.isnan(y)
    labelled, pool = (spread(meta[k], categories) if categories else meta[k] for k in (known, ~known))
    model = co_train(text[known], labelled, y[known], text[~known], pool)
    del text, meta, labelled, pool
    give_back_memory()
    return model


RESULT = "struct<score:double,text_score:double,meta_score:double>"


def score(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: Sequence[str] = ("source", "lang", "n_chars")) -> Column:
    columns = usable(docs, meta_cols)

    @F.arrow_udf(RESULT)
    def judge(texts: pa.Array, *others: pa.Array) -> pa.Array:
        buf, at = text_bytes(texts)
        text = np.concatenate([text_features(buf, at[lo : hi + 1]) for lo, hi in groups(at)] or [np.zeros((0, len(TEXT_FEATURES)))])
        meta = meta_features(others)
        values = combined(model, text, meta if meta.size else np.zeros((len(texts), 1)))
        out = pa.StructArray.from_arrays([pa.array(v) for v in values], ["score", "text_score", "meta_score"])
        del buf, text, meta
        give_back_memory()
        return out

    return judge(F.col(text_col), *(F.col(c) for c in columns))
