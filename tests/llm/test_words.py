"""The vectorised scanner against plain splitting."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quietmark.llm.words import SPACES, Words, groups, rolling, slide, text_bytes

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b\x00Z", max_size=30)), max_size=8)


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_split(values):
    buf, at = text_bytes(pa.array(values, pa.string()))
    w = Words(buf, at, SPACES)
    want = [(v or "").encode().split() for v in values]
    assert w.counts.tolist() == [len(x) for x in want]
    raw = bytes(buf[at[0] : at[-1]])
    flat = [x for v in want for x in v]
    assert [raw[s:e] for s, e in zip(w.start, w.end)] == flat
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (a == b) == bool(w.hash[i] == w.hash[j])


def test_slices_nulls_and_long_texts():
    column = pa.array(["x y", None, "", "word " * 700_000, "x y"]).slice(1)
    buf, at = text_bytes(column)
    assert [hi - lo for lo, hi in groups(at)] == [2, 1, 1]
    w = Words(buf, at)
    assert w.counts.tolist() == [0, 0, 700_000, 2] and len(set(w.hash[:700_000].tolist())) == 1
    assert text_bytes(pa.array([], pa.string()))[1].tolist() == [0]


@given(st.lists(st.integers(0, 3), max_size=30), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_rolling_and_sliding(values, k):
    h = np.array(values, np.uint64)
    got = rolling(h, k)
    whole = [i for i in range(len(values) - k + 1)]
    for i in whole:
        for j in whole:
            assert (values[i : i + k] == values[j : j + k]) == bool(got[i] == got[j])
    assert slide(h, k, np.minimum).tolist() == [min(values[i : i + k]) for i in whole]
