"""Periodic runs against a brute-force version, word by word and by query."""

import hashlib
import random
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quietmark.llm.queries import op13_periodic_runs
from quietmark.llm.runs import Catcher, collapse, periodic


def brute(words, least=12):
    """{(start, length, smallest period)} of the maximal repetitions."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                found.setdefault((i - p, j - i + p), p)
            i = max(j, i) + 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


@given(st.lists(st.sampled_from("ab"), max_size=70), st.sampled_from([2, 5, 12]))
@settings(max_examples=500, deadline=None)
def test_two_words(words, least):
    assert Catcher(least).extend(words).runs() == brute(words, least)


@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 6)), max_size=9))
@settings(max_examples=400, deadline=None)
def test_stretches_of_repeated_pieces(pieces):
    words = [w for piece, times in pieces for w in piece * times]
    assert Catcher(2).extend(words).runs() == brute(words, 2)
    assert Catcher().extend(words).runs() == brute(words)


@given(st.lists(st.sampled_from("abc"), max_size=60))
@settings(max_examples=100, deadline=None)
def test_word_by_word_is_the_same_at_every_prefix(words):
    reader = Catcher(4)
    for i, w in enumerate(words):
        reader.extend([w])
        assert reader.runs() == brute(words[: i + 1], 4)


def test_long_texts():
    rng = random.Random(7)
    prose = [f"w{rng.randrange(300)}" for _ in range(700)]
    for words in (["a"] * 900, ["a", "b"] * 500, (["a"] * 90 + ["b"]) * 9, prose + prose[100:400] * 4 + prose, prose[:301] * 5):
        assert Catcher().extend(words).runs() == brute(words)
    began = time.process_time()
    assert Catcher().extend(["a"] * 100_000).runs() == [(0, 100_000, 1)]
    assert Catcher().extend([str(i * i % 977) for i in range(100_000)]).runs() == [(0, 100_000, 977)]
    assert time.process_time() - began < 30


def words_of(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def expected(i, text):
    words = words_of(i, text)
    runs = brute(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (i, len(runs), *best, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(kept))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["la", "de", "tion", "Über", "x", "that"]) for _ in range(n))
    rows = [(i, prose(rng.randrange(0, 160))) for i in range(400)]
    rows += [(401, None), (402, ""), (403, " \t\n "), (404, "a " * 4000), (405, "x y\n" * 30 + "\x0bz  " + "q\tr s " * 9), (406, "no break " * 20), (405, "x y\n" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"p": F.lit(1), "runs": F.lit("r"), "words": F.lit(0)})
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20  # one document in ten repeats itself by the contract


def test_columns_nulls_and_an_empty_table(spark, table_of):
    rows = [("a", None, 5), ("b", "z " * 13, None), (None, "", 5)]
    out = table_of(rows, "id string, text string, n_words long").withColumn("periodic", periodic(F.col("text")))
    got = {r.id: r.periodic for r in out.collect()}
    assert [tuple(r) for r in got["b"].runs] == [(0, 13, 1)] and got["b"].kept_text == "z" and got["b"].n_words == 13
    assert got["a"].n_words == got[None].n_words == 0 and got["a"].kept_text == "" and got["a"].runs == []
    assert out.where("false").collect() == []
    with pytest.raises(ValueError):
        periodic(F.col("text"), least=1)


def test_collapse_keeps_the_first_period():
    words = "a b c a b c a b c a b c d".split()
    assert collapse(words, Catcher().extend(words).runs()) == "a b c d".split()
