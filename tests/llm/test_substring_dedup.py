"""Level-wise doubling against a dictionary of all windows."""

import random

import pytest
from brute import cut_passages, digest

from quietmark.llm.substring_dedup import levels, repeated_runs, substring_dedup


def corpus(seed):
    rnd = random.Random(seed)
    common = [rnd.choice("abcdefghij") for _ in range(60)]
    docs = []
    for i in range(40):
        w = [rnd.choice("abcdefghij") + rnd.choice("xyz") for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            a = rnd.randrange(50)
            at = rnd.randint(0, len(w))
            w[at:at] = common[a : a + rnd.randint(3, 30)]
        if i % 9 == 0:
            w = ["of"] * 50
        docs.append((rnd.randrange(60), rnd.choice([" ", "\n", "  "]).join(w)))
    return docs + [(3, docs[0][1]), (99, docs[5][1]), (98, None), (None, docs[5][1])]


@pytest.mark.parametrize("window", [1, 5, 13, 30])
def test_equals_brute_force(table_of, window):
    docs = corpus(window)
    got = substring_dedup(table_of(docs), window=window).select("doc_id", "text", "dedup.*").collect()
    key = lambda x: (x[0] is None, x[0], x[1] or "", x[2:])
    want = [(i, t, n, gone, kept.decode(), digest(kept)) for (i, t), (n, gone, kept) in zip(docs, cut_passages(docs, window))]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_levels_double():
    assert levels(13) == [13] and levels(50) == [13, 26, 50] and levels(1) == [1]


def test_shards_and_shuffle_join_do_not_matter(spark, table_of, monkeypatch):
    docs = corpus(4)
    before = sorted(map(str, repeated_runs(table_of(docs)).collect()))
    monkeypatch.setattr("quietmark.llm.substring_dedup.shard_count", lambda *_: 3)
    monkeypatch.setattr("quietmark.llm.common.small_enough", lambda *_: False)
    assert sorted(map(str, repeated_runs(table_of(docs).repartition(5)).collect())) == before and before


def test_empty_and_clashing_names(table_of):
    assert substring_dedup(table_of([])).count() == 0
    rows = [("1", "a b c d", 1, "x"), ("2", "a b c d", 2, "y")]
    out = substring_dedup(table_of(rows, "doc_id string, text string, runs int, dedup string"), window=3)
    assert [(r.doc_id, r.runs, r.dedup.n_removed) for r in out.orderBy("doc_id").collect()] == [("1", 1, 0), ("2", 2, 4)]


def test_ids_that_are_no_numbers_own_no_passage(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([("a", passage), ("1", passage), ("b", passage), ("2", passage)], "doc_id string, text string")
    assert {r.doc_id: r.dedup.n_removed for r in substring_dedup(df).collect()} == {"a": 0, "1": 0, "b": 0, "2": 20}
