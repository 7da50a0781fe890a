"""Exact search, URL filter and license scan on hand-made cases; whole tables are held against SQL elsewhere."""

import random

import pytest
from pyspark.sql import functions as F

from quietmark.llm import licenses, topk, url_filter
from quietmark.llm.licenses import TEMPLATES, key_place, rare_words, scan_licenses


def brute_top(rows, k):
    scaled = [(i, [int(256 * x // 1) for x in v]) for i, v in rows]
    out = {}
    for q, a in scaled:
        if q % 50 == 0:
            got = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in scaled if i != q]
            out[q] = [(i, -s) for s, i in sorted(got)[:k]]
    return out


@pytest.mark.parametrize("blocks", [(1024, 8192), (2, 7)])
def test_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[1])
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([0.0, rnd.uniform(-2, 2)]) for _ in range(rnd.choice([8, 8, 5]))]) for i in range(0, 300, 3)]
    rows += [(i + 1, v) for i, v in rows[:20]]  # ties
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_top(rows, 5)


def test_top_k_leaves_out_what_cannot_be_scored(spark):
    rows = [(50, [1.0, 0.0]), (1, [0.5, None]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [1e300, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, vec array<double>, w string, number int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == [(50, 1, 6, (1 << 63) - 1), (50, 2, 5, 0)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components_and_shared_ids(spark):
    rows = [(50, [3.0, -1.0]), (50, [3.0, -2.0]), (1, [6e5, 0.0]), (2, [7e5, 0.0]), (3, [2.0**54, 2.0**54]), (4, [2.0**54, 2.0**53])]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, vec array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault((r.query_id, r.rank), []).append((r.vec_id, r.score))
    score = lambda a, b: int(sum((x * 256) * (y * 256) for x, y in zip(a, b)))
    want = {}
    for i in (0, 1):  # each query row has the other as a candidate
        others = sorted((-min(score(rows[i][1], v), (1 << 63) - 1), j) for n, (j, v) in enumerate(rows) if n != i)
        for rank, (s, j) in enumerate(others[:5], 1):
            want.setdefault((50, rank), []).append((j, -s))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and (2, 256 * 256 * 3 * 700_000) in got[50, 3]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "block"), ("org", "/fr", "allow"), ("org", "/fr/x/y", "block")]


@pytest.mark.parametrize("block", [200_000, 1, 2])
def test_urls(spark, monkeypatch, block):
    monkeypatch.setattr(url_filter, "RULES_BLOCK", block)
    cases = {
        "https://Foo.NET/x": "net/", "http://net/": "net/", "https://foo.net": None, "http://xnet/": None, "https://b.example.net/en/1?q#f": "example.net/en/",
        "https://b.example.net/en": "net/", "https://x.a.example.net/en/": "a.example.net/", "http://w.org/french": "org/fr", "http://w.org/fr/x/yz": "org/fr/x/y",
        "http://w.org/de": None, "no scheme.net/": None, "": None, None: None, "x://net/a://org/fr": "net/", "http://example.net:80/en/": None, "http://net/\n?": "net/",
    }
    rows = [(i, u, "kept", 7) for i, u in enumerate(cases)]
    out = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, best string, path int"), RULES)
    got = {r.url: r for r in out.collect()}
    assert {u: r.rule for u, r in got.items()} == cases
    verdicts = {f"{h}{p}": v for h, p, v in RULES}
    assert all(r.verdict == verdicts.get(r.rule, "allow") and r.best == "kept" for r in got.values())
    assert (got["https://Foo.NET/x"].host, got["https://Foo.NET/x"].path) == ("foo.net", "/x") and got[None].host == ""
    assert url_filter.judge(out.limit(0), RULES).count() == 0 and url_filter.judge(out, []).where("rule is not null").count() == 0


def test_license_scan(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0!", "the apache\tLICENSE and cc-by and CC BY-NC 4.0", "Licensed under CC BY-NC 9.9.", None, "", "mit",
        "x " * 20_000 + "Released under the MIT License. " * 300, "permission is hereby granted free of charge to any individual obtaining a copy",
        "under the terms of the GNU Lesser General Public License", "licence apache", "gnu general public", "gnu general public license" + " license" * 5000,
    ]
    df = spark.createDataFrame([(i, t, "own", 3) for i, t in enumerate(texts)], "doc_id long, text string, labels string, found int")
    r = {x.doc_id: x for x in scan_licenses(df).collect()}
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].labels, r[0].score) == (1, 3, 3, "apache", 1.0)
    assert (r[1].n_base, r[1].first_word, r[1].last_word, r[1].base_labels) == (3, 1, 7, "apache,cc-by")
    assert r[2].base_labels == "cc-by" and r[2].labels == "cc-by,cc-by-nc"
    assert all((r[i].n_base, r[i].first_word, r[i].labels, r[i].score) == (0, None, "", 0.0) for i in (3, 4, 5, 9, 10))
    assert (r[6].n_words, r[6].n_base, r[6].first_word, r[6].last_word, r[6].labels) == (21_500, 300, 20_003, 20_003 + 299 * 5, "mit")
    assert r[7].base_labels == "" and r[7].labels == "mit" and r[7].score == 0.75
    assert r[8].labels == "lgpl" and r[11].n_base == 1 and r[0].found == 3
    assert scan_licenses(df.limit(0)).count() == 0


def test_license_scan_stays_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = scan_licenses(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_templates_hold_their_keys():
    for _, text, key in TEMPLATES:
        lo, hi = key_place(text, key)
        assert text.split()[lo:hi] == key.split()
    assert rare_words("a b a c d", {"a": 9, "b": 2, "c": 2, "d": 0}) == [("b", 1), ("c", 3), ("a", 0)]
    assert licenses.oracle().count("SELECT") > 10
