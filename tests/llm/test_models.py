"""Held-out accuracy of the trained operators, their parts against brute force, and defined cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_short_items import found

from quietmark.llm import decontaminate, language_id, quality, toxicity
from quietmark.llm.decontaminate import IGNORED, SPAN, find_overlaps, seed_hashes
from quietmark.llm.queries import QUERIES
from quietmark.llm.words import groups, text_bytes
from quietmark.sources.tables import table

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = table(spark, SF, "documents").select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, SF).where("held_out").join(docs, "doc_id")
    n, good, low, high = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")).first()
    assert n > 150 and good / n > 0.97 and 0 <= low and high <= 1


def test_language_defined_cases(spark):
    rows = [("the cat and the house of the king", "en"), ("le chat et la maison du roi", "fr"), ("12 34 !", "en"), (None, "fr"), ("oui", None)] * 5
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(docs)
    assert len(model.langs) <= 2 * language_id.CENTROIDS and set(model.langs) == {"en", "fr"}
    cases = spark.createDataFrame([("the house",), ("la maison",), (None,), ("",), ("1 2 3 ²",), ("中文",), ("the " * 200_000,)], "text string")
    got = [r.p for r in cases.select(language_id.identify(F.col("text"), model).alias("p")).collect()]
    assert [p.lang for p in got[:5]] == ["en", "fr", "und", "und", "und"] and got[6].lang == "en"
    assert got[5].lang in ("en", "fr") and got[5].rejected and not got[0].lang == "und" and got[2].score == 0
    nothing = language_id.fit(docs.limit(0))
    assert cases.select(language_id.identify(F.col("text"), nothing).alias("p")).where("p.lang != 'und'").count() == 0


def test_grams_do_not_cross_texts():
    whole = language_id.gram_counts(*text_bytes(pa.array(["abc", "", "de"])))
    alone = [language_id.gram_counts(*text_bytes(pa.array([t])))[0] for t in ("abc", "", "de")]
    assert (whole == np.stack(alone)).all() and whole.sum(axis=1).tolist() == [6, 0, 3]


def brute_segments(s):
    """The best segment, then the same to its left and right: the definition."""
    best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    _, _, i, j = best
    return brute_segments(s[:i]) + [(i, j, best[0])] + [(a + j, b + j, v) for a, b, v in brute_segments(s[j:])]


def test_all_maximal_segments():
    rnd = random.Random(5)
    for _ in range(200):
        s = [rnd.randint(-6, 5) + rnd.random() / 64 for _ in range(rnd.randint(0, 14))]
        got = [(i, j, round(v, 6)) for i, j, v in toxicity.segments(np.array(s, float))]
        assert got == [(i, j, round(v, 6)) for i, j, v in brute_segments(s)]


def test_toxicity_held_out(spark):
    labels = table(spark, SF, "labels").select("doc_id", "toxic")
    rows = QUERIES["op3_toxicity"](spark, SF).where("held_out").join(labels, "doc_id").collect()
    bad = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    order = np.argsort([r.score for r in rows])
    rank = np.empty(len(rows))
    rank[order] = np.arange(len(rows))
    auc = (sum(rank[i] for i, r in enumerate(rows) if r.toxic) - len(bad) * (len(bad) - 1) / 2) / (len(bad) * len(clean))
    assert auc > 0.9 and sum(r.predicted for r in clean) / len(clean) < 0.03
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_defined_cases(spark):
    rnd = random.Random(1)
    good = [f"g{i}" for i in range(40)]
    rows = [(" ".join(rnd.choices(good, k=40)), 0) for _ in range(60)]
    rows += [(" ".join(rnd.choices(good, k=20) + ["vile", "nasty", "scum"] + rnd.choices(good, k=20)), 1) for _ in range(30)]
    docs = spark.createDataFrame(rows, "text string, y int")
    model = toxicity.fit(docs, F.col("y"))
    cases = ["g1 g2 g3 VILE, nasty! scum g4", "g1 g2 g3 g4", None, "", "!!!", "g1 " * 50_000 + "vile nasty scum"]
    got = [r.p for r in docs.sparkSession.createDataFrame([(c,) for c in cases], "text string").select(toxicity.score(docs, F.col("text"), model).alias("p")).collect()]
    assert got[0].score > 0.7 > 0.2 > got[1].score and got[2] == got[3] == got[4]
    assert [(x.first_word, x.end_word) for x in got[0].passages] == [(3, 6)] and got[1].passages == []
    for one_kind in (docs.where("y = 0"), docs.limit(0)):
        flat = toxicity.fit(one_kind, F.col("y"))
        assert len({r.p.score for r in docs.select(toxicity.score(docs, F.col("text"), flat).alias("p")).collect()}) == 1


def test_quality_held_out(spark):
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    rows = QUERIES["op5_quality_classifier"](spark, SF).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.97 and sum(not r.kept for r in bad) / len(bad) > 0.6  # 11 rows


def test_quality_uses_both_views_and_pseudo_labels():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 2, 3000).astype(float)
    text = rng.normal(truth[:, None] * 1.5, 1, (3000, 3))
    meta = rng.normal(truth[:, None] * 1.5, 1, (3000, 2))
    few = quality.co_train(text[:60], meta[:60], truth[:60], text[60:2000], meta[60:2000])
    score, a, b = quality.combined(few, text[2000:], meta[2000:])
    right = lambda s: ((s > 0.5) == (truth[2000:] > 0.5)).mean()
    assert right(score) > max(right(a), right(b)) and right(score) > 0.85


def test_quality_defined_cases(spark):
    rows = [("good words in a line", "s1", 4, 1.0), ("BAD!! BAD!! BAD!!", None, None, 0.0), (None, "s1", 0, None), ("", None, 3, 1.0)] * 10
    docs = spark.createDataFrame(rows, "text string, source string, n_chars int, y double").withColumn("lang", F.array(F.lit("en")))
    for d in (docs, docs.where("y = 1"), docs.where("y is null"), docs.limit(0)):
        model = quality.fit(d, F.col("y"))
        got = [r.p.score for r in docs.select(quality.score(docs, model).alias("p")).collect()]
        assert len(got) == 40 and all(0 <= s <= 1 for s in got) and len(set(np.round(got, 12))) <= 4
    plain = docs.select("text", "y")  # no metadata at all
    assert plain.select(quality.score(plain, quality.fit(plain, F.col("y"))).alias("p")).count() == 40


def test_text_features_do_not_depend_on_neighbours():
    texts = ["a b a b a b\nx", "", "HELLO!! hello, 123 ñandú", " ", "x" * 30]
    buf, at = text_bytes(pa.array(texts))
    together = np.concatenate([quality.text_features(buf, at[lo : hi + 1]) for lo, hi in groups(at)])
    for t, row in zip(texts, together):
        assert np.allclose(quality.text_features(*text_bytes(pa.array([t])))[0], row)


def test_seeds_ignore_every_pair_once():
    for a in range(SPAN):
        for b in range(a):
            assert sum({a, b} <= {(d + m) % SPAN for d in IGNORED} for m in range(SPAN)) == 1
    h = np.arange(1, 14, dtype=np.uint64)
    for m in range(SPAN):
        other = h.copy()
        for d in IGNORED:
            other[(d + m) % SPAN] = 99
        assert seed_hashes(h, m)[0] == seed_hashes(other, m)[0]
        other[(IGNORED[0] + m + 2) % SPAN] = 98
        assert seed_hashes(h, m)[0] != seed_hashes(other, m)[0]


@pytest.mark.parametrize("block", [500_000, 60])
def test_decontamination_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("éñxyz")
    items = [(i, " ".join(word() for _ in range(rnd.choice([3, 6, 12, 13, 20, 40])))) for i in range(30)] + [(77, None), (None, "a b c d e f"), (78, "")]
    docs = []
    for i in range(80):
        w = [word() for _ in range(rnd.randint(0, 60))]
        if i % 2:
            part = rnd.choice(items[:30])[1].split()
            for _ in range(rnd.randint(0, 4)):
                part[rnd.randrange(len(part))] = word()
            at = rnd.randint(0, len(w))
            w[at:at] = part[rnd.randint(0, 3) :]
        docs.append((i, rnd.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 else " ".join(w), "own"))
    docs += [(100, None, "x"), (101, "", "x"), (102, " ".join(t for _, t in items if t) + " q" * 5000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: {c.item_id for c in r.contamination} for r in find_overlaps(df, bench).collect()}
    want = {i: found(t or "", [x for x in items if x[0] is not None and x[1]]) for i, t, _ in docs}
    assert got == want and any(want.values())
    assert find_overlaps(df.limit(0), bench).count() == 0 and find_overlaps(df, bench.limit(0)).where("size(contamination) > 0").count() == 0
