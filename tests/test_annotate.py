"""A caller's function over segments against the same function on the uncut text; spans that stay in their rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quietmark.operators import annotate, entities
from quietmark.operators.detectors import PARITY, STRICT
from quietmark.plans.queries import LISTED, rule_function
from quietmark.plans.redaction import redact, redact_hashed
from quietmark.sources.chunks import chunk_text
from quietmark.sources.tables import table

SF = "/root/testdata/sf0.001"


def drawn(rng):
    words = ["Aa", "Bbb", "Cc-Dd", "Eeee", "x", "yy", "zzz", ",", "É", "Ltd", "9"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ". "]) for _ in range(rng.randrange(0, 90)))


@pytest.mark.parametrize(("size", "overlap", "margin"), [(60, 45, 8), (40, 30, 8), (100, 20, 7)])
def test_segments_settle_to_the_uncut_entities(size, overlap, margin):
    rng, pattern = random.Random(size), re.compile(entities.TITLE_CASE, re.ASCII)
    function = lambda texts: [[(m.start(), m.end(), "X") for m in pattern.finditer(t)] for t in texts]
    for _ in range(3000):
        text = drawn(rng)
        [want] = function([text])
        pieces = []
        for a, b in annotate.segment_bounds(len(text), size, overlap):
            [found] = function([text[a:b]])
            pieces.append((a, b, [(a + s, a + e, label) for s, e, label in found]))
        got = annotate.settle(pieces, margin)
        assert got == want, (text, got, want)


def test_bounds_cover_the_text_once_and_overlap():
    assert annotate.segment_bounds(5, 10, 4) == [(0, 5)]
    assert annotate.segment_bounds(25, 10, 4) == [(0, 10), (6, 16), (12, 22), (18, 25)]


def test_function_is_loaded_in_tasks_and_sees_batches(spark):
    rows = [(1, 1, "see Asha Lind there " * 40, "k"), (2, 1, None, None), (3, 1, "", "e"), (4, 1, "Asha Lind", "z")]
    df = spark.createDataFrame(rows, "doc_id long, chunk_no int, text string, found string")

    def load():
        def function(texts):
            assert 0 < len(texts) <= 3 and all(texts)
            return [[(m.start(), m.end(), "PERSON") for m in re.finditer("Asha Lind", t)] + [(5, 5, "X"), (-1, 2, "X"), (0, 10**6, "X")] for t in texts]

        return function

    out = annotate.with_found(df, load, size=100, overlap=40, margin=12, batch=3)
    assert out.columns == ["doc_id", "chunk_no", "text", "found"]
    got = {r.doc_id: [(f.start, f.end, f.label, f.text) for f in r.found] for r in out.collect()}
    assert got[1] == [(4 + 20 * i, 13 + 20 * i, "PERSON", "Asha Lind") for i in range(40)]
    assert got[2] == got[3] == [] and got[4] == [(0, 9, "PERSON", "Asha Lind")]
    with pytest.raises(ValueError):
        annotate.with_found(df, load, size=100, overlap=40, margin=20)
    assert annotate.with_found(df.limit(0), load).count() == 0


def test_filters_in_the_row_equal_the_joined_ones(spark):
    text = "Flat near Lake Road, Hill Building floor Rahul Varma Pune. " + "x" * 100 + " Asha Lind Director said; Blue Hill Technologies Limited"
    chunks = chunk_text(spark.createDataFrame([(1, text), (2, "nothing"), (3, "Asha Lind")], "doc_id long, text string"))
    rows = entities.title_case_candidates(chunks)
    marked = chunks.withColumn("found", annotate.title_case(F.col("text")))
    assert sorted(annotate.candidate_rows(marked).collect()) == sorted(rows.collect())
    for rules in (PARITY, STRICT):
        joined = entities.filter_people(rows, chunks, rules, ("asha lind",)).unionByName(entities.filter_organizations(rows, rules))
        spans = annotate.with_entity_spans(marked, rules, ("asha lind",)).select("doc_id", "chunk_no", F.explode("found").alias("s"))
        got = spans.select("doc_id", "chunk_no", "s.st", "s.en", "s.type", "s.value", "s.rk").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, joined.collect())) and got


def shuffles(plan):
    return [line for line in plan.toString().splitlines() if "Join" in line or "Repartition" in line or "Aggregate" in line]


def test_annotated_chunks_are_joined_with_nothing(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = chunk_text(table(spark, SF, "documents").select("doc_id", "text")).withColumn("found", annotate.title_case(F.col("text")))
        spans = annotate.with_entity_spans(chunks, PARITY)
        hashed = redact_hashed(spans, LISTED, secret="k", found="found")
        assert not shuffles(hashed._jdf.queryExecution().optimizedPlan()) and "found" not in hashed.columns
        done = redact(spans, LISTED, found="found").chunks
        # Chunks without a span are one branch of a union and meet nothing.
        quiet = done._jdf.queryExecution().optimizedPlan().children().last()
        assert not shuffles(quiet) and "text" in quiet.toString() and "found" not in done.columns
        assert done.count() == chunks.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
