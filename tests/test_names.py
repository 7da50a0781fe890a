"""Listed names against plain regular expressions; the plan holds no name."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quietmark.operators import gazetteer, names
from quietmark.operators.names import occurrences
from quietmark.plans.redaction import redact
from quietmark.sources.chunks import chunk_text

ALPHABET = ["a", "A", "b", "n", "é", "É", " ", "-", "中", "ж", "Ж", "İ", "ı", "ß", ".", "\\", "E", "\U0001f600"]


def plain(texts, listed, bounded):
    left, right = (r"(?<![A-Za-z])", r"(?![A-Za-z])") if bounded else ("", "")
    out = set()
    for i, text in enumerate(texts):
        for name in listed:
            out |= {(i, name, m.start(), m.end()) for m in re.finditer(f"(?i){left}{re.escape(name)}{right}", text)}
    return out


def as_chunks(spark, texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, chunk_no int, text string")


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("split", [100_000, 3])
def test_occurrences_are_those_of_a_search_a_name(spark, monkeypatch, bounded, split):
    monkeypatch.setattr(names, "SPLIT", split)
    rng = random.Random(11)
    plain_letters = [c for c in ALPHABET if c not in "İıß"]  # whose case the two engines see differently
    texts = ["".join(rng.choices(plain_letters, k=rng.randrange(0, 60))) for _ in range(250)] + ["", "ab ab ab ab", "na na na"]
    listed = sorted({"".join(rng.choices(plain_letters, k=rng.randrange(1, 11))) for _ in range(150)} | {"ab ab", "na na"})
    table = spark.createDataFrame([(n,) for n in listed] + [("",), (None,), ("ab ab",)], "name string")
    got = [(r.doc_id, r.name, r.start, r.end) for r in occurrences(as_chunks(spark, texts), table, bounded).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(texts, listed, bounded)


def test_odd_case_pairs(spark):
    table = spark.createDataFrame([("İpek",), ("ΟΔΟΣ",), ("straße",), ("Kılıç",)], "name string")
    found = occurrences(as_chunks(spark, ["ipek IPEK İPEK", "οδος οδοσ", "STRAßE strasse", "KILIÇ kiliç"]), table)
    assert sorted((r.name, r.value) for r in found.collect()) == sorted(
        [("İpek", "ipek"), ("İpek", "IPEK"), ("İpek", "İPEK"), ("ΟΔΟΣ", "οδος"), ("ΟΔΟΣ", "οδοσ"), ("straße", "STRAßE"), ("Kılıç", "KILIÇ"), ("Kılıç", "kiliç")]
    )


def test_no_names_and_no_text(spark):
    nobody = spark.createDataFrame([], "name string")
    some = spark.createDataFrame([("Ann",)], "name string")
    assert occurrences(as_chunks(spark, ["Ann"]), nobody).collect() == []
    assert occurrences(as_chunks(spark, ["Ann"]).where("false"), some).collect() == []
    assert gazetteer.gazetteer_spans(as_chunks(spark, ["Ann"]), nobody.select(F.lit("known").alias("list"), "name")).collect() == []


def people(spark, n):
    """Names of letters in three scripts, from numbers."""
    first = lambda base: F.concat(*[F.char(F.lit(base) + F.floor(F.col("id") / 26**k) % 26) for k in range(4)])
    wide = F.expr("decode(unhex(concat(hex(19968 + id div 5000), hex(19968 + id % 5000))), 'UTF-16BE')")
    name = F.when(F.col("id") % 3 == 0, wide).when(F.col("id") % 3 == 1, F.concat(F.lit("É"), first(97))).otherwise(F.concat(first(65), F.lit(" Lind")))
    return spark.range(n).select(F.col("id").cast("int").alias("name_no"), name.alias("name"))


def test_detection_and_sweep_over_a_hundred_thousand_names(spark):
    table = people(spark, 100_000)
    some = {r.name_no: r.name for r in table.where("name_no in (0, 1, 2, 77775, 77776, 77777, 99998)").collect()}
    texts = [f"saw {n.upper()}, {n} and x{n}" if n.isascii() else f"見{n}。 {n}" for n in some.values()] + ["Nobody here", "Lind"]
    chunks = chunk_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    listed = table.select(F.lit("known").alias("list"), "name")
    spans = gazetteer.gazetteer_spans(chunks, listed)
    assert spans.count() == 2 * len(some)
    swept, found = gazetteer.sweep_names(redact(chunks), table)
    assert {r.original for r in found.collect()} == set(some.values())
    for df in (spans, swept):
        plan = df._jdf.queryExecution().toString()
        assert not any(n in plan for n in some.values())
    left = [r.swept_text for r in swept.orderBy("doc_id").collect()]
    assert left[-2:] == ["Nobody here", "Lind"] and left[0] == "見Person 1。 Person 1"
    whole = occurrences(chunks, table.where("name_no = 2"), bounded=False)
    assert whole.count() == 3  # also inside a longer word


def test_places_are_those_of_first_characters(spark):
    table = spark.createDataFrame([("Anna",), ("b",), ("]-x",), ("\U0001f600é",), ("ßa",)], "name string").withColumn("_n", F.length("name"))
    begin = names._beginnings(table)
    texts = ["zzz" * 500 + "aNna an", "B]-x]x", "\U0001f600é \U0001f600", "SSa ßA"]
    rows = names._places(as_chunks(spark, texts), 3, [1, 2], False, begin).select("doc_id", "start").distinct().collect()
    assert sorted((r.doc_id, r.start) for r in rows) == [(0, 1500), (0, 1505), (1, 0), (1, 1), (2, 0), (2, 3), (3, 4)]


def test_too_many_beginnings(spark, monkeypatch):
    monkeypatch.setattr(names, "MAX_BEGINNINGS", 3)
    table = spark.createDataFrame([("Abc",), ("Adc",), ("Bec",), ("Cfc",)], "name string").withColumn("_n", F.length("name"))
    assert "[" in names._beginnings(table) and names._beginnings(table.unionByName(table.select(F.lit("Dxx").alias("name"), "_n"))) == ""
    for more in ([], [("Dxx",)]):
        listed = spark.createDataFrame([("Abc",), ("Adc",), ("Bec",), ("Cfc",), *more], "name string")
        found = occurrences(as_chunks(spark, ["abc Dxx ADC", "xBECx"]), listed, bounded=False).select("doc_id", "name").collect()
        assert sorted(map(tuple, found)) == sorted([(0, "Abc"), (0, "Adc"), (1, "Bec"), *((0, n) for (n,) in more)])


@pytest.mark.parametrize("split", [100_000, 3])
def test_a_shared_beginning_makes_no_pairs(spark, monkeypatch, split):
    """A long list, all names of which begin alike, meets as many places by whole names only."""
    monkeypatch.setattr(names, "SPLIT", split)
    monkeypatch.setattr(names, "BROADCAST_BYTES", 0)
    met = []
    salted = names._salted
    monkeypatch.setattr(names, "_salted", lambda *given: met.append(salted(*given)) or met[-1])
    listed = spark.range(300).select(F.format_string("4539-1%03d", "id").alias("name"))
    texts = [f"card 4539-1{i:03d} and 4539-19" for i in range(400)]
    found = occurrences(as_chunks(spark, texts), listed, bounded=False).select("doc_id", "name").collect()
    assert sorted(map(tuple, found)) == [(i, f"4539-1{i:03d}") for i in range(300)]
    assert met[0].count() == 300
