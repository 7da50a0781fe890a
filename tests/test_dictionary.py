"""Dictionaries that live on, numbering within rows, tokens that are recognised."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quietmark.functions.placeholders import TYPES, hashed_placeholder
from quietmark.functions.predicates import is_placeholder
from quietmark.operators.detectors import PARITY, STRICT
from quietmark.operators.dictionary import DictionaryTable, build_dictionary, numbered_within_rows, value_spans
from quietmark.plans.redaction import find_merged, redact, redact_documents, redact_each, redact_hashed
from quietmark.session import save_stage
from quietmark.sources.chunks import chunk_text
from quietmark.sources.tables import table
from quietmark.streaming.redact import read_texts, redact_stream, write_numbered_stream, write_stream

SF = "/root/testdata/sf0.001"
EVERY_TYPE = (
    "Name: Asha Varma\nOrganization: Lind Trading Ltd\nOffice Address: 3 Mill Street, Oldtown\nDOB: 3/4/1980\nmail a.b@mail.test\nTel +91 98765 43210\n"
    "Host 10.1.2.7\nCard 4539 1488 0343 6467\nSSN 123-45-6789\nRegistered Office: 5 Lake Road, Pune 411001\nsee [PHONE-100000]"
)


def texts(spark, *rows, start=1):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows, start)], "doc_id bigint, text string")


def values(spark, *rows, start=1):
    return value_spans(find_merged(chunk_text(texts(spark, *rows, start=start))))


def numbers(entries):
    return {(r["type"], r["norm_key"]): (r["n"], r["replacement"]) for r in entries.collect()}


def test_deliveries_number_like_one_run(spark, tmp_path):
    one = ["a@x.io b@x.io 10.0.0.1", "b@x.io 10.0.0.2"]
    two = ["c@x.io A@X.io", "10.0.0.3 d@x.io 10.0.0.1 Tel +91 98765 43210"]
    known = DictionaryTable(spark, str(tmp_path / "entries"))
    assert known.entries().collect() == []
    known.extend(values(spark, *one), 1)
    second = known.extend(values(spark, *two, start=3), 2)
    assert numbers(known.entries()) == numbers(build_dictionary(values(spark, *one, *two)))
    assert {(r["type"], r["norm_key"]): r["uses"] for r in second.collect()}["ip", "10.0.0.1"] == 1
    before = known.entries().count()
    known.extend(values(spark, *one), 3)
    assert known.entries().count() == before


def test_a_delivery_that_is_run_again_replaces_itself(spark, tmp_path):
    known = DictionaryTable(spark, str(tmp_path / "entries"))
    known.extend(values(spark, "a@x.io"), 1)
    known.extend(values(spark, "b@x.io c@x.io", start=2), 2)
    first = numbers(known.entries())
    known.extend(values(spark, "b@x.io c@x.io", start=2), 2)
    assert numbers(known.entries()) == first
    with pytest.raises(ValueError, match="older"):
        known.extend(values(spark, "z@x.io"), 1)
    with pytest.raises(ValueError, match="over all documents"):
        redact(chunk_text(texts(spark, "a@x.io")), numbering="document", table=known, delivery=3)
    known.extend(values(spark, "nothing here"), 4)  # an empty delivery
    assert numbers(known.entries()) == first


def test_numbered_stream_and_its_restart(spark, tmp_path):
    known = DictionaryTable(spark, str(tmp_path / "entries"))
    folder, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    run = lambda: write_numbered_stream(read_texts(spark, folder), known, out, offsets).awaitTermination()
    texts(spark, "mail a@x.io", "mail b@x.io and a@x.io").write.parquet(folder)
    run()
    texts(spark, "mail c@x.io, b@x.io", start=3).write.mode("append").parquet(folder)
    run()
    run()  # nothing new
    got = {r["doc_id"]: r["redacted_text"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "mail person1@example.com", 2: "mail person2@example.com and person1@example.com", 3: "mail person3@example.com, person2@example.com"}
    # The last batch is run again, as after a failure between its output and its commit.
    done = redact(chunk_text(texts(spark, "mail c@x.io, b@x.io", start=3)), table=known, delivery=1).chunks.collect()
    assert [r["redacted_text"] for r in done] == [got[3]] and known.entries().count() == 3


def test_numbers_within_a_row_are_ranks_of_first_appearance(spark):
    rng = random.Random(6)
    rows = [[(rng.choice(TYPES[:3]), rng.choice("abcdefgh")) for _ in range(n)] for n in (0, 1, 2, 40, 700)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, found array<struct<type:string,norm_key:string>>")
    for r in numbered_within_rows(df, "found").collect():
        order, want = {}, []
        for kind, key in r["found"]:
            want.append(order.setdefault(kind, {}).setdefault(key, len(order[kind]) + 1))
        assert r["_numbers"] == want


@pytest.mark.parametrize("rules", [PARITY, replace(STRICT, canonical_keys=True, known_names=("Tomas Lind",))])
def test_redacting_each_document_equals_a_run_of_its_own(spark, rules):
    rows = [EVERY_TYPE, "", None, "a@x.io\n\na@x.io b@x.io\n", "Tomas Lind\r\nName: Tomas Lind", "quiet", "+91 98765-43210 +91 98765 43210", "x@y.io " * 600]
    docs = texts(spark, *rows).withColumn("redactions", F.lit("kept out"))
    got = {r["doc_id"]: r for r in redact_each(docs, rules).collect()}
    run = redact(chunk_text(docs), rules, numbering="document")
    want = {}
    for r in run.findings.collect():
        starts = [0]
        for line in rows[r["doc_id"] - 1].split("\n"):
            starts.append(starts[-1] + len(line) + 1)
        at = starts[r["chunk_no"] - 1]
        want.setdefault(r["doc_id"], []).append((r["st"] + at, r["en"] + at, r["type"], r["value"], r["replacement"]))
    for i, text in enumerate(rows, 1):
        found = [(s["st"], s["en"], s["type"], s["value"], s["replacement"]) for s in got[i]["redactions"] or []]
        assert found == sorted(want.get(i, [])) and got[i]["n_redactions"] == len(found)
        out, at = "", 0
        for st, en, _, _, replacement in found:
            out, at = out + text[at:st] + replacement, en
        assert got[i]["redacted_text"] == (None if text is None else out + text[at:])


def test_documents_are_redacted_without_an_exchange(spark):
    raw = table(spark, SF, "documents").select("doc_id", "text")
    plan = redact_documents(raw, STRICT, "document")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan
    named = raw.withColumn("doc_id", F.concat(F.lit("/files/"), "doc_id", F.lit(".txt")))  # any id
    assert redact_documents(named, STRICT, "document").where("n_redactions > 0").count() > 0


def test_hashed_tokens_of_every_type_are_recognised(spark):
    kinds = spark.createDataFrame([(t,) for t in TYPES], "t string")
    assert kinds.where(~is_placeholder(hashed_placeholder(F.col("t"), F.lit("k"), "s"))).collect() == []
    once = save_stage(redact_hashed(chunk_text(texts(spark, EVERY_TYPE)), STRICT, secret="s"))
    rows = {r["chunk_no"]: r for r in once.collect()}
    assert sum(r["n_redactions"] for r in rows.values()) == 10 and rows[11]["n_redactions"] == 0
    again = redact_hashed(once.select("doc_id", "chunk_no", F.col("redacted_text").alias("text")), STRICT, secret="s").collect()
    assert {r["chunk_no"]: (r["redacted_text"], r["n_redactions"]) for r in again} == {k: (r["redacted_text"], 0) for k, r in rows.items()}


def test_hashed_stream_twice(spark, tmp_path):
    texts(spark, EVERY_TYPE).write.parquet(str(tmp_path / "in"))
    for step, name in enumerate(("in", "out1")):
        rows = read_texts(spark, str(tmp_path / name), "doc_id bigint, text string" if step == 0 else "doc_id bigint, redacted_text string")
        stream = redact_stream(rows.toDF("doc_id", "text"), secret="s").select("doc_id", "redacted_text")
        write_stream(stream, str(tmp_path / f"out{step + 1}"), str(tmp_path / f"offsets{step}")).awaitTermination()
    one, two = (sorted(r["redacted_text"] for r in spark.read.parquet(str(tmp_path / f"out{i}")).collect()) for i in (1, 2))
    assert one == two and any("[ORGANIZATION-" in t for t in one)


def test_lists_of_any_length_in_the_rules(spark):
    names = tuple(f"Nora Q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    rules = replace(STRICT, known_names=names)
    got = redact(chunk_text(texts(spark, "NORA QAB met Nora Qlm", "nobody")), rules).chunks.orderBy("doc_id").collect()
    assert [r["redacted_text"] for r in got] == ["Person 1 met Person 2", "nobody"]
    with pytest.raises(ValueError, match="more than 200 names"):  # whole documents still want a short list, or a table
        redact_documents(texts(spark, "x\nNora Qab"), rules, "document")
