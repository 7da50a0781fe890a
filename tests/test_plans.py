"""Every query against its oracle SQL, and the shape of the main plans."""

import pytest
from compare import compare, oracle_connection
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quietmark.operators.detectors import detect, has_candidates
from quietmark.plans.queries import LISTED, QUERIES, cells, documents
from quietmark.plans.redaction import redact_hashed
from quietmark.sources.chunks import chunk_text
from quietmark.sources.tables import table

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_oracle(spark, con, name):
    ok, note = compare(spark, con, entry.queries()[name], SQL[name], SF)
    assert ok, note


def test_entry_lists_every_query():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.queries()) and set(QUERIES) <= set(SQL)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "redacted_text", "n_redactions"]
    assert df.count() == table(spark, SF, "documents").count()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_is_narrow_and_stays_in_the_jvm(spark):
    raw = table(spark, SF, "documents").select("doc_id", "text")
    for df in (detect(chunk_text(raw), LISTED), redact_hashed(chunk_text(raw), LISTED, secret="k")):
        text = plan(df)
        assert "Exchange" not in text
        assert "Python" not in text and "Arrow" not in text


def test_scan_reads_only_two_columns(spark):
    text = plan(detect(chunk_text(table(spark, SF, "documents")), LISTED))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_candidate_filter_is_generated_code(spark):
    df = chunk_text(documents(spark, SF)).where(has_candidates(F.col("text"), LISTED))
    filters = [line for line in plan(df).splitlines() if "Filter" in line and "RLIKE" in line]
    assert filters and all("*(" in line for line in filters)
    assert cells(spark, SF).count() > 0
