"""Queries over the whole corpus, and sections."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quietmark.operators.structure import structure_counts
from quietmark.plans.queries import QUERIES, TURN_ID_BASE
from quietmark.sources.cards import CARD_ID_BASE
from quietmark.sources.tables import table
from quietmark.sources.word import word_chunks, word_sections

SF = "/root/testdata/sf0.001"


def per_source(df):
    source = F.when(F.col("doc_id") >= TURN_ID_BASE, "turns").when(F.col("doc_id") >= CARD_ID_BASE, "cards").otherwise("documents")
    return {r.source: r.n for r in df.groupBy(source.alias("source")).agg(F.count_distinct("doc_id").alias("n")).collect()}


@pytest.mark.parametrize("name", ["text_assembly", "stream_redacted", "structure_counts"])
def test_every_source_is_read(spark, name):
    got = QUERIES[name](spark, SF)
    if "source" in got.columns:
        got = got.where("source = 'corpus'")
    sizes = {t: table(spark, SF, t).where(r"text rlike '\\S'").count() for t in ("documents", "conversations")}
    assert per_source(got) == {"documents": sizes["documents"], "turns": sizes["conversations"], "cards": table(spark, SF, "customer").count()}


def test_findings_of_documents_and_their_places(spark):
    got = QUERIES["findings_corpus"](spark, SF)
    assert per_source(got).keys() >= {"documents", "cards"}
    assert got.where(F.col("doc_id") < CARD_ID_BASE).where("location != 'paragraph'").count() == 0
    assert QUERIES["findings"](spark, SF).select("doc_id", "location", "st").exceptAll(got.select("doc_id", "location", "st")).count() == 0


def test_sections_without_headers_or_text_count(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    ends = "<w:p><w:pPr><w:sectPr/></w:pPr></w:p>"
    bodies = {"three": f"<w:p><w:r><w:t>one</w:t></w:r></w:p>{ends}{ends}<w:sectPr/>", "blank": f"{ends}<w:sectPr/>"}
    for name, body in bodies.items():
        with zipfile.ZipFile(tmp_path / f"{name}.docx", "w") as z:
            z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    got = structure_counts(word_chunks(spark, str(tmp_path)), word_sections(spark, str(tmp_path)))
    assert {r.doc_id.split("/")[-1]: (r.paragraphs, r.tables, r.sections) for r in got.collect()} == {"three.docx": (1, 0, 3), "blank.docx": (0, 0, 2)}
