"""Chunks of Word files: body paragraphs, table cells, headers and footers.

Spark lists, splits and reads the files; a small helper unpacks the XML of each
one.  A task holds one input split at a time (``spark.sql.files.maxPartitionBytes``).
``doc_id`` is the path of the file.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, chunk_no int, kind string, table_no int, row_no int, col_no int, text string"

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MARKS = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}


def word_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank chunks of every ``.docx`` file below ``path``, in reading order.

    A merged cell is one chunk, numbered by its first grid column.  For headers
    and footers ``row_no`` is the number of the section.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    chunks = files.select("path", "content").mapInPandas(_unpack, SCHEMA)
    return chunks.where(F.col("text").rlike(r"(?U)\S"))


def word_sections(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, sections`` of every ``.docx`` file below ``path``, for ``structure_counts``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(_count_sections, "doc_id string, sections long")


def _count_sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts = []
        for content in batch["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
            counts.append(len(body.findall(f"{W}sectPr")) + len(body.findall(f"{W}p/{W}pPr/{W}sectPr")))
        yield pd.DataFrame({"doc_id": batch["path"], "sections": counts})


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = [(path, i, *chunk) for i, chunk in enumerate(_walk(content), 1)]
            yield pd.DataFrame(rows, columns=columns).astype(
                {"table_no": "Int32", "row_no": "Int32", "col_no": "Int32"}
            )


def _text(paragraph: ElementTree.Element) -> str:
    return "".join(
        (e.text or "") if e.tag == f"{W}t" else MARKS.get(e.tag, "") for r in paragraph.iter(f"{W}r") for e in r
    )


def _walk(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        for p in body.findall(f"{W}p"):
            yield "paragraph", None, None, None, _text(p)
        for t, table in enumerate(body.findall(f"{W}tbl"), 1):
            for r, row in enumerate(table.findall(f"{W}tr"), 1):
                c = 1
                for cell in row.findall(f"{W}tc"):
                    yield "cell", t, r, c, "\n".join(_text(p) for p in cell.findall(f"{W}p"))
                    span = cell.find(f"{W}tcPr/{W}gridSpan")
                    c += 1 if span is None else int(span.get(f"{W}val"))
        if "word/_rels/document.xml.rels" not in z.namelist():
            return
        targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
        for s, section in enumerate(body.iter(f"{W}sectPr"), 1):
            for kind in ("header", "footer"):
                for ref in section.findall(f"{W}{kind}Reference"):
                    if ref.get(f"{W}type", "default") == "default":
                        part = ElementTree.fromstring(z.read(f"word/{targets[ref.get(REL)]}"))
                        for p in part.findall(f"{W}p"):
                            yield kind, None, s, None, _text(p)
