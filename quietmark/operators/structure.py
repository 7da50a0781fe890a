"""Structure profile: how many paragraphs, tables and sections, and their heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def structure_counts(chunks: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Per document: paragraphs, cells, tables, header and footer chunks, characters, sections.

    ``sections`` (``doc_id, sections``) comes from the reader (``word_sections``), as a
    section need not have a chunk of its own; a document in it without any text is
    counted too.  Plain texts and pages are one section.
    """
    kind = F.col("kind")
    out = chunks.groupBy("doc_id").agg(
        F.count_if(kind == "paragraph").alias("paragraphs"),
        F.count_if(kind == "cell").alias("cells"),
        F.coalesce(F.max("table_no"), F.lit(0)).cast("bigint").alias("tables"),
        F.count_if(kind == "header").alias("headers"),
        F.count_if(kind == "footer").alias("footers"),
        F.sum(F.length("text")).cast("bigint").alias("characters"),
    )
    if sections is None:
        return out.withColumn("sections", F.lit(1).cast("bigint"))
    out = out.join(sections.select("doc_id", F.col("sections").cast("bigint").alias("sections")), "doc_id", "outer")
    return out.na.fill(0, [c for c in out.columns if c not in ("doc_id", "sections")]).na.fill(1, ["sections"])


def first_paragraphs(chunks: DataFrame, k: int = 20, width: int = 300) -> DataFrame:
    """First ``k`` paragraphs per document, cut to ``width`` characters for display.

    The text is cut before the shuffle, and the rank filter lets Spark keep only
    ``k`` rows per document and task ahead of it.
    """
    heads = chunks.where(F.col("kind") == "paragraph").select(
        "doc_id", "chunk_no", F.substring(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 1, width).alias("head")
    )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_no"))
    return (
        heads.withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("doc_id", F.col("rank").cast("bigint").alias("rank"), "head")
    )


def table_sizes(chunks: DataFrame, k: int = 10) -> DataFrame:
    """Rows and columns of the first ``k`` tables of every document."""
    cells = chunks.where((F.col("kind") == "cell") & (F.col("table_no") <= k))
    return cells.groupBy("doc_id", F.col("table_no").cast("bigint").alias("table_no")).agg(
        F.max("row_no").cast("bigint").alias("n_rows"), F.max("col_no").cast("bigint").alias("n_cols")
    )
