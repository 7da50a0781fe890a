"""Review aids: listed names still present, keyword in context, numbered lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietmark.functions.text import match_spans, slice_text
from quietmark.operators.dictionary import number_in_order
from quietmark.operators.gazetteer import name_hits


def name_check(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """``STILL PRESENT`` or ``REDACTED`` for every listed name, with its chunk count."""
    found = name_hits(chunks, names).groupBy("list", "name").agg(F.count("*").alias("chunks"))
    return names.dropDuplicates(["list", "name"]).join(found, ["list", "name"], "left").select(
        "list",
        "name",
        F.when(F.col("chunks").isNull(), "REDACTED").otherwise("STILL PRESENT").alias("status"),
        F.coalesce("chunks", F.lit(0)).cast("bigint").alias("chunks"),
    )


def keyword_in_context(chunks: DataFrame, keyword: str, radius: int = 180) -> DataFrame:
    """Every occurrence of ``keyword`` with ``radius`` characters on either side."""
    pattern = rf"(?i)\Q{keyword}\E"
    text = F.col("text")
    hits = chunks.where(F.contains(F.lower(text), F.lit(keyword.lower())))
    spans = hits.select(
        "doc_id", "chunk_no", "text", F.explode_outer(match_spans(text, pattern)).alias("s")
    ).where(F.col("s.st").isNotNull())
    left, right = F.greatest(F.col("s.st") - radius, F.lit(0)), F.col("s.en") + radius
    return spans.select(
        "doc_id",
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.col("s.st").cast("bigint").alias("position"),
        F.col("s.value").alias("found"),
        F.replace(slice_text(text, left, right), F.lit("\n"), F.lit(" ")).alias("context"),
    )


def numbered_candidates(values: DataFrame, group: str = "label") -> DataFrame:
    """Candidates per label, sorted without regard to case, numbered from 001.

    Numbers are made per range partition, so a label is not sorted in one task.
    """
    keyed = values.withColumn("_order", F.struct(F.lower("value").alias("l"), F.col("value").alias("v")))
    return number_in_order(keyed, [group], "_order").select(
        group, "n", F.concat(F.lpad(F.col("n").cast("string"), F.greatest(F.length(F.col("n").cast("string")), F.lit(3)), F.lit("0")), F.lit(". "), F.col("value")).alias("line")
    )
