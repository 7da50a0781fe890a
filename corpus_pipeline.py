"""The corpus pipeline: quality, near copies, repeated passages, benchmark passages, packing.

Every stage takes the whole table its predecessor kept and returns a table with
the columns of ``documents`` (the last one: packed pieces).  The driver may write
and reread each result, or ``run`` does so below the shared stage folder.

* quality: documents that the classifier rejects go.
* near_duplicates: of each group of near copies the one with the smallest id stays.
* repeated_passages: passages that an earlier document holds are cut out of
  ``text`` (its kept words, joined by blanks); ``n_chars`` follows.  Texts without
  such a passage stay as they are; a text that loses all its words stays, empty.
* benchmark_passages: documents with a passage of a benchmark item go, if it has at
  least five words (of scripts without blanks: characters).
* packing: one row a piece of at most 1024 tokens.

Null texts and ids pass every stage (a null text is scored as an empty one); an
empty table gives an empty result; extra columns stay up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietmark.llm import quality
from quietmark.llm.common import bound_batches, fresh
from quietmark.llm.decontaminate import contaminated, find_overlaps
from quietmark.llm.near_dedup import drop_near_duplicates
from quietmark.llm.packing import pack
from quietmark.llm.queries import quality_model, table
from quietmark.llm.substring_dedup import substring_dedup
from quietmark.session import Stages

#: SQL cannot express the trained and iterative stages; tests hold them against brute-force versions.
ORACLE_SQL: str | None = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    judged = fresh("quality")
    scored = docs.withColumn(judged, quality.score(docs, quality_model(spark, docs, sf_dir)))
    return scored.where(F.col(f"{judged}.score") >= quality.KEEP_FROM).drop(judged)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    out = substring_dedup(docs)
    cut, kept = F.col("dedup.n_removed") > 0, F.col("dedup.kept_text")
    changed = {"text": F.when(cut, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    out = find_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~contaminated()).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_passages", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stages = table(spark, sf_dir, "documents"), Stages(spark)
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            result = stages.save(result)
            stages.drop(docs)
        docs = result
    return docs
