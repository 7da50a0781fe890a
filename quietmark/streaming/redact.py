"""Redaction of a stream of text rows.

Detection, overlap resolution and splicing look at one chunk at a time and
hashed placeholders need no dictionary, so the batch flow runs unchanged on a
streaming DataFrame: stateless, append mode, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quietmark.operators.detectors import STRICT, Rules
from quietmark.operators.dictionary import DictionaryTable
from quietmark.plans.redaction import redact, redact_hashed
from quietmark.sources.chunks import chunk_text


def read_texts(spark: SparkSession, folder: str, schema: str = "doc_id bigint, text string") -> DataFrame:
    """Parquet files as they arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def redact_stream(texts: DataFrame, rules: Rules = STRICT, mode: str = "paragraph", *, secret: str) -> DataFrame:
    return redact_hashed(chunk_text(texts, mode=mode), rules, secret=secret)


def write_stream(redacted: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append redacted chunks to Parquet until the available input is used up."""
    return (
        redacted.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


def write_numbered_stream(
    texts: DataFrame, table: DictionaryTable, path: str, checkpoint: str, rules: Rules = STRICT, mode: str = "paragraph"
) -> StreamingQuery:
    """Numbered placeholders on a stream: every micro-batch is a delivery to the dictionary table.

    A batch that is run again after a failure replaces its entries and its folder
    ``batch=...`` of redacted chunks, so nothing is written or numbered twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = redact(chunk_text(batch, mode=mode), rules, table=table, delivery=batch_id)
        done.chunks.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
