"""Helpers that several operators share: names, row keys, size-checked joins."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietmark.session import Stages

#: A table whose measured bytes are within this bound may be broadcast.
BROADCAST_BYTES = 32 << 20


#: Rows of an Arrow batch: texts are long, and a worker holds a whole batch.
BATCH_ROWS = 2_000


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold fewer rows than Spark's default of 10,000; memory only, results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(name: str) -> str:
    """A column name that no input column has."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def row_tag(text: Column) -> Column:
    """Tells apart rows that share an id but not their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fold(id_column: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(buckets))


def fold_of(value: object, buckets: int) -> int:
    return zlib.crc32(str(value).encode()) % buckets


def small_enough(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the measured size of a (saved) table is within ``limit``."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.sum(size.cast("double")).alias("b")).first()["b"]
    return (total or 0) <= limit


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join without moving ``big`` where ``small`` was measured to be small, else by a shuffle.

    Both ways give the same rows; ``small`` should be a saved table.
    """
    if small_enough(small, row_bytes, limit):
        small = F.broadcast(small)
    return big.join(small, on, how)


def shard_count(df: DataFrame, text_col: str, per_shard: int = 32 << 20) -> int:
    """Shards so that each gets what about ``per_shard`` bytes of text produce."""
    total = df.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    at_least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(at_least, -(-int(total) // per_shard))


def give_back_memory() -> None:
    """At the end of a task: what its batches took goes back to the system, as the worker lives on for other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def giving_back(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` over a task's batches; memory is given back when it has ended and holds nothing any more."""

    @wraps(step)
    def run(batches: Iterator) -> Iterator:
        yield from step(batches)
        give_back_memory()

    return run


def packed(values: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(values, kind).tobytes()


def unpacked(value: bytes | None, kind) -> np.ndarray:
    return np.frombuffer(value or b"", kind)


__all__ = [
    "BROADCAST_BYTES",
    "Stages",
    "attach",
    "bound_batches",
    "fold",
    "fold_of",
    "fresh",
    "give_back_memory",
    "giving_back",
    "packed",
    "row_tag",
    "shard_count",
    "small_enough",
    "unpacked",
]
