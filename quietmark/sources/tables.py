"""Readers for the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A missing path raises Spark's own ``PATH_NOT_FOUND`` error."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition before heavy per-row work when a scan yields few partitions.

    A table in one small file is read by one task; pattern matching after it
    should use every core.  Large inputs already have enough splits and are
    left alone, so no shuffle is added there.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
