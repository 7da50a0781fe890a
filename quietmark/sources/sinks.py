"""Result tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_redacted(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Redacted rows as Parquet, replacing an earlier run."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_inventory(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Two tables below ``path``: ``findings`` and their ``counts`` by category."""
    options = {"header": "true"} if fmt == "csv" else {}
    findings.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/findings")
    counts = findings.groupBy("category").agg(F.count("*").alias("n")).orderBy("category")
    counts.write.mode("overwrite").format(fmt).options(**options).save(f"{path}/counts")
