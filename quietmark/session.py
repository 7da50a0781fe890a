"""Session helpers and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quietmark", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one named by ``spark.checkpoint.dir``.

    Only a single-JVM master may run without the setting; it then gets a fresh
    temporary folder.  On a cluster a machine-local folder would not survive
    the loss of an executor, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="quietmark-stage-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Stages:
    """Intermediate tables of one run, below the stage folder.

    A saved table is Parquet in the shared folder: it cuts the lineage in a form
    that survives lost executors, and later readers can prune by column.  Leaving
    the ``with`` block (or ``close``) removes every table of the run; ``drop``
    removes those that are no longer needed.  Tables that a lazy result still
    reads must live until that result has been written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}
        self.root = f"{stage_root(spark).rstrip('/')}/quietmark-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, partitioned_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{len(self._paths):03d}-{uuid.uuid4().hex[:8]}"
        writer = df.write if partitioned_by is None else df.write.partitionBy(partitioned_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._quietmark_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_quietmark_path", None)
            if path is not None:
                self._remove(path)

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        self._remove(self.root)

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def save_stage(df: DataFrame) -> DataFrame:
    """Save one table in a run of its own; it stays until its folder is removed."""
    return Stages(df.sparkSession).save(df)
