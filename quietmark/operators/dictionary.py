"""Numbering of distinct values and the replacement dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietmark.functions.placeholders import norm_key, placeholder
from quietmark.functions.text import let, running
from quietmark.operators.detectors import STRICT, Rules
from quietmark.session import path_exists, save_stage

HOT_KEYS = 1_000


def number_in_order(df: DataFrame, groups: list[str], order: str, out: str = "n") -> DataFrame:
    """``row_number`` per group without putting a whole group into one task.

    Rows are range-partitioned by (group, order) and written, so partition ids
    are fixed.  Each row is numbered inside its partition; only groups that
    cross a partition border need an offset, and there are fewer than two such
    rows per partition, which bounds the broadcast.
    """
    placed = save_stage(
        df.repartitionByRange(*groups, order).withColumn("_pid", F.spark_partition_id())
    )
    inside = Window.partitionBy("_pid", *groups).orderBy(order)
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_pid", *groups).agg(F.count("*").alias("_size"))
    crossing = sizes.groupBy(*groups).agg(F.count("*").alias("_parts")).where("_parts > 1").select(*groups)
    offsets = (
        sizes.join(F.broadcast(crossing), groups, "left_semi")
        .withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    return (
        placed.withColumn("_rank", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["_pid", *groups], "left")
        .withColumn(out, (F.col("_rank") + F.coalesce("_offset", F.lit(0))).cast("bigint"))
        .drop("_pid", "_rank", "_offset")
    )


def value_spans(resolved: DataFrame, rules: Rules = STRICT) -> DataFrame:
    """One row per kept span with its dictionary key and position."""
    rows = resolved.select("doc_id", "chunk_no", F.explode_outer("merged").alias("s")).where(F.col("s.st").isNotNull())
    return rows.select(
        "doc_id",
        "chunk_no",
        F.col("s.st").alias("st"),
        F.col("s.en").alias("en"),
        F.col("s.type").alias("type"),
        F.col("s.value").alias("value"),
        norm_key(F.col("s.type"), F.col("s.value"), rules.canonical_keys).alias("norm_key"),
    )


def key_id(*parts: str) -> Column:
    """Fixed-width digest of a dictionary key, so long values are not shuffled twice."""
    return F.md5(F.concat_ws("\u001f", *[F.col(p).cast("string") for p in parts]))


def build_dictionary(values: DataFrame, scope: str = "corpus", rules: Rules = STRICT) -> DataFrame:
    """Numbered placeholders in order of first appearance.

    ``scope="corpus"`` numbers over the whole table, ``"document"`` starts again
    in every document.  The grouping combines map-side, so a value that fills a
    third of all rows reaches the reducers as one row per task.  A document's
    distinct values are bounded by its text, so they are numbered in one window.
    """
    groups = ["type"] if scope == "corpus" else ["doc_id", "type"]
    distinct = values.groupBy(*groups, "norm_key").agg(
        F.min(F.struct("doc_id", "chunk_no", "st")).alias("first"), F.count("*").alias("uses")
    )
    if scope == "corpus":
        numbered = number_in_order(distinct, groups, "first")
    else:
        numbered = distinct.withColumn("n", F.row_number().over(Window.partitionBy(*groups).orderBy("first")).cast("bigint"))
    return numbered.withColumn("replacement", placeholder(F.col("type"), F.col("n"), rules.overflow))


def numbered_within_rows(df: DataFrame, found: str, out: str = "_numbers") -> DataFrame:
    """Number the values of an array of spans (``type, norm_key``, in text order) within its row.

    Adds ``out``, an array of numbers: a value has its rank among the values of its
    type by first appearance.  Sorts and running sums, so a row with a hundred
    thousand spans is not quadratic, and no row meets another.  Arrays that a lambda
    looks into are bound by ``let``: a column would be evaluated for every element.
    """
    def differs(xs: Column, x: Column, k: Column, *fields: str) -> Column:
        return reduce(lambda a, b: a | b, [k == 0, *(F.get(xs, k - 1)[f] != x[f] for f in fields)])

    def last(xs: Column, *fields: str) -> Column:
        """Index of the latest element that differs from the one before it in some field."""
        return running(F.transform(xs, lambda x, k: F.when(differs(xs, x, k, *fields), k).otherwise(0)), "max")

    def by_first(v: Column) -> Column:
        def place(x: Column, first: Column) -> Column:
            return F.struct(x["type"].alias("type"), F.get(v, first)["i"].alias("first"), x["i"].alias("i"))

        return F.array_sort(F.zip_with(v, last(v, "type", "key"), place))

    def ranked(f: Column) -> Column:
        new = F.transform(f, lambda x, k: F.when(differs(f, x, k, "type", "first"), 1).otherwise(0))

        def numbers(rank: Column) -> Column:
            number = lambda x, start: F.struct(x["i"].alias("i"), (x["r"] - F.get(rank, start) + 1).cast("bigint").alias("n"))
            at = F.zip_with(f, rank, lambda x, r: F.struct(x["i"].alias("i"), r.alias("r")))
            return F.array_sort(F.zip_with(at, last(f, "type"), number))

        return let(running(new, "sum"), numbers)

    by_value = F.array_sort(F.transform(found, lambda s, i: F.struct(s["type"].alias("type"), s["norm_key"].alias("key"), i.alias("i"))))
    df = df.withColumn("_f", let(by_value, by_first))
    return df.withColumn(out, F.transform(let(F.col("_f"), ranked), lambda x: x["n"])).drop("_f")


class DictionaryTable:
    """A dictionary that lives on over many deliveries: entries are added, never numbered anew.

    A folder of Parquet with one subfolder a delivery.  A delivery's known values
    keep their placeholders; its new ones are numbered on from the largest number
    of their type, by first appearance.  Deliveries have rising numbers and are
    written one at a time.  One that failed, or whose job was run again, replaces
    what it wrote; a delivery older than the last cannot be run again under its
    number, as later ones built on it (under a new number it adds nothing).
    """

    ENTRIES = "type string, norm_key string, n bigint, replacement string, delivery bigint"

    def __init__(self, spark: SparkSession, path: str, rules: Rules = STRICT):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def entries(self, before: int | None = None) -> DataFrame:
        """``type, norm_key, n, replacement, delivery`` of all deliveries, or of those before one."""
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.ENTRIES)
        known = self.spark.read.schema(self.ENTRIES).parquet(self.path)
        return known if before is None else known.where(F.col("delivery") < before)

    def extend(self, values: DataFrame, delivery: int) -> DataFrame:
        """Add what is new in ``values`` (see ``value_spans``); the entries of all its values, with their ``uses``."""
        last = self.entries().agg(F.max("delivery").alias("d")).first()["d"]
        if last is not None and delivery < last:
            raise ValueError(f"delivery {delivery} is older than delivery {last}")
        known = self.entries(delivery)
        seen = save_stage(values.groupBy("type", "norm_key").agg(F.min(F.struct("doc_id", "chunk_no", "st")).alias("first"), F.count("*").alias("uses")))
        new = seen.join(known, ["type", "norm_key"], "left_anti").drop("uses")
        tops = known.groupBy("type").agg(F.max("n").alias("_top"))  # one row a type
        numbered = number_in_order(new, ["type"], "first").join(F.broadcast(tops), "type", "left").withColumn("n", F.col("n") + F.coalesce("_top", F.lit(0)))
        numbered = numbered.select("type", "norm_key", "n", placeholder(F.col("type"), F.col("n"), self.rules.overflow).alias("replacement"))
        numbered.write.mode("overwrite").parquet(f"{self.path}/delivery={delivery}")
        return self.entries(delivery + 1).drop("delivery").join(seen, ["type", "norm_key"])


def replace_values(values: DataFrame, dictionary: DataFrame, scope: str = "corpus") -> DataFrame:
    """Add ``replacement`` to every span.

    The most used keys are joined by broadcast: exactly ``HOT_KEYS`` rows of
    bounded width.  Any other key holds less than one row in ``HOT_KEYS``, so
    the shuffled join that remains has no hot partition.
    """
    keys = ["type", "norm_key"] if scope == "corpus" else ["doc_id", "type", "norm_key"]
    entries = dictionary.select(key_id(*keys).alias("_key"), "replacement", "uses")
    hot = entries.orderBy(F.desc("uses"), "_key").limit(HOT_KEYS).drop("uses")
    spans = values.withColumn("_key", key_id(*keys))
    near = spans.join(F.broadcast(hot.withColumnRenamed("replacement", "_hot")), "_key", "left")
    often = near.where(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "replacement")
    rare = near.where(F.col("_hot").isNull()).drop("_hot").join(entries.drop("uses"), "_key")
    return often.unionByName(rare).drop("_key")
