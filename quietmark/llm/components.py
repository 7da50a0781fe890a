"""Connected components of a table of links, by alternating stars.

Large-star hangs every larger neighbour of a node on its smallest neighbour,
small-star every smaller one; both are a map-side combined minimum and one join,
so a node with a third of all links is one row a task in the aggregate and a
splittable key in the join.  After a logarithmic number of rounds every node
hangs on the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietmark.llm.common import Stages


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node hangs on one node, and nothing hangs on that."""
    nodes = e.groupBy("a").agg(F.count("*").alias("n"), F.lit(0).alias("held"))
    roots = e.groupBy(F.col("b").alias("a")).agg(F.lit(0).alias("n"), F.count("*").alias("held"))
    both = nodes.union(roots).groupBy("a").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))
    return both.where("n > 1 or (n > 0 and held > 0)").isEmpty()


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, any orderable type); the root is the smallest node.

    Loops and repeated links do no harm; no links give an empty table.
    """
    known = stages.save(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(known):
        moved = stages.save(_small_star(_large_star(known)))
        stages.drop(known)
        known = moved
    return known.select(F.col("a").alias("node"), F.col("b").alias("root")).union(known.select("b", "b").distinct())
