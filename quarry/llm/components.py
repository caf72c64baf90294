"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(pairs: DataFrame, low: DataFrame) -> DataFrame:
    return pairs.join(low, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``links``; ``root`` is the smallest node it can reach.

    Nothing is gathered: every step is a partial aggregation (the smallest neighbour of a
    node) and an equi-join on the node, whose hot keys adaptive execution splits. Each step's
    links are written once to the shared folder.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = staged(edges, "cc")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour is linked to the smallest one around u
        large = _star(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = _star(large, least)
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = staged(small.where("u <> v").distinct(), "cc")
        # stars only: nobody is linked to two nodes, or to one and a centre as well
        ends = after.select(F.col("u").alias("n"), F.lit(2).alias("w")).unionByName(after.select(F.col("v").alias("n"), F.lit(1).alias("w")).distinct())
        if ends.groupBy("n").agg(F.sum("w").alias("w")).where("w > 2").isEmpty():
            break
        edges = after
    return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
