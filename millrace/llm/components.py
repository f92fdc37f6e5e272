"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for every node of an edge.

    Each round is two aggregations with partial sums and two joins; edges never leave the executors. It ends
    when a round changes nothing, after a number of rounds that grows with the logarithm of the diameter.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    pairs, last = stored(pairs), None
    while True:
        both = pairs.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(pairs.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        pairs = stored(small.where("u > v").distinct())
        mark = tuple(pairs.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if mark == last:
            break
        last = mark
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
