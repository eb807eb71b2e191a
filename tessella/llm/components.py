"""Connected components of an edge table by alternating large-star and small-star steps.

Labels and edges stay distributed; each round is cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(pairs: DataFrame, include_self: bool) -> DataFrame:
    """Of (u, v): each u with the least of its neighbours, and of itself."""
    least = F.min("v")
    return pairs.groupBy("u").agg((F.least(F.col("u"), least) if include_self else least).alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the least node of the component."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, mark = scratch.keep(now), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        mark = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_stars(both, True), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, before = scratch.keep(large), now
        least = _stars(large, False)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.free(before, large)
