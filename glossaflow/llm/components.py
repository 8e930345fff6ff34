"""Connected components by alternating large and small stars; nothing is gathered on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, merged


def _mark(edges: DataFrame) -> tuple[int, int]:
    """The number of edges and a sum that changes with them."""
    n, s = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
    return n, s or 0


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (u, v) of any comparable kind to (node, component): the least node that can be reached. Nodes without edges are not listed."""
    now = scratch.table(f"{name}-0", edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark, i = _mark(now), 0
    while True:
        # large star: each greater neighbour is linked to the least of the neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # each neighbour v above u; what is left of now has v below u
        large = now.join(merged(least.withColumnRenamed("u", "v")), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the least smaller neighbour takes all smaller ones and the node itself
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(small_least), "u")
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        i += 1
        following = scratch.table(f"{name}-{i}", linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        scratch.drop(f"{name}-{i - 1}")
        now, before = following, mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
