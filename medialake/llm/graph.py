"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (larger ones, or all smaller ones and itself) to its least neighbour."""
    both = edges.union(edges.select("v", "u")) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least.hint("merge"), "u")  # not broadcast, whatever Spark takes its size for
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long -> (node, root): every node of an edge and the least node of its component.

    Edges between a node and its neighbours are joined, never gathered, so a hub costs a skewed join
    that Spark can split. Each round is written to the shared folder. Null ends and loops are ignored.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    table, seen = saved(pairs), None
    for _ in range(MAX_ROUNDS):
        mark = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            return table.select(F.col("u").alias("node"), F.col("v").alias("root")).union(table.select("v", "v").distinct())
        seen = mark
        table = saved(_star(_star(table, True), False))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
