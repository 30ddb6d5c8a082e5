"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """(id, root), id > root: links the neighbours of each node (the larger ones, or the smaller ones and itself) to the least of them and itself."""
    both = edges.union(edges.select("root", "id")) if large else edges
    least = both.groupBy("id").agg(F.min("root").alias("m")).withColumn("m", F.least("id", "m"))
    linked = both.join(least.hint("merge"), "id")  # not broadcast, whatever Spark takes its size for
    if large:
        out = linked.where("root > id").select(F.col("root").alias("id"), F.col("m").alias("root"))
    else:
        out = linked.select(F.col("root").alias("id"), F.col("m").alias("root")).union(least.select("id", F.col("m").alias("root")))
    return out.where("id <> root").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long -> (id, root): the nodes of edges, each with the least one it reaches.

    A round links larger neighbours of each node to the least one about it, then smaller ones; long chains take a few rounds more
    than short ones, not one for each link. Every round is written to the shared folder; not settling within ``rounds`` is an error.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("id"), F.least("a", "b").cast("long").alias("root"))
    table, seen = saved(pairs.distinct()), None
    for _ in range(rounds):
        mark = table.agg(F.count("*"), F.sum(F.xxhash64("id", "root").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            return table.union(table.select("root", "root").distinct())
        seen = mark
        table = saved(_star(_star(table, True), False))
    raise RuntimeError(f"components did not settle in {rounds} rounds")
