"""Connected components of an edge table, wholly on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``edges`` the smallest node reachable.

    Large-star / small-star contraction: in every round each node's neighbours
    are re-linked to the smallest neighbour; rounds grow with the logarithm of
    the number of edges, not with the diameter. A node keeps one outgoing edge after
    a small star, so hubs don't gather lists: only minima are aggregated (with
    partial aggregation), written to the shared folder and joined back. Both sides of such a join are
    stored tables, so that adaptive execution can deal the edges of a hub to many tasks.
    Null ends and self-links are ignored; an empty table gives an empty one.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: neighbours above a node go to the smallest of the node and its neighbours
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = stored(e.unionByName(up).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = stored(up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: neighbours below a node, and the node, go to the smallest of them
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # done when every edge leads to a root and no node has two edges
        ends = new.select("u", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
            new.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        open_ends = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 or out = 1 and into = 1")
        settled = open_ends.isEmpty()
        for t in (low, large, least):
            drop_stored(t)
        drop_stored(e)
        e = new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
