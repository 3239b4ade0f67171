"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import settle, stash, unstash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u, v. Large star: every neighbour above a node is linked to the least neighbour (or the node). Small star: those not above."""
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u and v (long, not null). Rows: node, component (its least node), for every node that has an edge.

    Each round is written to the shared folder, so the plan stays short and a lost
    executor costs one round at most. Only sums reach the driver. Rounds grow with
    the logarithm of the longest chain. Loops and repeated edges are ignored.
    """
    settle(edges.sparkSession)
    now = stash(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        larger = stash(_star(now, large=True), "large-star")
        nxt = stash(_star(larger, large=False), "small-star")
        seen = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        unstash(now)
        unstash(larger)
        now = nxt
        if mark == (seen["n"], seen["h"]) or seen["n"] == 0:
            break
        mark = (seen["n"], seen["h"])
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
