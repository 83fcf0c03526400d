"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axolin.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges has two columns of one orderable type. Each round moves every node's links to its smallest neighbour, first
    for the larger neighbours, then for the smaller ones, until all links end in their component's smallest node. A
    round is joins and grouped minima, which combine before they shuffle; a hub's links are joined, not gathered. Each
    round's links are checkpointed. Self-links and repeated links are allowed; no links give no rows.
    """
    a, b = edges.columns
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    facts = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF))).alias("h")
    before = e.agg(*facts).first()
    while before["n"]:
        e = cut(_small_star(_large_star(e)))
        now = e.agg(*facts).first()
        if now == before:
            break
        before = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
