"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is an aggregate (the smallest neighbour of a node, combined map-side) joined back to the edges. The aggregate
is written first: both sides of the join are then plain exchanges, whose hot side adaptive execution splits (it does not
where an aggregate stands between exchange and join), so no task needs all edges of a hub. The edges are written after
each round: lineage stays short, and lost executors cost a rerun of one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unionlog.llm.common import cut, drop_cut


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    out = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
    drop_cut(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to its smallest neighbour."""
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
    tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = cut(tied.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    drop_cut(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    edges has longs a and b in any direction; loops, repeated edges and nulls are allowed and ignored.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut(clean)
    mark = _signature(now)
    while mark[0]:
        large = _large_star(now)
        nxt = _small_star(large)
        drop_cut(large)
        new = _signature(nxt)
        drop_cut(now)
        now = nxt
        if new == mark:
            break
        mark = new
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
