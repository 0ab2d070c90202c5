"""Connected components as joins: alternating large and small stars, one written table per round.

Every round replaces each node's neighbours by stars around the smallest node seen so far. It ends
when a round changes nothing, after about log(longest path) rounds. A hub meets an aggregate of one row
per node; where Spark does not broadcast that, the edges of a hub, two longs each, are joined in one task.
Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import saved


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node of ``edges`` other than a root.

    Edges with a null end and loops are ignored; repeated edges count once; no edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    edges = saved(pairs.where("x and y and u > v").select("u", "v").distinct())
    before = _signature(edges)
    while before[0]:
        edges = saved(_small_star(_large_star(edges)))
        now = _signature(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than the node moves to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """The node and its smaller neighbours move to the smallest of them; ``u > v`` in every edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
