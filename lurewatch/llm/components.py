"""Connected components over an edge table, without ever gathering a component.

Alternates the large-star and small-star steps; each is a grouped minimum (combined before
the shuffle) and a join, and a fixed point is reached when an iteration changes no edge.
Every iteration is cut with ``checkpoint()`` in the shared folder, and so are the minima before they are
joined: a node with very many links is then split like any skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.session import cut_lineage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = cut_lineage(edges)
    low = cut_lineage(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(low, "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links, any order -> (node, root): the smallest node reachable, for every non-smallest node.

    Nulls and self links are ignored, repeated links count once, an empty table gives an empty one.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = cut_lineage(pairs.distinct())
    before = _signature(current)
    while before[0]:
        current = cut_lineage(_small_star(_large_star(current).distinct()).where("u <> v").distinct())
        after = _signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
