"""Connected components of a graph given as edges, by alternating large and small stars.

Every step is a join and an aggregation; no neighbour list is ever gathered in
one row. Each round is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamwatch.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    joined = both.join(least, F.col("u") == F.col("n")).where("v > u")
    return joined.select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` has u > v throughout."""
    least = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("n"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Each node has one edge and no node that others point at has one: every edge leads to a root."""
    split = edges.groupBy("u").count().where("count > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return split.unionByName(inner).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root): every node that has an edge with the smallest node it is connected to.

    ``edges`` has two columns of longs, in either direction; loops, repeats and
    rows with nulls add nothing. A root is listed with itself.
    """
    a, b = edges.columns[:2]
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = saved(e)
    for _ in range(max_rounds):
        if _is_forest(e):
            break
        e = saved(_small_star(_large_star(e)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
