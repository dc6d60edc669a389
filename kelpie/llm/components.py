"""Connected components of a graph given as edges, by alternating large and small stars.

Each round takes the smallest neighbour of every node by an aggregate (combined before the
shuffle, so a node of any degree is one row a task) and joins it back to the edges; Spark can
split that join where a node is hot. Rounds grow with the logarithm of the component size.
Edges are written to the shared folder each round, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on (a, b), a > b: each node's larger (or smaller) neighbours are linked to its smallest neighbour or itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = near.join(least, F.col("a") == F.col("u"))
    if large:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return new.where("a > b").distinct()


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) of each node of the edges (a, b); root is the smallest node of its component.

    Null ends and loops are left out; an empty table gives an empty result.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sums = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    state = sums(now)
    for _ in range(most):
        if state[0] == 0:
            break
        now = saved(star(star(now, True), False))
        before, state = state, sums(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not stable after {most} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
