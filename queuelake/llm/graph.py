"""Connected components over edge tables, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.llm.common import save


def _least(edges: DataFrame) -> DataFrame:
    """(node, m): the least node below each node that has edges down. Written, so that a join with it has a plain shuffle on either side, which can be split where a hub is hot."""
    return save(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; a component is named by its least node.

    Each round rewrites the edges twice, so that nodes point ever more directly
    at their component's least node; the number of rounds follows the logarithm
    of the components' diameters. An edge (u, v) is kept once, as v < u: the
    least neighbour of a node is then the least v, and no edge is needed in both
    directions. Each step's edges are written to the shared folder. Self-loops
    and repeated edges do no harm.
    """
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = save(edges.where("a <> b").select(big, small).distinct())
    while True:
        least = _least(now)
        # Large star: what points at v points at the least below v.
        jumps = now.join(least, F.col("v") == F.col("node"), "left")
        rows, jumping = jumps.agg(F.count("*"), F.count("node")).first()
        # Nobody points at two nodes or at one that points on: every component is a star around its least node.
        if not jumping and rows == least.count():
            break
        large = save(jumps.select("u", F.coalesce("m", "v").alias("v")).distinct())
        # Small star: a node and all below it point at the least of them.
        least = _least(large)
        below = large.join(least, F.col("u") == F.col("node")).where("v <> m").select("v", "m")
        now = save(least.unionByName(below.withColumnRenamed("v", "node")).distinct().select(F.col("node").alias("u"), F.col("m").alias("v")))
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(heads)
