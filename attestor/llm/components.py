"""Connected components of an edge table by repeated contraction; no part of the graph goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that ``edges`` (a, b; no loops) names.

    In each round a node points to its smallest neighbour, pointers are followed twice, and the edges move to the
    ends of the pointers; self loops go. Each round shrinks a path to a quarter at worst.
    """
    cur = work.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        parent = work.keep(parent)
        step = parent.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        jumped = parent.join(step, "to").select("node", F.col("to2").alias("to"))
        jumped = work.keep(jumped.join(step, "to").select("node", F.col("to2").alias("to")))
        if labels is None:
            new = jumped.select("node", F.col("to").alias("component"))
        else:
            new = labels.join(jumped.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        new = work.keep(new)
        ends = jumped.select("node", "to")
        moved = cur.join(ends.toDF("a", "a2"), "a").join(ends.toDF("b", "b2"), "b").where("a2 <> b2").select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct()
        moved = work.keep(moved)
        work.drop(cur, parent, jumped, *([labels] if labels is not None else []))
        cur, labels = moved, new
    return labels if labels is not None else cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
