"""Distributed connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.base import cut


def _least(edges: DataFrame) -> DataFrame:
    """The least smaller neighbour of each node that has one; cut, so that its join is a plain one, whose skew Spark splits."""
    return cut(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")))


def _round(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node a to the smaller b.

    Large star: a moves from b to the least neighbour of b. Small star: all smaller neighbours of a move to the least
    of them. A node with many neighbours is only ever the many side of a join.
    """
    low = _least(edges)
    far = cut(edges.join(low, edges["b"] == low["u"], "left").select("a", F.coalesce("m", "b").alias("b")).distinct())
    low = _least(far)
    near = far.join(low, far["a"] == low["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return cut(near.union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges (a, b) -> (node, component): the least node reachable, for every node with an edge.

    Null ends and self-loops are dropped. Each round's edges are checkpointed to the shared folder; rounds grow with
    the logarithm of the longest path. No node's neighbours are ever gathered into one row.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most):
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            break
        mark, edges = tuple(row), _round(edges)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
