"""Connected components by alternating large-star and small-star steps, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star: every greater neighbour of a node is tied to its least neighbour (or itself).
    Small star: the same with every node's smaller neighbours and the node itself."""
    ends = edges
    if both:
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = ends.join(least, "u")
    if both:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node that it reaches.

    A node with very many neighbours is pre-aggregated and its join split by adaptive execution; each
    round is written to the shared folder, and rounds grow as the logarithm of the longest path.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = frames.materialise(now, "edges"), None
    for _ in range(rounds):
        now = frames.materialise(_star(_star(now, True), False), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
