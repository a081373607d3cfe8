"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges come with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of an orderable type → ``(u, v)``: each node but the least of its component, with that least node.

    Alternates the large-star and small-star steps, each of them joins and
    minima over the edges only, so a component is never in one task. Nodes
    without an edge are absent. Raises if ``max_rounds`` do not settle it.
    """
    now = pin(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    if now.isEmpty():
        return now
    for _ in range(max_rounds):
        before, now = now, pin(_small_star(_large_star(now).distinct()).distinct())
        # both are sets of edges: of equal size and with nothing new, they are the same
        if now.count() == before.count() and now.join(before, ["u", "v"], "left_anti").isEmpty():
            return now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
