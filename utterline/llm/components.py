"""Connected components by alternating large-star and small-star steps, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or, with itself, smaller) neighbours are linked to its least neighbour.

    Least neighbours come from a map-side minimum and are staged, so that Spark's adaptive skew join can deal a hub's edges over tasks:
    an aggregate right below the join would keep it from that.
    """
    near = _both(edges) if large else _both(edges).where("b < a")
    least = stage(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    out = near.join(least, "a").where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Every node has one smaller neighbour and no larger one, or larger ones alone."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of every node with an edge to another. Null ends are ignored."""
    now = stage(edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        now = stage(_star(stage(_star(now, True), "edges"), False), "edges")
    raise RuntimeError("components did not settle")
