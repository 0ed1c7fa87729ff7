"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v) with u > v: every node points its larger (or smaller) neighbours to its least one."""
    if large:
        out = edges.select(F.col("u").alias("n"), F.col("v").alias("x")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("x")))
    else:
        out = edges.select(F.col("u").alias("n"), F.col("v").alias("x"))
    least = out.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("n", "m").alias("m"))
    moved = out.join(least, "n").filter(F.col("x") > F.col("n") if large else F.col("x") != F.col("m")).select(F.col("x").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def starred(edges: DataFrame) -> bool:
    """Whether every u has one v and no v is a u, so that the edges are the components."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    open_ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1")
    return not open_ends.limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, component), component the least node reachable, for every node with an edge of (u, v)."""
    edges = saved(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not starred(edges):
        edges = saved(star(star(edges, True), False))
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
