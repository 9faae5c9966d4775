"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import remove, written_to


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row (node, component) per node of the undirected edges; component is the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
    MapReduce and Beyond" (2014): each step hangs the neighbours of a node on the smallest of them,
    until the graph is a set of stars. That takes O(log^2 n) rounds. A step is an aggregation, which
    combines before the shuffle, and a shuffle join, which adaptive execution splits where a node is
    hot. Each round ends in a table in the shared folder, so lost executors cost one round, and the table
    before it goes; only whether stars are left to make reaches the driver. Edges that are stars already, as
    searches from hubs give them, take no round; the given edges should be a table.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    e, path = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), None
    while not _stars(e):
        after, next_path = written_to(_small_star(_large_star(e)))
        if path is not None:
            remove(spark, path)
        e, path = after, next_path
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none who has one is the smaller neighbour of another."""
    upper = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    return upper.where("n > 1").isEmpty() and e.join(upper.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Neighbours that are larger than a node move to the smallest of its neighbours and itself."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
