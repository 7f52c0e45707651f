"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the smallest of it and its neighbours."""
    pairs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = common.written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # the join is then of plain exchanges, whose hubs Spark can split
    out = common.written(pairs.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
    common.removed(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours (few, hubs are small) move to the smallest of them."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return common.written(moved.filter("u <> v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the smallest node that it reaches.

    Every round is written to the shared folder. It ends when each node hangs on one other that hangs on none.
    """
    edges = common.written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def settled(df: DataFrame) -> bool:
        ends = df.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(df.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return not nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("n")).first()["n"]

    while not settled(edges):
        large = _large(edges)
        small = _small(large)
        common.removed(edges, large)
        edges = small
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
