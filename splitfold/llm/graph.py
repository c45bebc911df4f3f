"""Connected components by alternating large-star and small-star rounds; nothing but two totals reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitfold.llm.common import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node of its component.

    Empty edges give no rows; loops, repeated edges and both directions of one edge are allowed. Each round is written
    to the shared checkpoint folder. Minima are taken with map-side aggregation and joined back, so a node with very many
    edges costs no more in one task than a split of a skewed join.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = cut(_ordered(edges))
    total = _total(now)
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        if (after := _total(now)) == total:
            break
        total = after
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _total(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest of the node and its neighbours."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
    joined = both.where("v > u").join(lowest.withColumnRenamed("a", "u"), "u", "left")
    return joined.select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(lowest, "a")
    return joined.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
