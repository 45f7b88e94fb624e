"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, small, staged


def _round(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Each node u knows neighbours v; large: those above u move to u's least neighbour (or u itself);
    not large: those below u, and u, do. Only the least neighbour is summed up, so a node with any number of
    neighbours costs one row a task, and the join back is one that Spark can split."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where("v < u")
    least = staged(seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
    joined = seen.join(small(least, 32), F.col("u") == F.col("w"))
    moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    out = staged(moved.where("u <> v").distinct())
    drop(edges, least)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that it reaches) for every node of edges (u, v) with u <> v.

    Large and small stars alternate until a round changes nothing (a number of rounds of the order of the logarithm of
    the size); each round is a written table, and only its fingerprint of two numbers reaches the driver.
    """
    told = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen, is_ = None, told(now)
    while is_ != seen and is_[0]:
        seen = is_
        now = _round(_round(now, large=True), large=False)
        is_ = told(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
