"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges`` (columns ``a``, ``b``): the smallest node reachable.

    Each round is two shuffles with map-side minima and is written to the
    shared folder; stars of any size are joined, never gathered in a row.
    Self-loops and repeated edges are harmless; no edges give no rows.
    """
    e = common.stage(edges.where("a != b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        e = common.stage(_small_star(_large_star(e)).where("u != v").distinct(), "stars")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == seen:
            break
        seen = now
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(e.select("v", "v").distinct())
