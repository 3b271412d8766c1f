"""Connected components of a distributed edge list (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every node's (larger, or other) neighbours are linked to its smallest one."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the smallest node of its component.

    Each round is written to the shared checkpoint folder. The number of rounds grows with the
    logarithm of the longest path; the driver sees one checksum per round.
    """
    now = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v"), "stars")
    mark = _mark(now)
    while mark[0]:
        now = staged(_stars(_stars(now, True), False), "stars")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    return now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root")).union(
        now.select(F.least("u", "v").alias("node"), F.least("u", "v").alias("root"))).distinct()
