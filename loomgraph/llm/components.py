"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Links each neighbour of a node to the least of them and the node: larger ones, or smaller ones
    and the node itself."""
    if small:
        own = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        own = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = own.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = own.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, label) for every node of edges(u, v): the least node of its component.

    Takes a number of rounds that grows with the logarithm of the size; each is a few joins on the
    shrinking links, written to the shared folder. Loops and repeated links don't matter.
    """
    scratch = Scratch(edges.sparkSession)
    edges = scratch.written(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    state = None
    for _ in range(most_rounds):
        before, scratch = scratch, Scratch(edges.sparkSession)
        edges = scratch.written(_stars(_stars(edges, small=False), small=True), "links")
        before.drop()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
