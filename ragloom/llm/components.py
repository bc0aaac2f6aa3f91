"""Connected components of a graph that no single machine holds.

Alternating large-star and small-star steps: each is one aggregation with
map-side combining and one join, each round is written to the shared folder,
and the rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b.  Large: over all neighbours of a vertex; small: over its smaller ones."""
    if large:
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("n")))
        least = both.groupBy("v").agg(F.min("n").alias("m")).select("v", F.least("v", "m").alias("m"))
        # (n, m) for the neighbours n > v: these are the edges seen from their smaller end
        linked = edges.select(F.col("b").alias("v"), F.col("a").alias("n")).join(least, "v").select(F.col("n").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of the links (a, b); root is the least vertex of its component.

    Loops and repeated links are fine; an empty table gives an empty table.
    Vertices without links are not listed.  Keys are longs.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    held = common.durable(ordered, "links")
    mark = None
    while True:
        turned = common.durable(_star(_star(held, True), False), "links")
        now = turned.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        common.discard(held)
        held = turned
        if now == mark:
            break
        mark = now
    roots = held.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
