"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node (pre-aggregated before its shuffle) and a join back, so a hub with very many edges is
split like any skewed join. Steps are written to the shared folder; neither edges nor labels are collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b. Large: neighbours above a node go to its least neighbour; small: those below it do, and itself."""
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, both["a"] == least["u"])
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """edges (a, b) of bigints, in any direction. Returns (node, component): the least node that each node reaches."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == seen or not sums[0]:
            break
        seen, before = tuple(sums), now
        now = materialize(_star(_star(now, True), False), label)
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
