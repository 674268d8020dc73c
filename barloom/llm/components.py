"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: link each larger neighbour of u to u's smallest one. Small star: the same for u and its smaller neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")) if large else side.groupBy("u").agg(F.min("v").alias("m"))
    joined = both.where("v > u").join(least, "u") if large else side.join(least, "u")
    moved = joined.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("u"))
    if not large:
        moved = moved.union(least.select(F.col("u").alias("v"), F.col("m").alias("u")))
    return moved.where("u <> v").distinct().select("u", "v")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``links`` (u, v): label is the smallest node that it is connected with.

    Each round is written to the shared folder; groups are only ever reduced by
    min, so a node with any number of neighbours is no large group.
    """
    links = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()
    for _ in range(rounds):
        links = stash(_star(_star(links, True), False), "links")
        ends = links.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(links.select("u", F.lit(0), F.lit(1)))
        # settled: nodes hang on one other at most, and not on one that hangs itself
        loose = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below > 0 and above > 0)")
        if loose.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    return links.select(F.col("v").alias("node"), F.col("u").alias("label")).union(roots)
