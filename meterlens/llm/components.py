"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long, not null) -> one row per linked node: node, component (its smallest node).

    Each round, every node's larger neighbours move to its smallest one, then the
    smaller ones do, until the links are stars around smallest nodes: no node has a
    smaller neighbour and another one beside it. Links that are so at first take no round,
    and no round only confirms the last one. The number of rounds grows with the
    logarithm of the longest path. Minima and numbers of neighbours are partially
    aggregated before a shuffle, so a node with very many links is no task's burden.
    """
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        neighbours = both.groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("smaller"), F.count("*").alias("all"))
        if not neighbours.filter("smaller > 0 and all > 1").limit(1).count():
            break
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = stored(small, "small-star")
        dropped(large)
        dropped(now)
        now = small
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
