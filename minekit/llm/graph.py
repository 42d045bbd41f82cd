"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.scale import settle


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) for every node of the links ``a, b``.

    Alternating stars: each node first sends its larger neighbours, then its smaller ones, to the smallest node it
    knows. Every round is written to the shared folder, only its count and checksum reach the driver; the number of
    rounds grows with the logarithm of the longest chain.
    """
    stars = settle(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    seen = None
    while True:
        state = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m") % 1_000_003).alias("h")).first()
        if (state["n"], state["h"]) == seen:
            break
        seen = (state["n"], state["h"])
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(stars.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("least").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(low, "v")
        moved = small.where("m <> least").select(F.col("m").alias("v"), F.col("least").alias("m"))
        stars = settle(small.select("v", F.col("least").alias("m")).unionByName(moved).distinct())
    return stars.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(
        stars.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    )
