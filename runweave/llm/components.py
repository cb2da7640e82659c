"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b: long, not null) can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Minima are aggregated map-side before they are
    joined back, so the neighbours of a hub are never gathered; the edges of each round are written and reread, and
    those of the round before removed. The number of rounds grows with the logarithm of the graph; reaching `rounds`
    raises an error instead of returning something half done. No edges: no rows.
    """
    now, path = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == seen or size[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = size
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, (now, path) = path, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        remove(edges.sparkSession, before)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
