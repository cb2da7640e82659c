"""List ranking by pointer doubling: places in lists that only their links tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.steps import Steps


def ranked(steps: Steps, elements: DataFrame) -> DataFrame:
    """(x, next, dist, least, done): where each x leads to, how far that is, and the least on the way.

    elements: x and next of one type, next being x itself for the last of a list, dist 0 there and 1 for others, least of
    any type, done for the last ones. Each round doubles how far a pointer reaches, and what is done stays. It ends when
    every x is done, or when nothing changes for the others: they lie in circles, whose least they then know.
    """
    now, seen = steps.kept(elements, "ranks"), None
    while True:
        state = now.agg(F.count_if(~F.col("done")).alias("open"), F.sum(F.when(~F.col("done"), F.xxhash64("x", "least").cast("decimal(38,0)"))).alias("mark")).first()
        if not state.open or state == seen:
            return now
        seen = state
        there = now.select(F.col("x").alias("next"), F.col("next").alias("next_"), F.col("dist").alias("dist_"), F.col("least").alias("least_"), F.col("done").alias("done_"))
        far = now.where("not done").join(there, "next").select("x", F.col("next_").alias("next"), (F.col("dist") + F.col("dist_")).alias("dist"), F.least("least", "least_").alias("least"), F.col("done_").alias("done"))
        now = steps.kept(now.where("done").unionByName(far), "ranks")
