"""Scores of column orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def order_runs(orders: DataFrame, dists: DataFrame, num_rows: DataFrame) -> DataFrame:
    """(key, type, n_bit_changes, n_runs, n_cylinder_runs) of each order (key, pos, name) under each weighting.

    dists: (name_i, name_j, type, dist); num_rows: (type, num_rows) of the whole matrix. n_runs counts runs of either
    bit: changes plus rows. n_cylinder_runs adds the step from the last column to the first, but not the rows. A pair
    without a distance raises an error. The few adjacent pairs are the small side of the join, all distances are probed.
    """
    w = Window.partitionBy("key").orderBy("pos")
    near = orders.select("key", "name", F.lead("name").over(w).alias("nxt")).where("nxt is not null")
    ends = orders.groupBy("key").agg(F.min_by("name", "pos").alias("name"), F.max_by("name", "pos").alias("nxt"))
    steps = near.select("key", "name", "nxt", F.lit(1).alias("path")).union(ends.select("key", "name", "nxt", F.lit(0).alias("path")))
    pairs = steps.join(F.broadcast(num_rows)).select("key", "type", "num_rows", "path", F.least("name", "nxt").alias("a"), F.greatest("name", "nxt").alias("b"))
    known = dists.select(F.least("name_i", "name_j").alias("a"), F.greatest("name_i", "name_j").alias("b"), "type", "dist")
    found = pairs.join(known, ["a", "b", "type"], "left").withColumn(
        "dist", F.when(F.col("a") == F.col("b"), 0).when(F.col("dist").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no distance of"), "a", "b")).cast("long")).otherwise(F.col("dist"))
    )
    sums = found.groupBy("key", "type").agg(F.sum(F.col("dist") * F.col("path")).alias("n_bit_changes"), F.sum("dist").alias("n_cylinder_runs"), F.max("num_rows").alias("num_rows"))
    return sums.select("key", "type", "n_bit_changes", (F.col("n_bit_changes") + F.col("num_rows")).alias("n_runs"), "n_cylinder_runs")


def order_checks(orders: DataFrame, n: int) -> DataFrame:
    """(key, n_lines, n_names, is_valid): an order is valid if it has n lines and no name twice."""
    found = orders.groupBy("key").agg(F.count("*").alias("n_lines"), F.countDistinct("name").alias("n_names"))
    return found.withColumn("is_valid", (F.col("n_lines") == n) & (F.col("n_names") == n))
