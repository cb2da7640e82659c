"""From an incidence table and given column orders to scores, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import leaves
from ..operators import evaluate, matrix
from .config import Config


def tree_orders(trees: DataFrame, method: str) -> DataFrame:
    """(method, type, pos, name): the leaves of (type, tree), of a tree that an outside program built."""
    return trees.select(F.lit(method).alias("method"), "type", F.posexplode(leaves(F.col("tree"))).alias("pos", "name"))


def tour_orders(tours: DataFrame, method: str) -> DataFrame:
    """(method, type, pos, name): the names of (type, names), of a decoded tour that an outside solver found."""
    return tours.select(F.lit(method).alias("method"), "type", F.posexplode("names").alias("pos", "name"))


def scored_orders(incidence: DataFrame, lengths: DataFrame, colors: DataFrame, orders: DataFrame, config: Config, k: int, n: int) -> DataFrame:
    """(method, type, n_bit_changes, n_runs, n_cylinder_runs) of each given order of an enabled method and weighting.

    incidence: (row_id, color); lengths: (row_id, seq_len); colors: n rows (color, name), color from 0; orders: (method,
    type, pos, name). A single column has one order, without changes. Nothing runs before the result is asked for.
    """
    chosen = orders.where(F.col("method").isin(config.on_methods) & F.col("type").isin(config.on_matrices))
    sets = matrix.weighted_sets(matrix.row_sets(incidence), lengths, k)
    rows = matrix.row_counts(sets)
    if n < 2:
        zero = F.lit(0).cast("long")
        return chosen.select("method", "type").distinct().join(rows, "type").select("method", "type", zero.alias("n_bit_changes"), F.col("num_rows").alias("n_runs"), zero.alias("n_cylinder_runs"))
    keyed = chosen.select(F.concat_ws("/", "method", "type").alias("key"), "pos", "name")
    scored = evaluate.order_runs(keyed, matrix.distances_hybrid(sets, colors, n), rows)
    return scored.where(F.substring_index("key", "/", -1) == F.col("type")).select(F.substring_index("key", "/", 1).alias("method"), "type", "n_bit_changes", "n_runs", "n_cylinder_runs")
