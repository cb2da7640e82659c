"""The whole run: every planned run from incidence tables to scores, kept by partitions, and resumed where it stopped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.steps import Steps
from ..operators import evaluate, matrix, orders, sampling, trees
from ..sources.readers import exists
from .config import Config, planned_runs

#: Columns that tell runs apart; results are stored by them.
KEY = ["dataset", "k", "n", "method", "type"]


@dataclass(frozen=True)
class Inputs:
    """A dataset: incidence (row_id, color), lengths (row_id, seq_len), colors (color, name), and orders of outside
    programs (method, type, pos, name), if there are any."""

    incidence: DataFrame
    lengths: DataFrame
    colors: DataFrame
    given: DataFrame | None = None


def grown_order(method: str, dists: DataFrame, columns: DataFrame, seed: int) -> DataFrame:
    """(type, pos, name) of the orders that Spark makes itself.

    dists: (type, i, j, dist) of the columns (color, name). optimal and worst: tours around the least spanning trees of the
    distances and of the inverted ones; upgma: leaves of average-linkage trees; randomized: a seeded shuffle.
    """
    if method == "randomized":
        shuffled = sampling.random_order(columns.select("name"), "name", seed)
        return dists.select("type").distinct().crossJoin(F.broadcast(shuffled)).select("type", "pos", "name")  # a matrix side, three times
    if method == "upgma":
        found = trees.average_linkage(dists, columns.select(F.col("color").alias("column")))[1]
    elif method in ("optimal", "worst"):
        found = trees.tour_order(trees.spanning_tree(orders.inverted(dists, ["type"]) if method == "worst" else dists))
    else:
        raise ValueError(f"no order {method} is given, and none can be made")
    return found.join(columns, F.col("column") == F.col("color")).select("type", "pos", "name")


def finished_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of the runs whose results lie in `folder`."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "dataset string, k int, n int, method string, type string")
    return results(spark, folder).select(*KEY).distinct()


def results(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset, k, n, method, type, n_bit_changes, n_runs, n_cylinder_runs) of all finished runs."""
    schema = "n_bit_changes long, n_runs long, n_cylinder_runs long, dataset string, k int, n int, method string, type string"
    return spark.read.schema(schema).parquet(folder).select(*KEY, "n_bit_changes", "n_runs", "n_cylinder_runs")


def run_all(spark: SparkSession, config: Config, datasets: dict[str, Inputs], folder: str) -> list[tuple]:
    """Do all planned runs that have no result in `folder` yet; returns the keys (dataset, k, n, method) that were done.

    Each dataset is run for each k and each sample size of its columns, under all enabled methods and weightings. A sample
    takes the first n columns of a seeded shuffle. Results of a method replace just their own partitions. A run that fails
    leaves no result and does not stop the others; one RuntimeError tells all failures at the end. Sizes, methods and
    weightings are few: the loop is over options, all data stays in Spark.
    """
    steps = Steps(spark)
    totals = [(d, x.colors.count()) for d, x in datasets.items()]
    sizes = spark.createDataFrame([(d, n, config.sampling_steps) for d, n in totals], "dataset string, total long, steps int")
    planned = planned_runs(spark, config, sampling.sample_sizes(sizes, "total", "steps").select("dataset", F.col("n").cast("int").alias("n")))
    open_ = planned.join(finished_runs(spark, folder), KEY, "left_anti").groupBy("dataset", "k", "n", "method").agg(F.collect_set("type").alias("types"))
    todo = sorted((r.dataset, r.k, r.n, r.method, sorted(r.types)) for r in open_.collect())
    done, failed, now = [], [], None
    for dataset, k, n, method, types in todo:
        x = datasets[dataset]
        try:
            if now != (dataset, k):
                sets = steps.kept(matrix.weighted_sets(matrix.row_sets(x.incidence), x.lengths, k), "sets")
                dists = steps.kept(matrix.distances_hybrid(sets, x.colors, x.colors.count()), "dists")
                rows, now = steps.kept(matrix.row_counts(sets), "rows"), (dataset, k)
            columns = x.colors.join(sampling.selection(x.colors.select("name"), "name", n, config.random_seed), "name").select("color", "name")
            chosen = orders.selected_pairs(dists.where(F.col("type").isin(types)), columns)
            of_method = x.given.where((F.col("method") == method) & F.col("type").isin(types)) if x.given is not None else None
            if n < 2:  # no step, no distance: one run in each row
                zero = F.lit(0).cast("long")
                scored = rows.where(F.col("type").isin(types)).select("type", zero.alias("n_bit_changes"), F.col("num_rows").alias("n_runs"), zero.alias("n_cylinder_runs"))
            else:
                if of_method is not None and not of_method.isEmpty():
                    order = of_method.join(columns, "name", "left_semi").select("type", "pos", "name")
                else:
                    order = grown_order(method, chosen.select("type", "i", "j", "dist"), columns, config.random_seed)
                scored = evaluate.order_runs(order.select(F.col("type").alias("key"), "pos", "name"), chosen, rows).where(F.col("key") == F.col("type"))
            keyed = scored.select(F.lit(dataset).alias("dataset"), F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(method).alias("method"), "type", "n_bit_changes", "n_runs", "n_cylinder_runs")
            keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY).parquet(folder)
            done.append((dataset, k, n, method))
        except Exception as fault:  # told below; other runs go on
            failed.append(f"{dataset} k={k} n={n} {method}: {str(fault).splitlines()[0] if str(fault) else type(fault).__name__}")
    if failed:
        raise RuntimeError("; ".join(failed))
    return done
