"""Tables of all runs and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import run_key


def final_runs(lines: DataFrame) -> DataFrame:
    """(path, dataset, method, k, n, type, n_bit_changes, n_runs, n_cylinder_runs) from (path, key, value) lines."""
    keys = ["n_bit_changes", "n_runs", "n_cylinder_runs"]
    wide = lines.groupBy("path").pivot("key", keys).agg(F.first("value"))
    return wide.select("path", run_key(F.col("path")).alias("r"), *keys).select("path", "r.*", *keys)


def timing_summary(runs: DataFrame) -> DataFrame:
    """For each experiment: mean, sample deviation, least, median and largest real_s of its ok runs; counts by status over all.

    runs: (experiment, run, real_s, status, command). The deviation of fewer than two runs is null.
    """
    ok = F.col("status") == "ok"
    real = F.when(ok, F.col("real_s"))
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "failed", "timeout", "timing_error")]
    return runs.groupBy("experiment").agg(
        F.avg(real).alias("mean_s"), F.stddev_samp(real).alias("stddev_s"), F.min(real).alias("min_s"), F.median(real).alias("median_s"), F.max(real).alias("max_s"),
        *counts, F.max_by("status", "run").alias("last_status"), F.min_by("command", "run").alias("first_command"),
    )


def first_lines(lines: DataFrame) -> DataFrame:
    """(value, pos): repeated lines go, the first stays in its place."""
    return lines.groupBy("value").agg(F.min("pos").alias("pos"))


def collected_timings(lines: DataFrame) -> DataFrame:
    """(part, value): the distinct lines of all timing tables, the header as part 0 and all others as part 1, in this order.

    lines: (path, pos, value). The header is the first line of the first path.
    """
    header = lines.agg(F.min_by("value", F.struct("path", "pos")).alias("header"))
    parted = lines.select("value").distinct().crossJoin(F.broadcast(header)).select((F.col("value") != F.col("header")).cast("int").alias("part"), "value")
    return parted.orderBy("part", "value")
