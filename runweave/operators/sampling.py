"""Seeded shuffles, nested samples and sample sizes."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import half_even


def seeded_key(seed: int, line: Column) -> Column:
    """Sort key of the distributed shuffle: md5 of seed and line."""
    return F.md5(F.concat(F.lit(f"{seed}:"), line))


def shuffled_lines(lines: list[str], seed: int) -> list[str]:
    """The lines in the order of Python's seeded shuffle, for manifests, which fit the driver. Line ends stay with their lines."""
    out = list(lines)
    random.Random(seed).shuffle(out)
    return out


def selection(items: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """The first n items of the seeded shuffle, sorted. Smaller n give subsets. A top-n: no global sort."""
    return items.select(column).orderBy(seeded_key(seed, F.col(column)), column).limit(n).orderBy(column)


def random_order(selected: DataFrame, column: str, seed: int) -> DataFrame:
    """(pos, name): the seeded shuffle of a selection; selections are columns of a matrix, few enough for one window."""
    at = F.row_number().over(Window.orderBy(seeded_key(seed, F.col(column)), column)) - 1
    return selected.select(at.alias("pos"), F.col(column).alias("name"))


def sample_sizes(totals: DataFrame, total: str, steps: str) -> DataFrame:
    """Each row with its sample sizes: the total alone for 0 steps, else 1, the total, and 10**(e / steps) between, rounded half-even."""
    t, c = F.col(total), F.col(steps)
    top = F.ceil(F.log10(F.greatest(t, F.lit(1)).cast("double")) * c).cast("int")
    powers = F.transform(F.sequence(F.lit(0), top), lambda e: F.greatest(F.lit(1).cast("long"), F.least(t.cast("long"), half_even(F.pow(F.lit(10.0), e / c)).cast("long"))))
    sizes = F.when(c == 0, F.array(t.cast("long"))).otherwise(F.array_distinct(F.concat(F.array(F.lit(1).cast("long"), t.cast("long")), powers)))
    return totals.select("*", F.explode(sizes).alias("n"))
