"""The algebra of TSP instances: inverted and scaled distances, padded matrices, tours back to names.

Tours and trees come from outside programs, whose files the readers parse; no solver runs here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the export format: the city that turns a cycle to a path, nodes below which padding is added, how many
#: copies are added, and the largest weight.
DUMMY, SMALL, COPIES, LARGEST = "_DUMMY_CITY_SEPARATOR_", 35, 35, 10000


def inverted(dists: DataFrame, by: list[str]) -> DataFrame:
    """Distances subtracted from the largest of their group: the shortest path becomes the longest."""
    top = dists.groupBy(*by).agg(F.max("dist").alias("_top"))
    return dists.join(F.broadcast(top), by).withColumn("dist", F.col("_top") - F.col("dist")).drop("_top")


def scaled(dist: Column, largest: Column) -> Column:
    """Weights that fit the solver: above LARGEST all are divided to it, rounded half-even, and at least 1."""
    return F.when(largest > LARGEST, F.greatest(F.lit(1), F.rint(dist / (largest / float(LARGEST))).cast("int"))).otherwise(dist.cast("int"))


def selected_pairs(dists: DataFrame, selected: DataFrame, column: str = "name") -> DataFrame:
    """Distances both of whose ends are selected."""
    a, b = selected.select(F.col(column).alias("name_i")), selected.select(F.col(column).alias("name_j"))
    return dists.join(a, "name_i", "left_semi").join(b, "name_j", "left_semi")


def _filled(cells: Column, n: Column) -> Column:
    """Weights of a row of n places from its known cells (pb, w) in order of pb; what lies between them is 0."""
    gap = lambda c, i: c["pb"] - F.when(i == 0, 0).otherwise(F.get(cells, i - 1)["pb"] + 1)
    parts = F.transform(cells, lambda c, i: F.concat(F.array_repeat(F.lit(0), gap(c, i)), F.array(c["w"])))
    behind = n - F.when(F.size(cells) > 0, F.get(cells, F.size(cells) - 1)["pb"] + 1).otherwise(0)
    return F.concat(F.flatten(parts), F.array_repeat(F.lit(0), behind))


def instance_rows(dists: DataFrame) -> DataFrame:
    """(pos, key, weights): the full matrix of one weighting of (name_i, name_j, dist) with a dummy city and padding.

    Few keys get COPIES copies of the first one; equal keys are 0 apart, and so are keys without a distance. Only the
    numbers of places travel with the weights; zeros are filled in within each row.
    """
    listed = dists.select(F.explode(F.array("name_i", "name_j")).alias("key")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    keys = F.concat(F.array(F.lit(DUMMY)), F.col("keys"), F.when(F.size("keys") < SMALL, F.array_repeat(F.col("keys")[0], COPIES)).otherwise(F.array().cast("array<string>")))
    whole = listed.select(keys.alias("keys"))
    places = whole.select(F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
    top = dists.agg(F.max("dist").alias("top"))
    weights = dists.where("name_i <> name_j").crossJoin(F.broadcast(top)).select("name_i", "name_j", scaled(F.col("dist"), F.col("top")).alias("w"))
    a, b = places.select(F.col("pos").alias("pa"), F.col("key").alias("name_i")), places.select(F.col("pos").alias("pb"), F.col("key").alias("name_j"))
    above = weights.join(a, "name_i").join(b, "name_j").select("pa", "pb", "w")
    rows = above.union(above.select("pb", "pa", "w")).groupBy("pa").agg(F.array_sort(F.collect_list(F.struct("pb", "w"))).alias("cells"))
    none = F.array().cast("array<struct<pb:int,w:int>>")
    held = places.join(rows, places.pos == rows.pa, "left").withColumn("cells", F.coalesce("cells", none))
    return held.select("pos", "key", _filled(F.col("cells"), F.col("n")).alias("weights"))


def checked_tour(dim: Column, tour: Column, keys: Column) -> Column:
    """The tour, if it is a permutation of `dim` nodes from the dummy on and there are as many keys; else an error."""
    sound = (F.size(tour) == dim) & (F.size(keys) == dim) & (F.array_sort(tour) == F.sequence(F.lit(0), dim - 1)) & (F.element_at(keys, tour[0] + 1) == DUMMY)
    return F.when(sound, tour).otherwise(F.raise_error(F.concat(F.lit("no tour from the dummy through all nodes of dimension "), dim.cast("string"))).cast("array<int>"))


def decoded_tour(tour: Column, keys: Column) -> Column:
    """Names of a tour in order: dummies go, of repeated names the first stays."""
    return F.array_distinct(F.filter(F.transform(tour, lambda i: F.element_at(keys, i + 1)), lambda k: ~k.startswith("_DUMMY_")))
