"""Writers: distance tables, TSP instances, orders, runs, final tables, manifests and vertical statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import kmers
from ..functions.steps import Steps


def write_distances(dists: DataFrame, path: str) -> None:
    """Distance tables as Parquet, a folder for each weighting."""
    dists.write.mode("overwrite").option("compression", "zstd").partitionBy("type").parquet(path)


def distance_lines(dists: DataFrame) -> DataFrame:
    """Lines `name_i<TAB>name_j<TAB>dist` in the order of color ids."""
    return dists.orderBy("i", "j").select(F.concat_ws("\t", "name_i", "name_j", F.col("dist").cast("string")).alias("value"))


def tsplib_lines(matrix: DataFrame, name: str = "instance") -> DataFrame:
    """(line, value): a TSP instance from rows (pos, key, weights), the keys in its comment."""
    keys = matrix.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key"))), lambda x: x["key"]), ",").alias("keys"), F.count("*").alias("n"))
    head = keys.select(F.posexplode(F.array(F.lit(f"NAME : {name}"), F.concat(F.lit("COMMENT : keys:"), "keys"), F.lit("TYPE : TSP"), F.concat(F.lit("DIMENSION : "), F.col("n").cast("string")), F.lit("EDGE_WEIGHT_TYPE : EXPLICIT"), F.lit("EDGE_WEIGHT_FORMAT : FULL_MATRIX"), F.lit("EDGE_WEIGHT_SECTION"))).alias("line", "value"))
    rows = matrix.select((F.col("pos") + 7).alias("line"), F.array_join("weights", " ").alias("value"))
    end = keys.select((F.col("n") + 7).alias("line"), F.lit("EOF").alias("value"))
    return head.union(rows).union(end).orderBy("line")


def order_lines(orders: DataFrame) -> DataFrame:
    return orders.orderBy("pos").select(F.col("name").alias("value"))


def run_lines(runs: DataFrame) -> DataFrame:
    """(key, value) in the order of a runs file, behind the other columns of `runs`."""
    keys = ("n_bit_changes", "n_runs", "n_cylinder_runs")
    others = [c for c in runs.columns if c not in keys]
    return runs.select(*others, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys])).alias("x")).select(*others, "x.*")


def write_final(runs: DataFrame, path: str) -> None:
    """The table of all runs with a header, ordered by path as a string (so N10 comes before N2)."""
    runs.orderBy("path").drop("path").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def manifest_lines(paths: DataFrame) -> DataFrame:
    return paths.select("path").distinct().orderBy("path")


def metadata_with_kmers(meta: DataFrame, n_kmers: DataFrame) -> DataFrame:
    """(key, value) with a num_kmers line where there was none; inputs are never changed."""
    missing = n_kmers.select(F.lit("num_kmers").alias("key"), F.col("n_kmers").cast("string").alias("value"))
    return meta.unionByName(missing.join(meta.select("key"), "key", "left_anti"))


def vertical(stats: DataFrame, key: str) -> DataFrame:
    """(key, column, value): one row for each statistic, all as text, NA where missing."""
    cols = [c for c in stats.columns if c != key]
    return stats.select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in cols]).unpivot([key], cols, "column", "value")


def color_set_line(color_set_id: Column, colors: Column) -> Column:
    return F.concat_ws(" ", F.concat(F.lit("color_set_id="), color_set_id), F.concat(F.lit("size="), F.size(colors).cast("string")), F.array_join(F.transform(colors, lambda c: c.cast("string")), " "))


def color_set_lines(sets: DataFrame) -> DataFrame:
    """(value): lines of a color-set dump, in the order of ids."""
    return sets.orderBy("color_set_id").select(color_set_line(F.col("color_set_id"), F.col("colors")).alias("value"))


def unitig_records(unitigs: DataFrame, width: int = 60) -> DataFrame:
    """(value): FASTA records of (unitig_id, color_set_id, sequence), without the `>` that parts them; lines of `width`."""
    head = F.concat(F.lit(" unitig_id="), F.col("unitig_id").cast("string"), F.lit(" color_set_id="), F.col("color_set_id").cast("string"))
    rest = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    return unitigs.select(F.concat(head, F.lit("\n"), rest, F.lit("\n")).alias("value"))


def write_unitigs(unitigs: DataFrame, path: str, width: int = 60) -> None:
    """A FASTA file for each partition."""
    unitig_records(unitigs, width).select(F.concat(F.lit(">"), F.regexp_replace("value", "\n$", "")).alias("value")).write.mode("overwrite").text(path)


def timing_lines(timings: DataFrame, columns: list[str]) -> DataFrame:
    """(value): tab-separated lines of the columns, NA where null."""
    return timings.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]).alias("value"))


def bit_matrix_lines(rows: DataFrame, names: list[str]) -> DataFrame:
    """(pos, value): a header of names and a line of bits for each (row_id, colors), row_id from 0."""
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda c: F.when(F.array_contains("colors", c), "1").otherwise("0")), "")
    header = rows.sparkSession.createDataFrame([(0, "\t".join(names))], "pos long, value string")
    return header.unionByName(rows.select((F.col("row_id") + 1).cast("long").alias("pos"), bits.alias("value")))


def metadata_lines(unitigs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """(value): lines of a dump's metadata, from (sequence) and (color_set_id)."""
    lines = lambda n, name: n.select(F.concat(F.lit(f"num_{name}="), F.col("n").cast("string")).alias("value"))
    kmer_sum = unitigs.agg(F.coalesce(F.sum(kmers(F.length("sequence"), k)), F.lit(0)).cast("long").alias("n"))
    return lines(unitigs.agg(F.count("*").alias("n")), "unitigs").union(lines(kmer_sum, "kmers")).union(lines(sets.agg(F.count("*").alias("n")), "color_sets"))


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """`rows` with numbers from 0 in the order of `by`, which must tell them apart: from a range sort and the counts of its parts."""
    steps = Steps(rows.sparkSession)
    ranged = steps.kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33).alias("_part")
    counts = ranged.groupBy(part).agg(F.min("_at").alias("_base"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("_part", (before - F.col("_base")).alias("_shift"))  # a row for each part of the sort
    return ranged.withColumn("_part", part).join(F.broadcast(shift), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def dump_tables(unitigs: DataFrame, colors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(color_set_id, colors) and (unitig_id, color_set_id, sequence) of a coloured graph (unitig, names, sequence).

    colors: (color, name). Sets are numbered in the order of their colors, unitigs in that of their sequences and places.
    """
    steps = Steps(unitigs.sparkSession)
    unitigs = steps.kept(unitigs.select("unitig", "names", "sequence"))  # read three times
    sets = unitigs.select("names").distinct()
    listed = sets.select("names", F.explode("names").alias("name")).join(colors, "name").groupBy("names").agg(F.array_sort(F.collect_list("color")).alias("colors"))
    ids = steps.kept(numbered(listed, ["colors"], "color_set_id"))
    joined = unitigs.join(ids.select("names", "color_set_id"), "names").select("color_set_id", "sequence", "unitig")
    return ids.select("color_set_id", "colors"), steps.kept(numbered(joined, ["sequence", "unitig"], "unitig_id").select("unitig_id", "color_set_id", "sequence"))


def write_dump(unitigs: DataFrame, colors: DataFrame, k: int, folder: str, dataset: str) -> None:
    """A whole index dump in `folder`: color sets, unitigs and metadata of a coloured graph; see dump_tables()."""
    sets, records = dump_tables(unitigs, colors)
    stem = f"{folder}/{dataset}_k{k}"
    color_set_lines(sets).write.mode("overwrite").text(f"{stem}.color_sets.txt")
    write_unitigs(records, f"{stem}.unitigs.fa")
    metadata_lines(records, sets, k).coalesce(1).write.mode("overwrite").text(f"{stem}.metadata.txt")
