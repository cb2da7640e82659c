"""Readers of manifests, index dumps, distances, orders, tours, trees, runs, bit matrices and timings."""

from __future__ import annotations

import lzma
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, pos, value): lines of text files, numbered from 0 in each file; block is the start of their split.

    Spark splits only at line ends and keeps file order within a partition; a file's splits are numbered by counts.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", "least", before.alias("start"))
    return lines.join(starts, ["path", "block"]).select("path", "block", (F.col("at") - F.col("least") + F.col("start")).alias("pos"), "value")


def counted(lines: DataFrame, which: Column, name: str) -> DataFrame:
    """`lines` with a running number, from 0 in each path, of those for which `which` holds; null for the others.

    Numbers are counted within blocks, and blocks by their counts: no file is gathered into one task.
    """
    marked = lines.withColumn("which", which)
    sizes = marked.where("which").groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("path", "block", "which").orderBy("pos")) - 1
    starts = sizes.select("path", "block", before.alias("start"))
    return marked.withColumn("inside", inside).join(starts, ["path", "block"], "left").withColumn(name, F.when(F.col("which"), F.col("inside") + F.col("start"))).drop("which", "inside", "start")


def stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"[.][^.]*$", "")


def manifests(spark: SparkSession, glob: str) -> DataFrame:
    """(dataset, pos, line) of all manifests; a glob without files raises Spark's error."""
    return numbered_lines(spark, glob).select(stem(F.col("path")).alias("dataset"), "pos", F.col("value").alias("line"))


def manifest_sizes(lines: DataFrame) -> DataFrame:
    """(dataset, n_lines): all lines, blank ones and comments included."""
    return lines.groupBy("dataset").agg(F.count("*").alias("n_lines"))


def colors(lines: DataFrame) -> DataFrame:
    """(dataset, color, name): color ids are positions among the lines that name a sample.

    A manifest lists samples, which are columns: its size is that of a matrix side, not of the data.
    """
    named = lines.where(N.is_entry(F.col("line")))
    color = F.row_number().over(Window.partitionBy("dataset").orderBy("pos")) - 1
    return named.select("dataset", color.alias("color"), N.sample_name(F.col("line")).alias("name"))


def _file_system(spark: SparkSession, path: str):
    """The path as Spark's file systems know it, and the file system that it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists on its file system, for the places where a names file may lie."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def common_parent(folders: Column) -> Column:
    """Aggregate: the name of the deepest folder that all `folders` (absolute paths) lie in or are; empty for the root.

    What the first and the last path in order have in common, all others between them have too.
    """
    low, high = (f(F.split(F.regexp_replace(folders, "/+$", ""), "/")) for f in (F.min, F.max))
    apart = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.size(low), F.size(high))), lambda i: F.when(~F.get(low, i).eqNullSafe(F.get(high, i)) | F.get(low, i).isNull(), i)), lambda i: i.isNotNull())
    return F.get(F.slice(low, 1, F.get(apart, F.lit(0))), F.get(apart, F.lit(0)) - 1)


def dataset_inputs(spark: SparkSession, given: list[str]) -> tuple[str, DataFrame]:
    """Name of the dataset and its distinct sequence files (path), sorted, from files and folders that a user names.

    Folders are searched with all below; a file must have the suffix of a sequence file. The name is that of the deepest
    folder that holds all that was given. What doesn't exist, another suffix and no file at all are errors. The few paths
    that are given are looked up on the driver, on any file system that Spark reads.
    """
    folders, parts = [], []
    for p in given:
        at, fs = _file_system(spark, p)
        if not fs.exists(at):
            raise FileNotFoundError(p)
        whole = fs.makeQualified(at).toUri().getPath()
        if fs.getFileStatus(at).isDirectory():
            folders.append(whole)
            parts.append(sequence_files(spark, p))
        elif spark.range(1).select(F.lit(whole).rlike(N.SEQUENCE_SUFFIX)).first()[0]:
            folders.append(whole.rsplit("/", 1)[0])
            parts.append(spark.createDataFrame([(fs.makeQualified(at).toString(),)], "path string"))
        else:
            raise ValueError(f"not a sequence file: {p}")
    found = reduce(DataFrame.union, parts).distinct().orderBy("path") if parts else None
    if found is None or found.isEmpty():
        raise FileNotFoundError("no sequence files in " + ", ".join(given))
    return spark.createDataFrame([(f,) for f in folders], "f string").agg(common_parent(F.col("f"))).first()[0], found


def color_sets(spark: SparkSession, path: str, n_colors: int) -> DataFrame:
    return parsed_color_sets(numbered_lines(spark, path), n_colors)


def parsed_color_sets(lines: DataFrame, n_colors: int) -> DataFrame:
    """(color_set_id, colors): sorted distinct colors; ids are given or count the lines without one.

    lines: (path, block, pos, value). Colors outside the manifest, tokens that are no number, and gaps in the ids raise an
    error; of equal ids the last holds.
    """
    tokens = F.split(N.stripped(F.col("value")), r"\s+")
    given = F.regexp_extract("value", r"(?:^|\s)color_set_id=(\d+)", 1)
    numbered = counted(lines.where(N.stripped(F.col("value")) != ""), given == "", "running")
    value = lambda t: F.when(t.rlike(r"^\d{1,9}$") & (t.try_cast("int") < n_colors), t.try_cast("int")).otherwise(F.raise_error(F.concat(F.lit("bad color "), t)).cast("int"))
    listed = F.filter(tokens, lambda t: ~t.startswith("size=") & ~t.startswith("color_set_id="))
    sets = numbered.select("pos", F.when(given != "", given.cast("long")).otherwise(F.col("running")).alias("color_set_id"), F.array_sort(F.array_distinct(F.transform(listed, value))).alias("colors"))
    last = sets.groupBy("color_set_id").agg(F.max_by("colors", "pos").alias("colors"))
    whole = last.agg(F.max("color_set_id").alias("top"), F.count("*").alias("n"))
    checked = last.crossJoin(F.broadcast(whole)).withColumn("ok", F.assert_true(F.col("n") == F.col("top") + 1, "gap in the color set ids"))
    return checked.where("ok is null").select("color_set_id", "colors")


def unitigs(spark: SparkSession, path: str) -> DataFrame:
    return parsed_unitigs(spark.read.option("lineSep", "\n>").text(path))


def parsed_unitigs(records: DataFrame) -> DataFrame:
    """(color_set_id, seq_len): a row for each FASTA record (value); lines of a wrapped sequence are added up."""
    some = records.select(F.regexp_replace("value", r"^>", "").alias("r")).where("trim(r) <> ''")
    head, body = F.split("r", "\n", 2)[0], F.coalesce(F.get(F.split("r", "\n", 2), F.lit(1)), F.lit(""))
    given = F.regexp_extract(head, r"(?:^|\s)color_set_id=(\d+)", 1)
    checked = F.when(given != "", given.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no color set in "), head)).cast("long"))
    return some.select(checked.alias("color_set_id"), F.length(F.regexp_replace(body, r"\s+", "")).cast("long").alias("seq_len"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return parsed_metadata(spark.read.text(path))


def parsed_metadata(lines: DataFrame) -> DataFrame:
    """(key, value) of `key=value` lines."""
    return lines.where(F.col("value").contains("=")).select(F.split_part("value", F.lit("="), F.lit(1)).alias("key"), F.split_part("value", F.lit("="), F.lit(2)).alias("value"))


def xz_lines(content: bytes, size: int = 1 << 20) -> Iterator[list[str]]:
    """The lines of xz data, a list at a time of those that end within the next `size` bytes; streams may follow each other.

    No more than `size` bytes and a broken-off line are ever unpacked at once. Data that ends too early is an error.
    """
    rest, packed = b"", content
    while packed:
        stream = lzma.LZMADecompressor()
        part = stream.decompress(packed, size)
        while True:
            *whole, rest = (rest + part).split(b"\n")
            if whole:
                yield [x.removesuffix(b"\r").decode() for x in whole]
            if stream.eof:
                break
            if stream.needs_input:
                raise EOFError("xz data ends before its end mark")
            part = stream.decompress(b"", size)
        packed = stream.unused_data.lstrip(b"\0")  # padding between streams
    if rest:
        yield [rest.decode()]


def distances(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, dist) of a distance table; plain, gzip or xz."""
    if path.endswith(".xz"):
        def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for name, content in zip(f.path, f.content):
                    at = 0
                    for lines in xz_lines(content):
                        yield pd.DataFrame({"path": name, "pos": range(at, at + len(lines)), "value": lines})
                        at += len(lines)

        lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpacked, "path string, pos long, value string")
    else:
        lines = numbered_lines(spark, path)
    return parsed_distances(lines)


def parsed_distances(lines: DataFrame) -> DataFrame:
    """(a, b, dist) of (pos, value) lines of three fields. Equal ends go, ends are ordered, the last of repeated pairs holds."""
    t = F.split(N.stripped(F.col("value")), r"\s+")
    return normalised_pairs(lines.select(N.sample_name(t[0]).alias("a"), N.sample_name(t[1]).alias("b"), t[2].cast("long").alias("dist"), "pos"))


def normalised_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, dist) with a < b from (a, b, dist, pos): self-pairs go, the last of repeated pairs holds."""
    return pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max_by("dist", "pos").alias("dist"))


def order(spark: SparkSession, path: str) -> DataFrame:
    return parsed_order(numbered_lines(spark, path))


def parsed_order(lines: DataFrame) -> DataFrame:
    """(pos, name) of the lines of a column order; blank lines are kept."""
    return lines.select("pos", N.sample_name(F.col("value")).alias("name"))


def tour(spark: SparkSession, path: str) -> DataFrame:
    return parsed_tours(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed_tours(texts: DataFrame) -> DataFrame:
    """(path, dim, tour): dimension and node numbers of (path, value), value the text of a tour file.

    A tour that is no permutation of its dimension raises an error.
    """
    t = F.transform(F.split(N.stripped(F.col("value")), r"\s+"), lambda x: x.cast("int"))
    parsed = texts.select("path", t.alias("t")).select("path", F.col("t")[0].alias("dim"), F.filter("t", lambda x, i: i > 0).alias("tour"))
    sound = (F.size("tour") == F.col("dim")) & (F.array_sort("tour") == F.sequence(F.lit(0), F.col("dim") - 1))
    return parsed.select("path", "dim", F.when(sound, F.col("tour")).otherwise(F.raise_error(F.concat(F.lit("not a permutation of its dimension: "), "path")).cast("array<int>")).alias("tour"))


def instance_keys(spark: SparkSession, path: str) -> DataFrame:
    return parsed_keys(numbered_lines(spark, path))


def parsed_keys(lines: DataFrame) -> DataFrame:
    """(path, keys) of the last of (path, pos, value) lines with `keys:` in each TSP instance."""
    some = lines.where(F.col("value").contains("keys"))
    return some.groupBy("path").agg(F.max_by("value", "pos").alias("v")).select("path", F.split(N.stripped(F.substring_index("v", "keys:", -1)), ",").alias("keys"))


def newick(spark: SparkSession, path: str) -> DataFrame:
    """(path, tree) of tree files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("tree"))


def tree_nodes(trees: DataFrame) -> DataFrame:
    """(path, node, parent, depth, name, length, first_leaf, last_leaf): all nodes of Newick trees (path, tree).

    node and parent are places of tokens, null for the root's parent; depth is 0 at the root; leaves are numbered from 0 in
    each tree, a leaf being its own first and last. Quoted names lose their quotes; missing names and lengths are null.
    Brackets that don't match raise an error. Depths are running sums, and a bracket finds its other one as the next of
    its level.
    """
    text = r"(?:'(?:[^']|'')*'|[^(),;'])+"
    tokens = trees.select("path", F.posexplode(F.regexp_extract_all("tree", F.lit(rf"[(),;]|{text}"), 0)).alias("at", "token")).where(~F.col("token").rlike(r"^[\s;]*$"))
    own = Window.partitionBy("path").orderBy("at")
    step = F.when(F.col("token") == "(", 1).when(F.col("token") == ")", -1).otherwise(0)
    marked = tokens.select("*", F.lag("token").over(own).alias("before"), F.sum(step).over(own).alias("depth"), F.lead("token").over(own).alias("after"), F.sum(step).over(Window.partitionBy("path")).alias("left_open"))
    sound = (F.col("depth") >= 0) & (F.col("left_open") == 0)
    marked = marked.withColumn("depth", F.when(sound, F.col("depth")).otherwise(F.raise_error(F.concat(F.lit("brackets don't match in "), "path")).cast("long")))
    is_text = ~F.col("token").isin("(", ")", ",")
    is_leaf = is_text & (F.col("before").isNull() | F.col("before").isin("(", ","))
    level = F.when(F.col("token") == ")", F.col("depth") + 1).otherwise(F.col("depth"))
    placed = marked.select("path", "at", "token", "depth", "after", level.alias("level"), is_leaf.alias("leaf"), F.sum(is_leaf.cast("int")).over(own).alias("leaves"))
    of_level = Window.partitionBy("path", "level").orderBy("at")
    opened = F.last(F.when(F.col("token") == "(", F.col("at")), ignorenulls=True).over(of_level)
    around = placed.where("token in ('(', ')') or leaf").withColumn("open", opened).withColumn("close", F.lead(F.struct("leaves", "after", "at")).over(Window.partitionBy("path", "level", F.col("token").isin("(", ")")).orderBy("at")))
    label = F.when(F.col("leaf"), F.col("token")).otherwise(F.when(~F.col("close.after").isin("(", ")", ","), F.col("close.after")))
    parts = F.regexp_extract(label, r"(?s)^\s*('(?:[^']|'')*'|[^:']*?)\s*(?::(.*))?$", 1), F.regexp_extract(label, r"(?s)^\s*(?:'(?:[^']|'')*'|[^:']*?)\s*(?::(.*))?$", 1)
    bare = F.when(parts[0].startswith("'"), F.regexp_replace(F.substring(parts[0], F.lit(2), F.length(parts[0]) - 2), "''", "'")).otherwise(parts[0])
    nodes = around.where("token = '(' or leaf").select(
        "path", F.col("at").alias("node"), F.when(F.col("leaf"), F.col("open")).alias("inner"), "level", "leaf", F.nullif(bare, F.lit("")).alias("name"), F.nullif(F.trim(parts[1]), F.lit("")).cast("double").alias("length"),
        F.when(F.col("leaf"), F.col("leaves") - 1).otherwise(F.col("leaves")).alias("first_leaf"), F.when(F.col("leaf"), F.col("leaves") - 1).otherwise(F.col("close.leaves") - 1).alias("last_leaf"),
    )
    # the parent of an inner node is the last bracket before it that opened one level further out
    outer = around.where("token = '('").select("path", (F.col("level") + 1).alias("level"), F.col("at").alias("node"), F.lit(True).alias("opens"))
    both = nodes.where("not leaf").select("path", "level", "node", F.lit(False).alias("opens")).unionByName(outer)
    over = both.withColumn("outer", F.last(F.when(F.col("opens"), F.col("node")), ignorenulls=True).over(Window.partitionBy("path", "level").orderBy("node"))).where("not opens").select("path", "node", "outer")
    return nodes.join(over, ["path", "node"], "left").select(
        "path", "node", F.when(F.col("leaf"), F.col("inner")).otherwise(F.col("outer")).alias("parent"), F.when(F.col("leaf"), F.col("level")).otherwise(F.col("level") - 1).alias("depth"), "name", "length", "first_leaf", "last_leaf"
    )


def runs(spark: SparkSession, path: str) -> DataFrame:
    return parsed_runs(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"))


def parsed_runs(lines: DataFrame) -> DataFrame:
    """(path, dataset, method, k, n, type, n_bit_changes, n_runs, n_cylinder_runs) of (path, value) lines of runs files.

    Any other line, a value that is missing and one that is there twice raise an error.
    """
    keys = ["n_bit_changes", "n_runs", "n_cylinder_runs"]
    some = lines.select("path", F.split("value", "\t").alias("t"))
    good = (F.size("t") == 2) & F.col("t")[0].isin(keys) & F.col("t")[1].rlike("^[0-9]+$")
    parsed = some.select("path", F.when(good, F.col("t")[0]).otherwise(F.raise_error(F.concat(F.lit("bad line in "), F.col("path"))).cast("string")).alias("key"), F.col("t")[1].cast("long").alias("v"))
    wide = parsed.groupBy("path").pivot("key", keys).agg(F.collect_list("v"))
    one = lambda k: F.when(F.size(k) == 1, F.col(k)[0]).otherwise(F.raise_error(F.concat(F.lit(f"{k} is not there once in "), F.col("path"))).cast("long")).alias(k)
    return wide.select("path", N.run_key(F.col("path")).alias("key"), *map(one, keys)).select("path", "key.*", *keys)


def bit_matrix(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Column names, and (row_id, bits) of a text matrix whose first line holds the names."""
    lines = numbered_lines(spark, path)
    return lines.where("pos = 0").first().value.split("\t"), parsed_bits(lines)


def parsed_bits(lines: DataFrame) -> DataFrame:
    """(row_id, bits) of the (pos, value) lines after the header; blank lines go."""
    return lines.where("pos > 0 and value <> ''").select((F.col("pos") - 1).alias("row_id"), F.col("value").alias("bits"))


def parsed_timings(lines: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of tab-separated timing lines (value) below a header; NA and None are null."""
    t = F.split("value", "\t")
    return lines.where(F.col("value") != "\t".join(columns)).select(*[F.when(~t[i].isin("NA", "None"), t[i]).alias(c) for i, c in enumerate(columns)])


def timing_rows(lines: DataFrame) -> DataFrame:
    """(path, pos, fields): each line of timing files below their headers, as a map from the header's names to its values.

    lines: (path, pos, value), pos 0 being the header of its file. Each file has a header of its own; lines equal to it go,
    as collected tables may repeat it. NA and None are null. A line with more or fewer fields than its header, a name that
    a header holds twice and an empty name are errors.
    """
    heads = lines.where("pos = 0").select("path", F.col("value").alias("head"))
    some = lines.where("pos > 0").join(heads, "path").where("value <> head").select("path", "pos", F.split("value", "\t").alias("t"), F.split("head", "\t").alias("names"))
    sound = (F.size("t") == F.size("names")) & (F.size(F.array_distinct("names")) == F.size("names")) & ~F.array_contains("names", "")
    fault = F.concat(F.lit("line "), F.col("pos").cast("string"), F.lit(" does not fit the header of "), F.col("path"))
    values = F.transform("t", lambda x: F.when(~x.isin("NA", "None"), x))
    return some.select("path", "pos", F.when(sound, F.map_from_arrays("names", values)).otherwise(F.raise_error(fault).cast("map<string,string>")).alias("fields"))


def timing_names(lines: DataFrame) -> list[str]:
    """All names that headers of timing files hold, in the order of their first places; headers are few."""
    heads = lines.where("pos = 0").select("value").distinct()
    names = heads.select(F.posexplode(F.split("value", "\t")).alias("at", "name")).groupBy("name").agg(F.min("at").alias("at"))
    return [r.name for r in names.orderBy("at", "name").collect()]


def united_timings(lines: DataFrame, names: list[str]) -> DataFrame:
    """(path, *names) of timing files with different headers; a name that a file's header lacks is null there."""
    return _named(timing_rows(lines), names)


def _named(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select("path", *[F.col("fields")[n].alias(n) for n in names])


def timings(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(*names) of all timing files in the order of their lines, each by its own header; names: those of all headers, if none are given."""
    lines = numbered_lines(spark, path)
    return _named(timing_rows(lines).orderBy("path", "pos"), names or timing_names(lines)).drop("path")


def sequence_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all sequence files under a folder, sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    return found.where(F.col("path").rlike(N.SEQUENCE_SUFFIX)).orderBy("path")
