"""Color sets from texts or sequences, and sketch distances between samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_shingles(text: Column, k: int, joined: bool = True) -> Column:
    """k-word shingles of a text, words being parted by spaces, as texts or as arrays of words; none if it has fewer words."""
    w = F.filter(F.split(text, " "), lambda x: x != "")
    gram = lambda a, i: F.array_join(F.slice(a, i, k), " ") if joined else F.slice(a, i, k)
    bound = F.get(F.transform(F.array(w), lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - k + 1), lambda i: gram(a, i))), F.lit(0))
    return F.when(F.size(w) >= k, bound).otherwise(F.array().cast("array<string>" if joined else "array<array<string>>"))


def canonical_kmers(sequence: Column, k: int) -> Column:
    """k-mers of a sequence in their canonical form: the smaller of itself and its reverse complement."""
    s = F.upper(sequence)
    bound = lambda a: F.transform(F.sequence(F.lit(1), F.length(a) - k + 1), lambda i: F.least(F.substring(a, i, F.lit(k)), F.translate(F.reverse(F.substring(a, i, F.lit(k))), "ACGT", "TGCA")))
    return F.when(F.length(s) >= k, F.get(F.transform(F.array(s), bound), F.lit(0))).otherwise(F.array().cast("array<string>"))


def fragment_sets(samples: DataFrame, fragments: Column, sample: str) -> DataFrame:
    """(colors, n_fragments): distinct sets of samples that hold a fragment, and how many fragments each set has.

    A fragment is known by 128 bits of hashes and a sample by its number in the order of names, so that sets are bit masks,
    joined map-side: what is shuffled is a few numbers for each fragment of a task. Samples are the columns of a matrix;
    their names are listed first and laid beside the masks at the end.
    """
    names = samples.select(F.col(sample).alias("name")).where("name is not null").distinct().orderBy("name")
    listed = [r.name for r in names.collect()]
    place = samples.sparkSession.createDataFrame([(x, i) for i, x in enumerate(listed)], "name string, place int")
    known = samples.withColumnRenamed(sample, "name").join(F.broadcast(place), "name")
    hashed = known.select("place", F.explode(F.transform(fragments, lambda f: F.struct(F.xxhash64(f).alias("a"), F.xxhash64(F.lit(1), f).alias("b")))).alias("h"))
    masks = [F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / 64) == w, F.expr("shiftleft(1L, place % 64)"))), F.lit(0)).alias(f"m{w}") for w in range(len(listed) // 64 + 1)]
    words = [f"m{w}" for w in range(len(masks))]
    counted = hashed.groupBy("h.a", "h.b").agg(*masks).groupBy(*words).agg(F.count("*").alias("n_fragments"))

    def held(w: int) -> Column:
        some = F.lit(listed[64 * w : 64 * w + 64]).cast("array<string>")
        return F.filter(F.transform(some, lambda x, i: F.when(F.getbit(F.col(f"m{w}"), i) == 1, x)), lambda x: x.isNotNull())

    return counted.select(F.flatten(F.array(*map(held, range(len(masks))))).alias("colors"), "n_fragments")


def same_set_stretches(samples: DataFrame, fragments: Column, sample: str) -> DataFrame:
    """(colors, n_stretches): maximal stretches of neighbouring fragments of one set within a sequence.

    An approximation of the segments of a compacted graph, which would also end at branches.
    """
    spread = samples.select(F.col(sample).alias("color"), F.monotonically_increasing_id().alias("seq"), F.posexplode(fragments).alias("at", "fragment"))
    sets = spread.groupBy("fragment").agg(F.array_sort(F.collect_set("color")).alias("colors"))
    lag = F.lag("colors").over(Window.partitionBy("seq").orderBy("at"))
    placed = spread.join(sets, "fragment").withColumn("new", lag.isNull() | (lag != F.col("colors")))
    return placed.groupBy("colors").agg(F.count_if("new").alias("n_stretches"))


def sketches(samples: DataFrame, fragments: Column, sample: str, size: int) -> DataFrame:
    """(name, sketch): the `size` least md5 values of each sample's fragments, sorted.

    Ranks that repeated values share are limited in each task before anything is shuffled, so no more than `size` values of
    a sample leave a task, but for repeats of those.
    """
    hashed = samples.select(F.col(sample).alias("name"), F.explode(F.array_distinct(F.transform(fragments, F.md5))).alias("h"))
    least = F.dense_rank().over(Window.partitionBy("name").orderBy("h"))
    return hashed.withColumn("r", least).where(F.col("r") <= size).groupBy("name").agg(F.array_sort(F.collect_set("h")).alias("sketch"))


def sketch_distances(sketched: DataFrame, size: int, k: int) -> DataFrame:
    """(name_i, name_j, shared, mash): members of the joint bottom sketch that both hold, and -1/k ln(2j / (1 + j)).

    Samples meet under the hashes that they share. The place of a shared hash in the joint sketch follows from its places
    in both and from how many shared ones lie before it, so no sketch goes along with a pair.
    """
    spread = lambda x: sketched.select(F.col("name").alias(f"name_{x}"), F.posexplode("sketch").alias(f"at_{x}", "h"))
    met = spread("i").join(spread("j"), "h").where(F.col("name_i") < F.col("name_j"))
    before = F.row_number().over(Window.partitionBy("name_i", "name_j").orderBy("h"))
    placed = met.withColumn("place", F.col("at_i") + F.col("at_j") + 2 - before)
    both = placed.groupBy("name_i", "name_j").agg(F.count_if(F.col("place") <= size).alias("shared"), F.count("*").alias("common"))
    a, b = (sketched.select(F.col("name").alias(f"name_{x}"), F.size("sketch").alias(f"n_{x}")) for x in "ij")
    pairs = a.join(b, F.col("name_i") < F.col("name_j")).join(both, ["name_i", "name_j"], "left").na.fill(0, ["shared", "common"])
    j = F.col("shared") / F.least(F.lit(size), F.col("n_i") + F.col("n_j") - F.col("common"))
    return pairs.select("name_i", "name_j", F.col("shared").cast("long").alias("shared"), F.when(F.col("shared") == 0, 1.0).otherwise(F.least(F.lit(1.0), -F.log(2 * j / (1 + j)) / k)).alias("mash"))
