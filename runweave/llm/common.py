"""Helpers shared by the text operators: table access, lineage cuts, tokens and Arrow output."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all of Spark runs in one process, as in tests, a temporary one; on a cluster executors
    could not see that, so it is an error there.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getCheckpointDir()


@contextmanager
def tidy(spark: SparkSession):
    """While it lasts, Spark removes an action's shuffle files when the action has ended: its result is stored elsewhere."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it from there: its lineage ends, lost executors don't matter."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, lasting: bool = False) -> tuple[DataFrame, str]:
    """`df` read again from a compressed table in the shared folder, and the table's path, for remove().

    A lasting table stays even if it is stored within passing().
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    if _PASSING and not lasting:
        _PASSING[-1].append(path)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def scratch(df: DataFrame) -> DataFrame:
    """As cut(), but a compressed table: for wide rows, and readers that take few of the columns."""
    return stored(df)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession):
    """Tables that are stored while it lasts go when it ends; what was made of them must be stored elsewhere by then."""
    _PASSING.append([])
    try:
        yield
    finally:
        for path in _PASSING.pop():
            remove(spark, path)


def unused(columns: Iterable[str], *stems: str) -> list[str]:
    """Column names made of the stems that clash with none of `columns`; Spark's names ignore case."""
    taken, out = {c.lower() for c in columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(column: str) -> Column:
    """The column of just that name, whatever signs the name holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() parts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As words(), with A-Z in lower case; bytes.lower() touches no other character."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that what one of them is turned into stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches: Iterable[pa.RecordBatch], column: int, size: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """As slices(), with at most `size` bytes in a string column, or members in a list column; a longer one lies alone."""
    for batch in batches:
        whole = batch.column(column)
        sizes = pc.list_value_length(whole) if pa.types.is_list(whole.type) else pc.binary_length(whole)
        ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            low = ends[at - 1] if at else 0
            n = min(rows, max(1, int(np.searchsorted(ends, low + size, side="right")) - at))
            yield batch.slice(at, n)
            at += n


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow without a barrier; `fn` takes and yields record batches."""
    return df.mapInArrow(fn, schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def kgram_hashes(tokens: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams of a sequence of 64-bit token hashes; empty if there are fewer than k."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def text_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, under fixed names, so that no other column of the input can clash."""
    return df.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text"))


def seed_filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the 64-bit hashes `seed`, two bits for each, as 2**(bits - 6) machine words.

    Spark joins the bits; however many seeds there are, no more than those words reach the driver. A full filter lets
    everything through: more work, never a wrong result.
    """
    low = F.lit((1 << bits) - 1)
    spots = F.array(F.shiftrightunsigned("seed", 64 - bits).bitwiseAND(low), F.shiftrightunsigned("seed", 8).bitwiseAND(low))
    joined = (
        seeds.select(F.explode(spots).alias("b"))
        .groupBy(F.shiftright("b", 6).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    )
    with tidy(seeds.sparkSession):
        joined = joined.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[joined.column("w").to_numpy()] = joined.column("v").to_numpy()
    return out.view(np.uint64)


def in_filter(seeds: np.ndarray, words_of_bits: np.ndarray) -> np.ndarray:
    """Which seeds the filter may hold."""
    bits = (len(words_of_bits) << 6).bit_length() - 1
    hit = np.ones(len(seeds), bool)
    for spot in (seeds >> np.uint64(64 - bits), (seeds >> np.uint64(8)) & np.uint64((1 << bits) - 1)):
        hit &= (words_of_bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
    return hit
