"""Weighted rendezvous hashing of stable keys over shards, with gapless slots.

Each key draws a number for every shard and goes to the shard whose weighted number is largest, so a new shard takes
rows from all others and none moves elsewhere. Slots come from a range sort: rows are numbered inside their partition,
and counts of each (partition, shard), a table bounded by partitions and shards, give the offsets; no shard is ever
gathered into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_columns

SHARDS = 24
#: Bytes that each record adds to its text.
OVERHEAD = 8


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (int, from 0) of a key: largest w / -ln(u), u being the key's draw for that shard in (0, 1).

    A null key draws as the missing key: all null keys share one shard. Equal scores go to the higher number.
    Weights must be positive.
    """
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive")
    draw = lambda i: (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
    scores = [F.struct((F.lit(float(w)) / -F.log(draw(i))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0]).getField("shard")


def shards(docs: DataFrame, weights: list[float] | None = None, grown: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): a row for each row of `docs`.

    shard depends on doc_id and weights alone (law `key`); grown_shard is the shard if one of weight `grown` is added.
    slot counts from 0 without gaps in each shard, in the order of checksum, size and doc_id, so that equal texts of a
    shard lie side by side. A null text has size 8 and checksum 0. Null doc_ids share a shard. Repeated rows get a slot
    each. Empty tables give no rows; other columns are ignored.
    """
    weights = [1.0] * SHARDS if weights is None else weights
    order = ("shard", "text_crc32", "size", "doc_id")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    dealt = text_columns(docs, id_col, text_col).select(
        "doc_id",
        (F.octet_length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, grown]).alias("grown_shard"),
    )
    ranged = cut(dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33).alias("part")
    counts = ranged.groupBy("shard", part).agg(F.min("at").alias("base"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("base")).alias("shift"))
    return ranged.withColumn("part", part).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard"
    )
