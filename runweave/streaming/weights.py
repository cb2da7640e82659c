"""Weights that follow a stream of sequence records: plain sums, so each batch only updates the sets it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import kmers


def streamed_weights(unitigs: DataFrame, k: int) -> DataFrame:
    """(color_set_id, w_unitig, w_kmer) of a stream of (color_set_id, seq_len); write it in update or complete mode."""
    return unitigs.groupBy("color_set_id").agg(F.count("*").alias("w_unitig"), F.sum(kmers(F.col("seq_len"), k)).cast("long").alias("w_kmer"))
