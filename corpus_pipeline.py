"""The corpus pipeline: quality rules, near-dedup, decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and
gives the next stage what it reads again. All stages but the last return the columns of documents, whatever further
columns there are. Edge cases hold for every stage: null texts count as empty, texts are read whole however long, an
empty table stays empty, ties are broken the same way on every run; what becomes of null keys and of repeated rows is
said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.llm import bpe, decontam, pii, quality, simhash
from runweave.llm.common import passing, remove, stored, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has both."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others the failing and repeated lines go.

    Null and empty texts have too few words and go. Each row is judged alone: null keys and repeated rows make no difference.
    """
    return _counted(quality.clean(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates on five-word shingles the document with the smallest doc_id stays.

    Null keys come after all others; of repeated rows one stays. Texts without a word are one group.
    """
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words or more in its own runs of five words go.

    Null keys and repeated rows stay or go by their texts. An empty benchmark leaves all documents.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, in texts that stay otherwise as they are; no row goes.

    Null texts stay null. Null keys and repeated rows keep their rows.
    """
    return _counted(pii.redact(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, starts, ends) of each document: tokens and the characters that each covers; no row goes.

    Null and empty texts have no ids. Null keys and repeated rows keep their rows.
    """
    return bpe.encode(docs, *bpe.public_ranks())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_bpe", byte_bpe),
]

#: SimHash, tiling, bootstrapping and BPE can't be expressed in SQL; tests/llm holds run() against a plain version of all
#: stages in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the data folder, each on all that the one before kept.

    What a stage stores on its way goes when its result is written, and its input when the next result is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with passing(spark):
            docs, path = stored(stage(spark, docs, sf_dir), lasting=True)
        if before:
            remove(spark, before)
        before = path
    return docs
