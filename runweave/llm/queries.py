"""Registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, divergence, langid, licenses, periods, pii, quality, sharding, simhash, substring, urltree, wordbpe
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; edge cases as in simhash.near_duplicates()."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, learned outside the held-out fold; see langid.predict()."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak a benchmark item, a row each; edge cases as in decontam.contaminated()."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document; edge cases as in pii.spans()."""
    return pii.spans(table(spark, sf_dir, "documents"))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict, ...) of every page; edge cases as in urltree.judge()."""
    return urltree.judge(table(spark, sf_dir, "pages"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; edge cases as in bpe.encode()."""
    return bpe.digests(table(spark, sf_dir, "documents"), *bpe.public_ranks())


def op7_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document by 24 equal shards and by one more; edge cases as in sharding.shards()."""
    return sharding.shards(table(spark, sf_dir, "documents"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; edge cases as in quality.verdicts()."""
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document; edge cases as in substring.deduplicate()."""
    return substring.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses that documents hold, a row for each; edge cases as in licenses.licenses()."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of documents; edge cases as in divergence.audit()."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; edge cases as in wordbpe.encode()."""
    return wordbpe.digests(table(spark, sf_dir, "documents"), wordbpe.public_file())


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, each tenth key's words with a periodic tail; edge cases as in periods.find(), planted()."""
    return periods.digests(table(spark, sf_dir, "documents"), change=periods.planted)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_language_id,
        op3_benchmark_decontamination,
        op4_personal_data,
        op5_url_templates,
        op6_byte_bpe,
        op7_rendezvous_shards,
        op8_line_quality,
        op9_substring_dedup,
        op10_license_scan,
        op11_source_divergence,
        op12_word_bpe,
        op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {"op8_line_quality": quality.VERDICTS_SQL, "op11_source_divergence": divergence.AUDIT_SQL}
