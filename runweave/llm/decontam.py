"""Benchmark decontamination by greedy string tiling.

Five-word grams are seeds. A Bloom filter of the benchmark's seeds, of fixed size, goes to the scan of the documents;
only runs of words whose seeds it may hold leave the scan, and tiles of five words or more can lie nowhere else.
Documents and items meet under shared seeds, leaving out each item's commonest ones as far as an item that is covered
enough must still meet its document under another. For each pair the tiling marks the longest common runs first, found
by running Karp-Rabin hashes of falling length, never marking a word twice; tiles may lie in any order, so passages
that were moved around still add up. An item is leaked where tiles cover `COVERAGE` of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, in_filter, kgram_hashes, named, record, scratch, seed_filter, slices, unused

MATCH, COVERAGE = 5, 0.5
FILTER_BITS = 24
WORD = re.compile(r"\w+")
_BASE, _MOD = 1_000_003, (1 << 61) - 1
_SEEDS = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("n", pa.int32()), ("said", pa.string()), ("seeds", pa.list_(pa.int64()))])
_PAIR = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("item_id", pa.int64()), ("covered", pa.int32()), ("n", pa.int32())])


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall(text.lower()) if text else []


def seeds_of(words: list[str]) -> np.ndarray:
    """Hash of the five words at each position."""
    return kgram_hashes(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), MATCH)


def _rolling(words: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of each unmarked stretch of `length` words."""
    top, h, n = pow(_BASE, length - 1, _MOD), 0, 0
    for i, w in enumerate(words):
        if not free[i]:
            h = n = 0
            continue
        if n == length:
            h = (h - words[i - length] * top) % _MOD
            n -= 1
        h = (h * _BASE + w) % _MOD
        n += 1
        if n == length:
            yield i - length + 1, h


def tiles(pattern: list[str], text: list[str], least: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in pattern, start in text, length) of non-overlapping common runs, longest first.

    `None` in a sequence matches nothing. Among equally long runs the one first in the pattern, then in the text, wins.
    """
    ids: dict = {}
    p, t = ([-1 if w is None else ids.setdefault(w, len(ids) + 1) for w in x] for x in (pattern, text))
    free_p, free_t, found = [w > 0 for w in p], [w > 0 for w in t], []
    length = min(len(p), len(t))
    while length >= least:
        at: dict[int, list[int]] = {}
        for i, h in _rolling(p, free_p, length):
            at.setdefault(h, []).append(i)
        matches, longest = [], 0
        for j, h in _rolling(t, free_t, length) if at else ():
            for i in at.get(h, ()):
                if i and j and free_p[i - 1] and free_t[j - 1] and p[i - 1] == t[j - 1]:
                    continue  # its left neighbour starts the same run
                n = 0
                while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                if n >= length:
                    matches.append((-n, i, j))
                    longest = max(longest, n)
        again = False
        for n, i, j in sorted(matches):
            if all(free_p[i : i - n]) and all(free_t[j : j - n]):
                found.append((i, j, -n))
                free_p[i : i - n] = [False] * -n
                free_t[j : j - n] = [False] * -n
            else:
                again = True  # what is left of it may still be long enough
        if not again:
            length = length // 2 if length > 2 * least else least if length > least else 0
    return found


def _tile_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 64):
        out = []
        for doc_id, xh, said, item_id, text in zip(*(c.to_pylist() for c in b.columns)):
            item = tokens(text)
            runs = [None if w == "" else w for w in said.split(" ")]
            out.append((doc_id, xh, item_id, sum(n for _, _, n in tiles(item, runs)), len(item)))
        yield record(_PAIR, *([x[i] for x in out] for i in range(5)))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, xh, item_id, covered, n_words): pairs of a document and an item that it holds to `coverage` or more.

    xh is a hash of the document's text; rows of equal doc_id and text are one document here. Items under five words
    hold too little to tell and never match; null or empty texts never match. Null keys are kept as null. Repeated
    items count once; equal texts under two item keys give two pairs. Empty tables give no rows.
    """
    spark = docs.sparkSession
    some = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("text")).withColumn("xh", F.xxhash64("text"))
    bench = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("item")).distinct().withColumn("ih", F.xxhash64("item_id", "item"))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [tokens(t) for t in b.column(1).to_pylist()]
            yield record(_SEEDS, pa.nulls(b.num_rows, pa.int64()), b.column(0), [len(w) for w in words], pa.nulls(b.num_rows, pa.string()), [seeds_of(w).view(np.int64).tolist() for w in words])

    by_item = arrow_map(bench.select("ih", "item"), item_seeds, "doc_id long, xh long, n int, said string, seeds array<long>")
    seeds = scratch(by_item.select(F.col("xh").alias("ih"), "n", F.explode("seeds").alias("seed")))
    bits = spark.sparkContext.broadcast(seed_filter(seeds.select("seed").distinct(), FILTER_BITS))

    def doc_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for b in slices(batches):
            rows = []
            for doc_id, xh, text in zip(*(c.to_pylist() for c in b.columns)):
                w = tokens(text)
                s = seeds_of(w)
                at = np.flatnonzero(in_filter(s, known))
                if len(at):
                    said, end = [], -1
                    for i in at.tolist():
                        if i > end and said:
                            said.append("")
                        said.extend(w[max(i, end) : i + MATCH])
                        end = i + MATCH
                    rows.append((doc_id, xh, len(w), " ".join(said), np.unique(s[at]).view(np.int64).tolist()))
            yield record(_SEEDS, *([r[i] for r in rows] for i in range(5)))

    runs = scratch(arrow_map(some.select("doc_id", "xh", "text"), doc_runs, "doc_id long, xh long, n int, said string, seeds array<long>")).distinct()
    common = seeds.select("ih", "seed").distinct().groupBy("seed").agg(F.count("*").alias("items"))
    spare = F.ceil(F.col("n") * coverage / MATCH) - 1
    probes = seeds.join(common, "seed").withColumn("r", F.row_number().over(Window.partitionBy("ih").orderBy(F.desc("items"), "seed"))).where(F.col("r") > spare).select("ih", "seed").distinct()
    pairs = runs.select("doc_id", "xh", F.explode("seeds").alias("seed")).join(probes, "seed").select("doc_id", "xh", "ih").distinct()
    met = pairs.select(F.col("doc_id").alias("d"), F.col("xh").alias("x"), "ih")
    full = met.join(runs.select("doc_id", "xh", "said"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("xh"))).join(bench, "ih")
    tiled = arrow_map(full.select("doc_id", "xh", "said", "item_id", "item"), _tile_pairs, "doc_id long, xh long, item_id long, covered int, n int")
    return tiled.where((F.col("n") >= MATCH) & (F.col("covered") >= F.col("n") * coverage)).withColumnRenamed("n", "n_words")


def contaminated(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """(doc_id, item_id, covered, n_words, coverage, n_items): the documents that leak, a row each, with the item most covered.

    Of equal coverages the smallest item_id is named. Documents that leak nothing have no row. Other cases as in leaks().
    """
    found = leaks(docs, items, **names).withColumn("coverage", F.col("covered") / F.col("n_words"))
    best = F.max_by(F.struct("item_id", "covered", "n_words", "coverage"), F.struct("coverage", -F.col("item_id"))).alias("b")
    return found.groupBy("doc_id", "xh").agg(best, F.count("*").alias("n_items")).select("doc_id", "b.item_id", "b.covered", "b.n_words", F.round("b.coverage", 6).alias("coverage"), "n_items")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of `docs` that leak no item; all columns stay, whatever their names.

    Null and empty texts leak nothing and stay. Null keys and repeated rows stay or go by their text, a row each. Empty
    tables of documents or items give the documents as they are. A text of any length is read whole.
    """
    d, x = unused(docs.columns, "leak_id", "leak_hash")
    gone = scratch(leaks(docs, items, id_col=id_col, text_col=text_col, **names).select(F.col("doc_id").alias(d), F.col("xh").alias(x)).distinct())
    return docs.join(gone, named(id_col).cast("long").eqNullSafe(gone[d]) & (F.xxhash64(named(text_col).cast("string")) == gone[x]), "left_anti")
