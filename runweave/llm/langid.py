"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters in hashed bins, in every task over its own rows, and sums the bins by
language in Spark. The model is a matrix of log-probabilities, bins by languages: its size is bounded by parameters,
not by the data, and it goes out as a broadcast of plain values. Prediction counts the distinct bins of each text of a
batch, a sparse matrix of texts by bins, and multiplies it with the model's in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, record

BINS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3), 0.5
#: Languages a model may hold; more is an error, so that the broadcast stays bounded (64 MB).
MOST_LANGUAGES = 256
#: Characters that are hashed at a time, and numbers of the model that are gathered at a time.
CHUNK, CELLS = 1 << 18, 1 << 21
UNKNOWN = "und"
_COUNT = pa.schema([("lang", pa.string()), ("bin", pa.int32()), ("n", pa.int64()), ("docs", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _folding() -> np.ndarray:
    """For each code point of the first plane: its lower-case letter, or a space for what is no letter."""
    out = np.full(0x10000, 32, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def letters(text: str, fold: np.ndarray) -> np.ndarray:
    """Code points of the lower-case letters, with one space for each gap between them and at both ends."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.concatenate([np.array([32], np.uint32), np.where(raw < 0x10000, fold[np.minimum(raw, 0xFFFF)], raw), np.array([32], np.uint32)])
    gap = cp == 32
    return cp[~(gap & np.r_[False, gap[:-1]])]


def bins(cp: np.ndarray, at: int = 0) -> np.ndarray:
    """Bins of the n-grams of a folded text that start at one of the CHUNK characters from `at` on."""
    cp, out = cp[at : at + CHUNK + max(ORDERS) - 1], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = min(CHUNK, len(cp) - n + 1)
            if m > 0:
                h = np.full(m, n, np.uint32)
                for j in range(n):
                    h = (h ^ cp[j : m + j]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                out.append(h & np.uint32(BINS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    """Languages in order, and log-probabilities (bins + 1 rows, the last the priors; languages)."""

    languages: list[str]
    weights: np.ndarray


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row of `docs` whose language and text are not null.

    Each task counts into bins of its own, so at most bins x languages rows of it are shuffled. A row's prior counts
    even if its text has no letter. No labelled rows: a model without languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, sums, rows = _folding(), {}, {}
        for b in byte_slices(batches, 0):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = sums.setdefault(lang, np.zeros(BINS, np.int64))
                rows[lang] = rows.get(lang, 0) + 1
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
                cp = letters(text, fold)
                for at in range(0, len(cp), CHUNK):
                    own += np.bincount(bins(cp, at), minlength=BINS)
        for lang, own in sums.items():
            some = np.flatnonzero(own)
            yield record(_COUNT, [lang] * (len(some) + 1), np.r_[some, -1].astype(np.int32), np.r_[own[some], 0], np.r_[np.zeros(len(some), np.int64), rows[lang]])

    labelled = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    found = arrow_map(labelled, run, "lang string, bin int, n long, docs long").groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toArrow()
    coded = found.column("lang").combine_chunks().dictionary_encode()
    bin_of, n, docs_of = (found.column(c).to_numpy() for c in ("bin", "n", "docs"))
    names = sorted(coded.dictionary.to_pylist())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = {x: i for i, x in enumerate(names)}
    column = np.array([place[x] for x in coded.dictionary.to_pylist()], int)[coded.indices.to_numpy(zero_copy_only=False)] if names else np.zeros(0, int)
    counts, prior = np.zeros((BINS, len(names))), np.zeros(len(names))
    grams = bin_of >= 0
    counts[bin_of[grams], column[grams]] = n[grams]
    prior[column[~grams]] = docs_of[~grams]
    logs = np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * BINS) if names else counts
    return Model(names, np.vstack([logs, np.log(prior / prior.sum()) if names else prior]).astype(np.float32))


def bin_counts(text: str, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct bins of a text's n-grams, in order, and how often each occurs: a row of the sparse matrix."""
    cp, counts = letters(text, fold), None
    for at in range(0, len(cp), CHUNK):
        own = bins(cp, at)
        if counts is None and len(cp) <= CHUNK:
            return np.unique(own, return_counts=True)
        counts = (np.zeros(BINS, np.int64) if counts is None else counts) + np.bincount(own, minlength=BINS)
    some = np.flatnonzero(counts)
    return some, counts[some]


def log_scores(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Texts by languages: priors and the product of the sparse matrix with the model, a bounded part at a time."""
    sizes = np.array([len(b) for b, _ in rows], np.int64)
    which, counts = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, int) for i in (0, 1))
    out = np.tile(weights[-1].astype(np.float64), (len(rows), 1))
    of = np.repeat(np.arange(len(rows)), sizes)
    step = max(1, CELLS // max(1, weights.shape[1]))
    for at in range(0, len(which), step):
        own, part = of[at : at + step], weights[which[at : at + step]].astype(np.float64) * counts[at : at + step, None]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(part, first, axis=0)
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language of each row's whole text and its posterior probability.

    `und` with score 0 if the text is null or has no letter, or if the model has no language. Ties go to the first
    language in order. Repeated rows and null keys keep their rows; other columns are ignored; no rows in, no rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tuple(model.languages), model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, (names, weights) = _folding(), shared.value
        for b in byte_slices(batches, 1, 1 << 18):
            texts = b.column(1).to_pylist()
            told = [i for i, t in enumerate(texts) if t and names and any(map(str.isalpha, t))]
            found: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            for i, row in zip(told, log_scores([bin_counts(texts[i], fold) for i in told], weights)):
                p = np.exp(row - row.max())
                found[i] = names[int(row.argmax())], float(p.max() / p.sum())
            yield record(_OUT, b.column(0), [x for x, _ in found], [s for _, s in found])

    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(some, run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """True for the fold that training never sees: crc32 of the key as text is 2 modulo 4. A null key counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for all rows, learned from the labelled rows outside the held-out fold."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
