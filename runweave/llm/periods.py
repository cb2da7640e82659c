"""Periodic runs of words, by internal pattern matching.

A run of period q that is four periods long holds a block of 2**k words (q < 2**k <= 2q) that starts at a multiple of 2**k
and whose next or last occurrence lies exactly q words away. So each such block asks for its occurrences in the windows
beside it: the block's occurrences are a range of the suffix array, and a wavelet tree over that range gives the successor
and the predecessor of the block's own place. The step to it is a candidate period; blocks that follow each other with the
same step are one progression, which is then extended as far as the period holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, byte_slices, record, text_columns, words

#: Words that a run has at least, and periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUNS = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of all texts in one row, equal only for equal words of one text, and where each text ends."""
    numbers: list[int] = []
    ends, used = [], 0
    for text in texts:
        own: dict[bytes, int] = {}
        numbers += [own.setdefault(w, used + len(own)) for w in text]
        used += len(own)
        ends.append(len(numbers))
    return np.array(numbers, np.int64), np.array(ends, np.int64)


def suffix_array(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of texts that share no number, and (k, at, low, high) of each level of doubling.

    at: the aligned places whose block of 2**k words occurs again, low and high: the range of its occurrences in the
    suffix array. Only suffixes that are not told apart yet are sorted again; one that its text ends is least.
    """
    n = len(t)
    last = np.repeat(ends, np.diff(np.r_[0, ends]))  # the end of each place's text
    order = np.argsort(t, kind="stable")
    rank, levels, k = np.zeros(n + 1, np.int64), [], 0
    slots, keys = np.arange(n), t[order]
    while True:
        # order[slots] is sorted by keys: ranks are the first slots of equal ones
        some = order[slots]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(keys)])
        low = np.repeat(slots[first], sizes)
        rank[some] = low
        many = np.repeat(sizes, sizes) > 1
        slots, some, low, high = slots[many], some[many], low[many], (low + np.repeat(sizes, sizes))[many]
        if not len(slots):
            return order, levels
        even = some & ((1 << k) - 1) == 0
        levels.append((k, some[even], low[even], high[even]))
        after = some + (1 << k)
        follow = np.where(after < last[some], rank[np.minimum(after, n)] + 1, 0)
        keys = low * (n + 2) + follow
        again = np.argsort(keys, kind="stable")
        order[slots], keys, k = some[again], keys[again], k + 1


class Wavelet:
    """Wavelet tree, laid out by levels, over a permutation of 0 to n - 1; all questions of a call are answered side by side."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for b in reversed(range(max(1, (len(values) - 1).bit_length()))):
            one = (values >> b & 1).astype(bool)
            self.levels.append((b, np.r_[0, np.cumsum(~one)]))
            values = np.r_[values[~one], values[one]]

    def less(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many values in the range are less than `value`."""
        found = np.zeros(len(low), np.int64)
        for b, zeros in self.levels:
            one, left, right = (value >> b & 1).astype(bool), zeros[low], zeros[high]
            found += np.where(one, right - left, 0)
            low, high = np.where(one, zeros[-1] + low - left, left), np.where(one, zeros[-1] + high - right, right)
        return found

    def least(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The nth of the values in the range, from 0, in ascending order."""
        found = np.zeros(len(low), np.int64)
        for b, zeros in self.levels:
            left, right = zeros[low], zeros[high]
            one = nth >= right - left
            nth = np.where(one, nth - (right - left), nth)
            found |= one.astype(np.int64) << b
            low, high = np.where(one, zeros[-1] + low - left, left), np.where(one, zeros[-1] + high - right, right)
        return found


def candidates(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of stretches that have a period, one at least inside each run, merged where they are of one run."""
    order, levels = suffix_array(t, ends)
    levels = [x for x in levels if x[0] >= 1 and len(x[1])]
    none = np.zeros(0, np.int64)
    if not levels:
        return none, none, none
    # only slots of two-word blocks that occur again are asked for: the tree holds those, places in the order of places
    asked = np.unique(np.concatenate([np.repeat(low, high - low) + _counted(high - low) for _, _, low, high in levels]))
    places = np.sort(order[asked])
    tree = Wavelet(np.searchsorted(places, order[asked]))
    found = []
    for k, at, low, high in levels:
        low, high, own = np.searchsorted(asked, low), np.searchsorted(asked, high), np.searchsorted(places, at)
        before = tree.less(low, high, own)
        for some, nth in ((before > 0, before - 1), (before + 1 < high - low, before + 1)):
            other = places[tree.least(low[some], high[some], nth[some])]
            step = np.abs(other - at[some])
            near = (step < 1 << k) & (step >= 1 << (k - 1))
            start = np.minimum(other, at[some])[near]
            found.append((start, start + step[near] + (1 << k), step[near]))
    start, end, period = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((start, period))
    start, end, period = start[by], end[by], period[by]
    if not len(start):
        return none, none, none
    # stretches of one period that overlap by that period or more belong to one run; ends ascend with starts of one period
    apart = np.r_[True, (period[1:] != period[:-1]) | (start[1:] + period[1:] > end[:-1])]
    first = np.flatnonzero(apart)
    return start[first], np.maximum.reduceat(end, first), period[first]


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each size n, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _agreeing(x: np.ndarray, y: np.ndarray) -> int:
    """How many members agree before the first that doesn't; looks at ever longer pieces."""
    n, at, step = min(len(x), len(y)), 0, 32
    while at < n:
        differ = x[at : min(at + step, n)] != y[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 4
    return n


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start, then period."""
    t, ends = numbered(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, q in zip(*(x.tolist() for x in candidates(t, ends))):
        start -= _agreeing(t[:start][::-1], t[: start + q][::-1])
        end += _agreeing(t[end - q :], t[end:])
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
            text = int(np.searchsorted(ends, start, side="right"))
            out[text].append((start - (int(ends[text - 1]) if text else 0), end - start, q))
    return [sorted(set(x), key=lambda r: (r[0], r[2])) for x in out]


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words of a text without those that a run holds after its first period."""
    if not runs:
        return text
    gone = np.zeros(len(text), bool)
    for start, length, q in runs:
        gone[start + q : start + length] = True
    return [text[i] for i in np.flatnonzero(~gone).tolist()]


def planted(text: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail for each tenth key by its checksum: word i >= a becomes word a + (i - a) % p. Null keys get none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not text:
        return text
    g, n = h // 10, len(text)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return text[:a] + (text[a : a + p] * ((n - a) // p + 1))[: n - a]


def _over(docs: DataFrame, rows, schema: pa.Schema, ddl: str, change: Callable | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            ids, texts = b.column(0).to_pylist(), [words(t) for t in b.column(1).to_pylist()]
            if change:
                texts = [change(t, i) for t, i in zip(texts, ids)]
            found = [rows(t, r) for t, r in zip(texts, runs_of(texts))]
            yield record(schema, b.column(0), *([r[i] for r in found] for i in range(len(schema) - 1)))

    return arrow_map(docs, run, ddl)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of each text's words, and the text without the words that repeat a period.

    A run (start, length, period) is a stretch of words whose smallest period it is, four periods and six words long or
    longer, that no neighbouring word carries on. collapsed has one blank between words. `change` makes other words of
    (words, doc_id) first. Null and empty texts have no words and no runs. Repeated rows and null keys keep their rows; other
    columns are ignored; no rows in, no rows out; texts are read whole. Runs that tie in all but their period are all told.
    """
    rows = lambda t, r: ([dict(zip(("start", "length", "period"), x)) for x in r], b" ".join(collapsed(t, r)).decode("utf-8", "replace"))
    return _over(text_columns(docs, id_col, text_col), rows, _RUNS, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string", change)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): find(), digested.

    The run told is the one with the greatest length over period, of equal ones that with the smallest start, then period;
    nulls where there is none. Edge cases as in find().
    """

    def rows(t: list[bytes], r: list[tuple[int, int, int]]) -> tuple:
        best = min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None, None, None)
        lines = b"".join(b"%d,%d,%d\n" % x for x in r)
        return len(r), *best, best[1] * 1000 // best[2] if r else None, hashlib.sha256(lines).hexdigest(), hashlib.sha256(b" ".join(collapsed(t, r))).hexdigest()

    ddl = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _over(text_columns(docs, id_col, text_col), rows, _DIGEST, ddl, change)
