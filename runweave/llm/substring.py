"""Substring deduplication: words of 20-word windows that also start earlier are removed.

Windows are routed by content. Each window has an anchor, the six-word gram in it with the least hash (the first of
equals); neighbouring windows with one anchor form a context. Equal windows have equal anchors, so all that could match
meets under the anchor's gram, the seed. The reference is cut in shards by seed; over a shard's distinct contexts, in
order of first occurrence, suffix automata are built while each context streams through the automaton of those before
it: where the matching statistic reaches 20, a window also starts earlier. The reference grows with the corpus, so a
shard's automaton goes to the task that holds the shard's contexts; an automaton never has more than `SHARD` words.

Before that, seeds are counted; those that occur twice fill a Bloom filter sized by their number, which is broadcast so
that only contexts with a repeated seed are shuffled (a false hit costs work, never a wrong result); a second one holds
the seeds whose contexts differ, and only those contexts carry their words. Both stop growing at 2**MOST_BITS bits; with
more seeds than fit, a semi-join on the seed takes the filters' place. Equal contexts fall together map-side and stay one
row however often they occur. Contexts meet the counts of their seed under salted keys. A seed with more than `HOT`
distinct contexts is taken apart into its windows, which Spark aggregates like any key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, in_filter, record, scratch, seed_filter, slices, words

WINDOW, GRAM = 20, 6
#: Words in one automaton; distinct contexts of a seed from which its windows are aggregated by Spark.
SHARD, HOT = 60_000, 512
#: Binary logarithm of the most bits of a Bloom filter (32 MB); bits for each seed; salts of a seed.
MOST_BITS, BITS_A_SEED, SALTS = 28, 12, 8
_SEED = pa.schema([("seed", pa.int64()), ("ctx", pa.int64())])
_CONTEXT = pa.schema([("d", pa.int64()), ("xh", pa.int64()), ("at", pa.int32()), ("m", pa.int32()), ("seed", pa.int64()), ("ctx", pa.int64()), ("said", pa.binary())])
_MASK = pa.schema([("seed", pa.int64()), ("ctx", pa.int64()), ("mask", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Weights of a word's bytes; longer words are hashed one by one.
_LONG = 4096
_WEIGHTS = np.cumprod(np.full(_LONG, 0x9E3779B97F4A7C15, np.uint64))


def _joined(left: np.ndarray, right: np.ndarray, n: int, by: int) -> np.ndarray:
    """Hashes of sequences that consist of one of `left` and, `by` words on, one of `right` with n words."""
    m = max(0, len(right) - by)
    return left[:m] * np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64)) + right[by : by + m]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def token_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, first byte and end of each word of texts that lie one after the other in `raw`."""
    full = ~_BLANK[raw]
    before, after = np.r_[False, full[:-1]], np.r_[full[1:], False]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    first, end = np.flatnonzero(full & ~before), np.flatnonzero(full & ~after) + 1
    size = end - first
    of = np.searchsorted(bounds, first, side="right") - 1
    if not len(first):
        return np.zeros(0, np.uint64), of, first, end
    at = np.flatnonzero(full)
    inside = at - np.repeat(first, size)
    weighed = (raw[at].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[np.minimum(inside, _LONG - 1)]
    h = np.add.reduceat(weighed, np.cumsum(size) - size)
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(raw[first[i] : end[i]].tobytes())
    return _mixed(h + size.astype(np.uint64)), of, first, end


def contexts(raw: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The contexts of texts that lie one after the other in the bytes `raw`, parted at `bounds`.

    doc: number of the text; at: first word; m: windows; seed, ctx: hashes; first, end: bytes of its words.
    """
    h1, of, first, end = token_hashes(raw, bounds)
    h2 = _joined(h1, h1, 1, 1)
    h4 = _joined(h2, h2, 2, 2)
    h8 = _joined(h4, h4, 4, 4)
    h16 = _joined(h8, h8, 8, 8)
    grams, wide = _mixed(_joined(h4, h2, 2, 4)), WINDOW - GRAM + 1
    window = _joined(h16, h4, 4, 16)
    n = len(window)
    # of the grams in a window, the least by its upper bits, then the first
    low = (grams & ~np.uint64((1 << 30) - 1)) | np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << 30) - 1)
    for by in (1, 2, 4):
        low = np.minimum(low[: len(low) - by], low[by:])
    low = np.minimum(low[: len(low) - (wide - 8)], low[wide - 8 :])[:n] if n else low[:0]
    valid = np.flatnonzero(of[:n] == of[WINDOW - 1 : n + WINDOW - 1]) if n else np.zeros(0, int)
    low = low[valid] & np.uint64((1 << 30) - 1)
    start = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (of[valid[1:]] != of[valid[:-1]])]) if len(valid) else np.zeros(0, int)
    m = np.diff(np.r_[start, len(valid)])
    place = valid[start]
    offset = np.arange(len(valid)) - np.repeat(start, m)
    ctx = np.add.reduceat(_mixed(window[valid] + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), start) if len(start) else np.zeros(0, np.uint64)
    words_before = np.searchsorted(of, np.arange(len(bounds)), side="left")
    return {"doc": of[place], "at": place - words_before[of[place]], "m": m, "seed": grams[low[start].astype(np.int64)], "ctx": _mixed(ctx + m.astype(np.uint64)), "first": first[place], "end": end[place + m + WINDOW - 2] if len(place) else place}


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column without nulls, of short or of long offsets."""
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], wide, len(column) + 1, column.offset * wide().itemsize).astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


class Automaton:
    """Suffix automaton of token sequences; sequences are parted, no match runs across two of them."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def add(self, sequence) -> None:
        """Add a sequence to those whose substrings are recognised."""
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            if c in nxt[last]:
                q = nxt[last][c]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                own = -1
            else:
                own, q, p = self._state(length[last] + 1, 0, {}), -1, last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = own
                    p = link[p]
                if p == -1:
                    last = own
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[own] = q
                    last = own
                    continue
                last, p = p, own
            # q is reached by longer paths too: part it
            base = last
            clone = self._state(length[base] + 1, link[q], dict(nxt[q]))
            p = base
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if own == -1:
                last = clone
            else:
                link[own] = clone
                last = own

    def statistics(self, sequence) -> Iterator[int]:
        """For each position: the length of the longest match that ends there."""
        nxt, link, length, v, n = self.next, self.link, self.length, 0, 0
        for c in sequence:
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                n += 1
            else:
                n = 0
            yield n


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (seed, ctx, said) sorted by seed and first occurrence: the repeated windows of each context as a bit mask."""
    shard, seen, size, last = Automaton(), {}, 0, None
    for b in slices(batches, 2048):
        out = []
        for seed, ctx, said in zip(*(c.to_pylist() for c in b.columns)):
            if seed != last and size > SHARD:
                shard, seen, size = Automaton(), {}, 0
            last = seed
            tokens = [seen.setdefault(w, len(seen)) for w in said.split()]
            mask = 0
            for i, n in enumerate(shard.statistics(tokens)):
                if n >= WINDOW:
                    mask |= 1 << (i - WINDOW + 1)
            shard.add(tokens)
            size += len(tokens)
            if mask:
                out.append((seed, ctx, mask))
        yield record(_MASK, *([x[i] for x in out] for i in range(3)))


def _repeats(docs: DataFrame) -> DataFrame:
    """(d, xh, spans): for each document (d, xh, text) with repeated windows, their starts as (at, mask)."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 0, rows=256):
            c = contexts(*_buffer(b.column(0)))
            yield record(_SEED, pa.array(c["seed"].view(np.int64)), pa.array(c["ctx"].view(np.int64)))

    counted = arrow_map(docs.select("text"), seeds, "seed long, ctx long").groupBy("seed").agg(F.count("*").alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high")).where("n > 1")
    twice = scratch(counted.select("seed", (F.col("low") != F.col("high")).alias("differs")))
    share, n_seeds = docs.sparkSession.sparkContext.broadcast, twice.count()
    bits = max(20, (n_seeds * BITS_A_SEED).bit_length())
    fits = bits <= MOST_BITS
    any_seed, telling = (share(seed_filter(x, bits)) if fits else None for x in (twice, twice.where("differs")))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 2, rows=256):
            raw, bounds = _buffer(b.column(2))
            c = contexts(raw, bounds)
            if fits:
                hit = in_filter(c["seed"], any_seed.value)
                c = {k: v[hit] for k, v in c.items()}
            ids = [b.column(i).take(pa.array(c["doc"])) for i in (0, 1)]
            text = raw.tobytes()
            told = in_filter(c["seed"], telling.value) if fits else np.ones(len(c["seed"]), bool)
            said = [text[i:j] if t else None for i, j, t in zip(c["first"].tolist(), c["end"].tolist(), told.tolist())]
            yield record(_CONTEXT, *ids, c["at"], c["m"], pa.array(c["seed"].view(np.int64)), pa.array(c["ctx"].view(np.int64)), said)

    maybe = arrow_map(docs.select("d", "xh", "text"), candidates, "d long, xh long, at int, m int, seed long, ctx long, said binary")
    found = scratch(maybe if fits else maybe.join(twice.select("seed"), "seed", "left_semi").select(maybe.columns))
    distinct = scratch(found.groupBy("seed", "ctx").agg(F.min(F.struct("d", "xh", "at")).alias("first"), F.min("m").alias("m"), F.min("said").alias("said")))
    many = distinct.where("said is not null").groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")
    salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shared = distinct.where("said is not null").withColumn("salt", F.pmod("ctx", F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"]).drop("salt")
    cold = shared.where(F.col("n") <= HOT).select("seed", "ctx", "said", "first").repartition("seed").sortWithinPartitions("seed", "first").select("seed", "ctx", "said")
    by_automaton = arrow_map(cold, _match, "seed long, ctx long, mask long")
    said = F.split(F.col("said").cast("string"), r"[\x20\x09-\x0D]+")
    windows = shared.where(F.col("n") > HOT).select("seed", "ctx", "first", said.alias("w"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    windows = windows.select("seed", "ctx", "i", F.struct("first.d", "first.xh", (F.col("first.at") + F.col("i")).alias("at")).alias("own"), F.array_join(F.slice("w", F.col("i") + 1, WINDOW), " ").alias("g"))
    firsts = windows.groupBy("seed", "g").agg(F.min("own").alias("least"))
    by_window = windows.join(firsts, ["seed", "g"]).where("own > least").groupBy("seed", "ctx").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask"))
    # stored, so that both sides of the next join are plain shuffles, whose large partitions Spark can split
    known = scratch(distinct.select("seed", "ctx", "first").join(by_automaton.unionByName(by_window), ["seed", "ctx"], "left"))
    own = F.struct("d", "xh", "at") == F.col("first")
    mask = F.when(own, F.coalesce("mask", F.lit(0))).otherwise(F.expr("shiftleft(1L, m) - 1"))
    marked = found.select("d", "xh", "at", "m", "seed", "ctx").join(known, ["seed", "ctx"]).select("d", "xh", "at", mask.alias("mask")).where("mask <> 0")
    return scratch(marked.groupBy("d", "xh").agg(F.collect_set(F.struct("at", "mask")).alias("spans")))


def _removed(n: int, spans) -> np.ndarray:
    """Words covered by the windows of (at, mask) spans."""
    edges = np.zeros(n + 1, np.int64)
    for s in spans or ():
        at, mask = s["at"], s["mask"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            run = ((~(mask >> low)) & ((mask >> low) + 1)).bit_length() - 1
            edges[at + low] += 1
            edges[at + low + run + WINDOW - 1] -= 1
            mask &= ~(((1 << run) - 1) << low)
    return np.cumsum(edges[:-1]) > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): a row for each row of `docs`, kept being the words left as UTF-8.

    A window that also starts earlier (smaller doc_id, or same document, earlier start) is removed, by the input as it is.
    Rows with equal doc_id and text are one document and lose the same words. Different texts under one doc_id are
    ordered by a hash of the text. Null doc_ids come after all others; null and empty texts have no word. Other columns
    are ignored; empty tables give no rows.
    """
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = some.withColumn("d", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("xh", F.xxhash64("text"))
    joined = some.join(_repeats(some), ["d", "xh"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1, rows=256):
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                w, gone = words(text), 0
                n = len(w)
                if spans:
                    off = _removed(n, spans)
                    gone = int(off.sum())
                    w = [x for x, o in zip(w, off.tolist()) if not o]
                kept = b" ".join(w)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), kept))
            yield record(_OUT, b.column(0), *([r[i] for r in rows] for i in range(4)))

    return arrow_map(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
