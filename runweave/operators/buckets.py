"""Color sets of the k-mers of sequences, counted in buckets of minimizers.

Neighbouring k-mers mostly have the same minimizer, the m-mer in them whose hash is least. A stretch of such k-mers goes
to the minimizer's bucket as one string, which is far less than its k-mers one by one. K-mers with different minimizers
differ, so buckets are counted on their own. Sequences are laid together in slices, four bases to a byte, and all stretches of a
slice for one bucket travel as one row; those alike in a slice travel once. A bucket with more k-mers than a task can hold is
counted in rounds, each for a part of their hashes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import Steps
from .graph import grouped

#: Sets that a task holds before it tells them, k-mers that a task counts at once, of which a bucket has a quarter, and bases of a slice.
HOT, AT_ONCE, SLICE = 1 << 20, 1 << 22, 1 << 20
_BASE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _BASE[_c] = _i


def _codes(sequence: str) -> np.ndarray:
    return _BASE[np.frombuffer(sequence.upper().encode("latin-1", "replace"), np.uint8)]


def _packed(codes: np.ndarray) -> np.ndarray:
    """Four bases to a byte."""
    c = np.concatenate([codes, np.zeros(-len(codes) % 4, np.uint8)]).reshape(-1, 4)
    return c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]


def _unpacked(packed: np.ndarray) -> np.ndarray:
    return (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel()


def _padded(packed: np.ndarray) -> np.ndarray:
    return np.concatenate([packed, np.zeros(9, np.uint8)])


def _raw(padded: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k bases (31 at most) from each position, as a number."""
    words = np.ndarray((len(padded) - 8,), ">u8", padded, strides=(1,))
    i, shift = at >> 2, ((at & 3) << 1).astype(np.uint64)
    return (words[i].astype(np.uint64) << shift | padded[i + 8].astype(np.uint64) >> (np.uint64(8) - shift)) >> np.uint64(64 - 2 * k)


def canonical(raw: np.ndarray, k: int) -> np.ndarray:
    """The lesser number of k bases and their reverse complement."""
    x = ~raw
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = x >> np.uint64(bits) & np.uint64(mask) | (x & np.uint64(mask)) << np.uint64(bits)
    return np.minimum(raw, x.byteswap() >> np.uint64(64 - 2 * k)).astype(np.int64)


def _mers(packed: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The canonical k-mers at the positions, some at a time, so that only the outcome is held whole."""
    padded, found = _padded(packed), np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 16):
        found[i : i + (1 << 16)] = canonical(_raw(padded, at[i : i + (1 << 16)], k), k)
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of numbers, so that runs of one base aren't the commonest minimizers; not negative."""
    h = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(1)).astype(np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as each size."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _cut(packed: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, k-mers, minimizer) of the stretches in runs of bases of the given sizes, each with k bases at least."""
    total = int(sizes.sum())
    if total < k:
        return (np.zeros(0, np.int64),) * 3
    least, width, window = _mixed(_mers(packed, np.arange(total - m + 1), m)), 1, k - m + 1
    while width < window:
        step = min(width, window - width)
        least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
    step = np.zeros(len(least) + 1, np.int64)
    np.add.at(step, offsets, 1)
    np.add.at(step, offsets + sizes - k + 1, -1)
    good = np.cumsum(step[:-1]) > 0
    starts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (good[1:] != good[:-1])]))
    n = np.diff(np.append(starts, len(least)))
    kept = good[starts]
    return starts[kept], n[kept], least[starts[kept]]


def _runs(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs of k bases at least."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], codes < 4, [False]]).astype(np.int8)))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    return starts[sizes >= k], sizes[sizes >= k]


def stretches(sequence: str, k: int, m: int) -> list[tuple[int, str]]:
    """(minimizer, bases) of the stretches of neighbouring k-mers with one minimizer; k-mers with other letters are left out."""
    codes, sequence = _codes(sequence), sequence.upper()
    at, sizes = _runs(codes, k)
    whole, offsets = _spread(at, sizes), np.cumsum(sizes) - sizes
    s, n, least = _cut(_packed(codes[whole]), offsets, sizes, k, m)
    return [(x, sequence[p : p + c + k - 1]) for x, p, c in zip(least.tolist(), whole[s].tolist(), n.tolist())]


def _bytes(sizes: np.ndarray, places: np.ndarray, codes: np.ndarray) -> bytes:
    """Runs of bases as they are stored and shuffled: their sizes and places, lowest bytes first, and their bases."""
    planes = [v.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for v in (sizes, places)]
    return b"".join([np.int64(len(sizes)).tobytes(), *planes, _packed(codes).tobytes()])


def _read(x: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, places, packed bases)."""
    n = int(np.frombuffer(x, "<i8", 1)[0])
    sizes, places = (np.ascontiguousarray(np.frombuffer(x, np.uint8, 4 * n, 8 + 4 * n * i).reshape(4, n).T).view("<u4").ravel().astype(np.int64) for i in (0, 1))
    return sizes, places, np.frombuffer(x, np.uint8, offset=8 + 8 * n)


def _of_runs(rows: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k-mer, place) of all k-mers of stored runs."""
    parts = [_read(x) for _, _, x in rows]
    shift = 4 * np.cumsum([0, *[len(p) for _, _, p in parts]])
    starts = np.concatenate([np.cumsum(s) - s + b for (s, _, _), b in zip(parts, shift.tolist())])
    sizes, places = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return _mers(np.concatenate([p for _, _, p in parts]), _spread(starts, sizes - k + 1), k), np.repeat(places.astype(np.int32), sizes - k + 1)


def _counted(mers: np.ndarray, places: np.ndarray) -> Iterator[tuple[bytes, int]]:
    """How many k-mers each set of places holds, sets as bytes of sorted 32-bit numbers."""
    order = np.argsort(mers)
    mers = mers[order]
    each = np.cumsum(np.concatenate([[0], mers[1:] != mers[:-1]]))
    held = np.sort(each << 32 | places[order])
    held = held[np.concatenate([[True], held[1:] != held[:-1]])]
    each, places = held >> 32, held & 0xFFFFFFFF
    sizes = np.bincount(each)
    first = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        at = first[sizes == size]
        code = places[at]
        for j in range(1, size):  # sets alike so far have one number
            code = np.unique(code, return_inverse=True)[1] << 32 | places[at + j]
        _, some, n = np.unique(code, return_index=True, return_counts=True)
        for i, c in zip(at[some].tolist(), n.tolist()):
            yield places[i : i + size].astype("<i4").tobytes(), c


def kmer_sets(samples: DataFrame, sample: str, sequence: str, k: int, m: int) -> DataFrame:
    """(colors, n_fragments): distinct sets of sample names that hold a canonical k-mer, and how many k-mers each set has.

    k up to 31; m, the length of minimizers, less than k. Letters other than bases part a sequence, in whatever case. Null
    sequences and short ones hold nothing, rows without a name go, repeated rows change nothing; no rows in, no rows out.
    """
    if not 0 < m < k <= 31:
        raise ValueError("minimizers must be shorter than k-mers, and those 31 bases at most")
    steps = Steps(samples.sparkSession)
    some = samples.select(F.col(sample).cast("string").alias("name"), F.col(sequence).cast("string").alias("s")).where("name is not null")
    # samples are the columns of a matrix: their list is one of its sides
    names = steps.kept(some.select("name").distinct().select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("place")))
    placed = some.where("s is not null").join(names, "name").select("place", "s")

    most, at_once, hot = SLICE, AT_ONCE, HOT

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of bases in slices."""
        held, size = [], 0

        def one() -> pa.RecordBatch:
            runs = [(place, codes, *_runs(codes, k)) for place, codes in held]
            sizes = np.concatenate([n for _, _, _, n in runs])
            places = np.repeat([place for place, _, _, _ in runs], [len(n) for _, _, _, n in runs])
            bases = np.concatenate([codes[_spread(at, n)] for _, codes, at, n in runs])
            return pa.RecordBatch.from_arrays([pa.array([len(bases)], pa.int64()), pa.array([_bytes(sizes, places, bases)], pa.binary())], names=["n", "x"])

        for b in batches:
            for place, s in zip(*(c.to_pylist() for c in b.columns)):
                if len(s) >= k:
                    held.append((place, _codes(s)))
                    size += len(s)
                if size > most:
                    yield one()
                    held, size = [], 0
        if held:
            yield one()

    slices = steps.kept(placed.mapInArrow(gather, "n long, x binary"))
    n_buckets = 1 + (slices.agg(F.sum("n").alias("n")).first().n or 0) // max(1, at_once // 4)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The stretches of a slice, those for one bucket together; of those that are alike the first."""
        for b in batches:
            for x in b.column(0).to_pylist():
                sizes, places, packed = _read(x)
                offsets = np.cumsum(sizes) - sizes
                starts, n, least = _cut(packed, offsets, sizes, k, m)
                if not len(starts):
                    continue
                owner = places[np.searchsorted(offsets, starts, "right") - 1]
                # two k-mers at the ends tell a stretch of 2 k bases
                padded = _padded(packed)
                keys = [_raw(padded, starts, k).astype(np.int64), _raw(padded, starts + n - 1, k).astype(np.int64), n, owner]
                mix = np.zeros(len(n), np.int64)
                for v in keys:
                    mix = _mixed(mix ^ v)
                order = np.argsort(mix)
                alike = np.zeros(len(n), bool)
                alike[order[1:]] = np.logical_and.reduce([v[order[1:]] == v[order[:-1]] for v in keys]) & (n[order[1:]] <= k + 1)
                bucket = least % n_buckets
                order = np.argsort(bucket, kind="stable")
                order = order[~alike[order]]
                some, first = np.unique(bucket[order], return_index=True)
                codes, bounds, found = _unpacked(packed), [*first.tolist(), len(order)], []
                for lo, hi in zip(bounds, bounds[1:]):
                    i = order[lo:hi]
                    found.append(_bytes(n[i] + k - 1, owner[i], codes[_spread(starts[i], n[i] + k - 1)]))
                counts = np.add.reduceat(n[order], first)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.binary())], names=["bucket", "n", "x"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets one by one, large ones in rounds."""
        total: Counter = Counter()
        for _, rows in grouped(batches):
            rounds = 1 + sum(n for _, n, _ in rows) // at_once
            for turn in range(rounds):
                parts, some, size = [], [], 0
                for i, row in enumerate(rows):
                    some.append(row)
                    size += row[1]
                    if size > at_once // 8 or i == len(rows) - 1:
                        mers, places = _of_runs(some, k)
                        mine = slice(None) if rounds == 1 else _mixed(mers) % rounds == turn
                        parts.append((mers[mine], places[mine]))
                        some, size = [], 0
                mers, places = (np.concatenate(v) for v in zip(*parts))
                if len(mers):
                    for x, c in _counted(mers, places):
                        total[x] += c
            if len(total) > hot:
                yield told(total)
                total = Counter()
        yield told(total)

    def told(total: Counter) -> pa.RecordBatch:
        sets = pa.array([np.frombuffer(x, "<i4") for x in total], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([sets, pa.array(list(total.values()), pa.int64())], names=["places", "n"])

    sent = slices.select("x").mapInArrow(send, "bucket long, n long, x binary")
    counted = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "places array<int>, n long")
    sets = steps.kept(counted.groupBy("places").agg(F.sum("n").alias("n_fragments")))
    named = sets.select("places", F.explode("places").alias("place")).join(names, "place").groupBy("places").agg(F.array_sort(F.collect_list("name")).alias("colors"))
    return sets.join(named, "places").select("colors", "n_fragments")
