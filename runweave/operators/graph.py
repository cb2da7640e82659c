"""Compacted coloured graphs: maximal paths without branches whose fragments are in the same samples.

A fragment of k units (words or bases) overlaps its neighbours by k - 1 units, its junctions. Where a junction has just one
fragment on each side, both in the same samples, they belong to one path. Texts are laid together in slices, and what their
junctions need to know of each other goes, packed as arrays, to buckets of junctions, in two turns. The first tells which junctions
occur once: 32 bits of each do for that, as a chance meeting only sends a junction on. Those that occur once link the fragments beside
them. In the second turn the others bring their neighbours and samples, and learn which fragments have their first place there
and which junctions link them. Stretches of linked first places in one text follow at once; only these, joined where a path
goes on elsewhere, are ranked by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import Steps
from .ranking import ranked

LEFT, RIGHT = 0, 1
#: Units of a slice at most, if it holds several texts, and units to a bucket of junctions.
SLICE, BUCKET = 1 << 17, 1 << 21
#: A place is a slice's number above this many bits of a position in it; slices are numbered within this many bits of a partition's.
_POS, _OWN = 30, 14
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_SIDES = np.array([0, 0x6A09E667F3BCC908, 0xBB67AE8584CAA73B], np.uint64)
_FLIPPED = np.array([1, 0, 2])
_CODES = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODES[_c] = _i
_COMPLEMENT = str.maketrans("ACGT", "TGCA")
#: What a junction of a slice is: in no fragment, there once, sent to its bucket, alike to one that is sent.
_NONE, _ONCE, _SENT, _ALIKE = range(4)


def text_words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def _chained(units: np.ndarray, n: int, factor: np.uint64, back: bool = False) -> np.ndarray:
    """A hash of each n neighbours, which differ by 64 bits each, taken from first to last or back."""
    h = np.zeros(max(0, len(units) - n + 1), np.uint64)
    for j in range(n - 1, -1, -1) if back else range(n):
        h ^= h >> np.uint64(29)
        h *= factor
        h += units[j : len(h) + j]
    h ^= h >> np.uint64(32)
    h *= factor
    return h ^ h >> np.uint64(29)


def _words(text: str) -> list[str]:
    found = text.split(" ")
    return [x for x in found if x] if "" in found else found


def _hashed(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False)


def _hashes(texts: list[str], k: int, bases: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, a, b, side, good): junctions of each text, and of each junction two hashes, its side and whether it is one.

    Bases are read in both directions, and a junction is known by the lesser hashes of the two. side 0: it is read so, 1: in
    the other direction, 2: both are the same; words have side 0. Places with another letter than A, C, G, T are none.
    """
    n = k - 1
    if bases:
        parts = [_CODES[np.frombuffer(t.upper().encode("latin-1", "replace"), np.uint8)] for t in texts]
        codes = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        bad = np.concatenate([[0], np.cumsum(codes > 3)])
        good = bad[n:] == bad[: len(bad) - n]
        back = np.where(codes > 3, 4, 3 - codes)
        letters = _hashed(list("ACGT-"))
        a, b = (_chained(letters[codes], n, x) for x in _FACTORS)
        ra, rb = (_chained(letters[back], n, x, back=True) for x in _FACTORS)
        turned = (ra < a) | ((ra == a) & (rb < b))
        side = np.where((ra == a) & (rb == b), 2, turned).astype(np.int64)
        a, b = np.where(turned, ra, a), np.where(turned, rb, b)
    else:
        parts = [_words(t) for t in texts]
        every = _hashed(list(chain.from_iterable(parts)))
        a, b = (_chained(every, n, x) for x in _FACTORS)
        side, good = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    units = np.fromiter(map(len, parts), np.int64, len(parts))
    sizes = np.where(units >= k, units - n + 1, 0)
    local = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    kept = (local < np.repeat(sizes, units))[: len(a)]
    return sizes, a[kept], b[kept], side[kept], good[kept]


class _Slice:
    """The junctions of a slice of texts: what they are, and the distinct parts of hashes that go to each bucket."""

    def __init__(self, texts: list[str], k: int, bases: bool, n_buckets: int):
        self.sizes, self.a, self.b, self.side, good = _hashes(texts, k, bases)
        n = len(self.a)
        begins = np.zeros(n + 1, bool)
        begins[np.cumsum(self.sizes)] = begins[:1] = True
        self.left = good & ~begins[:n]
        self.left[1:] &= good[:-1]
        self.right = np.append(self.left[1:], False)
        self.live = np.flatnonzero(self.left | self.right)
        self.bucket = (self.a[self.live] % np.uint64(n_buckets)).astype(np.int64)
        self.keys, self.at, self.counts = np.unique(self.bucket << 32 | (self.b[self.live] & np.uint64(0xFFFFFFFF)).astype(np.int64), return_inverse=True, return_counts=True)
        self.bounds = np.searchsorted(self.keys, np.arange(n_buckets + 1) << 32)


def _planes(numbers: np.ndarray) -> bytes:
    """Rising numbers of 32 bits as steps, their lowest bytes first: high ones are mostly zero and vanish when compressed."""
    return np.diff(numbers, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(x: bytes | memoryview) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def _told(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split(" ") for x in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[kind]) if c in columns else pa.nulls(n, kinds[kind]) for c, kind in fields], names=[c for c, _ in fields])


def _pressed(texts: list[str]) -> bytes:
    """Texts as they are stored and shuffled."""
    batch, sink = pa.record_batch([pa.array(texts, pa.large_string())], names=["text"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(batch)
    return sink.getvalue().to_pybytes()


def _texts(x: bytes) -> list[str]:
    return pa.ipc.open_stream(x).read_all().column(0).to_pylist()


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each value of the first column, by which they are sorted."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[0] != now and held:
                yield now, held
                held = []
            now = row[0]
            held.append(row)
    if held:
        yield now, held


_SLICED = "sid long, units long, colors array<int>, texts binary"
_PACKED = "bucket long, sid long, x binary, y binary, colors array<int>"
_ANSWER = "sid long, kind int, x binary, y binary, colors array<int>, u long, v long"
_STRETCH = "id long, last long, n long, sid long, text int, pos int, color int"
_STATUS, _FIRST, _LINK, _COLORS = range(4)


def _sliced(named: DataFrame, k: int, bases: bool) -> DataFrame:
    """(sid, units, colors, texts): (color, text) in slices, numbered by partition, the texts compressed; those that are too short go."""
    most = SLICE

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        colors, texts, size, n = [], [], 0, 0

        def one() -> pa.RecordBatch:
            if part >> 61 - _POS - _OWN or n >> _OWN:
                raise OverflowError("too many texts in a partition, or partitions")
            return _told(_SLICED, sid=[part << _OWN | n], units=[size], colors=[colors], texts=[_pressed(texts)])

        for b in batches:
            for part, color, text in zip(*(c.to_pylist() for c in b.columns)):
                units = len(text) if bases else text.count(" ") + 1
                if units < k:
                    continue
                if texts and size + units > most:
                    yield one()
                    colors, texts, size, n = [], [], 0, n + 1
                colors.append(color)
                texts.append(text)
                size += units
        if texts:
            yield one()

    return named.select(F.spark_partition_id().alias("part"), "color", "text").mapInArrow(gather, _SLICED)


def _repeated(slices: DataFrame, k: int, bases: bool, n_buckets: int) -> DataFrame:
    """(sid, r): for each bucket, which of the sorted keys of a slice are also in other slices, as (bucket, bits); nothing where none is."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sid, texts in zip(*(c.to_pylist() for c in b.columns)):
                s = _Slice(_texts(texts), k, bases, n_buckets)
                some = np.flatnonzero(np.diff(s.bounds)).tolist()
                yield _told("bucket long, sid long, x binary", bucket=some, sid=[sid] * len(some), x=[_planes(s.keys[s.bounds[i] : s.bounds[i + 1]] & 0xFFFFFFFF) for i in some])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches):
            parts = [_unplaned(x) for _, _, x in rows]
            every = np.concatenate(parts)
            order = np.argsort(every, kind="stable")
            same = np.concatenate([[False], every[order][1:] == every[order][:-1], [False]])
            again = np.zeros(len(every), bool)
            again[order] = same[1:] | same[:-1]
            found = [(sid, np.packbits(x).tobytes()) for (_, sid, _), x in zip(rows, np.split(again, np.cumsum(list(map(len, parts)))[:-1])) if x.any()]
            yield _told("sid long, bucket long, bits binary", sid=[x for x, _ in found], bucket=[bucket] * len(found), bits=[x for _, x in found])

    sent = slices.select("sid", "texts").mapInArrow(send, "bucket long, sid long, x binary")
    told = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "sid long, bucket long, bits binary")
    steps = Steps(slices.sparkSession)
    found = steps.kept(steps.kept(told).groupBy("sid").agg(F.collect_list(F.struct("bucket", "bits")).alias("r")))
    steps.freed()
    return found


def _packed(slices: DataFrame, repeated: DataFrame, k: int, bases: bool, n_buckets: int) -> DataFrame:
    """(bucket, sid, x, y, colors): the junctions that may occur again, with their neighbours; and what all junctions of a slice are.

    In x: 8 and 2 bytes of hashes that tell junctions apart, 6 of the neighbours on its two sides (0: none), positions, colors,
    and flags: read in the other direction, its own reverse complement, its own neighbour. Of those alike in a slice the first goes.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sid, colors, texts, r in zip(*(c.to_pylist() for c in batch.columns)):
                s = _Slice(_texts(texts), k, bases, n_buckets)
                again = s.counts > 1
                for x in r or []:
                    lo, hi = s.bounds[x["bucket"]], s.bounds[x["bucket"] + 1]
                    again[lo:hi] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)
                status = np.zeros(len(s.a), np.uint8)
                status[s.live] = _ONCE
                again_at = np.flatnonzero(again[s.at] | (s.side[s.live] == 2))
                p = s.live[again_at]  # one that is its own reverse complement may meet a fragment twice
                side, left, right = s.side[p], s.left[p], s.right[p]
                before, after = np.maximum(p - 1, 0), np.minimum(p + 1, len(s.a) - 1)

                def known(there: np.ndarray, q: np.ndarray, flip: np.ndarray) -> np.ndarray:
                    x = (s.a[q] ^ _SIDES[np.where(flip, _FLIPPED[s.side[q]], s.side[q])]) & np.uint64(0xFFFFFFFFFFFF)  # noqa: B023
                    return np.where(there, np.maximum(x, np.uint64(1)), np.uint64(0))

                x, y = known(left, before, side > 0), known(right, after, side == 1)
                into, out = np.where(side == 1, y, x), np.where(side == 1, x, y)
                same = lambda there, q: there & (s.a[q] == s.a[p]) & (s.b[q] == s.b[p])  # noqa: B023, E731
                flags = (side == 1) | (side == 2) << 1 | (same(left, before) | same(right, after)) << 2
                color = np.repeat(np.array(colors, np.int64), s.sizes)[p]
                alike = np.zeros(len(p), bool)
                own = np.flatnonzero(s.counts[s.at[again_at]] > 1)
                keys = [v[own] for v in (color, out, into, s.a[p])]
                order = np.lexsort(keys)
                alike[own[order[1:]]] = np.logical_and.reduce([v[order[1:]] == v[order[:-1]] for v in keys])
                status[p] = np.where(alike, _ALIKE, _SENT)
                bucket = (s.a[p] % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                order = order[~alike[order]]
                bounds = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                raw = lambda v, size, i: v[i].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
                rows = []
                for g in np.flatnonzero(np.diff(bounds)).tolist():
                    i = order[bounds[g] : bounds[g + 1]]
                    rows.append((g, raw(s.a[p], 8, i) + raw(s.b[p], 2, i) + raw(into, 6, i) + raw(out, 6, i) + _planes(p[i]) + _planes(color[i]) + flags[i].astype(np.uint8).tobytes()))
                yield _told(_PACKED, bucket=[g for g, _ in rows], sid=[sid] * len(rows), x=[x for _, x in rows])
                yield _told(_PACKED, bucket=[n_buckets + sid % n_buckets], sid=[sid], x=[status.tobytes()], y=[s.sizes.astype("<i8").tobytes()], colors=[colors])

    joined = slices.select("sid", "colors", "texts").join(repeated.hint("shuffle_hash"), "sid", "left")
    return joined.select("sid", "colors", "texts", "r").mapInArrow(send, _PACKED)


def _unpacked(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """(a, b, into, out, place, color, flags) of the junctions of a bucket."""
    found = []
    for _, sid, x, _, _ in rows:
        n, at, view = len(x) // 31, 0, memoryview(x)

        def wide(size: int) -> np.ndarray:
            nonlocal at
            v = np.zeros((n, 8), np.uint8)  # noqa: B023
            v[:, :size] = np.frombuffer(view[at : at + size * n], np.uint8).reshape(n, size)  # noqa: B023
            at += size * n  # noqa: B023
            return v.view("<u8").ravel()

        a, b, into, out = wide(8), wide(2), wide(6), wide(6)
        pos, color, flags = _unplaned(view[at : at + 4 * n]), _unplaned(view[at + 4 * n : at + 8 * n]) & 0xFFFFFFFF, np.frombuffer(view[at + 8 * n :], np.uint8)
        found.append((a, b, into, out, sid << _POS | pos, color, flags))
    return tuple(map(np.concatenate, zip(*found)))


def _answers(packed: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of four kinds: what the junctions of a slice are; positions in a slice of junctions before which a fragment has its first
    place, and of those that link it to the one before; links (u, v) of ends elsewhere, 2 * place + end; colors of fragments at places u
    that no link there precedes, where there are several."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in grouped(batches):
            if bucket >= n_buckets:
                for _, sid, x, y, colors in rows:
                    yield _told(_ANSWER, sid=[sid], kind=[_STATUS], x=[x], y=[y], colors=[colors])
                continue
            a, b, into, out, place, color, flags = _unpacked(rows)
            n, turned, reverse = len(a), flags & 1 == 1, flags & 2 == 2
            order = np.lexsort((b, a))
            gid = np.zeros(n, np.int64)
            gid[order[1:]] = np.cumsum((a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]]))
            n_g = int(gid.max()) + 1
            # each junction meets a fragment on either side: its place there is one less if it is read before the junction
            near = [np.where(turned, LEFT, RIGHT), np.where(turned, RIGHT, LEFT)]  # the end that is at the junction
            slot = np.flatnonzero(np.concatenate([into, out]))
            entry, kind = slot % n, np.where(reverse[slot % n], 2, slot // n)
            key, met = gid[entry] * 3 + kind, np.concatenate([into, out])[slot]
            end = np.concatenate(near)[slot]
            home = place[entry] - end
            order = np.lexsort((home, met, key))
            new = np.concatenate([[True], (key[order[1:]] != key[order[:-1]]) | (met[order[1:]] != met[order[:-1]])])
            of = np.zeros(len(slot), np.int64)
            of[order] = np.cumsum(new) - 1
            first = order[new]  # of each fragment on a side of a junction: where it is met first
            side = key[first]
            degree = np.bincount(side, minlength=3 * n_g).reshape(n_g, 3)
            # colors of each fragment, and of both sides of a junction
            pairs = np.unique(of << 31 | color[entry])
            held, shade = pairs >> 31, pairs & 0x7FFFFFFF
            n_colors, color_at = np.bincount(held, minlength=len(first)), np.searchsorted(held, np.arange(len(first) + 1))
            n_both = np.bincount(np.unique((side[held] // 3) << 31 | shade) >> 31, minlength=n_g)
            g = np.flatnonzero((degree[:, 0] == 1) & (degree[:, 1] == 1) & (degree[:, 2] == 0) & (np.bincount(gid, flags & 4, minlength=n_g) == 0))
            f = np.searchsorted(side, 3 * g)  # sides are sorted, and such a junction has one fragment on each
            g, f = (v[(n_colors[f] == n_both[g]) & (n_colors[f + 1] == n_both[g])] for v in (g, f))
            (u, v), (eu, ev) = ([w[first[f]], w[first[f + 1]]] for w in (home, end))
            beside = ((v == u + 1) & (eu == RIGHT) & (ev == LEFT)) | ((u == v + 1) & (ev == RIGHT) & (eu == LEFT))
            links = np.full(n_g, -1, np.int64)
            links[g[beside]] = np.maximum(u, v)[beside]
            linked = links[gid] == place
            far = ~beside
            yield _told(_ANSWER, sid=np.zeros(far.sum(), np.int64), kind=np.full(far.sum(), _LINK), u=(2 * u + eu)[far], v=(2 * v + ev)[far])
            # the fragment after a junction, as it is read there
            follows = np.flatnonzero(end == LEFT)
            begun = np.zeros(n, bool)
            own = follows[home[first[of[follows]]] == place[entry[follows]]]
            begun[entry[own]] = True
            several = own[(n_colors[of[own]] > 1) & ~linked[entry[own]]]
            lists = [shade[color_at[i] : color_at[i + 1]].astype(np.int32) for i in of[several].tolist()]
            yield _told(_ANSWER, sid=np.zeros(len(lists), np.int64), kind=np.full(len(lists), _COLORS), u=place[entry[several]], colors=lists)
            found, at = [], 0
            pos = place & (1 << _POS) - 1
            for _, sid, x, _, _ in rows:
                here = slice(at, at := at + len(x) // 31)
                if begun[here].any():
                    found.append((sid, *(pos[here][w[here]].astype("<u4").tobytes() for w in (begun, linked))))
            yield _told(_ANSWER, sid=[x for x, _, _ in found], kind=[_FIRST] * len(found), x=[x for _, x, _ in found], y=[x for _, _, x in found])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, _ANSWER)


def _stretches(answers: DataFrame) -> DataFrame:
    """(id, last, n, sid, text, pos, color): neighbouring first places of linked fragments; id, last: places, pos: in the text of the slice."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sid, rows in grouped(batches):
            _, _, x, sizes, colors = next(r for r in rows if r[1] == _STATUS)
            status, sizes = np.frombuffer(x, np.uint8), np.frombuffer(sizes, "<i8")
            n = len(status)
            begun, linked = np.zeros(n, bool), np.zeros(n, bool)
            for _, kind, x, y, _ in rows:
                if kind == _FIRST:
                    begun[np.frombuffer(x, "<u4")] = True
                    linked[np.frombuffer(y, "<u4")] = True
            text = np.repeat(np.arange(len(sizes)), sizes)
            there = np.zeros(n, bool)  # a fragment lies between two junctions of a text
            there[:-1] = (status[1:] > 0) & (status[:-1] > 0) & (text[1:] == text[:-1])
            begun = there & (begun | (status == _ONCE))
            inner = begun & (linked | (status == _ONCE))
            inner[1:] &= there[:-1]
            inner[:1] = False
            p = np.flatnonzero(begun)
            first = p[~inner[p]]
            size = np.diff(np.append(np.searchsorted(p, first), len(p)))
            t = text[first]
            place = sid << _POS | first
            yield _told(_STRETCH, id=place, last=place + size - 1, n=size, sid=np.full(len(first), sid), text=t, pos=first - (np.cumsum(sizes) - sizes)[t], color=np.array(colors, np.int64)[t])

    some = answers.where(F.col("kind").isin(_STATUS, _FIRST)).select("sid", "kind", "x", "y", "colors")
    return some.repartition("sid").sortWithinPartitions("sid").mapInArrow(cut, _STRETCH)


def _ordered(steps: Steps, jumps: DataFrame, directed: bool) -> DataFrame:
    """(id, unitig, at, turned) of the stretches that jumps (from, end, to, entry) join to paths.

    Each stretch is two elements, 2 * id + way, one for each direction in which it is walked; the walk ends where no jump
    leaves. A circle is opened before its least stretch.
    """
    two = lambda i: F.explode(F.array(2 * F.col(i), 2 * F.col(i) + 1)).alias("x")
    id_of = lambda x: F.shiftright(x, 1)
    walk = jumps.select((2 * F.col("from") + 1 - F.col("end")).alias("x"), (2 * F.col("to") + F.col("entry")).alias("next"))
    every = jumps.select("from").distinct().select(two("from")).join(walk, "x", "left")
    first = every.select("x", F.coalesce("next", "x").alias("next"), F.col("next").isNotNull().cast("long").alias("dist"), F.least(id_of("x"), id_of(F.coalesce("next", "x"))).alias("least"), F.col("next").isNull().alias("done"))
    start = steps.kept(first)
    ranks = ranked(steps, start)
    rings = ranks.where("not done").select("x", F.col("least").alias("ring"))
    if not rings.isEmpty():
        # the least stretch begins: no walk enters it from its left, and walking it backwards ends there
        stop = (F.col("x") == 2 * F.col("ring") + 1) | (F.col("next") == 2 * F.col("ring"))
        cut = start.join(rings, "x").withColumn("done", stop)
        cut = cut.select("x", F.when(stop, F.col("x")).otherwise(F.col("next")).alias("next"), F.when(stop, 0).otherwise(F.col("dist")).cast("long").alias("dist"), "least", "done")
        straight = steps.kept(ranks.where("done"))
        ranks = straight.unionByName(ranked(steps, cut))
    ends = ranks.groupBy(id_of("x").alias("id")).agg(*[F.max(F.when(F.col("x") % 2 == w, F.struct("next", "dist"))).alias(f"w{w}") for w in (0, 1)])
    turned = F.lit(False) if directed else F.col("w0.next") < F.col("w1.next")
    begin = F.when(turned, F.col("w0")).otherwise(F.col("w1"))
    return steps.kept(ends.select("id", id_of(begin.getField("next")).alias("unitig"), begin.getField("dist").alias("at"), turned.alias("turned")))


def _pieces(steps: Steps, slices: DataFrame, k: int, bases: bool) -> DataFrame:
    """(id, unitig, at, alone, turned, n, sid, text, pos, colors): the stretches of each path in order; turned: it reads one in the other direction."""
    total = slices.agg(F.sum("units").alias("n")).first().n or 0
    n_buckets = 1 + total // BUCKET
    repeated = _repeated(slices, k, bases, n_buckets)
    answers = steps.kept(_answers(_packed(slices, repeated, k, bases, n_buckets), n_buckets))
    several = answers.where(F.col("kind") == _COLORS).select(F.col("u").alias("id"), "colors")
    found = _stretches(answers).join(several, "id", "left")
    stretches = steps.kept(found.select("id", "last", "n", "sid", "text", "pos", F.coalesce("colors", F.array("color")).alias("colors")))
    steps.freed()
    far = answers.where(F.col("kind") == _LINK).select("u", "v")
    ends = stretches.select("id", F.explode(F.array(2 * F.col("id") + LEFT, 2 * F.col("last") + RIGHT)).alias("e"))
    placed = steps.kept(far.join(ends.select(F.col("e").alias("u"), F.col("id").alias("from")), "u").join(ends.select(F.col("e").alias("v"), F.col("id").alias("to")), "v"))
    there = placed.select("from", (F.col("u") % 2).alias("end"), "to", (F.col("v") % 2).alias("entry"))
    back = placed.select(F.col("to").alias("from"), (F.col("v") % 2).alias("end"), F.col("from").alias("to"), (F.col("u") % 2).alias("entry"))
    ranks = _ordered(steps, there.unionByName(back), directed=not bases)
    at = [F.coalesce("unitig", "id").alias("unitig"), F.coalesce("at", F.lit(0)).alias("at"), F.col("unitig").isNull().alias("alone"), F.coalesce("turned", F.lit(False)).alias("turned")]
    return stretches.join(ranks, "id", "left").select("id", *at, "n", "sid", "text", "pos", "colors")


_CUT = "unitig long, at long, alone int, n long, colors array<int>, s string"


def _cutter(k: int, bases: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first stretch of a path brings all its units, a later one those that it adds."""
        for b in batches:
            for texts, pieces in zip(*(c.to_pylist() for c in b.columns)):
                texts, now, out = _texts(texts), None, []
                pieces.sort(key=lambda p: p["text"])
                for p in pieces:
                    if p["text"] != now:
                        now = p["text"]
                        units = texts[now].upper() if bases else _words(texts[now])
                    whole = units[p["pos"] : p["pos"] + p["n"] + k - 1]
                    if p["turned"]:
                        whole = whole.translate(_COMPLEMENT)[::-1]
                    some = whole if p["at"] == 0 else whole[k - 1 :]
                    out.append(some if bases else " ".join(some))
                yield _told(_CUT, **{c: [p[c] for p in pieces] for c in ("unitig", "at", "n", "colors")}, alone=[int(p["alone"]) for p in pieces], s=out)

    return cut


def unitigs(samples: DataFrame, k: int, sample: str, text: str, bases: bool = False) -> DataFrame:
    """(unitig, names, n_fragments, sequence): the compacted coloured graph of the samples' texts, a row for each path.

    samples: any number of texts for each sample name; rows without a name go, null texts hold nothing. names: those of the
    samples that hold each fragment of the path, sorted. sequence: its words, one blank between, or its bases; fragments
    of bases and their reverse complements are one, and other letters than A, C, G, T part a text. A circle is told once,
    from the fragment whose place is least. Paths are told apart by unitig, the place of their first stretch. Junctions are known by
    80 bits of hashes, and the neighbours of one by 48.
    """
    if k < 2:
        raise ValueError("fragments need two units at least")
    steps = Steps(samples.sparkSession)
    some = samples.select(F.col(sample).cast("string").alias("name"), F.col(text).cast("string").alias("text")).where("name is not null")
    # samples are the columns of a matrix: their list is one of its sides
    colors = steps.kept(some.select("name").distinct().select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("color")))
    slices = steps.kept(_sliced(some.where("text is not null").join(colors, "name"), k, bases))
    found = steps.kept(_pieces(steps, slices, k, bases))
    steps.freed()
    # a slice is laid once beside all its stretches, not once for each
    of_slice = found.groupBy("sid").agg(F.collect_list(F.struct("unitig", "at", "alone", "turned", "n", "text", "pos", "colors")).alias("p"))
    cut = slices.select("sid", "texts").join(of_slice.hint("shuffle_hash"), "sid").select("texts", "p").mapInArrow(_cutter(k, bases), _CUT)
    # paths of one stretch are whole
    parts = cut.where("alone = 0").groupBy("unitig").agg(
        F.min("colors").alias("colors"), F.sum("n").alias("n_fragments"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda y: y["s"]), "" if bases else " ").alias("sequence")
    )
    paths = cut.where("alone = 1").select("unitig", "colors", F.col("n").alias("n_fragments"), F.col("s").alias("sequence")).unionByName(parts)
    sets = found.select("colors").distinct()
    named = sets.select("colors", F.explode("colors").alias("color")).join(colors, "color").groupBy("colors").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return paths.join(named, "colors").select("unitig", "names", "n_fragments", "sequence")
