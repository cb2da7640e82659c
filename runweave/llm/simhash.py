"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by bit-sliced Hamming distances.

Fingerprints within `RADIUS` bits agree in at least three of six blocks of bits, so every pair that links meets under
one of the 20 choices of three blocks: about 32 bits of key, few strangers to a key. In each key's bucket the
fingerprints lie as 64 vertical bit planes; carry-save counters add the differing planes for 64 pairs per machine word,
and words whose pairs have all passed the radius are abandoned.

Copies fall together first (one row a fingerprint). Buckets above `BUCKET` are dealt as a grid of pairs of chunks over
many tasks, so none is gathered whole; within a bucket a spanning forest is emitted, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, cut, in_filter, lower_words, named, record, scratch, seed_filter, slices, text_columns, unused
from .components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a bucket that one task compares; larger buckets are cut in chunks of about this size.
BUCKET = 8192
#: First bit and width of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Masks of the 20 choices of three blocks; the other three may hold all differing bits.
MASKS = [signed(sum(((1 << w) - 1) << at for at, w in three)) for three in combinations(BLOCKS, 3)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text; 0 if it is null or has no word."""
    w = lower_words(text)
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    n = max(1, len(w) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n).astype(">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): a row for each row of `docs`; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield record(_FP, b.column(0), [signed(fingerprint(t, shingle)) for t in b.column(1).to_pylist()])

    return arrow_map(text_columns(docs, id_col, text_col), run, "doc_id long, fp long")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of unsigned fingerprints: 64 rows of machine words, a bit for each fingerprint."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    packed = np.packbits(bits, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def _added(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save sum of three stacks of bits: sum and carry bits."""
    u = x ^ y
    return u ^ z, (x & y) | (u & z)


def within(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bits set where the lanes of two stacks of planes differ in at most `radius` planes (radius 0 to 31).

    Eight planes at a time go through a tree of carry-save adders into counters that hold each lane's distance in binary;
    what a counter can't hold marks its lane as past. After each eight, words in which no lane is left within the radius
    are abandoned: their planes aren't read again.
    """
    shape = np.broadcast_shapes(left.shape[1:], right.shape[1:])
    full, size = ~np.uint64(0), int(np.prod(shape))
    over, live, spots = np.zeros(size, np.uint64), np.arange(size), None
    counters = [np.zeros(size, np.uint64) for _ in range(max(1, int(radius).bit_length()))]
    past = np.zeros(size, np.uint64)
    flat = [x.reshape(64, -1) for x in (left, right)]
    for at in range(0, 64, 8):
        if spots is None:
            adding = [np.bitwise_xor(left[p], right[p]).ravel() for p in range(at, at + 8)]
        else:
            adding = [flat[0][p][spots[0]] ^ flat[1][p][spots[1]] for p in range(at, at + 8)]
        for level in range(len(counters)):
            carries = []
            for i in range(0, len(adding), 2):
                other = adding[i + 1] if i + 1 < len(adding) else np.zeros_like(past)
                counters[level], carry = _added(counters[level], adding[i], other)
                carries.append(carry)
            adding = carries
        for carry in adding:
            past |= carry
        # counters above the radius: compare with its bits from the highest down
        far, equal = past.copy(), np.full(len(live), full)
        for i in reversed(range(len(counters))):
            if radius >> i & 1:
                equal &= counters[i]
            else:
                far |= equal & counters[i]
                equal &= ~counters[i]
        keep = far != full
        if not keep.all():
            over[live[~keep]] = full
            live, counters, past, far = live[keep], [c[keep] for c in counters], past[keep], far[keep]
            places = np.unravel_index(live, shape)
            spots = []
            for x in (left, right):
                own = x.shape[1:]
                own = (1,) * (len(shape) - len(own)) + own
                spots.append(np.ravel_multi_index([p if n > 1 else np.zeros_like(p) for p, n in zip(places, own)], own))
        if not len(live):
            break
    over[live] = far if len(live) else over[live]
    return (~over).reshape(shape)


def lanes(mask: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the set bits among the first n."""
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), count=n))


class _Forest:
    """Union-find that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.up[rb] = ra
            self.links.append((a, b))


def linked(fps: np.ndarray, runs: np.ndarray, radius: int = RADIUS, short: int = 48) -> list[tuple[int, int]]:
    """Spanning forest, as pairs of row numbers, of the links inside each run of rows with equal `runs`.

    Short runs: all at once, each row against the one d rows further on. Long runs: each against its planes.
    """
    n = len(fps)
    forest = _Forest(n)
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    rows = np.concatenate([np.arange(s, s + m) for s, m in zip(starts, sizes) if 1 < m <= short] or [np.zeros(0, int)])
    d = 1
    while len(rows):
        rows = rows[(rows + d < n)]
        rows = rows[runs[rows] == runs[rows + d]]
        if not len(rows):
            break
        for i in rows[lanes(within(planes(fps[rows]), planes(fps[rows + d]), radius), len(rows))]:
            forest.join(int(i), int(i) + d)
        d += 1
    for s, m in zip(starts, sizes):
        if m <= short:
            continue
        own = planes(fps[s : s + m])
        for q in range(0, m, 256):
            some = fps[s + q : s + min(m, q + 256)]
            bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
            every = np.where(bits, ~np.uint64(0), np.uint64(0))[:, :, None]
            for i, mask in enumerate(within(every, own[:, None, q // 64 :], radius)):
                for j in lanes(mask, m - q // 64 * 64) + q // 64 * 64:
                    if j > q + i:
                        forest.join(int(s + q + i), int(s + j))
    return forest.links


def _link_runs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, fp) sorted by bucket; a run that a batch breaks off is carried to the next one."""
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 2
        for b in _then_none(batches):
            if b is not None:
                kept = [np.concatenate([k, b.column(i).to_numpy(zero_copy_only=False)]) for i, k in enumerate(kept)]
                if len(kept[0]) < 1 << 15:
                    continue
                end = int(np.searchsorted(kept[0], kept[0][-1]))
            else:
                end = len(kept[0])
            fps, rest = kept[1][:end].view(np.uint64), [k[end:] for k in kept]
            links = linked(fps, kept[0][:end], radius)
            a, b2 = (fps[[x[i] for x in links]].view(np.int64) if links else np.zeros(0, np.int64) for i in (0, 1))
            yield record(_EDGE, pa.array(a), pa.array(b2))
            kept = rest

    return run


def _then_none(items):
    yield from items
    yield None


def _dealt(keyed: DataFrame, by: str, bucket: int) -> DataFrame:
    """Rows (key, n, ...) with their bucket. Keys of more than `bucket` rows become chunks, and each pair of chunks a bucket."""
    grid = F.when(F.col("c") <= 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda j: F.least("mine", j) * F.col("c") + F.greatest("mine", j))
    )
    cells = keyed.withColumn("c", F.ceil(F.col("n") / bucket)).withColumn("mine", F.pmod(F.xxhash64(by, F.lit(7)), "c")).withColumn("cell", F.explode(grid))
    return cells.withColumn("bucket", F.when(F.col("c") <= 1, F.col("key")).otherwise(F.xxhash64("key", "cell")))


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of distinct fingerprints within the radius that connect all that is connected.

    fps: (fp), each once. Buckets are numbered by a 64-bit hash of mask, key bits and pair of chunks; should two buckets
    share a number, their rows are compared too, which can't link what is too far apart.
    """
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(MASKS)])).alias("x")).select("fp", F.xxhash64("x.t", "x.k").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = _dealt(keys.join(shared, "key"), "fp", bucket).select("bucket", "fp")
    sorted_runs = dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return arrow_map(sorted_runs, _link_runs(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row for each row of `docs`.

    Fingerprints of at most `radius` differing bits link (radius 3 at most: the block keys are made for that).
    component_id is the smallest doc_id that links reach. Null or empty texts have fingerprint 0 and link like others.
    Null doc_ids keep their row and never become a component_id, unless a component has no other: then it is null.
    Repeated rows each keep a row. Empty tables give no rows. Other columns of `docs` are ignored.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("radius must lie between 0 and 3")
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    kinds = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(kinds.select("fp"), radius))
    named = kinds.join(roots, kinds.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies that differ in more than a few bits ----------------------------------------------------------------
# Texts that share 0.8 of their five-word shingles differ in 5 to 17 of 64 bits, too many for block keys. Their buckets
# come from bands of a sketch; inside a bucket the same bit-sliced counters pick pairs within WIDE bits whose sketches are
# not far apart. These are candidates only: whether a pair links is decided by the shingles that the two texts share.

#: Shingle and similarity of near copies; bins of a sketch, bins in a band, and bands.
NEAR_SHINGLE, SIMILARITY, BINS, ROWS, BANDS = 5, 0.8, 256, 5, 20
#: Differing bits up to which pairs are compared by sketch. Sketches of candidates may fall short of the similarity by
#: SLACK: those of short texts fill few bins and stray far.
WIDE, SLACK = 20, 0.3
#: Texts of a bucket that one task compares, by sketch and by their shingles; bits of the filter of candidates.
NEAR_BUCKET, EXACT_BUCKET, FILTER_BITS = 2048, 512, 24
#: Shingles that a text of an exact bucket has on average, at most; longer texts lie in smaller buckets.
EXACT_SHINGLES = 8192
#: Stands for a null doc_id, after all others.
LAST = (1 << 63) - 1
_MARK = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("fp", pa.int64()), ("whole", pa.int64()), ("sketch", pa.binary())])
_SET = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("hashes", pa.binary())])


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """Hash of each shingle of a text, repeats included; of all its words if they are fewer; none without a word."""
    w = lower_words(text)
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else iter([b" ".join(w)])
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, max(1, len(w) - shingle + 1))


def sketch(hashes: np.ndarray) -> bytes:
    """One byte of the least hash in each of BINS ranges; an empty range takes that of the next one, turned by its distance."""
    if not len(hashes):
        return bytes(BINS)
    h = np.unique(hashes)
    bin_of = (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]])
    full, least = bin_of[first], h[first]
    nxt = np.searchsorted(full, np.arange(BINS))
    away = np.where(nxt < len(full), full[nxt % len(full)] - np.arange(BINS), full[0] + BINS - np.arange(BINS)).astype(np.uint64)
    v = (least[nxt % len(full)] + away * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    return (v >> np.uint64(56)).astype(np.uint8).tobytes()


def near_pairs(fps: np.ndarray, sketches: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning forest, as pairs of row numbers, of the rows of one bucket that may be near copies of each other."""
    n, forest, own = len(fps), _Forest(len(fps)), planes(fps)
    least = (similarity - SLACK) * BINS
    for q in range(0, n, 256):
        some = fps[q : q + 256]
        bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
        every = np.where(bits, ~np.uint64(0), np.uint64(0))[:, :, None]
        for i, mask in enumerate(within(every, own[:, None, q // 64 :], WIDE)):
            j = lanes(mask, n - q // 64 * 64) + q // 64 * 64
            j = j[j > q + i]
            while len(j):
                root = forest.find(q + i)
                j = np.array([x for x in j.tolist() if forest.find(x) != root], int)
                if not len(j):
                    break
                # all of one tree at most, so a few rows at a time: most fall away once the tree is joined
                now, j = j[:64], j[64:]
                for x in now[(sketches[now] == sketches[q + i]).sum(axis=1) >= least]:
                    forest.join(q + i, int(x))
    return forest.links


def _near_runs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, node, fp, sketch) sorted by bucket."""
        kept = [np.zeros(0, np.int64)] * 3 + [np.zeros((0, BINS), np.uint8)]
        for b in _then_none(batches):
            if b is not None:
                new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                new.append(np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, BINS))
                kept = [np.concatenate([k, x]) for k, x in zip(kept, new)]
                end = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
            else:
                end = len(kept[0])
            starts = np.flatnonzero(np.r_[True, kept[0][1:end] != kept[0][: end - 1]]) if end else np.zeros(0, int)
            out: list[tuple[int, int]] = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), end]):
                if e - s == 2:  # most buckets: no planes needed for one pair
                    close = int(kept[2][s] ^ kept[2][s + 1]) & ((1 << 64) - 1)
                    if close.bit_count() <= WIDE and (kept[3][s] == kept[3][s + 1]).sum() >= (similarity - SLACK) * BINS:
                        out.append((int(kept[1][s]), int(kept[1][s + 1])))
                elif e - s > 2:
                    out += [(int(kept[1][s + i]), int(kept[1][s + j])) for i, j in near_pairs(kept[2][s:e].view(np.uint64), kept[3][s:e], similarity)]
            yield record(_EDGE, [x for x, _ in out], [y for _, y in out])
            kept = [k[end:] for k in kept]

    return run


def enough(shared, x, y, similarity: float):
    """Whether sets of x and y members that share so many reach the similarity: shared over united."""
    return shared >= similarity * (x + y - shared) - 1e-9


def alike(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sets, as sorted arrays of distinct hashes, reach the similarity."""
    if not enough(min(len(x), len(y)), len(x), len(y), similarity):
        return False
    return bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))


def exact_links(trees: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of row numbers that join trees: rows of different trees whose sets reach the similarity.

    A row's shared counts with all others come from the sorted list of everyone's hashes.
    """
    forest, n = _Forest(len(sets)), len(sets)
    _, first, of = np.unique(trees, return_index=True, return_inverse=True)
    for i in range(n):
        forest.join(int(first[of[i]]), i)
    before = len(forest.links)
    sizes = np.array([len(x) for x in sets], np.int64)
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(n), sizes)[order]
    for i in range(n):
        shared = np.zeros(n, np.int64)
        for part in range(0, len(sets[i]), 4096):
            low, high = (np.searchsorted(every, sets[i][part : part + 4096], side) for side in ("left", "right"))
            runs = high - low
            spots = np.repeat(low - np.r_[0, np.cumsum(runs)[:-1]], runs) + np.arange(runs.sum())
            shared += np.bincount(owner[spots], minlength=n)
        close = np.flatnonzero(enough(shared, sizes, sizes[i], similarity) & (shared > 0))
        for j in close[close > i].tolist():
            forest.join(i, j)
    return forest.links[before:]


def _confirmed(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, hashes of a, hashes of b): the pairs that reach the similarity."""
        for b in byte_slices(batches, 2, rows=128):
            sets = zip(*(b.column(i).to_pylist() for i in (2, 3)))
            yield record(_EDGE, *b.filter(pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in sets], pa.bool_())).columns[:2])

    return run


def _exact_runs(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, tree, hashes) sorted by bucket: links of trees."""
        bucket, trees, sets = None, [], []
        for b in _then_none(batches):
            for key, tree, hashes in zip(*(c.to_pylist() for c in b.columns)) if b is not None else [(None, None, b"")]:
                if key != bucket or b is None:
                    links = exact_links(np.array(trees, np.int64), sets, similarity) if len(set(trees)) > 1 else []
                    if links:
                        yield record(_EDGE, [trees[i] for i, _ in links], [trees[j] for _, j in links])
                    bucket, trees, sets = key, [], []
                trees.append(tree)
                sets.append(np.frombuffer(hashes, np.uint64))

    return run


def _near_kinds(docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, xh, node) of each row, LAST for a null doc_id, xh a hash of its text, and (node, rep, root) of each set of shingles.

    rep: the least (doc_id, xh) of the set's rows. Texts whose sketches are near form loose groups, whose pairs are
    counted exactly: first those that tied the group together, then all pairs between the trees that these leave.
    """
    some = text_columns(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))).withColumn("xh", F.xxhash64("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            rows = []
            for text in b.column(1).to_pylist():
                h = shingle_hashes(text, shingle)
                counts = sum(np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) for at in range(0, len(h), 1 << 16))
                fp = int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big") if len(h) else 0
                once = np.unique(h)
                whole = int(((once ^ (once >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)) if len(h) else 0
                rows.append((signed(fp), signed(whole), sketch(h)))
            yield record(_MARK, b.column(0), b.column(2), *([r[i] for r in rows] for i in range(3)))

    marked = scratch(arrow_map(some, mark, "doc_id long, xh long, fp long, whole long, sketch binary").withColumn("node", F.xxhash64("fp", "whole")))
    kinds = scratch(marked.groupBy("node").agg(F.min("fp").alias("fp"), F.min(F.struct("doc_id", "xh")).alias("rep"), F.min("sketch").alias("sketch")))
    band = lambda b: F.xxhash64(b, F.substring("sketch", b * ROWS + 1, F.lit(ROWS)))
    keys = kinds.select("node", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("key"))
    shared = scratch(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    dealt = _dealt(keys.join(shared, "key"), "node", NEAR_BUCKET).join(kinds.select("node", "sketch"), "node")
    runs = dealt.select("bucket", "node", "fp", "sketch").repartition("bucket").sortWithinPartitions("bucket", "node")
    maybe = scratch(arrow_map(runs, _near_runs(similarity), "a long, b long").distinct())
    loose = components(maybe).withColumnRenamed("root", "key")
    chosen = scratch(loose.join(kinds, "node").select("node", "key", F.col("rep.doc_id").alias("d"), F.col("rep.xh").alias("x")))
    bits = docs.sparkSession.sparkContext.broadcast(seed_filter(chosen.select(F.col("x").alias("seed")), FILTER_BITS))

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1):
            b = b.filter(pa.array(in_filter(b.column(2).to_numpy(zero_copy_only=False).view(np.uint64), bits.value)))
            yield record(_SET, b.column(0), b.column(2), [np.unique(shingle_hashes(t, shingle)).tobytes() for t in b.column(1).to_pylist()])

    found = arrow_map(some, set_rows, "doc_id long, xh long, hashes binary")
    sets = scratch(found.join(chosen, (F.col("doc_id") == F.col("d")) & (F.col("xh") == F.col("x"))).select("node", "key", "hashes").dropDuplicates(["node"]))
    of = lambda node, hashes: sets.select(F.col("node").alias(node), F.col("hashes").alias(hashes))
    sure = arrow_map(maybe.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y"), _confirmed(similarity), "a long, b long")
    sized = sets.select("node", "key", (F.octet_length("hashes") / 8).alias("size"))
    trees = scratch(sized.join(components(sure), "node", "left").select("node", "key", "size", F.coalesce("root", "node").alias("tree")))
    # a group of long texts counts as one of more texts, so that a bucket's hashes stay small; as many buckets as texts at most
    count = F.greatest(F.count("*"), F.least(F.count("*") * EXACT_BUCKET, F.ceil(F.sum("size") / EXACT_SHINGLES)))
    parted = trees.groupBy("key").agg(count.alias("n"), F.min("tree").alias("low"), F.max("tree").alias("high")).where("low <> high").select("key", "n")
    cells = _dealt(trees.join(parted, "key"), "node", EXACT_BUCKET).select("bucket", "tree", "node").join(sets.select("node", "hashes"), "node")
    more = arrow_map(cells.select("bucket", "tree", "hashes").repartition("bucket").sortWithinPartitions("bucket"), _exact_runs(similarity), "a long, b long")
    joined = components(more.distinct()).select(F.col("node").alias("tree"), F.col("root").alias("over"))
    roots = trees.join(joined, "tree", "left").select("node", F.coalesce("over", "tree").alias("root"))
    return marked.select("doc_id", "xh", "node"), kinds.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = NEAR_SHINGLE) -> DataFrame:
    """(doc_id, component_id): a row for each row of `docs`; linked texts share `similarity` of their shingles.

    Sketches only find candidates; each link is confirmed by the exact counts of shared and united shingles. Equal sets
    fall together before anything is compared, so copies cost nothing more. component_id is the smallest doc_id that
    links reach. Texts without a word, null ones among them, are copies of each other. Null doc_ids come after all others:
    a component has the id null only if all its rows have. Repeated rows keep a row each; other columns are ignored;
    empty tables give no rows.
    """
    marked, kinds = _near_kinds(docs, id_col, text_col, similarity, shingle)
    lowest = kinds.groupBy("root").agg(F.min("rep.doc_id").alias("component_id"))
    back = lambda c: F.nullif(c, F.lit(LAST)).alias(c)
    return marked.join(kinds.join(lowest, "root").select("node", "component_id"), "node").select(back("doc_id"), back("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of `docs` for each component of near copies: one whose doc_id is the component's smallest.

    Rows are told apart by doc_id and a hash of the text, so different texts under one doc_id each stay or go with their
    own component; of those of one component the text with the least hash stays. Null doc_ids come after all others. Of
    rows with equal doc_id and text one stays, the first by its columns as JSON. Texts without a word, null ones among
    them, are one component. All columns are kept, whatever their names; an empty table stays empty.
    """
    marked, kinds = _near_kinds(docs, id_col, text_col, similarity, NEAR_SHINGLE)
    first = kinds.groupBy("root").agg(F.min("rep").alias("first"))
    chosen = kinds.join(first, "root").select("node", F.col("first.doc_id").alias("d"), F.col("first.xh").alias("x"))
    rows = scratch(marked.groupBy("doc_id", "xh", "node").agg(F.count("*").alias("n")).join(chosen, "node").select("doc_id", "xh", "n", ((F.col("doc_id") == F.col("d")) & (F.col("xh") == F.col("x"))).alias("stays")))
    d, x, whole = unused(docs.columns, "near_id", "near_hash", "near_row")
    key = (F.coalesce(named(id_col).cast("long"), F.lit(LAST)), F.xxhash64(named(text_col).cast("string")))
    pick = lambda r: r.select(F.col("doc_id").alias(d), F.col("xh").alias(x))
    same = (key[0] == F.col(d)) & (key[1] == F.col(x))
    kept = docs.join(pick(rows.where("not stays")), same, "left_anti")
    more = pick(rows.where("stays and n > 1"))
    every = F.struct(*[named(c) for c in docs.columns])
    again = kept.join(more, same, "left_semi").groupBy(key[0].alias(d), key[1].alias(x)).agg(F.min_by(every, F.to_json(every)).alias(whole)).select(f"{whole}.*")
    return kept.join(more, same, "left_anti").unionByName(again)
