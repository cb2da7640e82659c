"""How the sources of a language differ: exact smoothed frequencies of the terms that the language keeps.

The vocabulary is a minimal acyclic transducer, built from the sorted kept terms of a language: the walk of a term adds
up its ordinal in the order of UTF-8. Texts are counted again through it, so only kept terms leave a task, as ordinals,
and ordinals break ties where terms would. Vocabularies are built in shards of neighbouring terms inside tasks; shards go
out together up to a fixed number of bytes, and each such set reads the texts once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, cut, named, record, scratch

#: Documents of a language that a kept term is in, and ranks of the terms that are told.
LEAST_DOCS, TOP = 10, 10
#: Terms of a shard; bytes of the shards that go out together.
SHARD, AT_ONCE = 1 << 12, 64 << 20
#: Cells (sources times terms) of a block that is compared at once; counted terms that a task holds before it passes them on.
CELLS, HELD = 1 << 14, 1 << 19
#: Smoothed shares are told in parts of UNIT, with PRIOR added to each count.
UNIT, PRIOR = 1_000_000_000, 2

#: Bytes of terms stand for themselves, A-Z for a-z, all others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FREQUENCY = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("n_docs", pa.int64())])
_SHARD = pa.schema([("lang", pa.string()), ("first", pa.binary()), ("base", pa.int64()), ("keys", pa.binary()), ("targets", pa.binary()), ("skips", pa.binary()), ("ends", pa.binary())])
_CELL = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("source", pa.string()), ("ordinal", pa.int64()), ("n", pa.int64())])
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("ordinal", pa.int64()), ("value", pa.int64())])


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order: runs of letters A-Z, in lower case, and of all characters past ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Transducer:
    """Minimal acyclic transducer from terms to their ordinals, as arrays of edges sorted by (state, byte).

    The ordinal of a term is the sum of the skips on its way: how many terms branch off before it.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, skips: np.ndarray, ends: np.ndarray):
        self.keys, self.targets, self.skips, self.ends = keys, targets, skips, ends

    @classmethod
    def of(cls, sorted_terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in ascending order: states equal in all that follows are shared as soon as they are closed."""
        known: dict[tuple, int] = {}
        keys, targets, skips, ends, below = [], [], [], [], []

        def close(node: list) -> int:
            end, edges = node
            mark = (end, *edges)
            if mark not in known:
                state = known[mark] = len(ends)
                passed = int(end)
                for label, target in edges:
                    keys.append(state << 8 | label)
                    targets.append(target)
                    skips.append(passed)
                    passed += below[target]
                ends.append(end)
                below.append(passed)
            return known[mark]

        open_nodes, before = [[False, []]], b""
        for term in sorted_terms:
            same = next((i for i, (x, y) in enumerate(zip(before, term)) if x != y), min(len(before), len(term)))
            while len(open_nodes) > same + 1:
                node = open_nodes.pop()
                open_nodes[-1][1].append((before[len(open_nodes) - 1], close(node)))
            open_nodes += [[False, []] for _ in range(len(term) - same)]
            open_nodes[-1][0], before = True, term
        while len(open_nodes) > 1:
            node = open_nodes.pop()
            open_nodes[-1][1].append((before[len(open_nodes) - 1], close(node)))
        close(open_nodes[0])  # the start closes last and has the highest number
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array(ends, bool))

    def ordinals(self, some: list[bytes]) -> np.ndarray:
        """The ordinal of each term, -1 where it is none of the vocabulary; all terms walk side by side, a byte at a step."""
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        starts, raw = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(some), np.uint8).astype(np.int64)
        out = np.full(len(some), -1, np.int64)
        live, state, passed, at = np.arange(len(some)), np.full(len(some), len(self.ends) - 1, np.int64), np.zeros(len(some), np.int64), 0
        while len(live):
            through = sizes[live] == at
            good = through & self.ends[state]
            out[live[good]] = passed[good]
            live, state, passed = live[~through], state[~through], passed[~through]
            if not len(self.keys):
                break
            key = state << 8 | raw[starts[live] + at]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            spot, live, at = spot[hit], live[hit], at + 1
            state, passed = self.targets[spot].astype(np.int64), passed[hit] + self.skips[spot]
        return out


class Vocabulary:
    """The shards of a language that are at hand."""

    def __init__(self, shards: list[dict]):
        shards = sorted(shards, key=lambda s: s["base"])
        self.firsts, self.bases = [s["first"] for s in shards], [s["base"] for s in shards]
        read = lambda s: (np.frombuffer(s["keys"], np.int64), np.frombuffer(s["targets"], np.int32), np.frombuffer(s["skips"], np.int32), np.frombuffer(s["ends"], bool))
        self.parts = [Transducer(*read(s)) for s in shards]

    def ordinals(self, some: list[bytes]) -> np.ndarray:
        """As Transducer.ordinals(), in all of the language, of terms in ascending order; each walks through the one shard that may hold it."""
        out = np.full(len(some), -1, np.int64)
        bounds = [bisect_left(some, first) for first in self.firsts] + [len(some)]
        for part, base, low, high in zip(self.parts, self.bases, bounds, bounds[1:]):
            found = part.ordinals(some[low:high])
            out[low:high] = np.where(found < 0, found, found + base)
        return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n_docs) of rows (lang, source, text), summed over as many rows as a task holds at once."""
    found: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, of in found.items():
            yield record(_FREQUENCY, pa.array([lang]).take(pa.array(np.zeros(len(of), np.int32))), list(of), list(of.values()))
        found.clear()

    for b in byte_slices(batches, 2):
        for lang, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            found[lang].update(set(terms(text)))
        if sum(map(len, found.values())) > HELD:
            yield from flush()
    yield from flush()


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of rows (lang, shard, ordinal, term) sorted by all of them."""

    def close(key, of: list[bytes]):
        t = Transducer.of(of)
        return record(_SHARD, [key[0]], [of[0]], [key[1] * SHARD], [t.keys.tobytes()], [t.targets.tobytes()], [t.skips.tobytes()], [t.ends.tobytes()])

    now, held = None, []
    for b in batches:
        for lang, shard, term in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
            if (lang, shard) != now:
                if held:
                    yield close(now, held)
                now, held = (lang, shard), []
            held.append(term)
    if held:
        yield close(now, held)


def _recounted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, block, source, ordinal, n) of the kept terms of rows (lang, source, text)."""
        known = shared.value
        found: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))

        def flush():
            for lang, sources in found.items():
                if "vocabulary" not in known[lang]:  # made once in a worker, which keeps the broadcast value
                    known[lang]["vocabulary"] = Vocabulary(known[lang]["shards"])
                distinct = sorted(set().union(*sources.values()))
                place = dict(zip(distinct, known[lang]["vocabulary"].ordinals(distinct).tolist()))
                for source, of in sources.items():
                    at, n = np.fromiter(map(place.__getitem__, of), np.int64, len(of)), np.fromiter(of.values(), np.int64, len(of))
                    at, n = at[at >= 0], n[at >= 0]
                    same = lambda x: pa.array([x]).take(pa.array(np.zeros(len(at), np.int32)))  # noqa: E731, B023
                    yield record(_CELL, same(lang), at // known[lang]["width"], same(source), at, n)
            found.clear()

        for b in byte_slices(batches, 2):
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if lang in known:
                    found[lang][source].update(terms(text))
            if sum(len(of) for sources in found.values() for of in sources.values()) > HELD:
                yield from flush()
        yield from flush()

    return run


def shares(counts: np.ndarray, total, n_terms: int) -> np.ndarray:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * n_terms)), by long division: exact while totals are below 2**53."""
    whole = np.asarray(total, np.int64) + PRIOR * n_terms
    left, out = counts + PRIOR, np.zeros(np.broadcast(counts, whole).shape, np.int64)
    for _ in range(3):  # three digits at a time, UNIT being 1000 ** 3
        digits, left = np.divmod(left * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); shares are at most UNIT + 1, so squares stay below 2**63."""
    return (p - q) ** 2 // (p + q)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of pairs (other set) and best terms (ordinal set) of each block of rows (lang, block, ordinal, source, n, v).

    Rows are sorted by lang, block and ordinal. Those with ordinal -1 come first, one for each source of the language: n
    is the source's total, v how many terms the language keeps.
    """

    def close(lang: str, rows: list[tuple]):
        own = [r for r in rows if r[0] < 0]
        sources = sorted((r[1] for r in own), key=lambda s: s.encode("utf-8", "surrogatepass"))
        place, total, v = {s: i for i, s in enumerate(sources)}, dict((r[1], r[2]) for r in own), own[0][3]
        cells = rows[len(own) :]
        at = np.unique(np.array([r[0] for r in cells], np.int64))
        # terms of a block that no source holds can't be: each kept term is somewhere
        n = np.zeros((len(sources), len(at)), np.int64)
        if cells:
            np.add.at(n, ([place[r[1]] for r in cells], np.searchsorted(at, np.array([r[0] for r in cells], np.int64))), np.array([r[2] for r in cells], np.int64))
        totals = np.array([total[s] for s in sources], np.int64)
        p = shares(n, totals[:, None], v) if len(at) else np.zeros(n.shape, np.int64)
        for i, s in enumerate(sources):
            others = sources[i + 1 :]
            if others:
                yield record(_FOUND, [lang] * len(others), [s] * len(others), others, [None] * len(others), divergence(p[i], p[i + 1 :]).sum(axis=1))
        if len(at):
            q = shares(n.sum(axis=0), totals.sum(), v)
            for i, s in enumerate(sources):
                high = np.flatnonzero((n[i] > 0) & (p[i] > q))
                value = divergence(p[i, high], q[high])
                best = np.lexsort((at[high], -value))[:TOP]
                yield record(_FOUND, [lang] * len(best), [s] * len(best), pa.nulls(len(best), pa.string()), at[high][best], value[best])

    now, held = None, []
    for b in batches:
        for lang, block, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (lang, block) != now:
                if held:
                    yield from close(now[0], held)
                now, held = (lang, block), []
            held.append(row)
    if held:
        yield from close(now[0], held)


def kept_terms(some: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, ordinal): the terms in at least so many documents of their language, numbered in the order of UTF-8.

    some: (lang, source, text). Numbers come from a range sort and the counts of its parts, so no language is sorted in
    one task.
    """
    often = arrow_map(some, _frequencies, "lang string, term binary, n_docs long").groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= least_docs)
    ranged = cut(often.select("lang", "term").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33).alias("part")
    counts = ranged.groupBy("lang", part).agg(F.min("at").alias("base"), F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("lang", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("base")).alias("shift"))
    return ranged.withColumn("part", part).join(offsets, ["lang", "part"]).select("lang", "term", (F.col("at") + F.col("shift")).alias("ordinal"))


def recounts(some: DataFrame, kept: DataFrame, widths: DataFrame) -> DataFrame:
    """(lang, block, source, ordinal, n): occurrences of kept terms by source; widths: (lang, width), terms of a block.

    Shards go through the driver and out as a broadcast, AT_ONCE bytes or one shard at a time.
    """
    spark = some.sparkSession
    dealt = kept.select("lang", F.floor(F.col("ordinal") / SHARD).cast("long").alias("shard"), "ordinal", "term").repartition("lang", "shard").sortWithinPartitions("lang", "shard", "ordinal")
    shards = scratch(arrow_map(dealt, _built, "lang string, first binary, base long, keys binary, targets binary, skips binary, ends binary").join(widths, "lang"))
    bytes_of = F.octet_length("keys") + F.octet_length("targets") + F.octet_length("skips") + F.octet_length("ends")
    groups, size = [[]], 0
    for lang, base, n in shards.select("lang", "base", bytes_of).orderBy("lang", "base").collect():  # a row for each SHARD terms
        if groups[-1] and size + n > AT_ONCE:
            groups.append([])
            size = 0
        groups[-1].append((lang, base))
        size += n
    found = spark.createDataFrame([], "lang string, block long, source string, ordinal long, n long")
    for group in groups if groups[0] else []:
        place = lambda at: F.struct(F.lit(at[0]).alias("lang"), F.lit(at[1]).cast("long").alias("base"))
        inside = F.struct("lang", "base").between(place(group[0]), place(group[-1]))
        known: dict[str, dict] = {}
        for row in shards.where(inside).toArrow().to_pylist():
            known.setdefault(row["lang"], {"width": row["width"], "shards": []})["shards"].append(row)
        shared = spark.sparkContext.broadcast(known)
        cells = arrow_map(some, _recounted(shared), "lang string, block long, source string, ordinal long, n long")
        found = found.unionByName(scratch(cells.groupBy("lang", "block", "source", "ordinal").agg(F.sum("n").alias("n"))))
        shared.destroy()
    return found


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language lies from the others, and its own terms.

    A source's share of a term is 1 + floor(UNIT * (count + PRIOR) / (N + PRIOR * V)) over the V terms that the language
    keeps, N being the source's occurrences of them; all arithmetic is in whole numbers. Part `pair`: item is each other
    source of the language, value the summed divergences of all kept terms, all ranks. Part `term`: item is each kept term
    that the source holds more of than the language does, value its divergence from the language, the first TOP ranks.

    Null texts, languages and sources count as empty strings. A language without kept terms has pairs of value 0 and no
    terms; a source alone in its language has no pairs. Equal values are ranked by item in the order of UTF-8. Repeated rows
    count again; empty tables give no rows; other columns are ignored; texts are read whole.
    """
    empty = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    some = docs.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), named(text_col).cast("string").alias("text"))
    kept = scratch(kept_terms(some, least_docs))
    groups = cut(some.groupBy("lang", "source").agg(F.count("*").alias("n_docs")).drop("n_docs"))
    widths = groups.groupBy("lang").agg(F.greatest(F.lit(1), F.floor(CELLS / F.count("*"))).cast("long").alias("width"))
    cells = recounts(some, kept, widths)
    totals = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    sizes = widths.join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").select("lang", "width", F.coalesce("v", F.lit(0)).alias("v"))
    last = F.greatest(F.lit(0), F.ceil(F.col("v") / F.col("width")) - 1).cast("long")
    marks = totals.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), F.lit(-1).cast("long").alias("ordinal"), "source", "n", "v")
    rows = cells.select("lang", "block", "ordinal", "source", "n", F.lit(None).cast("long").alias("v")).unionByName(marks)
    dealt = rows.repartition("lang", "block").sortWithinPartitions("lang", "block", "ordinal")
    found = scratch(arrow_map(dealt, _compared, "lang string, source string, other string, ordinal long, value long"))
    half = found.where("ordinal is null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = half.select("lang", F.explode(F.array(F.struct(F.col("source").alias("s"), F.col("other").alias("item")), F.struct(F.col("other").alias("s"), F.col("source").alias("item")))).alias("x"), "value")
    ranked = lambda order: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), order)).alias("rank")
    pairs = pairs.select("lang", F.col("x.s").alias("source"), F.lit("pair").alias("part"), F.col("x.item").alias("item"), "value").select("*", ranked("item"))
    best = found.where("ordinal is not null").select("lang", "source", "ordinal", "value").select("*", ranked("ordinal")).where(F.col("rank") <= TOP)
    told = best.join(kept, ["lang", "ordinal"]).select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), "value", "rank")
    return pairs.unionByName(told)


_TEXT = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: DuckDB SQL of audit() over the documents table.
AUDIT_SQL = rf"""
with d as (select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TEXT} as t from documents),
occ as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from occ group by 1, 2 having count(distinct rid) >= {LEAST_DOCS}),
vs as (select lang, count(*) as v from kept group by 1),
groups as (select distinct lang, source from d),
cells as (select lang, source, term, count(*) as n from occ semi join kept using (lang, term) group by 1, 2, 3),
dense as (select g.lang, g.source, k.term, coalesce(n, 0) as n from groups g join kept k using (lang) left join cells c on c.lang = g.lang and c.source = g.source and c.term = k.term),
own as (select lang, source, term, n, (1 + ({UNIT}::hugeint * (n + {PRIOR})) // (sum(n) over (partition by lang, source) + {PRIOR} * v))::hugeint as p from dense join vs using (lang)),
tongue as (select lang, term, (1 + ({UNIT}::hugeint * (sum(n) + {PRIOR})) // (sum(sum(n)) over (partition by lang) + {PRIOR} * max(v)))::hugeint as q from dense join vs using (lang) group by 1, 2),
far as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from own a join own b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source),
high as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from own join tongue using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from high))
select lang, source, part, item, value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
