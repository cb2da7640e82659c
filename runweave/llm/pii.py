"""Personal data: fixed patterns, and contextual bootstrapping that finds identifiers the patterns miss.

Seed entities are the spans of the fixed patterns, and values of high entropy that are quoted and assigned to a name
(`name = "value"`), which make a kind of their own, `secret`. The words and signs beside a mention induce lexical
patterns, each for one class of values. Other values of a class (loosely written addresses and numbers, codes of letters
and digits) are instances whose kind is open. Patterns and instances form a graph that Spark scores in turns: a pattern,
for a kind, by the share of its distinct instances that are trusted, beside the share of the kind that is known at all;
an instance by the confident patterns that vouch for it. Instances that end trusted give spans of their own, wherever they are mentioned. The graph holds hashes of values
rather than values; its edges are counted map-side and nothing of it is gathered or broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import arrow_map, byte_slices, named, record, remove, scratch, stored, unused

#: Kinds of spans; those of the fixed patterns come first.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE, SECRET = 4, 4
#: Distinct seeds that a pattern needs for a kind; doubt added to a pattern's instances; score from which a pattern
#: vouches; trust from which an instance counts as known and gives spans.
SUPPORT, DOUBT, CONFIDENT, TRUSTED = 3, 1.0, 0.7, 0.6
#: Characters beside a mention in which its context is looked for.
REACH = 64
#: Shortest code of letters and digits; shortest assigned value that is a seed, and its bits of entropy a character.
LEAST_CODE, LEAST_SECRET, LEAST_ENTROPY = 8, 16, 3.0
#: Digits of a phone number at most.
MOST_PHONE = 15

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CODE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The digit before excludes starts inside a run of digits, where no match can begin that did not begin at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9]+")
_TAIL = re.compile(r"[A-Za-z0-9_+/-]*={0,2}")
_WORD = re.compile(r"\w+|[^\w\s]")
#: An assignment right before a value: a name, a sign and a quote.
_ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]{0,40}[\"']?\s{0,3}(?:=|:|:=|=>)\s{0,3}([\"'])\Z")
#: Classes of values: a pattern vouches only for values of the class that it was induced from. Class of each kind.
#: Numbers that a card's check digit fits are a class of their own, so that others are never taken for cards, and so are
#: numbers of more digits than a phone has.
CLASSES = ("mail", "dots", "number", "code", "checked", "long")
CLASS_OF = (0, 1, 4, 2, 3)
#: Loose shapes of the first three.
_LOOSE = (
    re.compile(r"(?<![\w.+%-])[\w.+%-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[\w-]+)*"),
    re.compile(r"(?<![0-9a-f.:])[0-9a-f]{1,4}(?:[.:]{1,2}[0-9a-f]{1,4}){3,7}(?![0-9a-z])", re.I),
    re.compile(r"(?:[(][0-9]{2,5}[)] ?)?(?<![0-9A-Za-z])[0-9](?:[ ./-]{0,3}[0-9]){6,18}(?![0-9A-Za-z])"),
)
_SAID = pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.string()))])
_ROW = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("xh", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:BASE]], ("base", pa.list_(pa.list_(pa.int32()))), ("base_sha256", pa.string()), ("said", pa.list_(_SAID))])


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @: the run of local characters before it, and the longest domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, sorted; offsets are code points, ends exclusive."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))] if "." in text else []
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(found)


def _normal(cls: int, value: str) -> str:
    """The form under which mentions of a value are one instance."""
    if cls in (2, 4, 5):
        return "".join(_DIGITS.findall(value))
    if cls == 0:
        return re.sub(r" ?(?:\[at\]|\(at\)|@) ?", "@", re.sub(r" ?(?:\[dot\]|\(dot\)|\.) ?", ".", value.lower()))
    return value.lower()


def contexts(text: str, start: int, end: int, cls: int) -> list[str]:
    """The lexical patterns of a mention: words and signs beside it, in lower case and with digits as 0.

    Before: the last word; the same with the signs after it; the last two words. After: the next word. Both sides: the
    nearest words; the nearest signs, where one of them assigns or introduces.
    """
    low = max(0, start - REACH)
    before = _WORD.findall(re.sub(r"[0-9]", "0", text[low:start].lower()))[1 if low else 0 :]
    after = _WORD.findall(re.sub(r"[0-9]", "0", text[end : end + REACH].lower()))
    last = max((i for i, w in enumerate(before) if w[0].isalnum() or w[0] == "_"), default=-1)
    words = [w for w in before if w[0].isalnum() or w[0] == "_"]
    nxt = next((w for w in after if w[0].isalnum() or w[0] == "_"), "")
    signs, out = "".join(before[last + 1 :]), []
    if words:
        out.append(f"before {words[-1]}")
        if signs:
            out.append(f"before {words[-1]} {signs}")
        if len(words) > 1:
            out.append(f"before {words[-2]} {words[-1]}")
        if nxt:
            out.append(f"between {words[-1]} {nxt}")
    if nxt:
        out.append(f"after {nxt}")
    if "=" in signs or ":" in signs:
        out.append(f"signs {signs} {after[0] if after and after[0] != nxt else ''}")
    return [f"{CLASSES[cls]} {x}" for x in out]


def entropy(value: str) -> float:
    """Bits a character."""
    return sum(-n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def codes(text: str) -> Iterator[tuple[int, int]]:
    """Runs of letters, digits and `_+/-` that hold both a letter and a digit."""
    done = 0
    for m in _RUN.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in _CODE:
            start -= 1
        done = _TAIL.match(text, m.end()).end()
        if done - start >= LEAST_CODE and any(c.isalpha() for c in text[start:done]):
            yield start, done


def is_checked(value: str) -> bool:
    """Whether a number has the digits of a card."""
    digits = "".join(_DIGITS.findall(value))
    return 12 <= len(digits) <= 19 and luhn(digits)


def number_class(value: str) -> int:
    """The class of a loosely written number."""
    return 4 if is_checked(value) else 2 if len(_DIGITS.findall(value)) <= MOST_PHONE else 5


def is_secret(text: str, start: int, end: int) -> bool:
    """Whether a code is a quoted value of high entropy that is assigned to a name."""
    m = _ASSIGNED.search(text, max(0, start - REACH), start) if start and text[start - 1] in "\"'" else None
    return m is not None and text[end : end + 1] == m[1] and end - start >= LEAST_SECRET and entropy(text[start:end]) >= LEAST_ENTROPY


def mentions(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, list[str]]]:
    """(kind or -1, start, end, instance, patterns) of seed entities and of values of open kind, none overlapping another."""
    value = lambda s, e, c: xxhash.xxh64_intdigest(f"{CLASSES[c]} {_normal(c, text[s:e])}".encode("utf-8", "surrogatepass")) - (1 << 63)
    seeds = [(s, e, k, CLASS_OF[k]) for s, k, e in base]
    found: list[tuple[int, int, int, int]] = []
    digits = _DIGIT.search(text) is not None
    for cls in range(4):
        if not (digits if cls else ("@" in text or "(at)" in text or "[at]" in text)):
            continue
        spots = ((m.start(), m.end()) for m in _LOOSE[cls].finditer(text)) if cls < 3 else codes(text)
        taken, i, new = sorted(x[:2] for x in (*seeds, *found)), 0, []
        furthest = 0  # end of all that begins before a spot; seeds of different kinds may overlap
        for s, e in spots:
            while i < len(taken) and taken[i][0] < e:
                furthest = max(furthest, taken[i][1])
                i += 1
            if furthest > s or (cls == 1 and not _DIGIT.search(text, s, e)):
                continue
            new.append((s, e, SECRET if cls == 3 and is_secret(text, s, e) else -1, number_class(text[s:e]) if cls == 2 else cls))
        found += new
    for s, e, k, c in (*seeds, *found):
        yield k, s, e, value(s, e, c), contexts(text, s, e, c)


def _scan(docs: DataFrame) -> DataFrame:
    """A row for each row: counts, base spans as [start, kind, end], their digest, and mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 3):
            rows = []
            for text in b.column(3).to_pylist():
                base = base_spans(text) if text else []
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                said = [dict(zip(("kind", "s", "e", "instance", "patterns"), m)) for m in mentions(text, base)] if text else []
                rows.append((*[sum(k == j for _, k, _ in base) for j in range(BASE)], [list(x) for x in base], hashlib.sha256(joined.encode()).hexdigest(), said))
            yield record(_ROW, b.column(0), b.column(1), b.column(2), *([r[i] for r in rows] for i in range(7)))

    return arrow_map(docs, run, "rid long, doc_id long, xh long, n_email long, n_ip long, n_card long, n_phone long, base array<array<int>>, base_sha256 string, said array<struct<kind:int,s:int,e:int,instance:long,patterns:array<string>>>")


def trusted(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(instance, kind, trust): the instances that end trusted, seeds among them, each with its most trusted kind.

    edges: distinct (pattern, instance), a pattern's first word being its class; seeds: distinct (instance, kind). Not all
    instances of a kind are known as such: the known share of a kind is estimated as the share of known instances, others
    than itself, in a seed's best pattern, on average over its seeds. A pattern with SUPPORT seeds of a kind or more
    scores, for that kind, the share of its instances that are trusted, smoothed by DOUBT instances of the class, over the
    kind's known share; from CONFIDENT on it vouches. Trust in an instance is the
    chance that not all patterns that vouch for it err; from TRUSTED on it counts as known. What counts as known only
    grows, and the turns end when it doesn't. Of equal trusts the first kind wins.
    """
    spark = edges.sparkSession
    every = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    support = edges.join(seeds, "instance").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= SUPPORT)
    near = scratch(edges.join(support.join(every, "pattern"), "pattern"))
    best_of = near.join(seeds, ["instance", "kind"]).groupBy("instance", "kind").agg(F.max((F.col("seeds") - 1) / (F.col("n") - 1)).alias("share"))
    known = scratch(best_of.groupBy("kind").agg(F.avg("share").alias("known")))  # a row for each kind
    members = edges.select(F.substring_index("pattern", " ", 1).alias("class"), "instance").distinct()
    usual = members.join(seeds, "instance").groupBy("class", "kind").agg(F.count("*").alias("m")).join(members.groupBy("class").agg(F.count("*").alias("of")), "class")
    usual = scratch(usual.select("class", "kind", (F.col("m") / F.col("of")).alias("usual")))  # a row for each class and kind
    sure = seeds.select("instance", "kind", F.lit(1.0).alias("trust"))
    (now, path), size = stored(sure), -1
    while size != (size := now.count()):
        score = F.least(F.lit(1.0), (F.col("t") + DOUBT * F.col("usual")) / (F.col("n") + DOUBT) / F.col("known"))
        counted = near.join(now, ["instance", "kind"]).groupBy("pattern", "kind", "n").agg(F.count("*").alias("t"))
        classed = counted.withColumn("class", F.substring_index("pattern", " ", 1)).join(F.broadcast(usual), ["class", "kind"])
        scores = classed.join(F.broadcast(known), "kind").select("pattern", "kind", score.alias("p")).where(F.col("p") >= CONFIDENT)
        vouched = near.join(scores, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999999)))))).alias("trust")).where(F.col("trust") >= TRUSTED)
        before, (now, path) = path, stored(sure.unionByName(vouched).groupBy("instance", "kind").agg(F.max("trust").alias("trust")))
        remove(spark, before)
    best = F.max_by(F.struct("kind", "trust"), F.struct("trust", -F.col("kind"))).alias("b")
    return now.groupBy("instance").agg(best).select("instance", "b.kind", "b.trust")


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The scan, stored, and (rid, more): the further spans of each row that has any, as [start, kind, end]."""
    some = docs.select(F.monotonically_increasing_id().alias("rid"), named(id_col).cast("long").alias("doc_id"), F.xxhash64(named(text_col).cast("string")).alias("xh"), named(text_col).cast("string").alias("text"))
    scan = scratch(_scan(some))
    said = scan.where(F.size("said") > 0).select("rid", F.explode("said").alias("m")).select("rid", "m.*")
    edges = scratch(said.select("instance", F.explode("patterns").alias("pattern")).distinct())
    seeds = scratch(said.where("kind >= 0").select("instance", "kind").distinct())
    open_ = said.where((F.col("kind") < 0) | (F.col("kind") >= BASE)).select("rid", "s", "e", "instance")
    more = open_.join(trusted(edges, seeds), "instance").groupBy("rid").agg(F.array_sort(F.collect_set(F.array("s", "kind", "e"))).alias("more"))
    return scan, scratch(more)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans): a row for each row of `docs`.

    Counts and base_sha256 are of the fixed patterns; spans also holds what bootstrapping adds (n_found of them; n_spans
    in all), as kind:start:end by start, then kind, joined by commas. A null text counts as empty. Repeated rows and null
    keys keep their rows; other columns are ignored; an empty table gives no rows. Texts of any length are read whole.
    """
    scan, more = _found(docs, id_col, text_col)
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), F.get(x, F.lit(1)) + 1)
    shown = lambda x: F.concat_ws(":", kind(x), F.get(x, F.lit(0)).cast("string"), F.get(x, F.lit(2)).cast("string"))
    added = F.coalesce("more", F.array().cast("array<array<int>>"))
    return scan.drop("said").join(more, "rid", "left").select(
        "doc_id", *[f"n_{k}" for k in KINDS[:BASE]], "base_sha256", F.array_join(F.transform(F.array_sort(F.concat("base", added)), shown), ",").alias("spans"),
        F.size(added).cast("long").alias("n_found"), (F.size("base") + F.size(added)).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with each span of the text replaced by its kind in brackets, such as [EMAIL]; all columns stay.

    Spans that overlap are replaced together, under the first one's kind. Texts without spans, and nulls, stay as they
    are. Rows with null keys and repeated rows stay, a row each; an empty table stays empty. Columns of any name may be
    there beside key and text.
    """
    scan, more = _found(docs, id_col, text_col)
    d, x, m = unused(docs.columns, "found_id", "found_hash", "found_spans")
    known = scratch(more.join(scan.select("rid", "doc_id", "xh"), "rid").select(F.col("doc_id").alias(d), F.col("xh").alias(x), F.col("more").alias(m)).dropDuplicates([d, x]))
    names, at = docs.columns, docs.columns.index(text_col)
    joined = docs.join(known, named(id_col).cast("long").eqNullSafe(known[d]) & (F.xxhash64(named(text_col).cast("string")) == known[x]), "left").select(*map(named, names), m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, at):
            texts = []
            for text, more in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                spans = sorted([*base_spans(text), *map(tuple, more or ())]) if text else []
                out, done = [], 0
                for s, k, e in spans:
                    if s >= done:
                        out += [text[done:s], f"[{KINDS[k].upper()}]"]
                    done = max(done, e)
                texts.append("".join([*out, text[done:]]) if spans else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, b.schema.field(i).type) if i == at else b.column(i) for i in range(len(names))], names=plain)

    # mapInArrow takes no names with backticks: plain ones meanwhile
    plain = [f"c{i}" for i in range(len(names))]
    schema = StructType([StructField(c, f.dataType) for c, f in zip(plain, docs.schema)])
    return joined.toDF(*plain, "more").mapInArrow(run, schema).toDF(*names)
