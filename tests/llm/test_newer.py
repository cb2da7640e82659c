"""The divergence audit, BPE with word ends and periodic runs against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from runweave.llm import divergence, periods, wordbpe

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, ties, columns whose names clash."""
    rng = random.Random(31)
    vocabulary = ["the", "The", "a", "été", "日本", "ab", "abc", "b", "zz", "naïve", "Straße"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", ", ", "1", "_"]) for _ in range(n))
    rows = [(1, None, "en", "s1"), (2, "", None, None), (None, text(40), "en", "s1"), (3, text(40), "en", "s1"), (3, text(40), "en", "s1"), (4, text(9000), "en", "s2")]
    rows += [(10 + i, text(rng.randint(0, 60)), rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None, "Ä"])) for i in range(90)]
    rows += [(200 + i, "same words here", "xx", "s1") for i in range(9)] + [(300, "alone", "solo", "s"), (301, "one " * 50 + "end", "en", "s4"), rows[3]]
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, ordinal int, block int, term string")


def plain_audit(rows, least):
    occurring = defaultdict(Counter)
    in_docs = defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        occurring[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = []
    for lang in in_docs:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        groups = sorted(s for x, s in occurring if x == lang)
        counts = {s: Counter({t: occurring[lang, s][t] for t in kept}) for s in groups}
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(counts[s]) for s in groups}, share(whole)
        for s in groups:
            far = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            own = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(far))]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(own)[:10])]
    return sorted(out)


@pytest.mark.parametrize("shard, at_once, cells, held", [(1 << 12, 64 << 20, 1 << 14, 1 << 18), (3, 1, 4, 5)])
def test_divergence(odd, monkeypatch, shard, at_once, cells, held):
    """Also with a few terms to a shard, a shard to a broadcast, and a term or two to a block."""
    for name, value in {"SHARD": shard, "AT_ONCE": at_once, "CELLS": cells, "HELD": held}.items():
        monkeypatch.setattr(divergence, name, value)
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    got = divergence.audit(odd)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 10)
    assert {r[2] for r in plain_audit(rows, 10)} == {"pair", "term"}


def test_divergence_of_nothing(odd):
    assert divergence.audit(odd.where("false")).count() == 0
    some = odd.where("lang = 'xx' or lang = 'solo'")
    assert sorted(map(tuple, divergence.audit(some, least_docs=9).collect())) == []  # a source alone holds no more than its language
    pairs = divergence.audit(odd.where("lang = 'fr'"), least_docs=10**6).collect()
    assert pairs and all(r.part == "pair" and r.value == 0 for r in pairs)


def test_divergence_sql():
    import duckdb

    con = duckdb.connect()
    rows = [("The cat_sat ÉTÉ 日本" * i, "en", f"s{i % 3}") for i in range(40)] + [(None, None, None), ("a b", None, "")]
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    assert sorted(con.sql(f"select lang, source, part, item, value, rank from ({divergence.AUDIT_SQL})").fetchall()) == plain_audit(rows, 10)


def test_transducer_is_minimal_and_orders_terms():
    rng = random.Random(5)
    for _ in range(200):
        some = sorted({bytes(rng.choice(b"abc\xc3\xff") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 60))})
        t = divergence.Transducer.of(some)
        tried = some + [x + b"a" for x in some] + [x[:-1] for x in some if len(x) > 1] + [b"zz"]
        place = {x: i for i, x in enumerate(some)}
        assert t.ordinals(tried).tolist() == [place.get(x, -1) for x in tried]
        # as many states as there are different sets of endings
        endings = defaultdict(set)
        for x in some:
            for i in range(len(x) + 1):
                endings[x[:i]].add(x[i:])
        assert len(t.ends) == len({frozenset(v) for v in endings.values()})
    assert divergence.Transducer.of([b"a" * 50000]).ordinals([b"a" * 50000, b"a" * 49999]).tolist() == [0, -1]


def test_shares_are_exact():
    rng = random.Random(6)
    for _ in range(500):
        total, v = rng.randint(0, 2**rng.randint(1, 52)), rng.randint(1, 10**6)
        count = rng.randint(0, total)
        assert divergence.shares(np.array([count]), total, v).tolist() == [1 + 10**9 * (count + 2) // (total + 2 * v)]


def test_word_bpe(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    path = wordbpe.public_file()
    own, codec = tokenizers.Tokenizer.from_file(path), wordbpe.Codec(open(path, encoding="utf-8").read())
    rng = random.Random(8)
    signs = [*"abcdeGHIÉéßñ日本ابπΣσς0123'!?.,-#  \n\t\r", " ", "́", "̀", "\x1c", "\x85", " ", "İ", "ǅ", "ㅎ", "😀", "<|endoftext|>", "<|StartOfText|>", "<|startoftext|>", "'s", "'LL", "</w>", "\ue000", " \ue000 ", " the ", "ing"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [None, "", "x" * 30000, "ab日" * 20000]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(2000)]
    for text, ids in zip(texts, codec.encode(texts)):
        whole = own.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == whole and codec.decode(ids) == own.decode(whole, skip_special_tokens=False)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def expected(i, text):
        ids = own.encode(text or "", add_special_tokens=False).ids
        return str((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(own.decode(ids, skip_special_tokens=False).encode())))

    assert sorted(str(tuple(r)) for r in wordbpe.digests(odd, path).collect()) == sorted(expected(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect())
    back = wordbpe.decode(wordbpe.encode(odd, path), path)
    assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str((r.doc_id, own.decode(own.encode(r.text or "").ids, skip_special_tokens=False))) for r in odd.select("doc_id", "text").collect())
    assert wordbpe.digests(odd.where("false"), path).count() == 0


def test_word_bpe_cuts_where_no_token_crosses(monkeypatch):
    codec = wordbpe.Codec(open(wordbpe.public_file(), encoding="utf-8").read())
    tokens = [t.removesuffix("</w>") for t in codec.tokens]
    word = "xqjzthe日本"
    shown = codec.words.pre_tokenize_str(word)[0][0]
    fragments = codec.cut([shown, "a"])[0]
    assert "".join(fragments) == shown + "</w>" and len(fragments) > 2
    plain = [f.removesuffix("</w>") for f in fragments]
    for a, b in zip(plain, plain[1:]):
        assert not any(a[-1] + b[0] in t for t in tokens)
    monkeypatch.setattr(wordbpe, "FRAGMENT_MEMORY", 500)
    monkeypatch.setattr(wordbpe, "MEMORY", 2000)  # memories that are always full
    texts = ["the cat", "the dog's 12 ways", "", "ééé the"] * 5
    small = wordbpe.Codec(open(wordbpe.public_file(), encoding="utf-8").read())
    assert [x.tolist() for t in texts for x in small.encode([t])] == [x.tolist() for x in codec.encode(texts)]
    with pytest.raises(ValueError):
        wordbpe.Codec(open(wordbpe.public_file("byte_bpe_50k.json"), encoding="utf-8").read())


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        at = 0
        while at + q < len(w):
            start = at
            while at + q < len(w) and w[at] == w[at + q]:
                at += 1
            length = at - start + q
            if at > start and length >= max(6, 4 * q) and not any(w[start : start + length - p] == w[start + p : start + length] for p in range(1, q)):
                out.append((start, length, q))
            at += at == start
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    rng = random.Random(3)
    texts = []
    for _ in range(1500):
        base = [b"%d" % rng.randint(0, rng.choice([0, 1, 2, 5, 20])) for _ in range(rng.randint(0, 80))]
        if base and rng.random() < 0.6:
            s, p = rng.randrange(len(base)), rng.randint(1, 12)
            base = base[:s] + base[s : s + p] * rng.randint(1, 12) + base[s + p :]
        texts.append(base * rng.choice([1, 1, 1, 3, 7]))
    for at in range(0, len(texts), 37):
        assert periods.runs_of(texts[at : at + 37]) == [plain_runs(t) for t in texts[at : at + 37]]
    long = [b"x"] + [b"%d" % (i % 4999) for i in range(25000)] + [b"y"] * 3000
    assert periods.runs_of([long]) == [[(1, 25000, 4999), (25001, 3000, 1)]]
    assert periods.runs_of([]) == [] and periods.runs_of([[], [b"a"]]) == [[], []]


def test_wavelet():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periods.Wavelet(values)
        low = rng.integers(0, n, 200)
        high = low + 1 + rng.integers(0, n - low)
        asked, nth = rng.integers(0, n, 200), rng.integers(0, high - low)
        assert tree.less(low, high, asked).tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(low, high, asked)]
        assert tree.least(low, high, nth).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(low, high, nth)]


def test_periodic_runs(spark, odd):
    """The query's rows by its contract, in plain Python."""
    more = spark.createDataFrame([(i, "again and again " * (i % 9) + "the end " * (i % 5)) for i in range(1000, 1120)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)

    def expected(i, text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(w)
        best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[0] if runs else (None,) * 3
        gone = {j for s, m, q in runs for j in range(s + q, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return str((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))

    got = periods.digests(docs, change=periods.planted)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(expected(r.doc_id, r.text) for r in docs.collect())
    real = {str((r.doc_id, r.collapsed)): r.runs for r in periods.find(more).collect()}
    assert all(len(v) == len(plain_runs(("again and again " * (i % 9) + "the end " * (i % 5)).split())) for i in range(1000, 1120) for k, v in real.items() if k.startswith(f"({i},"))
    assert periods.digests(odd.where("false"), change=periods.planted).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_audit_of_the_documents(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    got = divergence.audit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({divergence.AUDIT_SQL})").fetchall())


def test_word_bpe_of_many_texts_at_once():
    """Texts and special tokens side by side stay apart; words never go through the library; other files' words are their own."""
    import json

    tokenizers = pytest.importorskip("tokenizers")
    content = open(wordbpe.public_file(), encoding="utf-8").read()
    codec, own = wordbpe.Codec(content), tokenizers.Tokenizer.from_str(content)
    rng = random.Random(9)
    signs = [*"abcTHEéİ'slmre12٣日! \n ", "'ll", "'Re", "!'s", "it's ", " the", "<|endoftext|>", "<|startoftext|><|endoftext|>", "ationing"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(3000)] + [None, "", "'", "s", "l'", "l", " ", "<|endoftext|>", None]
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, bounds = codec.encode_column(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    raw, spans = codec.decode_column(ids, bounds)
    assert [raw[a:b].tobytes().decode() for a, b in spans] == [own.decode(w, skip_special_tokens=False) for w in want]
    assert not {"last", "inner"} & set(vars(codec))
    long = ["thing" * 12, "thing" * 13, "x" * 64, "x" * 65, "qj" * 100 + "the"]
    assert [x.tolist() for x in codec.encode(long)] == [own.encode(t, add_special_tokens=False).ids for t in long]
    spec = json.loads(content)
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"\p{L}{1,4}|\p{N}+|[^\s\p{L}\p{N}]"}
    other, theirs = wordbpe.Codec(json.dumps(spec)), tokenizers.Tokenizer.from_str(json.dumps(spec))
    assert [x.tolist() for x in other.encode(texts)] == [theirs.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(codec.encode([])) == []
