"""Each operator against brute force on small and awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runweave.llm import bpe, decontam, langid, licenses, pii, quality, sharding, simhash, substring, urltree
from runweave.llm.components import components as components_of

random.seed(7)
WORDS = ["the", "of", "and", "tion", "Ä", "été", "x1", "a@b.org", "Zoo."]
LONG = " ".join(random.choice(WORDS) + str(random.randint(0, 50)) for _ in range(30000)) + "."


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, equal and near texts, and columns whose names clash."""
    base = [" ".join(random.choice(WORDS) + str(random.randint(0, 400)) for _ in range(120)) + "." for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, base[0]), (4, base[0]), (5, base[0]), (5, base[0]), (6, base[1]), (7, base[1] + " tail"), (8, LONG), (9, LONG), (10, "one two"), (11, "one two"), (None, None)]
    rows += [(20 + i, b + " " + base[(i + 1) % 6][:300]) for i, b in enumerate(base)]
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 1, "c", 3, 4, 5) for i, t in rows], "doc_id long, text string, lang string, fp string, component_id int, seed string, d int, xh int, spans int")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("false")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {n: find(n) for n in nodes}


def test_components_with_hubs(spark):
    """Hubs, chains, loops and repeated edges against union by hand."""
    rng = random.Random(23)
    edges = [(7, i) for i in range(2000, 3500)] + [(9, i) for i in range(3400, 3600)] + [(i, i + 1) for i in range(5000, 5040)] + [(1, 1), (8, 6), (8, 6), (6, 8)] + [(rng.randint(9000, 9600), rng.randint(9000, 9600)) for _ in range(250)]
    up = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = components_of(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == up and got.count() == len(up)


def test_simhash(awkward, empty):
    prints = [(i, fingerprint(t)) for i, t in pairs(awkward)]
    roots = components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 3)
    lowest = {r: min([i for i, p in prints if roots[p] == r and i is not None], default=None) for r in set(roots.values())}
    expected = sorted([(str(i), f"{p:016x}", str(lowest[roots[p]])) for i, p in prints])
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(awkward).collect()) == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 20])
def test_bit_sliced_distances(radius):
    r = np.random.default_rng(radius)
    a = r.integers(0, 2**63, 200, dtype=np.uint64)
    b = a.copy()
    for i in range(200):
        for k in r.choice(64, r.integers(0, 40), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    near = simhash.lanes(simhash.within(simhash.planes(a), simhash.planes(b), radius), 200)
    assert near.tolist() == [i for i in range(200) if int(a[i] ^ b[i]).bit_count() <= radius]


def test_simhash_long_and_split_buckets(spark):
    """Buckets longer than the short path, and buckets cut in chunks, give the same components."""
    r = np.random.default_rng(5)
    fps = {int(r.integers(0, 2**62))}
    for _ in range(300):
        fps.add(random.choice(sorted(fps)) ^ (1 << int(r.integers(0, 64))) ^ (1 << int(r.integers(0, 64))))
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    roots = components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    for bucket in (10_000, 16):
        found = simhash.components(simhash.links(df, bucket=bucket)).collect()
        groups = {}
        for x in found:
            groups.setdefault(x.root, set()).add(x.node)
        own = {}
        for n, root in roots.items():
            own.setdefault(root, set()).add(simhash.signed(n))
        assert sorted(map(sorted, groups.values())) == sorted(sorted(v) for v in own.values() if len(v) > 1)


def test_near_copies(spark, awkward, empty):
    rng = random.Random(3)
    text = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = [(0, " ".join(text))]
    for i in range(1, 120):
        own = list(text)
        own[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"o{rng.randint(0, 10**6)}" for _ in range(200))) for i in range(30)]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == 0 for i in range(120)) and all(found[i] == i for i in range(1000, 1030))
    kept = pairs(simhash.keep_first(awkward))
    assert not any(i is None for i, _ in kept) and sum(i == 1 for i, _ in kept) == 1 and sum(i == 4 for i, _ in kept) == 1 and not any(i == 5 for i, _ in kept)
    assert simhash.keep_first(empty).count() == 0 and simhash.keep_first(awkward).columns == awkward.columns

def test_near_copies_are_counted(spark):
    """Short texts, whose sketches stray: exactly the pairs that share 0.8 of their shingles link."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        text = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.choice([54, 64, 104]))]
        rows.append((10 * i, " ".join(text)))
        for j in range(1, 4):  # of n shingles a new beginning of 2 * j words leaves n - 2 * j
            rows.append((10 * i + j, " ".join([f"n{i}x{j}x{k}" for k in range(j * 2)] + text[j * 2 :])))
    grams = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    jaccard = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    want = components(sorted(grams), lambda a, b: a // 10 == b // 10 and jaccard(a, b) >= 0.8)
    assert len(set(want.values())) > 60
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == want


def test_exact_links_join_trees():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 62, 60).astype(np.uint64) for _ in range(5)]
    sets = [np.unique(np.r_[rng.choice(base[i % 5], rng.integers(44, 60), replace=False), rng.integers(0, 1 << 62, rng.integers(0, 8)).astype(np.uint64)]) for i in range(40)]
    trees = np.array([i if i % 3 else i % 5 + 100 for i in range(40)])
    close = lambda i, j: trees[i] == trees[j] or len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))
    want = components(range(40), close)
    links = {frozenset(x) for x in simhash.exact_links(trees, sets)}
    assert components(range(40), lambda i, j: trees[i] == trees[j] or frozenset((i, j)) in links) == want
    assert all(close(i, j) and simhash.alike(sets[i], sets[j]) for i, j in map(tuple, links))


def test_different_texts_under_one_key(spark):
    """Each text under a repeated key stays or goes with its own near copies."""
    rng = random.Random(5)
    a, b, c = (" ".join(f"{x}{rng.randint(0, 10**6)}" for _ in range(200)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b + " tail"), (3, c), (3, a + " tail"), (4, c + " tail"), (4, c), (0, c + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(pairs(simhash.keep_first(docs))) == sorted([(1, a), (1, b), (0, c + " more")])
    found = {(r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()}
    assert found == {(1, 1), (2, 1), (3, 0), (3, 1), (4, 0), (0, 0)}


def test_language(spark, awkward, empty):
    rng = random.Random(1)
    kinds = {"en": ["the", "ing", "and"], "de": ["sch", "über", "ung"], "fr": ["é", "eaux", "tion"]}
    rows = [(i, " ".join("".join(rng.choices(s, k=2)) for _ in range(30)), lang) for i, (lang, s) in enumerate(list(kinds.items()) * 40)]
    docs = spark.createDataFrame([*rows, (900, "123 !!", "en"), (901, None, "en"), (902, "schung über", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "de"
    assert langid.identify(empty).count() == 0 and langid.identify(awkward).count() == awkward.count()
    unlabelled = langid.identify(awkward.withColumn("lang", langid.F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_language_is_naive_bayes(spark):
    """Against a plain naive Bayes over dictionaries of hashed n-grams."""
    import math

    rng = random.Random(21)
    kinds = {"en": "abcdefgh", "de": "efghijäö", "fr": "abhijklé"}
    rows = [(i, " ".join("".join(rng.choices(kinds[lang], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))) + rng.choice(["", " 12!", "Z"]), lang) for i, lang in enumerate(list(kinds) * 40)]
    counts, docs = {}, {}
    fold = langid._folding()
    grams = lambda t: langid.bins(langid.letters(t, fold)).tolist()
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            docs[lang] = docs.get(lang, 0) + 1
            for g in grams(t):
                counts.setdefault(lang, {})[g] = counts.get(lang, {}).get(g, 0) + 1
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        log = {}
        for lang, own in counts.items():
            total = sum(own.values()) + langid.SMOOTHING * langid.BINS
            log[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((own.get(g, 0) + langid.SMOOTHING) / total) for g in grams(t))
        best = max(sorted(log), key=log.get)
        assert got[i].lang_pred == best and abs(got[i].score - 1 / sum(math.exp(x - log[best]) for x in log.values())) < 1e-4

def test_long_texts_are_counted_once(monkeypatch):
    """Texts beyond a chunk have the bins of the whole."""
    fold, text = langid._folding(), "äbc" * 5000
    want = np.unique(langid.bins(langid.letters(text, fold)), return_counts=True)
    monkeypatch.setattr(langid, "CHUNK", 1000)
    assert all((a == b).all() for a, b in zip(langid.bin_counts(text, fold), want))



def greedy(p, t, least):
    fp, ft, out = [True] * len(p), [True] * len(t), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and fp[i + n] and ft[j + n] and p[i + n] == t[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        out += n
        fp[i : i + n], ft[j : j + n] = [False] * n, [False] * n


def test_tiles_cover_as_greedy_ones_do():
    rng = random.Random(4)
    for _ in range(150):
        p, t = (rng.choices("abcdef", k=rng.randint(0, 20)) for _ in range(2))
        assert sum(n for _, _, n in decontam.tiles(p, t, 2)) == greedy(p, t, 2)


def test_decontamination(spark, awkward, empty):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "tiny item"), (3, None), (4, ""), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    moved = "Eta theta IOTA, kappa lambda mu! other words alpha beta gamma delta epsilon zeta"
    docs = [(1, "x y z " + moved), (2, "alpha beta gamma delta only and much other text"), (3, None), (4, ""), (None, moved), (5, "tiny item"), (6, moved), (6, moved)]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, item_id int")
    got = [(r.doc_id, r.item_id, r.coverage, r.n_items) for r in decontam.contaminated(df, bench).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, 1.0, 1), (None, 1, 1.0, 1), (6, 1, 1.0, 1)], key=str)
    assert sorted(r.doc_id for r in decontam.clean(df, bench).collect()) == [2, 3, 4, 5]
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(awkward, bench.where("false")).count() == 0


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_personal_data(spark, awkward, empty):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab.@-+ 1234567890()%é", k=rng.randint(0, 60))) for _ in range(3000)]
    assert all(pii.base_spans(t) == base(t) for t in texts)
    rows = [(i, t) for i, t in pairs(awkward)] + [(1000 + i, t) for i, t in enumerate(texts[:200])]
    got = pii.spans(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, more int"))
    want = sorted((str(i), hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(t or "")).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got.collect()) == want
    assert pii.spans(empty).count() == 0
    seeds = [(i, f"Please call me at +1 (521) 555-{1000 + i} today, mail: user{i}@x.org .") for i in range(12)]
    docs = spark.createDataFrame([*seeds, (100, "Please call me at 0521 555 7788 today. mail: joe [at] acme.org ok"), (101, None), (102, "There were 1234567 things")], "doc_id long, text string")
    found = {r.doc_id: r for r in pii.spans(docs).collect()}
    assert found[100].spans == "phone:18:31,email:45:62" and found[100].n_found == 2 and found[102].spans == "" and found[101].n_email == 0
    red = dict(pairs(pii.redact(docs)))
    assert red[100] == "Please call me at [PHONE] today. mail: [EMAIL] ok" and red[101] is None and red[102] == "There were 1234567 things"


def test_bootstrapping_against_a_plain_version(spark):
    """The scores of the graph, turn by turn, as sums over dictionaries."""
    import math

    rng = random.Random(31)
    edges = {(f"p{rng.randint(0, 25)}", rng.randint(0, 60)) for _ in range(400)} | {("good", i) for i in range(100, 112)} | {("other", i) for i in range(110, 125)}
    seeds = {(i, rng.randint(0, 1)) for i in range(0, 20)} | {(i, 4) for i in range(100, 110)}
    edges = {(f"{'ab'[i % 2 if i < 100 else 0]} {p}", i) for p, i in edges}
    size, by_pattern = {}, {}
    for p, i in edges:
        size[p] = size.get(p, 0) + 1
        by_pattern.setdefault(p, set()).add(i)
    members = {c: {i for p, i in edges if p[0] == c} for c in "ab"}
    usual = {(c, k): sum((i, k) in seeds for i in members[c]) / len(members[c]) for c in "ab" for k in range(5)}
    support = {(p, k) for p in size for k in range(5) if sum((i, k) in seeds for i in by_pattern[p]) >= pii.SUPPORT}
    share = {}
    for i, k in seeds:
        of = [(sum((j, k) in seeds for j in by_pattern[p]) - 1) / (size[p] - 1) for p, kind in support if kind == k and i in by_pattern[p]]
        if of:
            share.setdefault(k, []).append(max(of))
    known = {k: sum(v) / len(v) for k, v in share.items()}
    trust, before = {s: 1.0 for s in seeds}, None
    while before is None or len(trust) != len(before):
        before = trust
        score = {(p, k): min(1, (sum((i, k) in trust for i in by_pattern[p]) + pii.DOUBT * usual[p[0], k]) / (size[p] + pii.DOUBT) / known[k]) for p, k in support}
        sure = {x: v for x, v in score.items() if v >= pii.CONFIDENT}
        new = {s: 1.0 for s in seeds}
        for i in {i for _, i in edges}:
            for k in range(5):
                err = [1 - min(v, 0.999999) for (p, kind), v in sure.items() if kind == k and i in by_pattern[p]]
                if err and 1 - math.prod(err) >= pii.TRUSTED:
                    new[i, k] = max(new.get((i, k), 0), 1 - math.prod(err))
        trust = new
    want = {}
    for (i, k), t in sorted(trust.items(), key=lambda x: (-x[1], x[0][1])):
        want.setdefault(i, (k, round(t, 6)))
    got = pii.trusted(spark.createDataFrame(sorted(edges), "pattern string, instance long"), spark.createDataFrame(sorted(seeds), "instance long, kind int")).collect()
    assert {r.instance: (r.kind, round(r.trust, 6)) for r in got} == want and {110, 111} <= set(want)


def test_secrets_are_discovered(spark):
    """Assigned values are seeds; the same name then vouches for values that nothing quotes. Other codes stay."""
    rng = random.Random(12)
    code = lambda n=40: "".join(rng.choices("0123456789abcdef", k=n))
    texts = [f'Some words{i} apikey = "{code()}" and more.' for i in range(12)]
    loose, other = code(20) + "7a", "part a1b2c3d4e5f6 of build x99y88z77"
    docs = spark.createDataFrame([*enumerate(texts), (100, f"my apikey {loose} it was"), (101, other), (102, "x of aaaaaaaaaaaaaaaaaaaaaa1")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    assert all(got[i].n_found == 1 and got[i].n_spans == 1 for i in range(12))
    assert got[100].spans == f"secret:10:{10 + len(loose)}" and got[101].spans == "" and got[102].spans == ""
    assert dict(pairs(pii.redact(docs)))[100] == "my apikey [SECRET] it was"


def test_urls(spark):
    rows = [(1, None), (2, "foo"), (3, "HTTP://A.Example.ORG/en/1?x"), (4, "http://org"), (5, "a://b.com/de/?"), (6, "http://h.org#/x"), (7, "x\ny://Ex.COM/fr/\nq?"), (8, "http://notorg/"), (None, "http://example.org/es/1"), (3, "HTTP://A.Example.ORG/en/1?x"), (9, "http://a.b.org/" + "y/" * 5000)]
    bad = [(100 + i, f"http://m.com/{'de' if i % 2 else 'fr'}/{i}") for i in range(60)] + [(300 + i, f"http://m.com/de-old/{i}") for i in range(3)]
    got = urltree.judge(spark.createDataFrame([(i, u, "h", "t") for i, u in rows + bad], "page_id long, url string, host string, template string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows + bad)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("", "", None, by[2].verdict)
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("a.example.org", "/en/1", "example.org/en/1", "block")
    assert by[4].rule is None and by[5].rule == "com/de/" and by[6].path == "" and by[7].rule == "com/fr/" and by[7].path == "/fr/\nq" and by[8].rule is None and by[None].verdict == "block"
    assert by[101].template == "/de/**" and by[100].template == "/fr/**" and by[300].rule is None
    assert urltree.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_purity(spark):
    """A template whose labelled pages are blocked rejects the pages that no rule decides."""
    rules = (("block", "x.net", "/ads/1"), ("allow", "x.net", "/news/1"))
    rows = [(i, f"http://x.net/{kind}/{i}") for i in range(1000, 1060) for kind in ("ads", "news")] + [(5, "http://x.net/ads/77"), (6, "http://x.net/news/77")]
    got = {r.page_id: r.verdict for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect() if r.page_id < 10}
    assert got == {5: "block", 6: "allow"}


@pytest.mark.parametrize("domains", [1, 2])
def test_url_tree_against_a_plain_version(spark, monkeypatch, domains):
    """All levels of the tree over dictionaries; only nodes that could split go on."""
    monkeypatch.setattr(urltree, "DOMAINS", domains)
    rng = random.Random(17)
    rules = (("block", "a.com", "/x/"), ("allow", "a.com", "/y/"), ("block", "b.com", "/x/q"), ("allow", "b.com", "/"), ("block", "c.com", "/y/z/"))
    urls = [f"http://{rng.choice(['w.', ''])}{rng.choice('abcd')}.com/" + "/".join(rng.choice(["x", "y", "z", "q", str(rng.randint(1, 99999)), f"s{rng.randint(1, 9)}"]) for _ in range(rng.randint(0, 4))) for _ in range(900)]
    got = urltree.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules).collect()
    shape = lambda s: "<num>" if s.isdigit() else s
    rows = []
    for r in sorted(got, key=lambda r: r.page_id):
        fit = [(len(h + p), v) for v, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        segs = [shape(s) for s in r.path.split("/") if s]
        rows.append({"host": r.host, "domain": ".".join(r.host.split(".")[-2:]), "segs": segs, "label": max(fit)[1] if fit else None, "t": "", "open": bool(segs)})
    count = lambda some: (sum(x["label"] == "block" for x in some), sum(x["label"] is not None for x in some))
    b, n = count(rows)
    for x in rows:
        x["all"] = (b + 1) / (n + 2)
    for h in {x["host"] for x in rows}:
        own = [x for x in rows if x["host"] == h]
        hb, hl = count(own)
        for x in own:
            x["own"] = (hb + urltree.WEIGHT * x["all"]) / (hl + urltree.WEIGHT)

    def apart(b, n, nb, nl):
        rb, rl = nb - b, nl - n
        if n < urltree.LEAST or rl < urltree.LEAST or nb in (0, nl):
            return False
        p = nb / nl
        return abs(b / n - rb / rl) / (p * (1 - p) * (1 / n + 1 / rl)) ** 0.5 >= urltree.DIFFERENT

    level = 0
    while any(x["open"] for x in rows):
        going = [x for x in rows if x["open"]]
        under = {t: count([x for x in going if x["t"] == t]) for t in {x["t"] for x in going}}
        for x in going:
            nb, nl = under[x["t"]]
            if nl < 2 * urltree.LEAST or nb in (0, nl):
                x["t"], x["open"] = x["t"] + "/**", False
        going = [x for x in going if x["open"]]
        group = lambda *keys: {k: [x for x in going if tuple(x[y] if y != "seg" else x["segs"][level] for y in keys) == k] for k in {tuple(x[y] if y != "seg" else x["segs"][level] for y in keys) for x in going}}
        ht, hts, t, ts = group("host", "t"), group("host", "t", "seg"), group("t"), group("t", "seg")
        dt, dts = group("domain", "t"), group("domain", "t", "seg")
        several = lambda some: len({x["domain"] for x in some if x["label"]}) >= domains
        for x in going:
            s = x["segs"][level]
            here = apart(*count(hts[x["host"], x["t"], s]), *count(ht[x["host"], x["t"]]))
            near = apart(*count(dts[x["domain"], x["t"], s]), *count(dt[x["domain"], x["t"]]))
            x["name"] = s if here or near or (several(ts[x["t"], s]) and apart(*count(ts[x["t"], s]), *count(t[x["t"],]))) else "*"
        new = []
        for x in going:
            same = [y for y in going if y["t"] == x["t"] and y["name"] == x["name"]]
            qb, ql = count(same)
            db, dl = count([y for y in same if y["domain"] == x["domain"]])
            pb, pl = count([y for y in same if y["host"] == x["host"]])
            every = (qb + urltree.WEIGHT * x["all"]) / (ql + urltree.WEIGHT) if several(same) else x["all"]
            near = (db + urltree.WEIGHT * every) / (dl + urltree.WEIGHT)
            new.append((every, (pb + urltree.WEIGHT * near + urltree.OWN * x["own"]) / (pl + urltree.WEIGHT + urltree.OWN)))
        for x, (every, own) in zip(going, new):
            x["all"], x["own"], x["t"], x["open"] = every, own, f"{x['t']}/{x['name']}", len(x["segs"]) > level + 1
        level += 1
    assert any(x["t"].endswith("/**") for x in rows) and any(x["t"].count("/") > 2 for x in rows)
    assert len({x["t"] for x in rows}) > 4
    for x, r in zip(rows, sorted(got, key=lambda r: r.page_id)):
        assert (r.template, r.verdict) == (x["t"], x["label"] or ("block" if x["own"] >= urltree.REJECT else "allow")) and abs(r.share - x["own"]) < 1e-5
    for by in ("host", "domain", "rule") if domains == 2 else ():
        measured = urltree.held_out(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules, by=by, fold=1).first()
        assert 0 <= measured.n_right <= min(measured.n_rejected, measured.n_blocked) <= measured.n_labelled


def test_templates_of_one_domain_stay_there(spark):
    """What a single domain teaches holds on its other hosts, but goes over to other domains only once a second one agrees."""
    rows = [(f"http://{h}/{kind}/{i}.html") for h in ("x.net", "w.x.net", "y.com:80", "z.io") for kind in ("ads", "news") for i in range(1000, 1060)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    blocked = lambda rules: {r.host for r in urltree.judge(pages, rules=rules).collect() if r.rule is None and r.verdict == "block"}
    first = (("block", "x.net", "/ads/100"), ("allow", "x.net", "/news/100"))
    second = (("block", "y.com:80", "/ads/100"), ("allow", "y.com:80", "/news/100"))
    assert blocked(first) == {"x.net", "w.x.net"}
    assert blocked(first + second) == {"x.net", "w.x.net", "y.com:80", "z.io"}


def test_domains(spark):
    hosts = ["a.b.example.org", "example.org", "user@w.x.net:8080", "10.0.0.1", "10.0.0.1:80", "localhost", ""]
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select(urltree.domain(F.col("h")).alias("d")).collect()
    assert [r.d for r in got] == ["example.org", "example.org", "x.net", "10.0.0.1", "10.0.0.1", "localhost", ""]


def test_deep_urls_are_told_apart(spark):
    """Branches far below the root are judged by their own labels."""
    rules, deep = (("block", "x.net", "/a/b/c/d/e/f/g/ads/1"), ("allow", "x.net", "/a/b/c/d/e/f/g/news/1")), "http://x.net/a/b/c/d/e/f/g"
    rows = [(i, f"{deep}/{kind}/{i}") for i in range(1000, 1060) for kind in ("ads", "news")] + [(5, f"{deep}/ads/77"), (6, f"{deep}/news/77")]
    got = {r.page_id: (r.verdict, r.template) for r in urltree.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=rules).collect() if r.page_id < 10}
    assert got[5][0] == "block" and got[6][0] == "allow" and "/ads/" in got[5][1] and "/news/" in got[6][1]


def test_bpe(spark, awkward, empty):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_ranks()
    ranks = bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    signs = [*" \n\t\r  aaab-=.,'sß字é1\u00a0\u2003\x1c\x85😀", "'s", "  ", "\n ", "<|endoftext|>"]
    codec = bpe.Codec(ranks, pattern)
    for _ in range(3000):
        t = "".join(rng.choices(signs, k=rng.randint(0, 25)))
        ids = next(codec.encode([t]))
        assert ids.tolist() == own.encode_ordinary(t) and codec.decode(ids) == t
        spans = np.stack(codec.offsets(t, ids), axis=1)
        assert len(spans) == len(ids) and (not len(ids) or (spans[0][0] == 0 and spans[-1][1] == len(t)))
        assert all(t[a:b].encode().find(codec.bytes_of[i]) >= 0 for i, (a, b) in zip(ids.tolist(), spans.tolist()))
    assert "\ufffd" in codec.decode(next(codec.encode(["字😀"]))[:-1])  # cut inside a character
    want = sorted((str(i), hashlib.sha256(np.array(own.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(awkward))
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in bpe.digests(awkward, path, pattern).collect()) == want
    encoded = bpe.encode(awkward, path, pattern)
    assert sorted((str(r.doc_id), r.text) for r in bpe.decode(encoded, path, pattern).collect()) == sorted((str(i), t or "") for i, t in pairs(awkward))
    assert bpe.digests(empty, path, pattern).count() == 0


def test_shards(spark, awkward, empty):
    got = sharding.shards(awkward).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in pairs(awkward))
    many = spark.range(3000).selectExpr("id as doc_id", "concat('t', id % 7) as text", "1 as slot", "2 as shard")
    rows = sharding.shards(many).collect()
    for s in range(24):
        mine = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        assert len([1 for a, b in zip(mine, mine[1:]) if a.text_crc32 != b.text_crc32]) <= 6
    assert all(r.grown_shard in (r.shard, 24) for r in rows) and 60 < sum(r.grown_shard == 24 for r in rows) < 190
    import math

    def drawn(key, n):
        score = lambda i: 1 / -math.log(((xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(key.to_bytes(8, "little"), seed=42)) >> 11) + 0.5) / (1 << 53))
        return max(range(n), key=lambda i: (score(i), i))

    assert all((r.shard, r.grown_shard) == (drawn(r.doc_id, 24), drawn(r.doc_id, 25)) for r in rows)
    heavy = sharding.shards(many, weights=[3.0, 1.0]).groupBy("shard").count().collect()
    assert 2000 < {r.shard: r["count"] for r in heavy}[0] < 2500
    assert sharding.shards(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.shards(many, weights=[0.0])


def test_quality(spark, awkward, empty):
    good = "\n".join(" ".join(f"{random.choice('abcdefg')}{random.randint(0, 9999)}" for _ in range(14)) + "." for i in range(12))
    more = [(201, good), (202, good + "\nHome | About | News | Contact"), (203, "\n".join(["Home | About | News | Contact"] * 9 + [good[:400]])), (204, "same words here " * 40), (205, "\n".join(["A line that comes again and ends."] * 30)), (206, good.upper().replace(".", "!!")), (207, None)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in [*pairs(awkward), *more]], "doc_id long, text string, kept string")
    for r in quality.verdicts(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = list(zip(w, w[1:], w[2:]))
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = len({j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)})
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in quality.verdicts(docs).where("doc_id > 200").collect()}
    assert kept == {201: True, 202: True, 203: False, 204: False, 205: False, 206: False, 207: False}
    cleaned = dict(pairs(quality.clean(docs)))
    assert cleaned[201] == good and cleaned[202] == good and 203 not in cleaned
    assert quality.verdicts(empty).count() == 0


def test_quality_of_scripts_without_case(spark):
    """Lines of such scripts pass with their own marks; shouted lines and lines without a letter still fail."""
    rng = random.Random(8)
    scripts = [("אבגדהוזחט", "."), ("ابتثجحخد", "؟"), ("ابتثجحخد", "۔"), ("कखगघचछजझ", "।"), ("가나다라마바사", "."), ("的一是不了人我在", "。"), ("あいうえおかき", "。」"), ("กขคงจฉช", ""), ("abcdefgh", "."), ("ABCDEFGH", "."), ("12345678", "."), ("ABCDEFGHº", ".")]
    text = lambda letters, mark: "\n".join(" ".join("".join(rng.choices(letters, k=6)) for _ in range(12)) + mark for _ in range(8))
    rows = [(i, text(*x)) for i, x in enumerate(scripts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.verdicts(docs).collect()} == {i: i < 9 for i in range(12)}
    assert dict(pairs(quality.clean(docs))) == dict(rows[:9])



@pytest.mark.parametrize("hot, bits", [(512, 28), (1, 28), (512, 1)])
def test_substrings(spark, awkward, empty, hot, bits, monkeypatch):
    """By automata, by windows of hot seeds, and with more seeds than a filter may hold."""
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "MOST_BITS", bits)
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(45)]
    rows = [(300 + i, " ".join([f"u{rng.randint(0, 999)}" for _ in range(rng.randint(0, 30))] + passage[rng.randint(0, 20) : rng.randint(21, 45)] + ["z"] * rng.randint(0, 50))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in [*pairs(awkward), *rows]], "doc_id long, text string, spans string, xh int")
    seen, want = set(), []
    done = {}
    for i, t in sorted(pairs(docs), key=lambda r: (r[0] is None, r[0], xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))):
        w = (t or "").encode().split()
        if (i, t) not in done:
            off = [False] * len(w)
            for a in range(len(w) - 19):
                g = tuple(w[a : a + 20])
                if g in seen:
                    off[a : a + 20] = [True] * 20
                seen.add(g)
            done[i, t] = (str(i), len(w), sum(off), hashlib.sha256(b" ".join(x for x, o in zip(w, off) if not o)).hexdigest())
        want.append(done[i, t])
    got = substring.deduplicate(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert substring.deduplicate(empty).count() == 0


def test_automaton_statistics():
    rng = random.Random(8)
    for _ in range(200):
        auto, known = substring.Automaton(), []
        for _ in range(3):
            s = rng.choices("abc", k=rng.randint(0, 12))
            auto.add(s)
            known.append("".join(s))
        q = rng.choices("abcd", k=15)
        want = [max(n for n in range(i + 2) if any("".join(q[i + 1 - n : i + 1]) in k for k in known)) for i in range(15)]
        assert list(auto.statistics(q)) == want


def test_licenses(spark, awkward, empty):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "Some words.\nReleased under the MIT License.\nMore words."), (2, "Licensed under CC BY-NC 3.0."), (3, "A license to fish is needed."), (4, None), (5, ""), (6, "x " * 20000 + mit.replace("person", "human") + " y" * 20000), (None, "Released under the MIT License."), (1, "Some words.\nReleased under the MIT License.\nMore words.")]
    got = licenses.licenses(spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, license string")).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == [("1", "MIT-line"), ("2", "CC-BY-NC"), ("6", "MIT"), ("None", "MIT-line")]
    by = {r.doc_id: r for r in got}
    assert by[1].differences == "" and by[1].at == 12 and by[2].differences == "4>3" and by[6].differences == "person>human; persons>humans" and by[6].at == 40000
    assert licenses.licenses(empty).count() == 0 and licenses.licenses(awkward).count() == 0


def test_licenses_in_text_that_compresses_well():
    """Notices word for word in prose of few words, of which the block alone already compresses well."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    prose = "the river was slow and old stones lay under it while people spoke of rain license terms and released water each evening under a mild sky".split()
    for seed in range(20):
        rng = random.Random(seed)
        before, after = (" ".join(rng.choice(prose) for _ in range(140)) for _ in range(2))
        hits = list(scanner.scan(f"{before}. {licenses.TEMPLATES['MIT-line']} {after}."))
        assert [(h[0], h[1], h[3]) for h in hits] == [("MIT-line", len(before) + 2, 1.0)]


def test_licenses_against_every_place():
    """Blocks pass over nothing that confirming each template over the whole text would find; templates may be long."""
    rng = random.Random(14)
    long = " ".join(f"term{rng.randint(0, 400)}" for _ in range(1200))
    scanner = licenses.Scanner(licenses.TEMPLATES | {"long": long})
    for _ in range(25):
        text = []
        for _ in range(3):
            words = (long if rng.random() < 0.2 else rng.choice(list(licenses.TEMPLATES.values()))).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["changed"], [words[at], "added"]])
            text += [" ".join(words), " ".join(rng.choice(["of", "the", "software", "river", "stone"]) for _ in range(rng.randint(0, 900)))]
        whole = " ".join(text)
        given = [w.lower() for w in licenses._WORD.findall(whole)]
        starts = [m.start() for m in licenses._WORD.finditer(whole)]
        want = {(t.name, starts[w]) for t in scanner.known for w, *_ in scanner.places(t, given, licenses.numbered(whole))}
        assert {h[:2] for h in scanner.scan(whole)} == want
    found = [h[:2] for h in scanner.scan(f"{long} {licenses.TEMPLATES['MIT-line']} {licenses.TEMPLATES['MIT-line']} {long}")]
    assert sorted(name for name, _ in found) == ["MIT-line", "MIT-line", "long", "long"]


def test_places_of_counted_edits():
    """Wordings with a counted number of edits, among words of no template: found, place and share follow from the count."""
    wanted = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    scanner = licenses.Scanner({"t": " ".join(wanted)})
    for seed in range(60):
        rng = random.Random(seed)
        kind, edits, words = rng.choice(["other", "gone", "more"]), rng.randint(0, 7), list(wanted)
        for at in sorted(rng.sample(range(2, 38), edits), reverse=True):
            words[at : at + 1] = {"other": ["changed"], "gone": [], "more": [words[at], "added"]}[kind]
        before, after = (" ".join(rng.choice(["river", "stone", "rain"]) for _ in range(rng.randint(1, 300))) for _ in range(2))
        share = 40 / (40 + edits) if kind == "more" else (40 - edits) / 40
        got = [(h[0], h[1], h[3]) for h in scanner.scan(f"{before} {' '.join(words)} {after}")]
        assert got == ([("t", len(before) + 1, round(share, 6))] if share >= licenses.LEAST_WORDS else []), (kind, edits)


def test_largest_saving_wins_a_place(spark):
    full, part, other = licenses.TEMPLATES["MIT-full"], licenses.TEMPLATES["MIT"], licenses.TEMPLATES["MIT-line"]
    rows = [(1, f"{other} And so on. {full}"), (2, part), (3, f"{part} between them {full}")]
    by = {(r.doc_id, r.license): r for r in licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[1, "MIT-full"].within is None and by[1, "MIT-line"].within is None and by[2, "MIT"].within is None
    assert (by[1, "MIT"].within, by[1, "MIT"].n_places, by[1, "MIT"].n_won) == ("MIT-full", 1, 0)
    assert (by[3, "MIT"].n_places, by[3, "MIT"].n_won, by[3, "MIT-full"].n_won) == (2, 1, 1)
    assert licenses.within([("a", 0, 10, 5), ("b", 2, 6, 3), ("c", 8, 16, 4), ("d", 3, 5, 2)]) == {("b", 2): "a", ("d", 3): "a"}
    assert licenses.within([]) == {}


def test_bpe_of_many_texts_at_once(monkeypatch):
    """Texts that lie side by side stay apart, pieces of all lengths and a memory that is always full change nothing, nor do other patterns."""
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe.public_ranks()
    ranks = bpe.read_ranks(path)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    signs = [*" \n\t '‘sdlmtrve!a1é字😀٣　  ", "'ll", "'re", " '", "  '", "\n's", "!'s", "'s's", "it's ", " the", "ationing"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(4000)] + [None, "", "'", "'", "s", " ", "l'", "l", "thing" * 12, "=" * 63, "=" * 64, "=" * 65, "ab" * 700]
    want = [own.encode_ordinary(t or "") for t in texts]
    codec = bpe.Codec(ranks, pattern)
    ids, bounds = codec.encode_column(bpe.pa.array(["cut off", *texts]).slice(1))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    raw, at = codec.decode_column(ids, bounds)
    assert [raw[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == [t or "" for t in texts]
    monkeypatch.setattr(bpe, "MEMORY", 1000)
    small = bpe.Codec(ranks, pattern)
    assert [x.tolist() for k in range(0, len(texts), 500) for x in small.encode(texts[k : k + 500])] == want
    assert "model" in vars(codec)  # for long pieces; words never go through the library
    words = bpe.Codec(ranks, pattern)
    assert len(list(words.encode([" ".join(w + x for w in signs for x in signs if w.isascii())]))) == 1 and "model" not in vars(words)
    other = r"\p{L}+|\s+|[^\s\p{L}]"
    theirs = tiktoken.Encoding("other", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    assert [x.tolist() for x in bpe.Codec(ranks, other).encode(texts)] == [theirs.encode_ordinary(t or "") for t in texts]
    assert list(codec.encode([])) == []


def test_merges_of_equal_rank_go_from_the_left():
    """Of overlapping pairs that make the same token, the leftmost merges first, however the token was split."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"ba": 257, b"aba": 258, b"abab": 259}
    codec = bpe.Codec(ranks, r".+")

    def plain(piece: bytes) -> list[int]:
        if piece in ranks:
            return [ranks[piece]]
        t = [bytes([b]) for b in piece]
        while some := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(t, t[1:])) if a + b in ranks]:
            i = min(some)[1]
            t[i : i + 2] = [t[i] + t[i + 1]]
        return [ranks[x] for x in t]

    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("abc", [5, 5, 1], k=rng.randint(1, 40)))
        assert next(codec.encode([text])).tolist() == plain(text.encode())
