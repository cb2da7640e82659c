"""The pipeline's stages, each on what the one before kept, against what they must keep and drop."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    text = lambda i: "\n".join(" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(12)) + "." for _ in range(8))
    clean = {i: text(i) for i in range(30)}
    item = " ".join(f"item{i}" for i in range(20))
    docs = dict(clean) | {
        100: clean[3],
        101: clean[4].replace(clean[4].split()[5], "changed", 1),
        102: text(0) + "\n" + item.title() + ".",
        103: text(0) + "\nWrite to jane.doe@example.com or 10.1.2.3 now.",
        104: "a | b | c\n" * 40,
        105: None,
    }
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = now.columns
    for step, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{step}")
        now = spark.read.parquet(f"{tmp_path}/{step}")
        seen[step] = {r.doc_id: r for r in now.collect()}
        assert step == "byte_bpe" or now.columns == names
    assert set(seen["quality_rules"]) == set(clean) | {100, 101, 102, 103}
    assert set(seen["near_dedup"]) == set(clean) | {102, 103}
    assert set(seen["decontamination"]) == set(clean) | {103}
    private = seen["personal_data"][103]
    assert private.text.endswith("Write to [EMAIL] or [IP] now.") and private.n_chars == len(private.text)
    assert all(seen["personal_data"][i].text == t for i, t in clean.items())
    assert set(seen["byte_bpe"]) == set(clean) | {103} and all(len(r.ids) == len(r.starts) == len(r.ends) > 0 for r in seen["byte_bpe"].values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["byte_bpe"])


CLASHING = "_w long, _l long, _q string, judged string, of_words int, more string, more_id long, near_id long, near_hash long, near_row int, leak_id long, found_id long, found_spans string, d int, xh int, `a.b` long, `c``d` string"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A folder of awkward documents: nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(19)
    text = lambda n=8: "\n".join(" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(12)) + "." for _ in range(n))
    base = [text() for _ in range(4)]
    item = " ".join(f"item{i}" for i in range(20))
    secret = f'\nNow token = "{"4f9a1c7e8b2d6053" * 2}" was set here.'
    rows = [(1, base[0]), (1, base[0]), (2, base[0]), (None, base[0]), (None, base[1]), (None, None), (3, None), (4, ""), (5, " \n\t"), (6, base[2] + secret), (6, base[3] + "\nWrite to a.b@c.org now."), (7, text(3000)), (8, base[2] + "\n" + item + "."), (9, base[3] + "\n" + base[3])]
    path = tmp_path_factory.mktemp("odd")
    extra = [c.rsplit(" ", 1) for c in CLASHING.split(", ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *[str(i) if k == "string" else 7 for _, k in extra]) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), base, rows


def test_stages_on_awkward_tables(spark, odd):
    path, base, rows = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for step, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert step == "byte_bpe" or out.dtypes == docs.dtypes
        kept[step] = sorted(str((r.doc_id, r.text if step != "byte_bpe" else len(r.ids))) for r in out.collect())
        assert stage(spark, docs.where("false"), path).count() == 0
    of = lambda some: sorted(str(x) for x in some)
    good = [(i, t) for i, t in rows if t and len(t) > 20 and i != 9]
    assert kept["quality_rules"] == of(good)  # 9 repeats half of its lines
    # (9, a text twice) has the shingles of base[3] and few more, as has the second text of 6; the first of 6 is near none
    assert kept["decontamination"] == of(x for x in rows if x[0] != 8)
    assert len(kept["personal_data"]) == len(kept["byte_bpe"]) == len(rows)
    assert sum("[SECRET]" in x for x in kept["personal_data"]) == sum("[EMAIL]" in x for x in kept["personal_data"]) == 1
    near = kept["near_dedup"]
    assert str((1, base[0])) in near and str((2, base[0])) not in near and str((None, base[0])) not in near and str((None, base[1])) in near
    assert near.count(str((1, base[0]))) == 1
    wordless = [x for x in near if x in of([(None, None), (3, None), (4, ""), (5, " \n\t")])]
    assert wordless == [str((3, None))]  # the least doc_id of the group of texts without a word


def test_run_on_empty_tables(spark, odd, tmp_path):
    path, _, _ = odd
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "ids", "starts", "ends"]


def test_run_against_a_plain_version(spark, odd):
    """All stages of run() over the awkward table, each as plain Python."""
    import re
    from collections import Counter

    tiktoken = pytest.importorskip("tiktoken")
    from runweave.llm import bpe

    path, _, rows = odd
    item = " ".join(f"item{i}" for i in range(20)).split()
    now = []
    for i, t in rows:  # quality rules, for texts of plain sentences
        w, lines = (t or "").split(), [x for x in (t or "").split("\n") if x.strip()]
        grams = Counter(zip(w, w[1:], w[2:]))
        repeated = len({j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)})
        passed = [x for x in dict.fromkeys(lines) if re.search(r"[.!?]\"?$", x) and re.search("[a-z]", x)]
        if len(w) >= 50 and 2 * repeated <= len(w) and sum(map(len, lines)) - sum(map(len, passed)) <= 0.4 * sum(map(len, lines)):
            now.append((i, "\n".join(passed)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in now for w in [t.lower().split()]]
    group = list(range(len(now)))
    for a in range(len(now)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    order = lambda k: (now[k][0] is None, now[k][0] or 0)
    now = [now[min((k for k in range(len(now)) if group[k] == g), key=order)] for g in dict.fromkeys(group)]

    def covered(t):  # greedy tiling of an item of distinct words: its maximal runs of five words or more
        w, n, k = re.findall(r"\w+", t.lower()), 0, 0
        at = {x: j for j, x in enumerate(item)}
        while k < len(w):
            m = 0
            while k + m < len(w) and w[k + m] in at and (m == 0 or at[w[k + m]] == at[w[k + m - 1]] + 1):
                m += 1
            n, k = n + (m if m >= 5 else 0), k + max(m, 1)
        return n

    now = [(i, t) for i, t in now if 2 * covered(t) < len(item)]
    clean = lambda t: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", re.sub(r'(?<= = ")[0-9a-f]{32}(?=")', "[SECRET]", t))
    rank_path, pattern = bpe.public_ranks()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(rank_path), special_tokens={})
    want = sorted(str((i, own.encode_ordinary(clean(t)))) for i, t in now)
    assert sorted(str((r.doc_id, list(r.ids))) for r in corpus_pipeline.run(spark, path).collect()) == want and len(want) > 3


def test_quality_sql(spark):
    import os

    import duckdb

    from runweave.llm import quality

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    got = quality.verdicts(spark.read.parquet(f"{folder}/documents.parquet"))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({quality.VERDICTS_SQL})").fetchall())
