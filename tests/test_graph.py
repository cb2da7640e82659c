"""Compacted coloured graphs against plain versions, and dumps that are read back."""

import os
import random
from collections import Counter, defaultdict
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from runweave.functions.steps import shared_folder
from runweave.operators import graph, matrix
from runweave.sources import readers, writers


def plain_words(rows, k):
    held = defaultdict(set)
    for name, t in rows:
        w = [x for x in (t or "").split(" ") if x]
        for i in range(len(w) - k + 1):
            held[tuple(w[i : i + k])] |= {name} - {None}
    held = {x: s for x, s in held.items() if s}
    into, out = defaultdict(list), defaultdict(list)
    for x in held:
        out[x[:-1]].append(x)
        into[x[1:]].append(x)
    after = {}
    for x in held:
        if len(into[x[1:]]) == len(out[x[1:]]) == 1 and (y := out[x[1:]][0]) != x and held[x] == held[y]:
            after[x] = y
    led, seen, paths = set(after.values()), set(), []
    for x in [*(h for h in held if h not in led), *held]:
        if x not in seen:
            path = [x]
            seen.add(x)
            while path[-1] in after and after[path[-1]] not in seen:
                path.append(after[path[-1]])
                seen.add(path[-1])
            paths.append((tuple(sorted(held[x])), len(path), frozenset(path)))
    return paths


def reverse(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_bases(rows, k):
    held, places = defaultdict(set), defaultdict(lambda: defaultdict(list))
    for name, t in rows:
        t = (t or "").upper()
        for i in range(len(t) - k + 1):
            if set(x := t[i : i + k]) <= set("ACGT") and name:
                held[min(x, reverse(x))].add(name)
    for x in held:
        for end, g, first in (("left", x[:-1], 1), ("right", x[1:], 0)):
            r = reverse(g)
            places[min(g, r)]["both" if g == r else first if g < r else 1 - first].append((x, end))
    next_to = {}
    for sides in places.values():
        if set(sides) == {0, 1} and len(sides[0]) == len(sides[1]) == 1:
            (u, d), (v, e) = sides[0][0], sides[1][0]
            if u != v and held[u] == held[v]:
                next_to[u, d], next_to[v, e] = (v, e), (u, d)
    seen, paths = set(), []
    for x in held:
        if x not in seen:
            group, todo = set(), [x]
            while todo:
                y = todo.pop()
                if y not in group:
                    group.add(y)
                    todo += [next_to[y, d][0] for d in ("left", "right") if (y, d) in next_to]
            seen |= group
            paths.append((tuple(sorted(held[x])), len(group), frozenset(group)))
    return paths


def shown(found, k, bases):
    out = []
    for r in found.collect():
        units = r.sequence if bases else tuple(r.sequence.split(" "))
        parts = [units[i : i + k] for i in range(len(units) - k + 1)]
        assert len(parts) == r.n_fragments  # a sequence holds just the fragments of its path
        out.append((tuple(r.names), r.n_fragments, frozenset(min(x, reverse(x)) for x in parts) if bases else frozenset(parts)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, seed", [(2, 1), (3, 2)])
def test_word_graph(spark, k, seed):
    """Branches, circles inside a text and over several, repeated texts, nulls, empty and short texts."""
    rng = random.Random(seed)
    rows = [(rng.choice("xyz"), " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 14)))) for _ in range(25)]
    rows += [("x", "1 2 3 1 2 3 1 2 3 1"), ("y", "p q r s t u v"), ("y", "r s t u v w x"), ("z", "k k k k k"), ("w", "9 8 7 6"), ("w", "7 6 5 9"), ("w", "5 9 8 7"), ("w", None), (None, "l m n o p"), ("x", ""), rows[0]]
    rows += [("long", " ".join(f"n{i}" for i in range(3000))), ("long", " ".join(f"n{i}" for i in range(2990, 6000)))]
    df = spark.createDataFrame(rows, "name string, text string").repartition(3)
    assert shown(graph.unitigs(df, k, "name", "text"), k, False) == sorted(plain_words(rows, k), key=repr)
    assert graph.unitigs(df.where("false"), k, "name", "text").count() == 0


@pytest.mark.parametrize("k", [4, 5])
def test_base_graph(spark, k):
    """Both directions of reading, palindromes, letters that are no base, lower case, circles."""
    rng = random.Random(k)
    draw = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = [(rng.choice("xy"), draw(rng.randint(0, 12 + k))) for _ in range(12)]
    long = draw(60)
    rows += [("x", long[:40]), ("x", reverse(long[25:])), ("y", "ACGTNACGGTTT"), ("y", "aattccgg"), ("z", "CATTA" * 4), ("z", "AAAAAAAA"), ("z", "GATATC"), (None, draw(20)), ("x", None)]
    df = spark.createDataFrame(rows, "name string, text string").repartition(3)
    assert shown(graph.unitigs(df, k, "name", "text", bases=True), k, True) == sorted(plain_bases(rows, k), key=repr)


@pytest.mark.parametrize("bases", [False, True])
def test_many_slices_and_buckets(spark, monkeypatch, bases):
    """Junctions of one slice or of several, in buckets of their own; copies, near copies and hot junctions."""
    monkeypatch.setattr(graph, "SLICE", 60)
    monkeypatch.setattr(graph, "BUCKET", 40)
    rng, k = random.Random(7), 6
    units = "ACGT" if bases else [f"{x}{y}" for x in "abcdé" for y in "abc"]
    glue, turn = ("", reverse) if bases else (" ", lambda s: s)
    draw = lambda n: glue.join(rng.choice(units) for _ in range(n))
    whole = [draw(90) for _ in range(3)]
    rows = [(rng.choice("xyz"), draw(rng.randint(0, 40))) for _ in range(25)] + [("xyz"[i % 3], w) for i, w in enumerate(whole)] * 3
    rows += [(rng.choice("xy"), turn(w[: rng.randint(30, 90)])) for w in whole for _ in range(6)] + [("v", glue.join([units[0]] * 30))] * 4
    rows += [("w", whole[0][:40] + glue + draw(5) + glue + whole[1][40:])] * 2
    df = spark.createDataFrame(rows, "name string, text string").repartition(3)
    plain = plain_bases if bases else plain_words
    assert Counter(shown(graph.unitigs(df, k, "name", "text", bases=bases), k, bases)) == Counter(plain(rows, k))


def test_graph_takes_little_disk(spark):
    """What is stored on the way is less than twice the texts: on sf0.1 it was 5.8 times them, and is 0.6."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(urlparse(shared_folder(spark)).path) for f in names if f.endswith(".parquet"))
    before, size = held(), docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n
    assert graph.unitigs(docs, 5, "source", "text").agg(F.sum("n_fragments").alias("n")).first().n > 100_000
    assert held() - before < 2 * size


def test_dump_is_written_and_read_back(spark, tmp_path):
    """The weights of a dump, read back, are those of the fragments' sets."""
    rng, k = random.Random(9), 11
    whole = "".join(rng.choice("ACGT") for _ in range(900))
    changed = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.01 else c for c in s)
    rows = [(f"s{i % 4}", changed(whole[100 * i : 100 * i + 300])) for i in range(7)]
    df = spark.createDataFrame(rows, "name string, text string")
    colors = spark.createDataFrame([(i, f"s{i}") for i in range(4)], "color int, name string")
    found = graph.unitigs(df, k, "name", "text", bases=True)
    writers.write_dump(found, colors, k, str(tmp_path), "set")
    stem = f"{tmp_path}/set_k{k}"
    sets, units = readers.color_sets(spark, f"{stem}.color_sets.txt", 4), readers.unitigs(spark, f"{stem}.unitigs.fa")
    weights = {tuple(r.colors): (r.w_unitig, r.w_kmer) for r in matrix.dump_weights(sets, units, k).collect()}
    held = defaultdict(set)
    for name, t in rows:
        for i in range(len(t) - k + 1):
            held[min(t[i : i + k], reverse(t[i : i + k]))].add(int(name[1:]))
    by_set = defaultdict(int)
    for s in held.values():
        by_set[tuple(sorted(s))] += 1
    paths = defaultdict(int)
    for names, _, _ in plain_bases(rows, k):
        paths[tuple(int(x[1:]) for x in names)] += 1
    assert {s: n for s, (_, n) in weights.items()} == by_set and {s: n for s, (n, _) in weights.items()} == paths
    told = {r.key: int(r.value) for r in readers.metadata(spark, f"{stem}.metadata.txt").collect()}
    assert told == {"num_unitigs": sum(paths.values()), "num_kmers": len(held), "num_color_sets": len(by_set)}


def test_graph_of_the_documents(spark, sf):
    from runweave import queries

    rows = [(r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["compacted_graph"](spark, sf).select(F.split("colors", " ").alias("names"), "n_fragments", "sequence")
    assert shown(got, 5, False) == sorted(plain_words(rows, 5), key=repr)


def test_numbers_follow_the_order(spark):
    rows = [(x,) for x in random.Random(1).sample(range(1000), 200)]
    got = writers.numbered(spark.createDataFrame(rows, "x int").repartition(5), ["x"], "n").collect()
    assert sorted((r.x, r.n) for r in got) == [(x, i) for i, (x,) in enumerate(sorted(rows))]
