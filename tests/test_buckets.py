"""K-mers in buckets of minimizers against all k-mers one by one."""

import os
import random
from collections import Counter, defaultdict
from urllib.parse import urlparse

import pytest

from runweave.functions.steps import shared_folder
from runweave.operators import buckets


def reverse(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain(rows, k):
    held = defaultdict(set)
    for name, s in rows:
        s = (s or "").upper()
        for i in range(len(s) - k + 1):
            if name and set(x := s[i : i + k]) <= set("ACGT"):
                held[min(x, reverse(x))].add(name)
    return Counter(tuple(sorted(v)) for v in held.values())


@pytest.mark.parametrize("k, m, hot, at_once", [(31, 15, 1 << 20, 1 << 22), (5, 3, 40, 10), (5, 1, 0, 1)])
def test_kmer_sets(spark, monkeypatch, k, m, hot, at_once):
    """Also with buckets that are all too hot, or of a few bases."""
    monkeypatch.setattr(buckets, "HOT", hot)
    monkeypatch.setattr(buckets, "AT_ONCE", at_once)
    rng = random.Random(k + m)
    whole = "".join(rng.choice("ACGT") for _ in range(3000))
    rows = [(f"s{i % 5}", whole[90 * i : 90 * i + rng.randint(0, 400)]) for i in range(30)] + [("s9", reverse(whole[500:900]))]
    rows += [("a", "acgtNNacgtacgtttgacca" * 4), ("b", "A" * 300), ("c", None), (None, "ACGTACGT"), ("d", ""), ("é", "ACéGTACGTACGT"), rows[0]]
    df = spark.createDataFrame(rows, "name string, seq string").repartition(3)
    assert {tuple(r.colors): r.n_fragments for r in buckets.kmer_sets(df, "name", "seq", k, m).collect()} == plain(rows, k)
    assert buckets.kmer_sets(df.where("false"), "name", "seq", k, m).count() == 0


def test_stretches_hold_each_kmer_once():
    rng = random.Random(2)
    s = "".join(rng.choice("ACGT") for _ in range(5000))
    found = buckets.stretches(s, 31, 15)
    assert [x[i : i + 31] for _, x in found for i in range(len(x) - 30)] == [s[i : i + 31] for i in range(len(s) - 30)]
    assert sum(len(x) for _, x in found) < 5 * len(s)  # a k-mer each would be 31 times as much
    with pytest.raises(ValueError):
        buckets.kmer_sets(None, "name", "seq", 32, 5)


def test_kmers_are_stored_packed(spark):
    """What is stored on the way is less than half the sequences, four bases to a byte: it was all stretches as texts."""
    rng = random.Random(4)
    rows = [(f"s{i % 3}", "".join(rng.choice("ACGT") for _ in range(20_000))) for i in range(100)]
    held = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(urlparse(shared_folder(spark)).path) for f in names if f.endswith(".parquet"))
    before = held()
    found = buckets.kmer_sets(spark.createDataFrame(rows, "name string, seq string"), "name", "seq", 31, 15)
    assert sum(r.n_fragments for r in found.collect()) == 100 * 19_970
    assert held() - before < 100 * 20_000 / 2
