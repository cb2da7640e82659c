"""The whole run: planned, stored by partitions, resumed, and failing in parts."""

import random
import shutil

import pytest

from runweave.plans import config as C
from runweave.plans import runs


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(17)
    held = {r: sorted(rng.sample(range(8), rng.randint(0, 8))) for r in range(60)}
    lengths = {r: rng.randint(1, 50) for r in held}
    given = [("nj", t, i, f"c{(3 * i) % 8}") for t in C.MATRICES for i in range(8)]
    frame = spark.createDataFrame
    x = runs.Inputs(
        frame([(r, c) for r, cs in held.items() for c in cs], "row_id int, color int"), frame(list(lengths.items()), "row_id int, seq_len int"), frame([(i, f"c{i}") for i in range(8)], "color int, name string"), frame(given, "method string, type string, pos int, name string")
    )
    return x, {r: cs for r, cs in held.items() if cs}, lengths


def changes(held, lengths, order, weighting, k):
    """Bit changes of distinct rows along an order of colors, counted row by row."""
    weights = {}
    for r, cs in held.items():
        w = weights.setdefault(tuple(cs), [0, 0])
        w[0], w[1] = w[0] + 1, w[1] + max(lengths[r] - k, 0) + 1
    value = lambda w: {"unitig": w[0], "kmer": w[1], "uniqrow": 1}[weighting]
    return sum(value(w) * sum((a in cs) != (b in cs) for a, b in zip(order, order[1:])) for cs, w in weights.items())


def test_a_run_is_whole_and_resumed(spark, inputs, tmp_path):
    x, held, lengths = inputs
    config = C.Config(kmer_sizes=[5], matrices={"unitig": False})
    folder = f"{tmp_path}/results"
    done = runs.run_all(spark, config, {"a": x}, folder)
    found = runs.results(spark, folder).collect()
    assert len(done) == 5 and len(found) == 2 * len(done)
    scores = {(r.method, r.type): r.n_bit_changes for r in found}
    for t in ("kmer", "uniqrow"):
        assert scores["nj", t] == changes(held, lengths, [(3 * i) % 8 for i in range(8)], t, 5)
        assert scores["optimal", t] <= scores["worst", t]
    # a second run does nothing; what is taken away is made again, and nothing else
    assert runs.run_all(spark, config, {"a": x}, folder) == []
    shutil.rmtree(f"{folder}/dataset=a/k=5/n=8/method=randomized/type=kmer")
    assert runs.run_all(spark, config, {"a": x}, folder) == [("a", 5, 8, "randomized")]
    assert sorted(map(tuple, runs.results(spark, folder).collect())) == sorted(map(tuple, found))


def test_a_failing_run_leaves_the_others(spark, inputs, tmp_path):
    x, _, _ = inputs
    bad = runs.Inputs(x.incidence, x.lengths, x.colors)  # no order of an outside program
    config = C.Config(kmer_sizes=[5], outputs={"worst": False, "optimal": False, "upgma": False})
    folder = f"{tmp_path}/results"
    with pytest.raises(RuntimeError, match="bad k=5 n=8 nj: no order nj is given"):
        runs.run_all(spark, config, {"bad": bad, "good": x}, folder)
    assert {(r.dataset, r.method) for r in runs.results(spark, folder).collect()} == {("bad", "randomized"), ("good", "nj"), ("good", "randomized")}
    assert runs.run_all(spark, config, {"bad": x, "good": x}, folder) == [("bad", 5, 8, "nj")]
