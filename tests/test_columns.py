"""Matrix, order, evaluation, reader and plan operators: against SQL, brute force and invariants."""

import itertools
import lzma
import os
import random

import pytest
from pyspark.sql import functions as F

from runweave import queries
from runweave.functions import names as N
from runweave.operators import evaluate, fragments, matrix, orders, reports, sampling
from runweave.plans import analysis
from runweave.plans import config as C
from runweave.sources import readers, writers

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, con, sf, name):
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(map(str, d[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def random_sets(seed, n, rows, dense=0.5):
    rng = random.Random(seed)
    sets = {tuple(c for c in range(n) if rng.random() < rng.choice((0.1, dense, 0.95))) for _ in range(rows)} | {(), (0,), tuple(range(n))}
    return [(list(s), rng.randint(0, 5), rng.randint(0, 90)) for s in sorted(sets)]


@pytest.mark.parametrize("seed", range(3))
def test_distances_agree(spark, seed):
    n, rows = 9, random_sets(seed, 9, 60)
    assert any(3 * len(s) > 2 * n + 1 for s, _, _ in rows)  # some rows are dense
    sets = spark.createDataFrame(rows, "colors array<int>, w_unitig long, w_kmer long")
    colors = spark.createDataFrame([(i, f"c{i}") for i in range(n)], "color int, name string")
    want = {(i, j, t): sum(w for s, u, k in rows for w in [{"unitig": u, "kmer": k, "uniqrow": 1}[t]] if (i in s) != (j in s)) for i, j in itertools.combinations(range(n), 2) for t in matrix.TYPES}
    for df in (matrix.distances_identity(sets, colors), matrix.distances_hybrid(sets, colors, n), matrix.distances_blocks(sets, colors), matrix.distances_blocks(sets, colors, 4), matrix.distances_xor(sets, colors, n)):
        assert {(r.i, r.j, r.type): r.dist for r in df.collect()} == want


def test_totals_without_pairs(spark, sf):
    """Totals of each column over those behind it, with colors that are no columns, and columns in several blocks."""
    rows = random_sets(3, 12, 60) + [([2, 5, 11, 40], 3, 9), ([-3, 4, 7], 2, 2), ([99], 1, 1)]
    sets = spark.createDataFrame(rows, "colors array<int>, w_unitig long, w_kmer long")
    columns = [0, 1, 2, 4, 5, 7, 8, 11, 60]
    colors = spark.createDataFrame([(c, f"c{c}") for c in columns], "color int, name string").repartition(3)
    pairs = matrix.distances_identity(sets, colors).groupBy("i", "name_i", "type").agg(F.sum("dist").alias("dist"), F.count("*").alias("n_pairs"))
    want = sorted(map(tuple, pairs.collect()))
    assert len(want) == 24
    for block in (1024, 4):
        assert sorted(map(tuple, matrix.distance_totals(sets, colors, block).collect())) == want
    assert matrix.distance_totals(sets.where("false"), colors).where("dist <> 0").count() == 0
    plan = queries.QUERIES["distance_suppliers"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan  # at 60,000 columns the pairs alone filled the disk


def test_blocks_of_many_columns(spark):
    """More columns than one block, or than the product of all of them could hold."""
    rng, n = random.Random(12), 5000
    rows = [(sorted(rng.sample(range(n), rng.choice([0, 1, 3, 40]))), rng.randint(0, 5), rng.randint(0, 90)) for _ in range(60)]
    rows = list({tuple(s): (s, u, k) for s, u, k in rows}.values())
    want = {}
    for s, u, k in rows:
        for i, j in itertools.combinations_with_replacement(s, 2):
            x = want.setdefault((i, j), [0, 0, 0])
            x[0], x[1], x[2] = x[0] + u, x[1] + k, x[2] + 1
    got = matrix.block_sums(spark.createDataFrame(rows, "colors array<int>, w_unitig long, w_kmer long"), 600)
    assert {(r.i, r.j): [r.c_unitig, r.c_kmer, r.c_uniqrow] for r in got.collect()} == want
    empty = spark.createDataFrame([([], 1, 1)], "colors array<int>, w_unitig long, w_kmer long")
    assert matrix.block_sums(empty).count() == 0


def test_names(spark):
    cases = {"/data/S1.fa.gz": "S1", "a/b/S.1.fasta": "S.1", " x.fna \n": "x", ".fa": "", ".hidden": ".hidden", "n.": "n", "dir/sub/": "sub", "UP.FA": "UP", "x.fa.gz.fa": "x.fa.gz", "plain": "plain", "t.txt": "t"}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select("p", N.sample_name(F.col("p")).alias("n"))
    assert {r.p: r.n for r in df.collect()} == cases


def test_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    m = put("set_a.txt", "# head\n/d/S2.fa.gz\n\n  /d/S1.fa\n/d/S3.fna")
    lines = readers.manifests(spark, m)
    assert [(r.color, r.name) for r in readers.colors(lines).orderBy("color").collect()] == [(0, "S2"), (1, "S1"), (2, "S3")]
    assert readers.manifest_sizes(lines).collect()[0].n_lines == 5
    sets = readers.color_sets(spark, put("x.color_sets.txt", "size=2 1 0 1\ncolor_set_id=2 size=1 2\nsize=3 0 1 2\n\ncolor_set_id=3 size=0\n"), 3)
    assert {r.color_set_id: r.colors for r in sets.collect()} == {0: [0, 1], 1: [0, 1, 2], 2: [2], 3: []}
    for bad in ("0 7\n", "0 x\n", "color_set_id=5 0\n"):
        with pytest.raises(Exception):
            readers.color_sets(spark, put(f"bad{abs(hash(bad))}.txt", bad), 3).collect()
    u = readers.unitigs(spark, put("x.unitigs.fa", "> unitig_id=1 color_set_id=0\nACGT\nAC\n\n>color_set_id=2 x\n\n> z color_set_id=0\nACG\n"))
    assert sorted((r.color_set_id, r.seq_len) for r in u.collect()) == [(0, 3), (0, 6), (2, 0)]
    w = {r.color_set_id: (r.w_unitig, r.w_kmer) for r in matrix.dump_weights(sets, u, 5).collect()}
    assert w == {0: (2, 3), 1: (0, 0), 2: (1, 1), 3: (0, 0)}
    with pytest.raises(Exception):
        matrix.dump_weights(sets, u.union(spark.createDataFrame([(9, 4)], u.schema)), 5).collect()
    with pytest.raises(Exception):
        readers.unitigs(spark, put("bad.fa", ">no id\nACGT\n")).collect()
    assert {r.key: r.value for r in readers.metadata(spark, put("x.metadata.txt", "num_unitigs=4\nnote\na=b=c\n")).collect()} == {"num_unitigs": "4", "a": "b"}
    text = "S2\tS1\t5\nS1\tS1\t9\nS1\tS2\t7\nS3.fa S1 2\n"
    want = {("S1", "S2", 7), ("S1", "S3", 2)}
    (tmp_path / "d.txt.xz").write_bytes(lzma.compress(text.encode()))
    for path in (put("d.txt", text), str(tmp_path / "d.txt.xz")):
        assert {tuple(r) for r in readers.distances(spark, path).collect()} == want
    assert [r.name for r in readers.order(spark, put("o.txt", "S2.fa\n\nS1\n")).orderBy("pos").collect()] == ["S2", "", "S1"]
    t = readers.tour(spark, put("i.sol", "4\n0 2 1\n3\n")).first()
    assert t.dim == 4 and t.tour == [0, 2, 1, 3]
    assert readers.instance_keys(spark, put("i.tsp", "NAME : x\nCOMMENT : keys:D,S1,S2\n")).first()["keys"] == ["D", "S1", "S2"]
    nw = readers.newick(spark, put("t.nw", "((A:0.1, B:0.2)x:0.3,C:1);\n"))
    assert nw.select(N.leaves(F.col("tree")).alias("x")).first().x == ["A", "B", "C"]
    r = readers.runs(spark, put("set_a_optimal_k31_N7_kmer.runs", "n_runs\t3\nn_bit_changes\t1\nn_cylinder_runs\t2\n")).first()
    assert (r.dataset, r.method, r.k, r.n, r.type, r.n_bit_changes, r.n_runs, r.n_cylinder_runs) == ("set_a", "optimal", 31, 7, "kmer", 1, 3, 2)
    for bad in ("n_runs\t3\n", "n_runs\t3\nn_runs\t3\nn_bit_changes\t1\nn_cylinder_runs\t2\n", "other\t1\n", "n_runs\tx\n"):
        with pytest.raises(Exception):
            readers.runs(spark, put(f"b{abs(hash(bad))}_optimal_k31_N7_kmer.runs", bad)).collect()
    head, bits = readers.bit_matrix(spark, put("m.txt", "A\tB\tC\n011\n110\n011\n"))
    assert head == ["A", "B", "C"] and {(x.i, x.j): x.dist for x in matrix.bit_matrix_hamming(bits).collect()} == {(0, 1): 2, (0, 2): 3, (1, 2): 1}
    times = readers.timings(spark, put("x.time", "experiment\trun\treal_s\ne\t1\tNA\ne\t2\t3.5\n")).collect()
    assert [x.real_s for x in times] == [None, "3.5"]
    assert readers.first_existing(spark, [str(tmp_path / "no"), m]) == m
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "no")])
    for bad in ("3\n0 2 2\n", "4\n0 1 2\n"):
        with pytest.raises(Exception, match="permutation"):
            readers.tour(spark, put(f"t{abs(hash(bad))}.sol", bad)).collect()
    for bad in ("(A,B);", "(A:1,merge_root:2);"):
        with pytest.raises(Exception, match="no leaves"):
            readers.newick(spark, put(f"t{abs(hash(bad))}.nw", bad)).select(N.leaves(F.col("tree"))).collect()
    for bad in ("set_a_other_k31_N7_kmer.runs", "set_a_nj_k31_N7_bits.runs"):
        with pytest.raises(Exception, match="not a runs file"):
            readers.runs(spark, put(bad, "n_runs\t3\nn_bit_changes\t1\nn_cylinder_runs\t2\n")).collect()


def test_timings_of_different_headers(spark, tmp_path):
    """Fields go by the header of their own file; what a header lacks is null; wrong widths and repeated names are errors."""
    put = lambda name, text: (tmp_path / name).write_text(text) and f"{tmp_path}/*.time"
    put("a.time", "experiment\trun\treal_s\ne\t1\t3.5\nexperiment\trun\treal_s\ne\t2\tNA\n")
    glob = put("b.time", "experiment\treal_s_py\trun\treal_s\nf\tNone\t7\t1.5\n")
    got = readers.timings(spark, glob)
    assert got.columns == ["experiment", "real_s_py", "run", "real_s"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, [("e", None, "1", "3.5"), ("e", None, "2", None), ("f", None, "7", "1.5")]))
    assert [tuple(r) for r in readers.timings(spark, f"{tmp_path}/b.time", ["run", "missing"]).collect()] == [("7", None)]
    for n, text in enumerate(("a\tb\n1\n", "a\tb\n1\t2\t3\n", "a\ta\n1\t2\n", "a\t\n1\t2\n")):
        put(f"{n}.bad", text)
        with pytest.raises(Exception, match="does not fit the header"):
            readers.timings(spark, f"{tmp_path}/{n}.bad", ["a"]).collect()


def plain_nodes(tree):
    """(depth, name, length, first leaf, last leaf, parent's leaves) of a Newick tree, by recursion."""
    out, at, leaf = [], 0, 0

    def label():
        nonlocal at
        name, start = None, at
        if tree[at : at + 1] == "'":
            end = at + 1
            while tree[end] != "'" or tree[end : end + 2] == "''":
                end += 2 if tree[end] == "'" else 1
            name, at = tree[at + 1 : end].replace("''", "'"), end + 1
        else:
            while at < len(tree) and tree[at] not in "(),:;":
                at += 1
            name = tree[start:at].strip() or None
        length = None
        if tree[at : at + 1] == ":":
            start = at = at + 1
            while at < len(tree) and tree[at] not in "(),;":
                at += 1
            length = float(tree[start:at])
        return name, length

    def node(depth):
        nonlocal at, leaf
        first = leaf
        inner = []
        if tree[at] == "(":
            while tree[at] in "(,":
                at += 1
                inner.append(node(depth + 1))
            at += 1
        else:
            leaf += 1
        name, length = label()
        span = (first, leaf - 1)
        out.append((depth, name, length, *span, None))
        for i in inner:
            out[i] = (*out[i][:5], span)
        return len(out) - 1

    node(0)
    return sorted(out, key=repr)


def test_tree_nodes(spark):
    trees = ["((A:0.1,B:0.2)x:0.3,C:1);", "('it''s (a), b':1.5,(c,(d:2,e)'f g':3)h)root;", "A:1;", "((((a:1e-3))));", "(a,b,c);"]
    got = readers.tree_nodes(spark.createDataFrame(list(enumerate(trees)), "path int, tree string")).collect()
    for i, tree in enumerate(trees):
        own = {r.node: r for r in got if r.path == i}
        span = lambda n: (own[n].first_leaf, own[n].last_leaf) if n is not None else None  # noqa: E731, B023
        assert sorted(((r.depth, r.name, r.length, *span(r.node), span(r.parent)) for r in own.values()), key=repr) == plain_nodes(tree)
    for bad in ("((a,b);", "(a,b));"):
        with pytest.raises(Exception, match="brackets don't match"):
            readers.tree_nodes(spark.createDataFrame([(1, bad)], "path int, tree string")).collect()


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_xz_lines(size):
    text = "".join(f"a{i}\tb{i}\t{i}\n" for i in range(300)) + "é\tlast\t1"
    packed = lzma.compress(text[:2000].encode()) + b"\0" * 4 + lzma.compress(text[2000:].encode())
    parts = list(readers.xz_lines(packed, size))
    assert [x for p in parts for x in p] == text.split("\n") and (size > 7 or max(map(len, parts)) <= 7)
    assert list(readers.xz_lines(lzma.compress(b""), size)) == []
    with pytest.raises(EOFError):
        list(readers.xz_lines(packed[:-20], size))


def test_manifest_is_written(spark):
    lines = writers.manifest_lines(spark.createDataFrame([("/b/x.fa",), ("/a/y.fa",), ("/b/x.fa",)], "path string"))
    assert [r.path for r in lines.collect()] == ["/a/y.fa", "/b/x.fa"]


def test_implicit_color_set_ids(spark, tmp_path):
    """Lines without an id are counted over the splits of a file."""
    (tmp_path / "s.txt").write_text("".join("\n" if i % 10 == 3 else f"size=1 {i % 7}\n" for i in range(4000)))
    want = dict(enumerate([i % 7] for i in range(4000) if i % 10 != 3))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = {r.color_set_id: r.colors for r in readers.color_sets(spark, str(tmp_path / "s.txt"), 7).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_dataset_inputs(spark, tmp_path):
    for f in ("d/a/S1.fa", "d/a/S2.fna.gz", "d/b/c/S3.fasta", "d/b/notes.txt"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text(">x\nA\n")
    at = lambda f: str(tmp_path / f)
    names = lambda df: [r.path.rsplit("/", 1)[1] for r in df.collect()]
    dataset, found = readers.dataset_inputs(spark, [at("d/a"), at("d/b")])
    assert dataset == "d" and names(found) == ["S1.fa", "S2.fna.gz", "S3.fasta"]
    dataset, found = readers.dataset_inputs(spark, [at("d/a/S2.fna.gz"), at("d/a/S1.fa"), at("d/a")])
    assert dataset == "a" and names(found) == ["S1.fa", "S2.fna.gz"]
    assert readers.dataset_inputs(spark, [at("d/b/c")])[0] == "c"
    for bad, kind in (([at("d/none")], FileNotFoundError), ([at("d/b/notes.txt")], ValueError), ([], FileNotFoundError)):
        with pytest.raises(kind):
            readers.dataset_inputs(spark, bad)


def test_numbered_lines_over_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "big.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.pos, r.value) for r in got) == [(i, f"line {i}") for i in range(5000)]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(0, 1, "a", "b", "kmer", 3), (0, 2, "a", "c", "kmer", 4), (1, 2, "b", "c", "kmer", 5)], "i int, j int, name_i string, name_j string, type string, dist long")
    assert [r.value for r in writers.distance_lines(d).collect()] == ["a\tb\t3", "a\tc\t4", "b\tc\t5"]
    writers.write_distances(d, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("type = 'kmer'").count() == 3
    rows = orders.instance_rows(d)
    assert rows.count() == 1 + 3 + orders.COPIES
    text = [r.value for r in writers.tsplib_lines(rows).collect()]
    assert text[3] == "DIMENSION : 39" and text[-1] == "EOF" and text[7].startswith("0 0 0") and text[8].startswith("0 0 3 4 0")
    runs = spark.createDataFrame([("p/N10", 1, 2, 3), ("p/N2", 4, 5, 6)], "path string, n_bit_changes long, n_runs long, n_cylinder_runs long")
    writers.write_final(runs, str(tmp_path / "f"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "f")).first().n_runs == "2"
    meta, total = spark.createDataFrame([("a", "1")], "key string, value string"), spark.createDataFrame([(9,)], "n_kmers long")
    full = writers.metadata_with_kmers(meta, total)
    assert {tuple(r) for r in full.collect()} == {("a", "1"), ("num_kmers", "9")} and writers.metadata_with_kmers(full, total).count() == 2
    stats = writers.vertical(runs.select("path", "n_runs", F.lit(None).cast("double").alias("x")), "path")
    assert ("p/N2", "x", "NA") in {tuple(r) for r in stats.collect()}


def test_sampling(spark):
    lines = [f"line-{i:02}" for i in range(1, 13)]
    a, b = sampling.shuffled_lines(lines, 42), sampling.shuffled_lines(lines, 43)
    assert a == sampling.shuffled_lines(lines, 42) and a != b and sorted(a) == lines
    df = spark.createDataFrame([(x,) for x in lines], "name string")
    few, more = ({r.name for r in sampling.selection(df, "name", n, 5).collect()} for n in (3, 7))
    assert few < more and len(more) == 7
    totals = spark.createDataFrame([(7, 0), (7, 1), (100, 1), (100, 2)], "total long, steps int")
    got = {}
    for r in sampling.sample_sizes(totals, "total", "steps").collect():
        got.setdefault((r.total, r.steps), []).append(r.n)
    assert {k: sorted(v) for k, v in got.items()} == {(7, 0): [7], (7, 1): [1, 7], (100, 1): [1, 10, 100], (100, 2): [1, 3, 10, 32, 100]}


def test_runs_are_flips(spark, sf):
    """Path sums of distances equal bit flips counted row by row."""
    inc, lens = queries._incidence(spark, sf).where("color < 10"), queries._lengths(spark, sf)
    colors = queries._colors(spark, sf).where("color < 10")
    flips = matrix.flips_by_row(matrix.row_sets(inc), colors.select(F.col("color").alias("pos"), "color")).first().n_flips
    sets = matrix.weighted_sets(matrix.row_sets(inc), lens, 31)
    one = colors.select(F.lit("o").alias("key"), F.col("color").alias("pos"), "name")
    scored = evaluate.order_runs(one, matrix.distances_hybrid(sets, colors, 10), matrix.row_counts(sets)).where("type = 'unitig'").first()
    assert scored.n_bit_changes == flips and scored.n_runs == flips + sum(r.w_unitig for r in sets.collect())


def test_given_orders(spark):
    """Orders from a tree and a tour that outside programs made; a single column has no changes."""
    inc = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 2)], "row_id long, color int")
    lens = spark.createDataFrame([(1, 40), (2, 3), (3, 9)], "row_id long, seq_len long")
    colors = spark.createDataFrame([(i, n) for i, n in enumerate("abc")], "color int, name string")
    trees = spark.createDataFrame([("unitig", "((a:1,c:1)x:1,b:2);")], "type string, tree string")
    tours = spark.createDataFrame([("unitig", list("abc"))], "type string, names array<string>")
    given = analysis.tree_orders(trees, "upgma").union(analysis.tour_orders(tours, "optimal"))
    got = {(r.method, r.type): (r.n_bit_changes, r.n_runs, r.n_cylinder_runs) for r in analysis.scored_orders(inc, lens, colors, given, C.Config(), 31, 3).collect()}
    assert got == {("upgma", "unitig"): (5, 8, 6), ("optimal", "unitig"): (3, 6, 6)}
    only = analysis.scored_orders(inc, lens, colors, given.where("name = 'a'"), C.Config(outputs={"upgma": False}), 31, 1).collect()
    assert [tuple(r) for r in only] == [("optimal", "unitig", 0, 3, 0)]


def test_dump_round_trip(spark, tmp_path):
    sets = spark.createDataFrame([(1, [0, 2]), (0, [1]), (2, [])], "color_set_id long, colors array<int>")
    unitigs = spark.createDataFrame([(5, 1, "ACGTACGTA"), (6, 0, "AC"), (7, 1, "A" * 8)], "unitig_id long, color_set_id long, sequence string")
    writers.write_unitigs(unitigs, str(tmp_path / "u"), width=4)
    assert sorted(tuple(r) for r in readers.unitigs(spark, str(tmp_path / "u")).collect()) == [(0, 2), (1, 8), (1, 9)]
    assert max(len(r.value) for r in spark.read.text(str(tmp_path / "u")).where("value not like '>%'").collect()) == 4
    writers.color_set_lines(sets).coalesce(1).write.text(str(tmp_path / "x"))
    assert {tuple(map(str, r)) for r in readers.color_sets(spark, str(tmp_path / "x"), 3).collect()} == {tuple(map(str, r)) for r in sets.collect()}


def test_missing_distance_is_an_error(spark):
    one = spark.createDataFrame([("o", 0, "a"), ("o", 1, "b")], "key string, pos int, name string")
    none = spark.createDataFrame([], "name_i string, name_j string, type string, dist long")
    with pytest.raises(Exception, match="no distance"):
        evaluate.order_runs(one, none, spark.createDataFrame([("kmer", 3)], "type string, num_rows long")).collect()


def test_scaling(spark):
    df = spark.createDataFrame([(0, 10001), (10001, 10001), (25, 50000), (35, 50000), (10000, 10000), (0, 10000)], "d long, top long")
    assert [r.w for r in df.select(orders.scaled(F.col("d"), F.col("top")).alias("w")).collect()] == [1, 10000, 5, 7, 10000, 0]


def test_fragments(spark):
    df = spark.createDataFrame([("a", "ACGTACGA"), ("b", "ACGTA"), ("c", "AC")], "s string, seq string")
    kmers = fragments.canonical_kmers(F.col("seq"), 4)
    comp = str.maketrans("ACGT", "TGCA")
    want = {}
    for s, seq in (("a", "ACGTACGA"), ("b", "ACGTA")):
        for i in range(len(seq) - 3):
            k = seq[i : i + 4]
            want.setdefault(min(k, k.translate(comp)[::-1]), set()).add(s)
    sizes = {}
    for v in want.values():
        sizes[tuple(sorted(v))] = sizes.get(tuple(sorted(v)), 0) + 1
    assert {tuple(r.colors): r.n_fragments for r in fragments.fragment_sets(df, kmers, "s").collect()} == sizes
    assert fragments.same_set_stretches(df, kmers, "s").count() == len(sizes)
    many = spark.createDataFrame([(f"s{i:03}", "ACGT" if i % 3 else "ACGTT") for i in range(150)] + [(None, "ACGT")], "s string, seq string")
    sets = {len(r.colors): r.colors for r in fragments.fragment_sets(many, fragments.canonical_kmers(F.col("seq"), 4), "s").collect()}
    assert sets == {150: [f"s{i:03}" for i in range(150)], 50: [f"s{i:03}" for i in range(0, 150, 3)]}


def test_config(spark):
    sizes = spark.createDataFrame([("x", 3)], "dataset string, n int")
    assert C.planned_runs(spark, C.Config(kmer_sizes=[15, 31], outputs={"worst": False}), sizes).count() == 2 * 4 * 3
    plain = C.Config()
    assert (plain.kmer_sizes, plain.random_seed, plain.sampling_steps, plain.sketch_k) == ([31], 1, 0, 31)
    assert plain.on_methods == list(C.METHODS) and plain.on_matrices == list(C.MATRICES)
    assert C.Config(matrices={"kmer": True}).on_matrices == list(C.MATRICES) and C.Config(matrices={"kmer": False}).on_matrices == ["unitig", "uniqrow"]
    for bad in ({"matrices": {"other": True}}, {"matrices": dict.fromkeys(C.MATRICES, False)}, {"outputs": {"nj": 1}}, {"outputs": []}, {"random_seed": True}, {"sampling_steps": -1}, {"kmer_sizes": ["31"]}, {"kmer_sizes": []}, {"other": 1}):
        with pytest.raises(ValueError):
            C.Config(**bad)
    with pytest.raises(ValueError, match="random_seed.*outputs"):
        C.Config(random_seed=1.5, outputs={"nj": 1})


def test_single_run_has_no_deviation(spark):
    runs = spark.createDataFrame([("e", 1, 2.0, "ok", "c"), ("e", 2, 9.0, "failed", "d")], "experiment string, run int, real_s double, status string, command string")
    r = reports.timing_summary(runs).first()
    assert r.stddev_s is None and r.mean_s == 2.0 and r.last_status == "failed" and r.first_command == "c"


def test_streamed_weights(spark, tmp_path):
    from runweave.streaming.weights import streamed_weights

    rows = [(i % 3, 30 + i) for i in range(20)]
    spark.createDataFrame(rows, "color_set_id long, seq_len long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("color_set_id long, seq_len long").parquet(str(tmp_path / "in"))
    q = streamed_weights(stream, 31).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    want = {c: (sum(x == c for x, _ in rows), sum(max(n - 31, 0) + 1 for x, n in rows if x == c)) for c in range(3)}
    assert {r.color_set_id: (r.w_unitig, r.w_kmer) for r in spark.table("w").collect()} == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 9 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("n", [3, 40])
def test_instance_rows(spark, n):
    """The full matrix cell by cell: zeros for the dummy, equal keys and a pair that has no distance."""
    rng = random.Random(n)
    dist = {(f"c{i:02}", f"c{j:02}"): rng.randint(1, 30000) for i in range(n) for j in range(i + 1, n) if (i, j) != (1, 2)}
    got = orders.instance_rows(spark.createDataFrame([(a, b, d) for (a, b), d in dist.items()], "name_i string, name_j string, dist long")).orderBy("pos").collect()
    keys = ["_DUMMY_CITY_SEPARATOR_", *sorted({k for pair in dist for k in pair})]
    keys += [keys[1]] * 35 if len(keys) - 1 < 35 else []
    top = max(dist.values())
    known = lambda a, b: dist.get((a, b), dist.get((b, a), 0))
    weight = lambda d: 0 if not d else max(1, round(d / (top / 10000)))
    assert [(r.pos, r.key, r.weights) for r in got] == [(i, k, [weight(known(k, x)) for x in keys]) for i, k in enumerate(keys)]
