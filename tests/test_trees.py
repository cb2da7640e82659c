"""Spanning trees, tours around them and average-linkage trees against plain versions."""

import random

import pytest

from runweave.operators import trees


def drawn(spark, n, seed, largest, types=("kmer", "unitig")):
    rng = random.Random(seed)
    rows = [(t, i, j, rng.randint(0, largest)) for t in types for i in range(n) for j in range(i + 1, n)]
    return rows, spark.createDataFrame(rows, "type string, i int, j int, dist long").repartition(3), spark.createDataFrame([(i,) for i in range(n)], "column int")


def plain_tree(rows, n):
    up, out = list(range(n)), set()

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, i, j in sorted((d, i, j) for _, i, j, d in rows):
        if top(i) != top(j):
            up[top(i)] = top(j)
            out.add((i, j, d))
    return out


def walked(edges, n):
    near = {i: sorted({j for a, b, _ in edges for j in (a, b) if i in (a, b) and j != i}) for i in range(n)}
    order, todo = [], [(0, None)]
    while todo:
        x, came = todo.pop()
        order.append(x)
        at = near[x].index(came) + 1 if came is not None else 0
        todo += [(y, x) for y in reversed(near[x][at:] + near[x][:at]) if y != came]
    return order


@pytest.mark.parametrize("n, seed, largest", [(2, 1, 5), (25, 2, 6), (40, 3, 10**6)])
def test_spanning_tree_and_tour(spark, n, seed, largest):
    """Ties among few different distances, two weightings at once."""
    rows, dists, _ = drawn(spark, n, seed, largest)
    tree = trees.spanning_tree(dists)
    got, order = tree.collect(), trees.tour_order(tree).collect()
    for t in ("kmer", "unitig"):
        edges = plain_tree([r for r in rows if r[0] == t], n)
        assert {(r.i, r.j, r.dist) for r in got if r.type == t} == edges
        assert [r.column for r in sorted(order, key=lambda r: r.pos) if r.type == t] == walked(edges, n)


def test_one_column_has_no_tree(spark):
    _, dists, columns = drawn(spark, 1, 1, 1)
    dists = dists.where("false")
    assert trees.spanning_tree(dists).count() == 0 and trees.tour_order(trees.spanning_tree(dists)).count() == 0
    merges, leaves = trees.average_linkage(dists, columns)
    assert merges.count() == 0 and leaves.count() == 0


def plain_linkage(rows, n):
    """One merge at a time."""
    d = {frozenset((i, j)): x for _, i, j, x in rows}
    members, merges = {i: [i] for i in range(n)}, set()
    while len(members) > 1:
        height, a, b = min((d[frozenset((a, b))] / (len(members[a]) * len(members[b])), a, b) for a in members for b in members if a < b)
        merges.add((a, b, len(members[a]) + len(members[b]), height))
        for c in members:
            if c not in (a, b):
                d[frozenset((a, c))] += d[frozenset((b, c))]
        members[a] += members.pop(b)
    return merges, members[0]


@pytest.mark.parametrize("n, seed, largest", [(2, 4, 3), (25, 5, 4), (60, 6, 10**6)])
def test_average_linkage(spark, n, seed, largest):
    rows, dists, columns = drawn(spark, n, seed, largest)
    merges, leaves = trees.average_linkage(dists, columns)
    merges, leaves = merges.collect(), leaves.collect()
    for t in ("kmer", "unitig"):
        want, order = plain_linkage([r for r in rows if r[0] == t], n)
        assert {(r.a, r.b, r.size, r.height) for r in merges if r.type == t} == want
        assert [r.column for r in sorted(leaves, key=lambda r: r.pos) if r.type == t] == order


def test_trees_of_the_nations(spark, sf):
    from runweave import queries

    rows = [(r.type, r.i, r.j, r.dist) for r in queries.QUERIES["distance_hybrid"](spark, sf).collect()]
    merges = queries.QUERIES["linkage_merges"](spark, sf).collect()
    scores = {(r.method, r.type): r.n_bit_changes for r in queries.QUERIES["grown_orders"](spark, sf).collect()}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        want, order = plain_linkage(own, 25)
        assert {(r.a, r.b, r.size, r.height) for r in merges if r.type == t} == {(a, b, n, round(h, 6)) for a, b, n, h in want}
        d = {(i, j): x for _, i, j, x in own}
        length = lambda o: sum(d[min(x, y), max(x, y)] for x, y in zip(o, o[1:]))  # noqa: E731, B023
        assert scores["upgma", t] == length(order) and scores["spanning", t] == length(walked(plain_tree(own, 25), 25))
