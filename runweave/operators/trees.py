"""Column orders from trees that Spark grows: least spanning trees, and average-linkage trees.

dists: (type, i, j, dist), every pair i < j of the columns of each weighting once; all weightings grow side by side. Both
trees take many merges in a round, and a round's table holds the pairs of what is left, so it shrinks with the square.
Equal distances are told apart by their columns, so a tree is always the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.steps import Steps
from .ranking import ranked


def spanning_tree(dists: DataFrame) -> DataFrame:
    """(type, i, j, dist): the n - 1 edges of the least spanning tree of each weighting, by (dist, i, j).

    Boruvka's rounds: each component takes its least edge out. Of all edges between two components only the least is
    kept on. A component's choices lead to a pair that chose each other; its lesser member names the new component.
    """
    steps = Steps(dists.sparkSession)
    now = steps.kept(dists.select("type", F.col("i").alias("a"), F.col("j").alias("b"), F.struct("dist", "i", "j").alias("e")), "edges")
    found = None
    while not now.isEmpty():
        both = now.unionByName(now.select("type", F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        least = steps.kept(both.groupBy("type", "a").agg(F.min(F.struct("e", "b")).alias("m")).select("type", "a", F.col("m.b").alias("b"), "m.e"))
        taken = least.select("type", "e.*").distinct()
        found = taken if found is None else found.unionByName(taken)
        chosen = least.select("type", "a", F.col("b").alias("to"))
        back = chosen.select("type", F.col("a").alias("to"), F.col("to").alias("again"))
        led = chosen.join(back, ["type", "to"]).withColumn("done", (F.col("again") == F.col("a")) & (F.col("a") < F.col("to")))
        x, to = F.struct("type", F.col("a").alias("c")), F.struct("type", F.col("to").alias("c"))
        roots = ranked(steps, led.select(x.alias("x"), F.when(F.col("done"), x).otherwise(to).alias("next"), (~F.col("done")).cast("long").alias("dist"), F.col("a").alias("least"), "done"))
        of = lambda c: roots.select("x.type", F.col("x.c").alias(c), F.col("next.c").alias(f"{c}_root"))
        moved = now.join(of("a"), ["type", "a"]).join(of("b"), ["type", "b"]).where("a_root <> b_root")
        pair = moved.groupBy("type", F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).agg(F.min("e").alias("e"))
        now = steps.kept(pair, "edges")
    if found is None:
        return dists.select("type", "dist", "i", "j").where("false").select("type", "i", "j", "dist")
    return steps.kept(found.distinct()).select("type", "i", "j", "dist")


def tour_order(tree: DataFrame) -> DataFrame:
    """(type, pos, column): columns in the order in which a walk around the tree (type, i, j, dist) first meets them.

    The walk starts at the least column and leaves a column by its neighbours in order, so its order is a path of at most
    twice the tree's length where distances keep the triangle's law. Steps of the walk are ranked by pointer doubling.
    """
    steps = Steps(tree.sparkSession)
    arcs = tree.select("type", F.col("i").alias("u"), F.col("j").alias("v")).unionByName(tree.select("type", F.col("j").alias("u"), F.col("i").alias("v")))
    own = Window.partitionBy("type", "u").orderBy("v")
    first = F.first("v").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    leaving = arcs.select("type", "u", "v", F.coalesce(F.lead("v").over(own), first).alias("after"))
    # who comes from v to u goes on from u to the neighbour after v
    roots = arcs.groupBy("type").agg(F.min("u").alias("root"))
    start = leaving.join(roots.withColumnRenamed("root", "u"), ["type", "u"]).groupBy("type", "u").agg(F.min("v").alias("v0")).select("type", F.col("u").alias("u0"), "v0")
    arc = lambda u, v: F.struct("type", F.col(u).alias("u"), F.col(v).alias("v"))
    walk = leaving.join(start, "type").select(arc("v", "u").alias("x"), arc("u", "after").alias("to"), ((F.col("u") == F.col("u0")) & (F.col("after") == F.col("v0"))).alias("done"), F.col("u").alias("least"))
    ranks = ranked(steps, walk.select("x", F.when(F.col("done"), F.col("x")).otherwise(F.col("to")).alias("next"), (~F.col("done")).cast("long").alias("dist"), "least", "done"))
    met = ranks.groupBy("x.type", F.col("x.v").alias("column")).agg(F.max("dist").alias("dist")).join(roots, "type")
    # the root is met before any step
    by = F.row_number().over(Window.partitionBy("type").orderBy(F.desc(F.when(F.col("column") == F.col("root"), F.lit((1 << 62))).otherwise(F.col("dist")))))
    return steps.kept(met.select("type", (by - 1).alias("pos"), "column"))


def average_linkage(dists: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merges (type, a, b, size, height) and leaves (type, pos, column) of the average-linkage tree of each weighting.

    columns: (column). Clusters are called by their least column; a < b, the merged one is called a and keeps the leaves
    of a before those of b. height is the average distance of the members of a and b. In a round all clusters that are each
    other's nearest merge at once: average linkage never brings a cluster nearer to a third one than both of its parts were,
    so later merges don't touch them, and the tree is that of one merge at a time. Distances of clusters are kept as whole
    sums, which joins add up; nearest by (average, a, b). Rounds are few unless clusters grow one column at a time.
    """
    steps = Steps(dists.sparkSession)
    now = steps.kept(dists.select("type", F.col("i").alias("a"), F.col("j").alias("b"), F.col("dist").alias("sum")), "sums")
    types = now.select("type").distinct()
    leaves = steps.kept(types.crossJoin(columns).select("type", "column", F.col("column").alias("c"), F.lit(0).cast("long").alias("pos")), "leaves")
    sizes = steps.kept(leaves.select("type", "c", F.lit(1).cast("long").alias("size")), "sizes")
    merges = None
    while not now.isEmpty():
        size = lambda c: sizes.select("type", F.col("c").alias(c), F.col("size").alias(f"{c}_size"))  # noqa: B023, E731
        pairs = now.join(size("a"), ["type", "a"]).join(size("b"), ["type", "b"]).select("type", F.struct((F.col("sum") / (F.col("a_size") * F.col("b_size"))).alias("height"), "a", "b").alias("p"), "a_size", "b_size")
        near = pairs.select("type", F.explode(F.array("p.a", "p.b")).alias("c"), "p", "a_size", "b_size").groupBy("type", "c").agg(F.min(F.struct("p", "a_size", "b_size")).alias("m"))
        new = steps.kept(near.groupBy("type", "m").agg(F.count("*").alias("n")).where("n = 2").select("type", "m.p.a", "m.p.b", "m.a_size", "m.b_size", "m.p.height"))
        told = new.select("type", "a", "b", (F.col("a_size") + F.col("b_size")).alias("size"), "height")
        merges = told if merges is None else merges.unionByName(told)
        joined = new.select("type", F.col("b").alias("c"), F.col("a").alias("into"), F.col("a_size").alias("shift"))
        leaves = steps.kept(leaves.join(joined, ["type", "c"], "left").select("type", "column", F.coalesce("into", "c").alias("c"), (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos")), "leaves")
        grown = sizes.join(joined.select("type", "c", "into"), ["type", "c"], "left").groupBy("type", F.coalesce("into", "c").alias("c")).agg(F.sum("size").alias("size"))
        to = lambda c: joined.select("type", F.col("c").alias(c), F.col("into").alias(f"{c}_into"))  # noqa: B023, E731
        moved = now.join(to("a"), ["type", "a"], "left").join(to("b"), ["type", "b"], "left").select("type", F.coalesce("a_into", "a").alias("a"), F.coalesce("b_into", "b").alias("b"), "sum").where("a <> b")
        sums = moved.groupBy("type", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("sum").alias("sum"))
        now, sizes = steps.kept(sums, "sums"), steps.kept(grown, "sizes")
    if merges is None:
        merges = dists.sparkSession.createDataFrame([], "type string, a int, b int, size long, height double")
    return merges, leaves.select("type", "pos", "column")
