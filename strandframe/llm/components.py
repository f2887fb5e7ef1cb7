"""Connected groups over pairwise links, by contraction.

1. Rake: vertices of degree one are taken off and remembered with their neighbour.
2. Compress: chains of degree-two vertices are ranked as lists by pointer doubling and replaced by one edge between the
   chain's ends. A vertex with the least hash among its neighbours stays as an end, so that rings are lists too.
   Both repeat while they take off a fair part of the vertices.
3. The reduced core is contracted: every vertex hooks onto its smallest neighbour, trees collapse, edges are renamed.
4. Every removed vertex gets the label of what it was attached to, by doubling over the remembered parents.

All state is in checkpointed tables; the driver sees counts only. Joins run on edges or, where a hub may hold a large
part of the rows, through ``skew_join``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.session import SMALL_ROWS, cut, drop, is_empty, n_rows, n_where, sized, skew_join

#: Rake and compress go on while a round removes at least this share of the vertices.
GOING_ON = 0.05


def links(pairs: DataFrame, a: str, b: str, missing: int = -1) -> DataFrame:
    """Distinct undirected edges (u < v) of the pairs; nulls, ``missing`` and self pairs are no links."""
    x, y = F.col(a), F.col(b)
    ok = x.isNotNull() & y.isNotNull() & (x != missing) & (y != missing) & (x != y)
    return pairs.where(ok).select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct()


def _edge(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _degrees(edges: DataFrame) -> DataFrame:
    """(x, deg, lo, hi): degree, smallest and largest neighbour; for degree two these are both neighbours."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    return both.groupBy("x").agg(F.count("y").alias("deg"), F.min("y").alias("lo"), F.max("y").alias("hi"))


def rake(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(edges left, removed (x, parent), their number). Of an edge between two leaves the smaller vertex stays."""
    leaf = _degrees(edges).where("deg = 1").select("x", *_edge(F.col("x"), F.col("lo")))
    gone = cut(leaf.groupBy("u", "v").agg(F.max("x").alias("x")))
    removed = gone.select("x", F.when(F.col("x") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("parent"))
    if is_empty(gone):
        return edges, removed, 0
    return cut(edges.join(gone.select("u", "v"), ["u", "v"], "left_anti")), removed, n_rows(gone)


def compress(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame, int]:
    """(edges left, removed (x, parent), their number): list ranking of the degree-two chains between kept vertices."""

    def h(c: str) -> Column:
        return F.xxhash64(F.col(c), F.lit(salt))

    inner = cut(_degrees(edges).where("deg = 2").where(~((h("x") < h("lo")) & (h("x") < h("hi")))).select("x", "lo", "hi"))
    if is_empty(inner):
        return edges, inner.select("x", F.col("lo").alias("parent")), 0
    arcs = inner.select("x", F.col("lo").alias("y")).union(inner.select("x", F.col("hi").alias("y")))
    other = inner.select(F.col("x").alias("y"), "lo", "hi")
    ahead = F.when(F.col("x") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    # an arc x -> y walks on while y is an inner vertex: (nx, ny) is the arc it has come to, end the kept vertex at last;
    # y may be a hub that very many chains lead to
    first = skew_join(sized(arcs, 2 * n_rows(inner)), other, ["y"], "left")
    active = cut(first.select("x", "y", F.when(F.col("lo").isNull(), F.col("y")).alias("end"), F.when(F.col("lo").isNotNull(), F.col("y")).alias("nx"), F.when(F.col("lo").isNotNull(), ahead).alias("ny")), open=F.col("end").isNull())
    done: list[DataFrame] = []
    while True:
        done.append(active.where("end is not null").select("x", "y", "end"))
        if not n_where(active, "open"):
            break
        open_arcs = active.where("end is null").select("x", "y", "nx", "ny")
        none = F.lit(None).cast(edges.schema["u"].dataType)
        on = reduce(DataFrame.unionByName, [d.select("x", "y", "end", none.alias("nx"), none.alias("ny")) for d in done]).unionByName(open_arcs.withColumn("end", none))
        on = on.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("end").alias("e2"), F.col("nx").alias("nx2"), F.col("ny").alias("ny2"))
        once = open_arcs.join(on, ["nx", "ny"]).select("x", "y", "e2", F.col("nx2").alias("nx"), F.col("ny2").alias("ny"))
        # a walk that has ended has no arc to go on from
        twice = once.select("x", "y", F.col("e2").alias("end"), "nx", "ny").join(on, ["nx", "ny"], "left")
        active = cut(twice.select("x", "y", F.coalesce("end", "e2").alias("end"), F.col("nx2").alias("nx"), F.col("ny2").alias("ny")), open=F.col("end").isNull())
    walked = reduce(DataFrame.unionByName, done)
    ends = cut(walked.groupBy("x").agg(F.min("end").alias("parent"), F.max("end").alias("far")))
    rest = edges.join(walked.select(*_edge(F.col("x"), F.col("y"))).distinct(), ["u", "v"], "left_anti")
    bridged = ends.where("parent < far").select(F.col("parent").alias("u"), F.col("far").alias("v"))
    return cut(rest.union(bridged).distinct()), ends.select("x", "parent"), n_rows(ends)


def collapse(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One contraction of the core: (edges left, removed (x, parent)) with every parent a root of this round."""
    hook = cut(_degrees(edges).select("x", F.least("x", "lo").alias("parent")))
    while True:
        moved = cut(climb(hook), moved=F.col("parent") != F.col("below"))
        drop(hook)
        hook = moved
        if not n_where(moved, "moved"):
            break
    n = n_rows(edges)
    for end in ("u", "v"):
        name = hook.select(F.col("x").alias(end), F.col("parent").alias("to"))
        edges = skew_join(edges, name, [end]).drop(end).withColumnRenamed("to", end)
        edges = sized(edges, n) if n < SMALL_ROWS else cut(edges)
    left = cut(edges.where("u != v").select(*_edge(F.col("u"), F.col("v"))).distinct())
    return left, hook.where("x != parent").select("x", "parent")


def climb(tree: DataFrame, hops: int = 3) -> DataFrame:
    """(x, parent, below): every vertex ``hops`` ancestors further up a table (x, parent), and the ancestor before that.

    A parent without a row of its own is a root. Roots of large trees are keys with very many rows."""
    n = n_rows(tree)
    rows = tree.select("x", "parent", F.col("parent").alias("below"))
    up = tree.select(F.col("x").alias("parent"), F.col("parent").alias("top"))
    for _ in range(hops):
        rows = sized(rows, n) if n < SMALL_ROWS else cut(rows)
        rows = skew_join(rows, up, ["parent"], "left").select("x", F.coalesce("top", "parent").alias("parent"), F.col("parent").alias("below"))
    return rows


def groups(edges: DataFrame) -> DataFrame:
    """(x, group_id) for every vertex of the distinct edges (u < v); group_id is the smallest vertex of its group.

    No edges give an empty table."""
    edges = cut(edges.select("u", "v"))
    kind = edges.schema["u"].dataType
    removed: list[DataFrame] = []
    salt = 0
    while not is_empty(edges):
        n, gone = n_rows(edges), 0
        for act in (rake, lambda e: compress(e, salt)):
            if is_empty(edges):
                break
            last = edges
            edges, off, k = act(edges)
            gone += k
            if k:
                removed.append(off)
                drop(last)
        salt += 1
        if gone < GOING_ON * n:
            break
    while not is_empty(edges):
        last = edges
        edges, off = collapse(edges)
        removed.append(off)
        drop(last)
    if not removed:
        return edges.select(F.col("u").alias("x"), F.col("v").alias("group_id"))
    tree = cut(reduce(DataFrame.union, removed).select(F.col("x").cast(kind).alias("x"), F.col("parent").cast(kind).alias("parent")))
    while True:  # a parent is removed later than its child if at all, so paths are no longer than the number of removals
        last, tree = tree, cut(climb(tree), moved=F.col("parent") != F.col("below"))
        drop(last)
        if not n_where(tree, "moved"):
            break
    tree = sized(tree.select("x", "parent"), n_rows(tree))
    members = cut(tree.unionByName(tree.select("parent").distinct().select(F.col("parent").alias("x"), "parent")))
    least = members.groupBy("parent").agg(F.min("x").alias("group_id"))
    return skew_join(members, least, ["parent"]).select("x", "group_id")
