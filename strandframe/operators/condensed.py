"""Reductions of the condensed graph as tables, and searches that need a whole part of it at once, cluster by cluster.

Edges are (in_node, out_node, len, score) between ``read:B`` and ``read:E``; every result is closed under mirrors. Forks, tips,
crossings, bridges and covered branches are told by the edges around a node, so they are joins and windows. Superbubbles are
popped on plain adjacency, but only among the edges that one can hold; for ``bubbles`` and ``flows`` one connected cluster of
reads at a time is searched.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.graph import EDGE, _with_mirrors, degrees, loops, remaining, unitigs
from strandframe.operators.pathgraph import PathGraph
from strandframe.session import cut, drop, is_empty, n_rows, n_where, sized, skew_join

#: Reductions of the condensed graph when none are asked for.
STRATEGY = "transitive|spur|duplicate|cross|bridge|bubble:s=1|bridge|bubble:s=0|spur|loop|semi"
#: Steps and open nodes of the search for superbubbles, see ``PathGraph.bubble``.
DEPTH, WIDTH = 50, 10
#: Edges that are searched for bubbles in one task without a look for connected parts.
PART_ROWS = 100_000
#: The most ways out of a node that are compared as a set.
SET_WAYS = 100


def _around(edges: DataFrame, node: str, side: str) -> DataFrame:
    """Edges with the degrees of the node on one side: ``{side}_in`` and ``{side}_out``."""
    d = degrees(edges).select(F.col("node").alias(node), F.col("n_in").alias(f"{side}_in"), F.col("n_out").alias(f"{side}_out"))
    return edges.join(d, node)


def tips(edges: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Edges from a node without a way in and with one way out that are shorter by ``ratio`` than the longest way into the same
    node."""
    longest = F.max("len").over(Window.partitionBy("out_node"))
    rows = _around(edges, "in_node", "u").withColumn("_top", longest)
    return _with_mirrors(rows.where((F.col("u_in") == 0) & (F.col("u_out") == 1) & (F.col("len") * ratio <= F.col("_top"))), "spur")


def semi(edges: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Dead ends at a fork that are shorter by ``ratio`` than the longest branch with what follows it."""
    on = edges.groupBy(F.col("in_node").alias("out_node")).agg(F.max("len").alias("_on"))
    rows = _around(_around(edges, "in_node", "u"), "out_node", "v").join(on, "out_node", "left")
    top = F.max(F.col("len") + F.coalesce("_on", F.lit(0))).over(Window.partitionBy("in_node"))
    return _with_mirrors(rows.withColumn("_top", top).where((F.col("u_out") > 1) & (F.col("v_out") == 0) & (F.col("v_in") == 1) & (F.col("len") * ratio <= F.col("_top"))), "semi")


def _best_other(side: str) -> Column:
    """The best score of the other edges at the node on one side; null if there is none."""
    w = Window.partitionBy(side).orderBy(F.col("score").desc(), *[c for c in EDGE if c != side])
    return F.when(F.row_number().over(w) == 1, F.lead("score").over(w)).otherwise(F.first("score").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def bridges(edges: DataFrame, factor: float = 2.0) -> DataFrame:
    """Edges between a fork and a join whose nodes both have another edge with a score larger by ``factor``."""
    rows = edges.where("score is not null").withColumn("_o", _best_other("in_node")).withColumn("_i", _best_other("out_node"))
    s = F.col("score") * factor
    return _with_mirrors(rows.where((F.col("_o") >= s) & (F.col("_i") >= s)), "bridge")


def crossings(edges: DataFrame) -> DataFrame:
    """(a, b, x, y, straight, crossed): two nodes with the same two ways out, a < b and x < y, that are the only ways into them;
    the scores of a-x with b-y and of a-y with b-x."""
    outs = edges.groupBy("in_node").agg(F.count(F.lit(1)).alias("_no"), F.min("out_node").alias("x"), F.max("out_node").alias("y")).where("_no = 2")
    ins = edges.groupBy("out_node").agg(F.count(F.lit(1)).alias("_ni"), F.min("in_node").alias("a"), F.max("in_node").alias("b")).where("_ni = 2")
    rows = edges.join(outs, "in_node").join(ins, "out_node")
    straight = (F.col("in_node") == F.col("a")) == (F.col("out_node") == F.col("x"))
    s = F.coalesce("score", F.lit(0))
    got = rows.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(straight, s).otherwise(0)).alias("straight"), F.sum(F.when(straight, 0).otherwise(s)).alias("crossed"))
    return got.where("n = 4").drop("n")


def crosses(edges: DataFrame, factor: float = 2.0) -> DataFrame:
    """The weaker pair of ways through every crossing whose other pair has a score larger by ``factor``."""
    c = crossings(edges)
    pair = lambda p, q: F.struct(F.col(p).alias("in_node"), F.col(q).alias("out_node"))
    weak = F.when(F.col("straight") >= F.col("crossed") * factor, F.array(pair("a", "y"), pair("b", "x"))).when(F.col("crossed") >= F.col("straight") * factor, F.array(pair("a", "x"), pair("b", "y")))
    return _with_mirrors(c.select(F.explode(weak).alias("_e")).select("_e.*"), "cross")


def duplicates(edges: DataFrame) -> DataFrame:
    """Of paths of one or two edges between the same nodes, with inner nodes on no other path, all but the best score falls; of
    equal ones the longer, then the smaller inner node, stays."""
    line = degrees(edges).where("n_in = 1 and n_out = 1").select("node")
    first = edges.select("in_node", F.col("out_node").alias("node"), F.col("len").alias("_l"), F.col("score").alias("_s")).join(line, "node")
    two = first.join(edges.select(F.col("in_node").alias("node"), "out_node", "len", "score"), "node").where("in_node != out_node")
    paths = edges.select(*EDGE, F.lit(None).cast("string").alias("node"), "len", "score").unionByName(two.select(*EDGE, "node", (F.col("len") + F.col("_l")).alias("len"), F.least("score", "_s").alias("score")))
    w = Window.partitionBy(*EDGE).orderBy(F.col("score").desc_nulls_last(), F.col("len").desc(), F.col("node").asc_nulls_first())
    gone = paths.withColumn("_r", F.row_number().over(w)).where("_r > 1")
    parts = F.when(F.col("node").isNull(), F.array(F.struct("in_node", "out_node"))).otherwise(F.array(F.struct("in_node", F.col("node").alias("out_node")), F.struct(F.col("node").alias("in_node"), "out_node")))
    return _with_mirrors(gone.select(F.explode(parts).alias("_e")).select("_e.*"), "duplicate")


def back_edges(edges: DataFrame) -> DataFrame:
    """The weaker edge of two that lead to each other; of equal ones the one back from the larger node."""
    both = loops(edges).select("in_node", "out_node")
    there = edges.select(*EDGE, F.coalesce("score", F.lit(0)).alias("_s")).join(both, EDGE)
    back = edges.select(F.col("out_node").alias("in_node"), F.col("in_node").alias("out_node"), F.coalesce("score", F.lit(0)).alias("_t"))
    rows = there.join(back, EDGE)
    weak = F.when(F.col("_s") >= F.col("_t"), F.struct(F.col("out_node").alias("in_node"), F.col("in_node").alias("out_node"))).otherwise(F.struct("in_node", "out_node"))
    return _with_mirrors(rows.select(weak.alias("_e")).select("_e.*"), "loop")


def clusters(edges: DataFrame) -> DataFrame:
    """(read, cluster): the smallest read linked to a read directly or through others.

    Reads take the least label around them and then their label's label, until nothing moves; the number of rounds grows with
    the logarithm of a cluster's width. Hubs are joined as heavy keys."""
    name = lambda c: F.expr(f"substring({c}, 1, length({c}) - 2)")
    links = cut(edges.select(name("in_node").alias("u"), name("out_node").alias("v")).where("u != v").distinct())
    both = cut(links.union(links.select("v", "u")).distinct())
    alone = edges.select(F.explode(F.array(name("in_node"), name("out_node"))).alias("v")).distinct()
    label = cut(alone.select("v", F.col("v").alias("l")))
    while True:
        near = skew_join(both, label.select("v", "l"), ["v"]).groupBy(F.col("u").alias("v")).agg(F.min("l").alias("m"))
        lower = sized(label.join(near, "v", "left").select("v", F.col("l").alias("was"), F.least("l", "m").alias("l")), n_rows(label))
        up = label.select(F.col("v").alias("l"), F.col("l").alias("top"))
        moved = cut(skew_join(cut(lower), up, ["l"], "left").select("v", "was", F.least("l", "top").alias("l")), moved=F.col("l") != F.col("was"))
        drop(label)
        label = moved
        if not n_where(moved, "moved"):
            return label.select(F.col("v").alias("read"), F.col("l").alias("cluster"))


def by_cluster(edges: DataFrame, run: Callable[[PathGraph], list[tuple]], schema: str) -> DataFrame:
    """``run`` on the graph of every cluster; rows of ``schema``."""
    part = clusters(edges).withColumnRenamed("read", "_r")
    rows = edges.withColumn("_r", F.expr("substring(in_node, 1, length(in_node) - 2)")).join(part, "_r").drop("_r")
    columns = [c.split()[0] for c in schema.split(", ")]

    def each(p: pd.DataFrame) -> pd.DataFrame:
        g = PathGraph(zip(p["in_node"], p["out_node"], p["len"].astype("int64"), p["score"].fillna(0).astype("float64"), strict=True), mirror=lambda n: n[:-1] + ("E" if n[-1] == "B" else "B"))
        return pd.DataFrame(run(g), columns=columns)

    return rows.select("cluster", *EDGE, "len", "score").groupBy("cluster").applyInPandas(each, schema)


def bubbles(edges: DataFrame) -> DataFrame:
    """(in_node, out_node, inner, paths): superbubbles with their inner nodes and the paths through them, at most ten a way out."""
    return by_cluster(edges, lambda g: [(s, t, len(inner), len(g.all_paths(s, t, inner))) for s, t, inner in g.bubbles()], "in_node string, out_node string, inner int, paths int")


def flows(edges: DataFrame) -> DataFrame:
    """(in_node, out_node, paths, shortest): of every superbubble the edge-disjoint paths through it and the bases of the
    shortest one."""

    def run(g: PathGraph) -> list[tuple]:
        out = []
        for s, t, inner in g.bubbles():
            way = g.shortest(s, t, within=inner) or []
            out.append((s, t, len(g.disjoint_paths(s, t)), sum(g.length[e] for e in zip(way, way[1:], strict=False))))
        return out

    return by_cluster(edges, run, "in_node string, out_node string, paths int, shortest long")


def _score() -> Column:
    """The score as it is compared: missing ones as 0."""
    return F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(None)), F.lit(0.0))


def contig_paths(edges: DataFrame, method: str = "best") -> DataFrame:
    """(first, last, nodes, bases) of contig paths: unbranched ones (``no``), or extended by the best edge both ways agree on
    (``best``); each node is on one path, rings begin at their smallest node.

    An edge that is the best at both its ends is the only such one there, so the paths are those of a graph without forks."""
    s = edges.select(*EDGE, F.coalesce(F.col("len").cast("long"), F.lit(0)).alias("len"), _score().alias("_s"))
    on = s.groupBy("in_node").agg(F.max_by(F.struct("out_node", "len"), F.struct("_s", "out_node")).alias("_e"), F.count(F.lit(1)).alias("_no")).select("in_node", "_e.*", "_no")
    back = s.groupBy("out_node").agg(F.max_by("in_node", F.struct("_s", "in_node")).alias("in_node"), F.count(F.lit(1)).alias("_ni"))
    both = on.join(back, EDGE).where("in_node != out_node")
    links = cut((both.where("_no = 1 and _ni = 1") if method == "no" else both).select(*EDGE, "len"))
    rows = links.join(unitigs(links), EDGE).groupBy("unitig")
    # of a ring the edge into its smallest node is left out
    ends = rows.agg(F.min_by("in_node", "place").alias("a"), F.max_by("out_node", "place").alias("z"), F.count(F.lit(1)).alias("n"), F.sum("len").alias("all"), F.min("out_node").alias("low"), F.min_by(F.struct("in_node", "len"), "out_node").alias("cut"))
    ring = F.col("a") == F.col("z")
    return ends.select(
        F.when(ring, F.col("low")).otherwise(F.col("a")).alias("first"), F.when(ring, F.col("cut.in_node")).otherwise(F.col("z")).alias("last"),
        (F.col("n") + F.when(ring, 0).otherwise(1)).cast("int").alias("nodes"), (F.col("all") - F.when(ring, F.col("cut.len")).otherwise(0)).alias("bases"),
    )


def _covered(edges: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Edges to a node all of whose ways out a better sibling has as well; of those to ``changed`` (node) alone, if given.

    Siblings with the same ways out are compared at once, and only the best of them with others. Others are looked for at the
    rarest of the ways out or among the siblings, whichever are fewer, so two hubs are not multiplied."""
    into = edges.groupBy("out_node").agg(F.count(F.lit(1)).alias("_ni"))
    forks = edges.groupBy("in_node").agg(F.count(F.lit(1)).alias("_no")).where("_no > 1").select("in_node")
    if changed is not None:
        forks = forks.join(edges.join(changed.select(F.col("node").alias("out_node")), "out_node", "left_semi").select("in_node"), "in_node", "left_semi")
    ways = edges.join(forks, "in_node", "left_semi").select(F.col("in_node").alias("n"), F.col("out_node").alias("w"), _score().alias("s"))
    ways = cut(ways)
    if is_empty(ways):
        return edges.select(*EDGE).where("false")
    ends = edges.join(ways.select(F.col("w").alias("in_node")).distinct(), "in_node", "left_semi").join(into, "out_node").select(F.col("in_node").alias("w"), F.col("out_node").alias("e"), "_ni")
    # large sets of ways out are rare and stand for themselves
    sets = ends.groupBy("w").agg(F.count(F.lit(1)).alias("d"), F.min(F.struct("_ni", "e")).alias("_p"))
    few = ends.join(sets.where(F.col("d") <= SET_WAYS).select("w"), "w", "left_semi").groupBy("w").agg(F.sort_array(F.collect_list("e")).alias("_set"))
    same = few.select("w", F.min("w").over(Window.partitionBy("_set")).alias("c"))
    info = sets.join(same, "w", "left").select("w", "d", F.col("_p._ni").alias("p_in"), F.col("_p.e").alias("p"), F.coalesce("c", "w").alias("c"))
    order = F.row_number().over(Window.partitionBy("n", "c").orderBy(F.col("s").desc(), F.col("w").desc()))
    ranked = cut(ways.join(info, "w").repartition("n").withColumn("_r", order).withColumn("k", F.count_if(F.col("_r") == 1).over(Window.partitionBy("n"))))
    fallen = ranked.where("_r > 1").select("n", "w")
    top = ranked.where("_r = 1 and k > 1").select("n", "w", "s", "d", "p", "p_in", "k")
    ask = top if changed is None else top.join(changed.select(F.col("node").alias("w")), "w", "left_semi")
    x = top.select("n", F.col("w").alias("x"), F.col("s").alias("xs"), F.col("d").alias("xd"))
    better = "xd >= d and x != w and (xs > s or (xs = s and x > w))"
    there = ask.where("p_in <= k").join(edges.select(F.col("in_node").alias("x"), F.col("out_node").alias("p")), "p").join(x, ["n", "x"]).where(better)
    among = ask.where("p_in > k").join(x, "n").where(better)
    found = cut(there.select("n", "w", "x", "d").unionByName(among.select("n", "w", "x", "d")))
    if is_empty(found):
        return fallen.select(F.col("n").alias("in_node"), F.col("w").alias("out_node"))
    e = edges.select(F.col("in_node").alias("x"), F.col("out_node").alias("e"))
    shared = found.select("w", "x", "d").distinct().join(e.withColumnRenamed("x", "w"), "w").join(e, ["x", "e"])
    whole = shared.groupBy("w", "x", "d").agg(F.count(F.lit(1)).alias("_n")).where("_n = d").select("w", "x")
    fallen = fallen.unionByName(found.join(whole, ["w", "x"]).select("n", "w"))
    return fallen.select(F.col("n").alias("in_node"), F.col("w").alias("out_node"))


def covered_branches(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Branches whose ends are all ends of a better sibling as well, repeated while any falls.

    After the first round only nodes that lost a way out can have become covered, so the later ones look at those."""
    gone, changed = None, None
    for _ in range(rounds):
        off = cut(_with_mirrors(_covered(edges, changed), "transitive").join(edges.select(*EDGE), EDGE, "left_semi"))
        gone = off if gone is None else gone.unionByName(off)
        if is_empty(off):
            break
        edges, changed = cut(remaining(edges, off)), off.select(F.col("in_node").alias("node")).distinct()
    return gone


def _bubble_parts(edges: DataFrame) -> DataFrame:
    """Edges that a superbubble can hold, with the degrees of their nodes: part, in_node, out_node, len, score, u_out, v_in.

    A bubble has all ways out of its start and all ways in and out of its inner nodes, so an edge that can't be in one takes
    those that share a node on the same side with it along. Starts have two ways out and ends two ways in at least; the search
    opens at most WIDTH nodes and sees DEPTH * WIDTH. That is asked again until few edges are left or none falls; what is
    left then is put into connected parts, where a node that can't be inner does not connect."""
    rows = _around(_around(edges, "in_node", "u"), "out_node", "v").where((F.col("u_out") <= WIDTH) & (F.col("v_in") <= DEPTH * WIDTH))
    rows = cut(rows.select(*EDGE, "len", "score", "u_out", "v_in"))
    while n_rows(rows) > PART_ROWS:
        deg = degrees(rows)
        u, v = (deg.select(F.col("node").alias(n), F.col("n_in").alias(f"_{s}i"), F.col("n_out").alias(f"_{s}o")) for n, s in (("in_node", "u"), ("out_node", "v")))
        kept = rows.join(u, "in_node").join(v, "out_node").where("_uo = u_out and _vi = v_in and not (_ui = 0 and u_out = 1) and not (_vo = 0 and v_in = 1)")
        last, rows = rows, cut(kept.select(*rows.columns))
        drop(last)
        if n_rows(rows) == n_rows(last):
            break
    if n_rows(rows) <= PART_ROWS:
        return rows.withColumn("part", F.lit(""))
    deg = degrees(rows).where("n_in > 0 and n_out > 0").select("node")
    inner = lambda n: deg.select(F.col("node").alias(n), F.lit(True).alias("_both"))
    named = lambda n, to: F.when(F.col("_both"), F.concat(F.lit("="), n)).otherwise(F.concat(F.lit(to), n))
    rows = rows.join(inner("in_node"), "in_node", "left").withColumn("_u", named("in_node", ">")).drop("_both")
    rows = cut(rows.join(inner("out_node"), "out_node", "left").withColumn("_v", named("out_node", "<")).drop("_both"))
    links = rows.select(F.concat("_u", F.lit(":B")).alias("in_node"), F.concat("_v", F.lit(":B")).alias("out_node"))
    part = clusters(links).select(F.col("read").alias("_u"), F.col("cluster").alias("part"))
    return rows.join(part, "_u").drop("_u", "_v")


def popped(edges: DataFrame, clear: bool = False) -> DataFrame:
    """Edges of superbubbles that are not on the path with the best score, see ``PathGraph.pop_bubbles``."""

    def each(p: pd.DataFrame) -> pd.DataFrame:
        while len(p):
            # as in _bubble_parts, until none falls
            o, i = p["in_node"].value_counts(), p["out_node"].value_counts()
            whole = (p["in_node"].map(o) == p["u_out"]) & (p["out_node"].map(i) == p["v_in"])
            whole &= ((p["u_out"] > 1) | p["in_node"].isin(i.index)) & ((p["v_in"] > 1) | p["out_node"].isin(o.index))
            if whole.all():
                break
            p = p[whole]
        g = PathGraph(zip(p["in_node"], p["out_node"], p["len"].fillna(0).astype("int64"), p["score"].fillna(0).astype("float64"), strict=True))
        return pd.DataFrame([(s, t, u, v) for s, t, gone in g.bubble_ways(clear) for u, v in gone], columns=["s", "t", *EDGE])

    found = _bubble_parts(edges).groupBy("part").applyInPandas(each, "s string, t string, in_node string, out_node string")
    back = edges.select(F.col("in_node").alias("t"), F.col("out_node").alias("s"))
    return _with_mirrors(found.join(back, ["s", "t"], "left_anti"), "bubble")


def simplify(edges: DataFrame, strategy: str = STRATEGY) -> tuple[DataFrame, DataFrame]:
    """(edges left, reduced with reasons) after the steps of ``name:key=value|name|...``, in order.

    spur, semi (ratio r), bridge, cross (factor f), duplicate, loop, transitive, bubble (s=1: clear ones only, whose ways
    through share no edge)."""
    known = {
        "spur": lambda e, p: tips(e, float(p.get("r", 2))),
        "semi": lambda e, p: semi(e, float(p.get("r", 2))),
        "bridge": lambda e, p: bridges(e, float(p.get("f", 2))),
        "cross": lambda e, p: crosses(e, float(p.get("f", 2))),
        "duplicate": lambda e, p: duplicates(e),
        "loop": lambda e, p: back_edges(e),
        "transitive": lambda e, p: covered_branches(e),
        "bubble": lambda e, p: popped(e, p.get("s", "0") == "1"),
    }
    edges, gone = cut(edges), None
    for part in filter(None, strategy.split("|")):
        name, *params = part.split(":")
        if name not in known:
            raise ValueError(f"unknown step: {name}")
        off = cut(known[name](edges, dict(p.split("=", 1) for p in params)).join(edges.select(*EDGE), EDGE, "left_semi"))
        if n_rows(off):
            last, edges = edges, cut(remaining(edges, off))
            drop(last)
        gone = off if gone is None else gone.unionByName(off)
    return edges, gone if gone is not None else edges.select(*EDGE, F.lit("").alias("reason")).where("false")
