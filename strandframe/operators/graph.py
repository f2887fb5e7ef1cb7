"""Overlap graphs as tables of directed edges (in_node, out_node, len, score).

A node is a read's end, ``name:B`` or ``name:E``. The graph is skew symmetric: the mirror of u -> v is rev(v) -> rev(u),
where rev swaps B and E; every reduction is closed under mirrors. Nothing is deleted: reductions are returned as
(in_node, out_node, reason), and the remaining edges are an anti join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.overlap import LEFT, RIGHT, location
from strandframe.operators.pairs import triangles
from strandframe.session import cut, is_empty, n_rows, n_where, sized

EDGE = ["in_node", "out_node"]


def rev(node: Column) -> Column:
    """The other end of the same read."""
    head = F.substring(node, F.lit(1), F.length(node) - 1)
    return F.concat(head, F.when(F.endswith(node, F.lit("B")), "E").otherwise("B"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges together with their mirrors, one row per pair of nodes; of two values the larger."""
    rest = [c for c in edges.columns if c not in EDGE]
    both = edges.select(*EDGE, *rest).union(edges.select(rev(F.col("out_node")), rev(F.col("in_node")), *rest))
    return both.groupBy(*EDGE).agg(*[F.max(c).alias(c) for c in rest])


def string_edges(overlaps: DataFrame, err: int = 0) -> DataFrame:
    """Two mirrored edges for the best proper overlap of every unordered pair: in_node, out_node, len (bases of the out
    read beyond the overlap) and score (aligned length)."""
    n = F.expr("(a_end - a_start + b_end - b_start) div 2")
    loc = location(err)
    w = Window.partitionBy(F.least("a_id", "b_id"), F.greatest("a_id", "b_id")).orderBy(n.desc(), "ol_id")
    one = overlaps.where(loc.isin(LEFT, RIGHT) & (F.col("a_id") != F.col("b_id"))).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    same, left = F.col("a_strand") == F.col("b_strand"), F.when(F.col("a_strand") == F.col("b_strand"), loc == LEFT).otherwise(loc == RIGHT)

    def node(read: str, end: Column) -> Column:
        return F.concat(F.col(read).cast("string"), F.lit(":"), end)

    # a's right end goes on into b where b lies behind it, else a's left end does
    a_end = F.when(left, "E").otherwise("B")
    b_far = F.when(left == same, "E").otherwise("B")
    b_len = F.when(b_far == "E", F.col("b_len") - F.col("b_end")).otherwise(F.col("b_start"))
    a_far = F.when(left, "B").otherwise("E")
    a_len = F.when(left, F.col("a_start")).otherwise(F.col("a_len") - F.col("a_end"))
    b_near = F.when(b_far == "E", "B").otherwise("E")
    out = F.struct(node("a_id", a_end).alias("in_node"), node("b_id", b_far).alias("out_node"), b_len.alias("len"))
    back = F.struct(node("b_id", b_near).alias("in_node"), node("a_id", a_far).alias("out_node"), a_len.alias("len"))
    return one.select(F.explode(F.array(out, back)).alias("_e"), n.alias("score")).select("_e.*", "score")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_out, n_in) of every node."""
    ends = F.array(F.struct(F.col("in_node").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("out_node").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return edges.select(F.explode(ends).alias("_n")).groupBy("_n.node").agg(F.sum("_n.o").alias("n_out"), F.sum("_n.i").alias("n_in"))


def remaining(edges: DataFrame, reduced: DataFrame) -> DataFrame:
    return edges.join(reduced.select(*EDGE).distinct(), EDGE, "left_anti")


def _with_mirrors(reduced: DataFrame, reason: str) -> DataFrame:
    both = reduced.select(*EDGE).union(reduced.select(rev(F.col("out_node")), rev(F.col("in_node"))))
    return both.distinct().withColumn("reason", F.lit(reason))


def transitive(edges: DataFrame, fuzz: int = 500) -> DataFrame:
    """Edges v -> x that v -> w -> x explains with a length within ``fuzz``.

    Triangles are listed at their vertex of least degree, see ``pairs.triangles``, so a hub's edges are not paired."""
    ahead = F.col("in_node") < F.col("out_node")
    links = edges.where("in_node != out_node").select(F.least(*EDGE).alias("lo"), F.greatest(*EDGE).alias("hi"), F.struct(ahead.alias("ahead"), F.col("len")).alias("item"))
    items = enumerate(("ab", "ac", "bc"))
    t = triangles(links).select("lo", "mid", "hi", *[c for i, x in items for c in (F.col(f"{x}.ahead").alias(f"d{i}"), F.col(f"{x}.len").alias(f"l{i}"))])
    # ways out of the three nodes: the edges are lo-mid, lo-hi and mid-hi
    d = [F.col(f"d{i}").cast("int") for i in range(3)]
    outs = {"lo": d[0] + d[1], "mid": 1 - d[0] + d[2], "hi": 2 - d[1] - d[2]}

    def node(n: int) -> Column:
        return F.when(outs["lo"] == n, F.col("lo")).when(outs["mid"] == n, F.col("mid")).when(outs["hi"] == n, F.col("hi"))

    # the long edge joins the node with two ways out to the one with none; where each has one they are a ring
    far = F.when(outs["lo"] == 1, F.col("l2")).when(outs["mid"] == 1, F.col("l1")).otherwise(F.col("l0"))
    hit = t.where(~((outs["lo"] == 1) & (outs["mid"] == 1))).select(node(2).alias("in_node"), node(0).alias("out_node"), far.alias("_l0"), (F.col("l0") + F.col("l1") + F.col("l2") - far).alias("_l12"))
    return _with_mirrors(hit.where(F.abs(F.col("_l0") - F.col("_l12")) <= fuzz), "transitive")


def repeats(edges: DataFrame) -> DataFrame:
    """Edges beside a node with one way in and one way out that look like a repeat's: from its predecessor to a node with
    other ways in that shares no successor with it, and the mirrored case."""
    deg = degrees(edges)
    line = deg.where("n_out = 1 and n_in = 1").select(F.col("node").alias("n"))
    before = edges.join(line, edges.out_node == F.col("n")).select("n", F.col("in_node").alias("p"))
    cand = before.join(edges.select(F.col("in_node").alias("p"), F.col("out_node").alias("w")), "p").where("w != n").join(deg.where("n_in > 1").select(F.col("node").alias("w")), "w")
    after = edges.select(F.col("in_node").alias("_s"), F.col("out_node").alias("_t"))
    common = cand.join(after.select(F.col("_s").alias("n"), F.col("_t").alias("t")), "n").join(after.select(F.col("_s").alias("w"), F.col("_t").alias("t")), ["w", "t"]).select("n", "p", "w").distinct()
    alone = cand.join(common, ["n", "p", "w"], "left_anti")
    return _with_mirrors(alone.select(F.col("p").alias("in_node"), F.col("w").alias("out_node")), "repeat")


def best(edges: DataFrame, order: list[Column]) -> DataFrame:
    """Edges that are not the best way out of their node and whose mirror is not either; ties by the out node.

    A mutual best edge stays; a node whose best edge is the best of one side only keeps that one, so no node loses its
    last way out. ``order`` is compared from left to right, larger is better."""
    key = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    top = edges.groupBy("in_node").agg(F.max_by("out_node", F.struct(key.alias("k"), F.col("out_node"))).alias("out_node"))
    return _with_mirrors(remaining(edges, _with_mirrors(top, "")), "best")


def loops(edges: DataFrame) -> DataFrame:
    """(in_node, out_node) of pairs that lead to each other: simple loops."""
    back = edges.select(F.col("out_node").alias("in_node"), F.col("in_node").alias("out_node"))
    return edges.select(*EDGE).join(back, EDGE, "left_semi").where("in_node < out_node")


def duplicates(paths: DataFrame, keep: list[Column]) -> DataFrame:
    """Rank of every path among those between the same nodes, the first to be kept."""
    return paths.withColumn("rank", F.row_number().over(Window.partitionBy(*EDGE).orderBy(*keep)))


def quality_threshold(mean: float, mean_dev: float, median: float, median_dev: float) -> float:
    """The quality below which edges fall, from robust and plain statistics."""
    return (mean - 6 * 1.253 * mean_dev + 2 * (median - 6 * 1.4826 * median_dev)) / 3


def low_quality(edges: DataFrame, quality: str, threshold: float) -> DataFrame:
    """Edges below the threshold, but for the best way out of a node that would lose all."""
    w = Window.partitionBy("in_node")
    n = edges.withColumn("_top", F.max(quality).over(w))
    bad = n.where((F.col(quality) < threshold) & ((F.col("_top") >= threshold) | (F.col(quality) < F.col("_top"))))
    return _with_mirrors(bad, "quality")


def unreliable(edges: DataFrame, score: str, share: float = 0.5) -> DataFrame:
    """Edges whose score is under a share of the best on both their sides."""
    o = F.max(score).over(Window.partitionBy("in_node"))
    i = F.max(score).over(Window.partitionBy("out_node"))
    bad = edges.withColumn("_o", o).withColumn("_i", i).where((F.col(score) < F.col("_o") * F.lit(share)) & (F.col(score) < F.col("_i") * F.lit(share)))
    return _with_mirrors(bad, "unreliable")


def uncovered(edges: DataFrame, cover: DataFrame, min_length: int = 10_000, min_rate: float = 0.66, max_rate: float = 1.5) -> DataFrame:
    """Ways out of a fork that its read's coverage does not call for. ``cover`` has (read, least, middle): the least coverage of a
    read and that of its middle third; a read without a row counts as 0 and limits nothing.

    The ways are gone through by falling score, ties by the out node. One falls if its score is below ``min_length`` and below
    ``min_rate`` of the best one kept, or if the least coverages kept so far and its own pass ``max_rate`` times the middle
    coverage of the fork's read. Rows stream by in order, so a fork's ways are not gathered."""
    name = lambda c: F.expr(f"substring({c}, 1, length({c}) - 2)")
    c = cover.groupBy("read").agg(F.max("least").alias("least"), F.max("middle").alias("middle"))
    forks = degrees(edges).where("n_out > 1").select(F.col("node").alias("in_node"))
    rows = edges.select(*EDGE, F.coalesce("score", F.lit(0)).cast("long").alias("score")).join(forks, "in_node", "left_semi").withColumns({"_u": name("in_node"), "_v": name("out_node")})
    rows = rows.join(c.select(F.col("read").alias("_u"), "middle"), "_u", "left").join(c.select(F.col("read").alias("_v"), "least"), "_v", "left")
    rows = rows.select(*EDGE, "score", F.coalesce("least", F.lit(0)).cast("long").alias("least"), F.coalesce(F.col("middle") * F.lit(max_rate), F.lit(float("inf"))).alias("most"))

    def run(parts):
        node, kept, best = None, 0, 0
        for p in parts:
            gone = []
            for n, s, least, most in zip(p["in_node"], p["score"], p["least"], p["most"], strict=True):
                if n != node:
                    node, kept, best = n, 0, 0
                short = s < min_length and s < best * min_rate
                fall = short or (kept != 0 and kept + least > most)
                gone.append(fall)
                if not fall:
                    kept, best = kept + least, max(best, s)
            yield p.loc[gone, EDGE]

    ordered = rows.repartition("in_node").sortWithinPartitions("in_node", F.col("score").desc(), "out_node")
    return _with_mirrors(ordered.mapInPandas(run, "in_node string, out_node string"), "unreliable")


def spurs(edges: DataFrame, nodes: int, length: int) -> DataFrame:
    """Edges of branches that end within fewer than ``nodes`` nodes or ``length`` bases, from nodes with a longer way out.

    Chains of one-in-one-out nodes are followed step by step while they have fewer nodes or bases. They hold no ring: a node
    on a way back to the chain or to its root would have two ways in or out."""
    deg = cut(degrees(edges))
    branch = deg.where("n_out > 1").select(F.col("node").alias("in_node"))
    walk = cut(edges.join(branch, "in_node").select(F.col("in_node").alias("root"), F.col("out_node").alias("first"), F.col("in_node").alias("prev"), F.col("out_node").alias("node"), F.col("len").alias("bases"), F.lit(1).alias("k")))
    ends: list[DataFrame] = []
    steps = [walk.select("root", "first", F.col("prev").alias("in_node"), F.col("node").alias("out_node"))]
    while True:
        here = walk.join(deg, "node").where(((F.col("k") < nodes) | (F.col("bases") < length)) & (F.col("n_in") == 1))
        ends.append(cut(here.where("n_out = 0").select("root", "first", "k", "bases")))
        going = here.where("n_out = 1").select("root", "first", F.col("node").alias("in_node"), "bases", "k")
        walk = cut(going.join(edges.select("in_node", F.col("out_node").alias("node"), F.col("len").alias("_l")), "in_node").select("root", "first", F.col("in_node").alias("prev"), "node", (F.col("bases") + F.col("_l")).alias("bases"), (F.col("k") + 1).alias("k")))
        if is_empty(walk):
            break
        steps.append(walk.select("root", "first", F.col("prev").alias("in_node"), F.col("node").alias("out_node")))
    dead = ends[0]
    for e in ends[1:]:
        dead = dead.unionByName(e)
    out = edges.select(F.col("in_node").alias("root"), F.col("out_node").alias("first"), F.col("len").alias("_l"))
    w = Window.partitionBy("root").orderBy(F.col("bases").isNull().desc(), F.col("bases").desc(), "first")
    # the longest branch of a node stays where all of them are short
    ranked = out.join(branch.withColumnRenamed("in_node", "root"), "root").join(dead, ["root", "first"], "left").withColumn("_r", F.row_number().over(w)).where("_r > 1 and bases is not null").select("root", "first")
    taken = steps[0]
    for s in steps[1:]:
        taken = taken.unionByName(s)
    return _with_mirrors(taken.join(ranked, ["root", "first"]), "spur")


def unitigs(edges: DataFrame) -> DataFrame:
    """(in_node, out_node, unitig, place): edges on maximal paths whose inner nodes have one way in and one way out.

    A path's id is its first edge, written ``u>v``; places count from 0. Rings are cut at their smallest edge. Found by
    pointer doubling: the number of rounds is the logarithm of the longest path."""
    deg = degrees(edges)
    inner = deg.where("n_in = 1 and n_out = 1").select(F.col("node").alias("in_node"))
    name = F.concat("in_node", F.lit(">"), "out_node")
    e = cut(edges.select(*EDGE, name.alias("e")))
    before = e.select(F.col("out_node").alias("in_node"), F.col("e").alias("up")).join(inner, "in_node")
    # up: an earlier edge on the path; dist: steps to it; low: the least edge passed on the way
    first = e.join(before, "in_node", "left").select("e", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("dist"), F.col("e").alias("low"), F.coalesce("up", "e").alias("top"))
    state = cut(first, open=F.col("up").isNotNull())
    done: list[DataFrame] = []
    limit = max(1, n_rows(e)).bit_length() + 1
    for _ in range(limit):
        done.append(state.where("up is null"))
        if not n_where(state, "open"):
            break
        # edges that have come to the beginning of their path stay where they are; only the others go on
        walking = state.where("up is not null")
        at = walking.unionByName(reduce(DataFrame.unionByName, done))
        far = at.select(F.col("e").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("d2"), F.col("low").alias("l2"), F.col("top").alias("t2"))
        moved = walking.join(far, "up").select("e", F.col("up2").alias("up"), (F.col("dist") + F.col("d2")).alias("dist"), F.least("low", "l2").alias("low"), F.coalesce("t2", "top").alias("top"))
        state = cut(moved, open=F.col("up").isNotNull())
    else:
        done.append(state.where("up is null"))
    lines = reduce(DataFrame.unionByName, done).select("e", F.col("top").alias("unitig"), F.col("dist").alias("place"))
    rings = sized(state.where("up is not null").select("e", "low"), n_where(state, "open"))
    if not is_empty(rings):
        # cut the ring before its least edge and rank again
        heads = rings.where("e = low").select(F.col("low").alias("e"))
        ring_edges = e.join(rings.select("e"), "e", "left_semi")
        opened = cut(ring_edges.join(heads.withColumn("_h", F.lit(True)), "e", "left").withColumn("in_node", F.when(F.col("_h"), F.concat("in_node", F.lit("#"))).otherwise(F.col("in_node"))).select(*EDGE))
        again = unitigs(opened)
        fixed = again.select(F.concat(F.regexp_replace("in_node", "#$", ""), F.lit(">"), "out_node").alias("e"), F.regexp_replace("unitig", "#>", ">").alias("unitig"), "place")
        lines = lines.unionByName(fixed)
    return e.join(lines, "e").select(*EDGE, "unitig", "place")


def condensed(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per unitig: in_node, out_node, unitig, n (edges), len, score (the least)."""
    rows = edges.join(paths, EDGE)
    return rows.groupBy("unitig").agg(F.min_by("in_node", "place").alias("in_node"), F.max_by("out_node", "place").alias("out_node"), F.count(F.lit(1)).alias("n"), F.sum("len").alias("len"), F.min("score").alias("score"))


def neighbourhood(edges: DataFrame, start: DataFrame, radius: int, both: bool = True) -> DataFrame:
    """(node, depth): nodes within ``radius`` steps of the start nodes (node), along edges or in either direction."""
    step = edges.select(F.col("in_node").alias("node"), F.col("out_node").alias("next"))
    if both:
        step = step.union(edges.select("out_node", "in_node"))
    step = cut(step.distinct())
    seen = cut(start.select("node").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, radius + 1):
        found = front.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = cut(found.withColumn("depth", F.lit(d)))
        if is_empty(front):
            break
        seen = cut(seen.unionByName(front))
    return seen


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("in_node")), "in_node", "left_semi").join(nodes.select(F.col("node").alias("out_node")), "out_node", "left_semi")


def contig_sequences(tiles: DataFrame, reads: DataFrame) -> DataFrame:
    """(ctg, seq) from tiles (ctg, tile_no, read, strand, start, end) and reads (read, seq): slices joined in order.

    A contig's bases are one string in one task, as they are in the output."""
    from strandframe.functions.dna import slice_of

    part = slice_of(F.col("seq"), F.col("start"), F.col("end"), F.col("strand"))
    rows = tiles.join(reads, "read").select("ctg", F.struct("tile_no", part.alias("s")).alias("t"))
    return rows.groupBy("ctg").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x.s), "").alias("seq"))


def link_scores(links: DataFrame, width: int) -> DataFrame:
    """(a, b, best, at) per pair of contigs: the best sum of ``score`` over links whose ``pos`` lie within ``width``."""
    from strandframe.operators.coverage import best_window

    return best_window(links.where("a != b"), ["a", "b"], "pos", "score", width)


def grouped_contigs(members: DataFrame, inconsistent: DataFrame, share: float) -> DataFrame:
    """(a, b, n, rate): contigs (ctg, read) of which at least a share of a's reads have an inconsistent partner in b."""
    size = members.groupBy("ctg").agg(F.countDistinct("read").alias("size"))
    x, y = members.select(F.col("ctg").alias("a"), F.col("read").alias("t")), members.select(F.col("ctg").alias("b"), F.col("read").alias("q"))
    hit = inconsistent.select("t", "q").distinct().join(x, "t").join(y, "q").where("a != b").groupBy("a", "b").agg(F.countDistinct("t").alias("n"))
    return hit.join(size.withColumnRenamed("ctg", "a"), "a").withColumn("rate", F.col("n") / F.col("size")).where((F.col("rate") >= share) & (F.col("n") >= 3) | (F.col("rate") >= 1)).select("a", "b", "n", "rate")


#: Reductions of the string graph when none are asked for.
STRATEGY = "transitive:fuzz=500|quality|spur|best|spur|extend|phase|unreliable|spur|bridge|"


def data_threshold(edges: DataFrame, quality: str) -> float | None:
    """``quality_threshold`` from the edges' own mean and median and the deviations from them; None without a value.

    Qualities are rounded to four places, so their histogram is what the median is found in."""
    from strandframe.operators import stats, weighted

    rows = edges.where(F.col(quality).isNotNull()).select(F.lit(1).alias("one"), F.col(quality).alias("q"))
    mean = stats.mean_deviation(rows, ["one"], "q").first()
    if mean is None:
        return None
    mid = weighted.median_deviation(weighted.compress(rows, ["one"], F.round(F.col("q") * 10_000).cast("long")), ["one"]).first()
    return quality_threshold(mean["mean"], mean["mad"], mid["median"] / 10_000, mid["mad"] / 10_000)


def extended(edges: DataFrame, spare: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges with the best ``spare`` edge (same columns) out of every dead end and its mirror, up to ``rounds`` times."""
    edges = cut(edges)
    for _ in range(rounds):
        ends = degrees(edges).where("n_out = 0 and n_in > 0").select(F.col("node").alias("in_node"))
        rest = [c for c in edges.columns if c not in EDGE]
        on = spare.join(ends, "in_node").join(edges.select(*EDGE), EDGE, "left_anti")
        top = on.groupBy("in_node").agg(F.max_by(F.struct("out_node", *rest), F.struct("score", "out_node")).alias("_e")).select("in_node", "_e.*")
        new = cut(mirrored(top.select(*EDGE, *rest)).join(edges.select(*EDGE), EDGE, "left_anti").select(*edges.columns))
        if is_empty(new):
            break
        edges = cut(edges.unionByName(new))
    return edges


def phased(edges: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """Ways out of a node with ``least`` more different than same alleles where another way agrees more than it differs.
    ``links`` has (in_node, out_node, same, diff)."""
    rows = edges.select(*EDGE).join(links, EDGE)
    good = F.max((F.col("same") > F.col("diff")).cast("int")).over(Window.partitionBy("in_node"))
    return _with_mirrors(rows.withColumn("_g", good).where((F.col("_g") == 1) & (F.col("diff") - F.col("same") >= least)), "phase")


def simplify(edges: DataFrame, strategy: str, registry: dict | None = None, spare: DataFrame | None = None, links: DataFrame | None = None, cover: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges left, reduced with reasons) after the steps of ``name:key=value:...|name|...``, in order.

    Known names: transitive (fuzz), quality (th; else from the data, where there is a column ``quality``), spur (n, l), best,
    extend (adds ``spare`` edges), phase (by ``links`` of alleles), unreliable (by the ``cover`` of reads: l, r, c; without it by
    the share r of the best scores), bridge (f), repeat. A step whose table is not given reduces nothing."""
    from strandframe.operators.condensed import bridges

    def quality(e: DataFrame, p: dict[str, str]) -> DataFrame | None:
        if "quality" not in e.columns:
            return None
        th = float(p["th"]) if "th" in p else data_threshold(e, "quality")
        return None if th is None else low_quality(e, "quality", th)

    known = {
        "transitive": lambda e, p: transitive(e, int(p.get("fuzz", 500))),
        "quality": quality,
        "spur": lambda e, p: spurs(e, int(p.get("n", 3)), int(p.get("l", 10_000))),
        "best": lambda e, p: best(e, [F.col("score")]),
        "phase": lambda e, p: None if links is None else phased(e, links, int(p.get("sc", 2))),
        "repeat": lambda e, p: repeats(e),
        "unreliable": lambda e, p: unreliable(e, "score", float(p.get("r", 0.5))) if cover is None else uncovered(e, cover, int(p.get("l", 10_000)), float(p.get("r", 0.66)), float(p.get("c", 1.5))),
        "bridge": lambda e, p: bridges(e, float(p.get("f", 2))),
    } | (registry or {})
    gone = None
    for part in filter(None, strategy.split("|")):
        name, *params = part.split(":")
        if name == "extend" and "extend" not in known:
            edges = edges if spare is None else extended(edges, spare)
            continue
        if name not in known:
            raise ValueError(f"unknown step: {name}")
        off = known[name](edges, dict(p.split("=", 1) for p in params))
        if off is None:
            continue
        off = cut(off.join(edges.select(*EDGE), EDGE, "left_semi"))
        edges = cut(remaining(edges, off))
        gone = off if gone is None else gone.unionByName(off)
    return edges, gone if gone is not None else edges.select(*EDGE, F.lit("").alias("reason")).where("false")
