"""Reductions of the condensed graph as tables against the same rules on plain adjacency, and searches on small graphs."""

import random

import pytest

from strandframe.operators import condensed, graph
from strandframe.operators.pathgraph import PathGraph

EDGE = "in_node string, out_node string, len int, score int"


def flip(n):
    return n[:-1] + ("E" if n[-1] == "B" else "B")


def closed(edges):
    """Edges with their mirrors, one per pair of nodes."""
    out = {}
    for u, v, n, s in edges:
        for e in ((u, v), (flip(v), flip(u))):
            out[e] = max(out.get(e, (0, 0)), (n, s))
    return [(u, v, n, s) for (u, v), (n, s) in out.items()]


def some_graph(seed):
    rnd = random.Random(seed)
    node = lambda: f"r{rnd.randrange(14)}:{rnd.choice('BE')}"
    edges = [(node(), node(), rnd.randrange(1, 30), rnd.choice([2, 4, 5, 9, 20])) for _ in range(22)]
    cross = [("a:E", "x:E", 5, 20), ("b:E", "y:E", 5, 20), ("a:E", "y:E", 5, 3), ("b:E", "x:E", 5, 3), ("s:E", "p:E", 4, 9), ("p:E", "t:E", 4, 9), ("s:E", "q:E", 4, 5), ("q:E", "t:E", 9, 5), ("k:E", "l:E", 3, 4), ("l:E", "k:E", 3, 7)]
    return closed([e for e in [*edges, *cross] if e[0] != e[1]])


STEPS = {
    "spur": (condensed.tips, lambda g: g.tips()),
    "semi": (condensed.semi, lambda g: g.semi_bubbles()),
    "bridge": (condensed.bridges, lambda g: g.bridges(rounds=1)),
    "cross": (condensed.crosses, lambda g: g.resolve_crosses()),
    "duplicate": (condensed.duplicates, lambda g: g.duplicates()),
}


@pytest.mark.parametrize("step", STEPS)
def test_tables_against_adjacency(spark, step):
    table, plain = STEPS[step]
    found = 0
    for seed in range(6):
        edges = some_graph(seed)
        g = PathGraph(edges, mirror=flip)
        plain(g)
        got = {(r["in_node"], r["out_node"]) for r in table(spark.createDataFrame(edges, EDGE)).collect()}
        want = {(u, v) for u, v in g.reason}
        assert got & {(u, v) for u, v, *_ in edges} == want
        found += len(want)
    assert found


def ways_beside(seed):
    """Nodes whose ways out hold those of their siblings, hubs on both sides, and bubbles between chains."""
    rnd = random.Random(seed)
    edges = [("h:E", f"m{i}:E", 3, 5) for i in range(14)] + [(f"m{i}:E", t, 4, rnd.choice([3, 7])) for i in range(14) for t in rnd.sample(["t:E", "u:E", "v:E"], rnd.choice([1, 2]))]
    for k in range(4):
        a, b, c, d = (f"{x}{k}:E" for x in "abcd")
        edges += [(a, b, 4, rnd.choice([2, 9])), (a, c, 5, 5), (b, d, 6, 5), (c, d, 1, rnd.choice([2, 9])), (d, f"a{k + 1}:E", 2, 3)]
        edges += [(b, c, 2, 4)] if rnd.random() < 0.3 else [(d, a, 2, 2)] if rnd.random() < 0.2 else []
    return closed([*some_graph(seed), *edges])


@pytest.mark.parametrize(("part_rows", "set_ways", "seed"), [(100_000, 100, 0), (0, 1, 1)])
def test_steps_of_whole_clusters_against_adjacency(spark, rows, monkeypatch, part_rows, set_ways, seed):
    monkeypatch.setattr(condensed, "PART_ROWS", part_rows)
    monkeypatch.setattr(condensed, "SET_WAYS", set_ways)
    edges = [(u, v, n, None if s == 4 else s) for u, v, n, s in ways_beside(seed)]
    df = spark.createDataFrame(edges, EDGE)
    found = 0
    for step, plain in (("transitive", lambda g: g.covered_branches()), ("bubble:s=0", lambda g: g.pop_bubbles())):
        g = PathGraph([(u, v, n, s or 0) for u, v, n, s in edges], mirror=flip)
        plain(g)
        assert rows(condensed.simplify(df, step)[1], "in_node", "out_node") == sorted(g.reason, key=repr)
        found += bool(g.reason)
    assert found == 2
    g = PathGraph([(u, v, n, s or 0) for u, v, n, s in edges], mirror=flip)
    want = [(p[0], p[-1], len(p), sum(g.length[e] for e in zip(p, p[1:], strict=False))) for p in g.paths()]
    assert rows(condensed.contig_paths(df)) == sorted(want, key=repr)


def test_contig_paths_of_rings_begin_at_the_smallest_node(spark, rows):
    ring = [("b:E", "c:E", 3, 9), ("c:E", "a:E", 5, 9), ("a:E", "b:E", 7, 9)]
    assert rows(condensed.contig_paths(spark.createDataFrame(ring, EDGE))) == [("a:E", "c:E", 3, 10)]


def test_branches_between_two_hubs_are_not_paired(spark, monkeypatch):
    """Siblings with the same ways out are compared at once, and no task gathers the cluster."""
    monkeypatch.setattr(condensed, "by_cluster", None)
    edges = closed([e for i in range(400) for e in (("h:E", f"m{i}:E", 3, i), (f"m{i}:E", "t:E", 4, i))])
    sizes = []
    write = condensed.cut
    monkeypatch.setattr(condensed, "cut", lambda df, **kw: sizes.append(write(df, **kw)) or sizes[-1])
    gone = condensed.simplify(spark.createDataFrame(edges, EDGE), "transitive")[1]
    assert gone.count() == 4 * 399
    assert max(condensed.n_rows(x) for x in sizes) <= len(edges)


def test_back_edges(spark, rows):
    df = spark.createDataFrame(closed([("k:E", "l:E", 3, 4), ("l:E", "k:E", 3, 7), ("m:E", "n:E", 3, 4)]), EDGE)
    assert rows(condensed.back_edges(df), "in_node", "out_node") == [("k:E", "l:E"), ("l:B", "k:B")]


def test_clusters(spark, rows):
    rnd = random.Random(3)
    pairs = [(f"r{rnd.randrange(60):02}", f"r{rnd.randrange(60):02}") for _ in range(40)] + [(f"s{i:02}", f"s{i + 1:02}") for i in range(30)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    df = spark.createDataFrame([(f"{a}:B", f"{b}:E", 1, 1) for a, b in pairs], EDGE)
    assert rows(condensed.clusters(df)) == sorted((x, top(x)) for x in list(up))
    assert rows(condensed.clusters(df.where("false"))) == []


def test_bubbles_flows_and_paths(spark, rows):
    bubble = [("a:E", "s:E", 1, 9), ("s:E", "p:E", 4, 9), ("p:E", "t:E", 4, 9), ("s:E", "q:E", 3, 5), ("q:E", "t:E", 9, 5), ("t:E", "z:E", 2, 9)]
    df = spark.createDataFrame(closed(bubble), EDGE)
    assert rows(condensed.bubbles(df)) == [("s:E", "t:E", 2, 2), ("t:B", "s:B", 2, 2)]
    assert rows(condensed.flows(df)) == [("s:E", "t:E", 2, 8), ("t:B", "s:B", 2, 8)]
    left, gone = condensed.simplify(df, "bubble:s=1")
    assert {r["reason"] for r in gone.collect()} == {"bubble"} and gone.count() == 4
    assert ("a:E", "z:E", 5, 11) in rows(condensed.contig_paths(left))
    assert condensed.simplify(df)[0].count() == left.count()
    with pytest.raises(ValueError):
        condensed.simplify(df, "nothing")
    assert rows(condensed.bubbles(df.where("false"))) == []


def test_every_step_of_the_string_graph_has_a_name(spark):
    df = spark.createDataFrame([(*e, 99.0) for e in closed([("a:E", "b:E", 9, 9), ("b:E", "c:E", 9, 9), ("a:E", "c:E", 18, 9)])], EDGE + ", quality double")
    left, gone = graph.simplify(df, graph.STRATEGY)
    assert {r["reason"] for r in gone.collect()} == {"transitive"} and left.count() == 4


def test_extend_leads_on_from_dead_ends(spark, rows):
    df = spark.createDataFrame(closed([("a:E", "b:E", 9, 9)]), EDGE)
    spare = spark.createDataFrame(closed([("b:E", "c:E", 5, 3), ("b:E", "d:E", 5, 4), ("d:E", "e:E", 5, 4), ("x:E", "y:E", 5, 4)]), EDGE)
    got = graph.extended(df, spare, rounds=3)
    assert {(r["in_node"], r["out_node"]) for r in got.collect()} == {("a:E", "b:E"), ("b:B", "a:B"), ("b:E", "d:E"), ("d:B", "b:B"), ("d:E", "e:E"), ("e:B", "d:B")}


def test_phase_drops_ways_whose_alleles_differ(spark, rows):
    df = spark.createDataFrame(closed([("a:E", "b:E", 9, 9), ("a:E", "c:E", 9, 9), ("d:E", "e:E", 9, 9)]), EDGE)
    links = spark.createDataFrame([("a:E", "b:E", 5, 0), ("a:E", "c:E", 1, 4), ("d:E", "e:E", 0, 9)], "in_node string, out_node string, same int, diff int")
    assert rows(graph.phased(df, links), "in_node", "out_node") == [("a:E", "c:E"), ("c:B", "a:B")]
