"""Graph reductions, unitigs, the condensed graph, phasing, consensus and streams."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions.align import edit_distance
from strandframe.operators import consensus, graph, phasing
from strandframe.operators.pathgraph import PathGraph, is_diploid, most_different
from strandframe.streaming import overlaps as streams

EDGE = "in_node string, out_node string, len int, score int"


def flip(n):
    return n[:-1] + ("E" if n[-1] == "B" else "B")


def closed(pairs):
    return all((flip(v), flip(u)) in pairs for u, v in pairs)


def random_graph(spark, seed, nodes=30, edges=80):
    rnd = random.Random(seed)
    e = {}
    while len(e) < edges:
        u, v = (f"r{rnd.randrange(nodes)}:{rnd.choice('BE')}" for _ in range(2))
        if u[:-1] != v[:-1]:
            e[u, v] = (u, v, rnd.randrange(1, 40) * 50, rnd.randrange(1, 100))
    return graph.mirrored(spark.createDataFrame(list(e.values()), EDGE))


@pytest.mark.parametrize("seed", range(2))
def test_reductions_are_closed_under_mirrors(spark, seed):
    g = random_graph(spark, seed)
    have = {(r[0], r[1]) for r in g.select(*graph.EDGE).collect()}
    assert closed(have)
    for off in (graph.transitive(g, 300), graph.repeats(g), graph.best(g, [F.col("score")]), graph.unreliable(g, "score"), graph.spurs(g, 3, 500)):
        got = {(r[0], r[1]) for r in off.collect()}
        assert closed(got) and got <= have


def test_transitive_spur_and_best(spark, rows):
    e = [("a:E", "b:E", 100, 9), ("b:E", "c:E", 100, 9), ("a:E", "c:E", 210, 5), ("b:E", "s:E", 50, 1), ("c:E", "d:E", 100, 9), ("d:E", "f:E", 5000, 9), ("f:E", "g:E", 5000, 9)]
    g = graph.mirrored(spark.createDataFrame(e, EDGE))
    assert rows(graph.transitive(g, 20), "in_node", "out_node") == [("a:E", "c:E"), ("c:B", "a:B")]
    assert rows(graph.transitive(g, 5), "in_node", "out_node") == []
    left, gone = graph.simplify(g, "transitive:fuzz=20|spur:n=3:l=1000")
    assert ("b:E", "s:E", "spur") in rows(gone) and ("a:E", "c:E", "transitive") in rows(gone)
    assert left.count() == 10
    with pytest.raises(ValueError):
        graph.simplify(g, "nope")


def test_short_spurs_of_many_nodes(spark, rows):
    way = [("a:E", "b:E", 100, 9), ("b:E", "c:E", 5000, 9), ("c:E", "d:E", 5000, 9), ("d:E", "f:E", 5000, 9)]
    tail = ["b:E"] + [f"s{i}:E" for i in range(6)]
    for bases, spur in ((250, True), (350, False)):
        g = graph.mirrored(spark.createDataFrame(way + [(u, v, bases, 1) for u, v in zip(tail, tail[1:], strict=False)], EDGE))
        want = [(u, v) for u, v in zip(tail, tail[1:], strict=False)] if spur else []
        assert rows(graph.spurs(g, 3, 2_000), "in_node", "out_node") == sorted(want + [(flip(v), flip(u)) for u, v in want])


@pytest.mark.parametrize("seed", range(3))
def test_unitigs_against_a_walk(spark, rows, seed):
    rnd = random.Random(seed)
    e = {(f"n{a}", f"n{b}") for a, b in ((rnd.randrange(40), rnd.randrange(40)) for _ in range(38)) if a != b}
    e |= {(f"x{i}", f"x{(i + 1) % 5}") for i in range(5)} | {(f"p{i}", f"p{i + 1}") for i in range(20)}
    outs, ins = defaultdict(list), defaultdict(list)
    for u, v in sorted(e):
        outs[u].append(v)
        ins[v].append(u)

    def inner(n):
        return len(outs[n]) == 1 and len(ins[n]) == 1

    want, done = [], set()

    def follow(u, v):
        name, k = f"{u}>{v}", 0
        while (u, v) not in done:
            done.add((u, v))
            want.append((u, v, name, k))
            if not inner(v):
                break
            u, v, k = v, outs[v][0], k + 1

    for u, v in sorted(e):
        if not inner(u):
            follow(u, v)
    for u, v in sorted(e, key=lambda x: f"{x[0]}>{x[1]}"):
        follow(u, v)
    got = graph.unitigs(spark.createDataFrame(sorted(e), "in_node string, out_node string"))
    assert rows(got) == sorted(want, key=repr)


def test_neighbourhood_and_contigs(spark, rows):
    g = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "b")], "in_node string, out_node string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.neighbourhood(g, start, 2)) == [("a", 0), ("b", 1), ("c", 2), ("x", 2)]
    assert rows(graph.neighbourhood(g, start, 9, both=False)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    tiles = spark.createDataFrame([("c", 1, "r", 1, 0, 2), ("c", 0, "r", 0, 1, 4), ("c", 2, "q", 0, 0, 1)], "ctg string, tile_no int, read string, strand int, start int, end int")
    reads = spark.createDataFrame([("r", "ACGTT"), ("q", "G")], "read string, seq string")
    assert rows(graph.contig_sequences(tiles, reads)) == [("c", "CGTGTG")]


def test_string_edges_of_all_relations(spark, rows):
    from tests_data import OVERLAP

    o = [(0, 1, 0, 500, 1000, 1000, 2, 0, 0, 500, 900, 9.0), (1, 3, 0, 0, 500, 1000, 4, 0, 400, 900, 900, 9.0), (2, 5, 0, 0, 500, 1000, 6, 1, 0, 500, 900, 9.0), (3, 7, 0, 500, 1000, 1000, 8, 1, 400, 900, 900, 9.0), (4, 1, 0, 600, 1000, 1000, 2, 0, 0, 400, 900, 9.0)]
    got = graph.string_edges(spark.createDataFrame(o, OVERLAP))
    assert rows(got) == sorted([
        ("1:E", "2:E", 400, 500), ("2:B", "1:B", 500, 500), ("3:B", "4:B", 400, 500), ("4:E", "3:E", 500, 500),
        ("5:B", "6:E", 400, 500), ("6:B", "5:E", 500, 500), ("7:E", "8:B", 400, 500), ("8:E", "7:B", 500, 500),
    ], key=repr)
    assert closed({(r[0], r[1]) for r in rows(got)})


def test_condensed_graph_structures():
    g = PathGraph([("s", "a", 5, 3), ("s", "b", 5, 1), ("a", "t", 5, 3), ("b", "t", 5, 1), ("t", "u", 9, 2), ("t", "dead", 1, 1)])
    assert g.bubble("s") == ("t", {"a", "b"})
    assert g.all_paths("s", "t", {"a", "b"}) == [["s", "a", "t"], ["s", "b", "t"]]
    assert sorted(g.disjoint_paths("s", "t")) == [["s", "a", "t"], ["s", "b", "t"]]
    assert g.shortest("s", "u") == ["s", "a", "t", "u"] and g.shortest("u", "s") is None
    assert g.simplify("bubble|semi") == {"bubble-0": 2, "semi-1": 1}
    assert list(g.paths()) == [["s", "a", "t", "u"]] and g.reason["b", "t"] == "bubble"
    g.reactivate([("s", "b"), ("b", "t")])
    assert g.bubble("s") is not None
    assert g.ego("s", 1) == ["s", "a", "b"] and g.extends(("s", "a"), 1, 1)
    assert [len(c) for c in PathGraph([("a", "b", 1, 1), ("c", "d", 1, 1), ("d", "e", 1, 1)]).clusters()] == [3, 2]


def test_crosses_bridges_tips_and_loops():
    c = PathGraph([("i", "x", 1, 9), ("j", "y", 1, 9), ("i", "y", 1, 1), ("j", "x", 1, 1)])
    assert c.cross("i") == (("i", "j"), ("x", "y")) and c.resolve_crosses() == 2 and c.reason == {("i", "y"): "cross", ("j", "x"): "cross"}
    b = PathGraph([("a", "b", 1, 9), ("a", "d", 1, 1), ("c", "d", 1, 9)])
    assert b.bridges() == 1 and ("a", "d") in b.reason
    t = PathGraph([("a", "n", 9, 1), ("tip", "n", 2, 1), ("n", "m", 1, 1), ("z", "a", 1, 1)])
    assert t.tips() == 1 and ("tip", "n") in t.reason
    assert PathGraph([("a", "b", 1, 2), ("b", "a", 1, 1)]).small_loops() == 1
    assert PathGraph([("a", "x", 1, 1), ("a", "y", 1, 2), ("x", "m", 1, 1), ("y", "m", 1, 1), ("y", "k", 1, 1)]).covered_branches() == 1
    p = PathGraph([("a", "x", 1, 1), ("a", "y", 1, 1)])
    assert p.phase_crosses({("a", "x"): (5, 0), ("a", "y"): (0, 4)}) == 1
    m = PathGraph([("a:E", "b:E", 1, 1), ("b:B", "a:B", 1, 1)], flip)
    assert m.extend_ends([("b:E", "c:E", 2, 1)]) == 1 and ("c:B", "b:B") in m.length
    assert m.reduce([("a:E", "b:E")], "x") == 2


def test_path_pairs():
    assert most_different([["a"], ["b"], ["c"]], {"a": {"1", "2"}, "b": {"1"}, "c": {"3"}}) == (["a"], ["c"])
    assert is_diploid(["a", "b"], ["c", "d", "e"], {("c", "a")}) and not is_diploid(["a", "b"], ["c"], set())


def simulated(seed, reads=40, sites=30, err=0.03):
    rnd = np.random.default_rng(seed)
    hap = rnd.integers(0, 2, sites)
    rows, truth = [], {}
    for r in range(reads):
        truth[r] = int(rnd.integers(0, 2))
        a = int(rnd.integers(0, sites - 12))
        for p in range(a, min(sites, a + 20)):
            x = (hap[p] + truth[r]) % 2
            c = -1 if rnd.random() < err else int(1 - x if rnd.random() < err else x)
            rows.append(("c", r, p, c))
    return rows, truth


@pytest.mark.parametrize("seed", range(2))
def test_phasing_of_simulated_haplotypes(spark, seed):
    data, truth = simulated(seed)
    got = phasing.phase(spark.createDataFrame(data, "ctg string, read long, pos int, choice int")).collect()
    right = sum((r["cls"] == 1) == (truth[r["t"]] == truth[r["q"]]) for r in got)
    assert len(got) > 300 and right / len(got) > 0.97


def test_reads_beyond_the_groups_get_a_class(spark):
    data, truth = simulated(1)
    df = spark.createDataFrame(data, "ctg string, read long, pos int, choice int")
    whole = {(r["t"], r["q"]) for r in phasing.phase(df).collect()}
    got = phasing.phase(df, most=12).collect()
    pairs = {(r["t"], r["q"]) for r in got}
    assert len(pairs) == len(got) and max(sum(t == x for t, _ in pairs) for x in truth) > 12
    assert len(pairs & whole) > 0.9 * len(whole)
    assert sum((r["cls"] == 1) == (truth[r["t"]] == truth[r["q"]]) for r in got) / len(got) > 0.97


def test_phasing_rules_and_masks():
    o = phasing.Options.parse("icc=2:sr=0.9")
    assert (o.count, o.same_rate) == (2, 0.9)
    with pytest.raises(ValueError):
        phasing.Options.parse("x=1")
    assert phasing.low_complexity("A" * 300 + "ACGTTGCATCGATTAGCCGTAAGCTTCGGATCCGATATCGGCTAAGTCCGATTGCAACCGGTTAGCATGCCTAGAATTCCGGATTACAGTCCAGGCTATA" * 2)[0][0] == 0
    assert phasing.flip_bubbles({("a", "b"): -5.0, ("b", "c"): 4.0}) in ({"a": -1, "b": 1, "c": 1}, {"a": 1, "b": -1, "c": -1})


def test_consensus_comes_nearer_to_the_truth(spark):
    rnd = random.Random(3)

    def noisy(s):
        out = []
        for ch in s:
            r = rnd.random()
            if r < 0.03:
                continue
            if r < 0.06:
                out.append(rnd.choice("ACGT"))
            out.append(rnd.choice("ACGT") if r > 0.97 else ch)
        return "".join(out)

    true = "".join(rnd.choice("ACGT") for _ in range(500))
    target = noisy(true)
    queries = [(i, noisy(true), 0, len(target)) for i in range(14)]
    seq, a, b, scores = consensus.correct(target, queries)
    assert edit_distance(seq, true) < edit_distance(target, true) / 3 and (b - a) > 450 and all(s[2] for s in scores)
    assert consensus.correct(target, []) == ("", 0, 0, [])
    flat = consensus.select_reads({i: 0.9 if i < 6 else 0.2 for i in range(12)}, 3)
    assert flat == set(range(6)) and consensus.select_reads({1: 0.5}, 3) == {1}
    rev = str.maketrans("ACGT", "TGCA")
    rows = [(i, i, 0, 0, len(q), len(q), 99, i % 2, 0, len(target), len(target), 90.0) for i, q, _, _ in queries]
    seqs = [(99, target)] + [(i, q if i % 2 == 0 else q.translate(rev)[::-1]) for i, q, _, _ in queries]
    from tests_data import OVERLAP

    got = consensus.correct_reads(spark.createDataFrame(rows, OVERLAP), spark.createDataFrame(seqs, "read_id long, seq string")).collect()
    assert len(got) == 1 and got[0]["read"] == 99 and got[0]["seq"] == seq and got[0]["used"] == 14


def test_streamed_filter(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = "{}\t1000\t{}\t1000\t+\t{}\t900\t0\t500\t490\t500\t60"
    (tmp_path / "in" / "a.paf").write_text("\n".join([line.format("a", 500, "b"), line.format("a", 500, "c"), line.format("d", 500, "d"), "bad line"]) + "\n")
    listed = spark.createDataFrame([("c", "a")], "t string, q string")
    lines = streams.filtered_lines(streams.overlap_stream(spark, str(tmp_path / "in")), "i=90:oh=10", listed)
    q = streams.write_lines(lines, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == [line.format("a", 500, "b")]
