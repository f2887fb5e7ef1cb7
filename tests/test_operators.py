"""Operators against direct computations, on small tables with nulls, ties, repeats and heavy keys."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandframe import session
from strandframe.functions.overlap import sides
from strandframe.operators import coverage, grouping, intervals, pairs, selecting, snps, stats, weighted
from strandframe.operators.prefix import next_position, running_sum
from tests_data import OVERLAP, random_overlaps


def test_weighted_results_of_heavy_null_and_tied_keys(spark, rows):
    rnd = random.Random(1)
    data = [("hot", rnd.choice([5, 5, 7, None, 3000])) for _ in range(400)] + [(k, rnd.randrange(-50, 50)) for k in "abc" for _ in range(21)] + [(None, 4), (None, None), ("only nulls", None)]
    pairs_ = weighted.compress(spark.createDataFrame(data, "k string, v int"), ["k"], F.col("v").cast("long"))
    got = {r["k"]: r for r in weighted.totals(pairs_, ["k"]).collect()}
    for k in {x for x, _ in data}:
        vs = [v for x, v in data if x == k and v is not None]
        n = Counter(vs)
        mode = min((v for v in n if n[v] == max(n.values())), default=None)
        assert tuple(got[k])[1:] == (sum(x == k for x, _ in data), sum(vs) if vs else None, len(n), mode)
    per = {(r["k"], r["percent"]): r["value"] for r in weighted.percentiles(pairs_, ["k"], [0, 50, 90, 100], width=16).collect()}
    for k in {x for x, _ in data}:
        vs = sorted(v for x, v in data if x == k and v is not None)
        for p in (0, 50, 90, 100):
            assert per.get((k, p)) == (vs[max(1, -(-len(vs) * p // 100)) - 1] if vs else None)
    ok = weighted.compress(spark.createDataFrame([d for d in data if d[0]], "k string, v int"), ["k"], F.col("v").cast("long"))
    for r in weighted.median_deviation(ok, ["k"], width=16).collect():
        vs = sorted(v for x, v in data if x == r["k"] and v is not None)
        m = vs[len(vs) // 2]
        assert (r["median"], r["mad"]) == (m, sorted(abs(v - m) for v in vs)[len(vs) // 2])
    assert rows(weighted.totals(pairs_.where("false"), ["k"])) == []


def test_joins_with_heavy_keys(spark, rows, monkeypatch):
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    monkeypatch.setattr(session, "HEAVY_SHARE", 0.1)
    left = spark.createDataFrame([("hot", i) for i in range(80)] + [("a", 1), ("b", 2), (None, 3), ("missing", 4)], "k string, v int")
    right = spark.createDataFrame([("hot", "x"), ("a", "y"), ("b", "z"), (None, "n")], "k string, w string")
    for how in ("inner", "left"):
        heavy = session.heavy_keys(left, ["k"], 0.1)
        assert rows(heavy) == [("hot",)]
        assert rows(session.skew_join(left, right, ["k"], how), "k", "v", "w") == rows(left.join(right, ["k"], how), "k", "v", "w")


def test_tables_in_the_shared_folder(spark, rows, tmp_path):
    t = session.cut(spark.range(5).where("id > 1"))
    assert rows(t) == [(2,), (3,), (4,)]
    assert len(t._jdf.queryExecution().logical().toString()) < 300
    assert rows(session.cut(spark.range(0))) == []
    session.drop(t)
    with pytest.raises(Exception):
        t.collect()


def test_broadcast_only_behind_a_count(spark):
    small, large = spark.range(3), spark.range(50)
    assert "broadcast" in session.broadcast_if_small(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in session.broadcast_if_small(large, 10)._jdf.queryExecution().logical().toString().lower()


def test_running_sums_over_buckets(spark):
    rnd = random.Random(2)
    data = [(k, p, rnd.randrange(9)) for k in "ab" for p in rnd.sample(range(-500, 500), 120)]
    df = spark.createDataFrame(data, "k string, p long, v long")
    got = {(r["k"], r["p"]): (r["s"], r["nx"]) for r in next_position(running_sum(df, ["k"], "p", "v", "s", 50), ["k"], "p", "nx", 50).collect()}
    for k, p, _ in data:
        assert got[k, p] == (sum(v for x, q, v in data if x == k and q <= p), min((q for x, q, _ in data if x == k and q > p), default=None))


def test_coverage(spark, rows):
    rnd = random.Random(3)
    iv = [(k, a, a + rnd.randrange(0, 40), 200) for k in "ab" for a in rnd.choices(range(150), k=25)] + [("a", 5, 5, 200), ("b", None, 9, 200), ("b", 9, 3, 200)]
    df = spark.createDataFrame(iv, "k string, s int, e int, l int")
    segs = session.cut(coverage.segments(df, ["k"], F.col("s"), F.col("e"), F.col("l")))
    depth = {k: [sum(1 for x, a, b, _ in iv if x == k and a is not None and a <= p < b) for p in range(200)] for k in "ab"}
    flat = defaultdict(list)
    for k, a, b, d in sorted(map(tuple, segs.collect())):
        assert len(flat[k]) == a
        flat[k] += [d] * (b - a)
    assert dict(flat) == depth
    core = {r["k"]: r for r in coverage.core(segs, ["k"], F.lit(20), F.lit(180)).collect()}
    thirds = {r["k"]: r for r in coverage.thirds(segs, ["k"], F.lit(200)).collect()}
    runs = {r["k"]: (r["start"], r["end"]) for r in coverage.longest_run(segs, ["k"], 3).collect()}
    for k, d in depth.items():
        assert (core[k]["min_depth"], core[k]["max_depth"], core[k]["bases"], core[k]["sum_depth"]) == (min(d[20:180]), max(d[20:180]), 160, sum(d[20:180]))
        assert tuple(thirds[k])[1:] == (sum(d[:66]) // 66, sum(d[66:132]) // 66, sum(d[132:]) // 66)
        best, at = (0, 0), None
        for p in range(201):
            ok = p < 200 and d[p] >= 3
            at = p if ok and at is None else at
            if not ok and at is not None:
                best, at = max(best, (p - at, -at)), None
        assert runs[k] == (-best[1], -best[1] + best[0])


def plain_trough(c, last, k):
    """Steps one value at a time, on a histogram from its least value on."""
    n = max(k, len(c))
    c = [*c, *[0] * (3 * k + last)]
    start = next((i - 1 for i in range(1, min(last // 10, n)) if c[i - 1] > c[i]), 0)
    at = start
    while at + 1 < min(n, last) and sum(c[at + 1 : at + 1 + k]) < sum(c[at : at + k]):
        at += 1
    low = min(range(at, at + k), key=lambda i: (c[i], i))
    pick = low
    while pick >= 1 and 0.85 * c[pick] <= c[pick - 1] <= 1.15 * c[pick] and 0.5 * c[low] <= c[pick - 1] <= 1.5 * c[low]:
        pick -= 1
    return max(pick, 1)


@pytest.mark.parametrize("seed", range(8))
def test_trough(spark, seed):
    rnd = random.Random(seed)
    c = [[9, 5, 2, 1, 2, 6, 9, 6, 2, 1], [50, 30, 10, 4, 3, 4, 10, 30, 50, 30, 10, 1]][seed] if seed < 2 else [rnd.choice([1, 2, 5, 5, 5, 6, 40]) for _ in range(rnd.randrange(1, 60))]
    hist = spark.createDataFrame([(7 + i, n) for i, n in enumerate(c)], "value long, freq long")
    assert coverage.first_trough(hist, 40, 3).first()[0] == plain_trough(c, 40, 3)


def test_cliffs(spark):
    assert coverage.cliffs([0] * 5 + [10] * 40, 10) == (10, -1)
    assert coverage.cliffs([10] * 40 + [0] * 5, 10)[1] >= 30
    with pytest.raises(ValueError):
        coverage.first_trough(spark.createDataFrame([], "value long, freq long"), 2, 4)


@pytest.mark.parametrize(("lens", "strict", "want"), [([5, 3, 2], True, (3, 2)), ([5, 3, 2], False, (5, 1)), ([4, 4, 4, 4], True, (4, 3)), ([4, 4, 4, 4], False, (4, 2)), ([7], True, (7, 1)), ([10, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1], True, (1, 2))])
def test_n50(spark, lens, strict, want):
    got = stats.n_values(spark.createDataFrame([(x,) for x in [*lens, None]], "n int"), "n", [50], strict).collect()
    assert [tuple(r)[1:] for r in got] == [want]


def test_longest_to_total(spark, rows):
    rnd = random.Random(4)
    for total in (0, 1, 50, 300, 10**6):
        lens = [rnd.randrange(1, 30) for _ in range(40)]
        order = sorted(lens, reverse=True)
        need, least = 0, 0
        for n in order:
            if need >= total:
                break
            need, least = need + n, n
        keep = lens if need < total else [n for n in lens if n >= least] if total else None
        got = [r[0] for r in selecting.longest_to_total(spark.createDataFrame([(n,) for n in lens], "n int"), "n", total).collect()]
        if keep is not None:
            assert sorted(got) == sorted(keep)


def test_interval_join(spark, rows):
    rnd = random.Random(5)
    left = [(i, rnd.choice("ab"), s, s + rnd.randrange(0, 60)) for i in range(60) for s in [rnd.randrange(0, 300)]]
    right = [(i, rnd.choice("ab"), s, s + rnd.randrange(0, 200)) for i in range(40) for s in [rnd.randrange(0, 300)]]
    got = intervals.interval_join(spark.createDataFrame(left, "l int, k string, l_start int, l_end int"), spark.createDataFrame(right, "r int, k string, r_start int, r_end int"), "k", 25)
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] == b[1] and a[2] < b[3] and b[2] < a[3] and a[2] < a[3] and b[2] < b[3])
    assert rows(got, "l", "r") == sorted(want, key=repr)


def test_blocks_close_when_full(spark):
    df = spark.createDataFrame([(i, i % 7 * 10) for i in range(100)], "id int, n int")
    out = selecting.blocks(df, "id", "n", 100, shards=2).orderBy("shard", "id").collect()
    sums = defaultdict(int)
    for r in out:
        sums[r["shard"], r["block"]] += r["n"]
    last = {s: max(b for x, b in sums if x == s) for s, _ in sums}
    assert len(out) == 100 and all(n >= 100 for (s, b), n in sums.items() if b != last[s])


def test_greedy_choices(spark, rows):
    df = spark.createDataFrame([(1, 0, 10, 10), (1, 2, 9, 7), (1, 20, 25, 5), (1, 40, 44, 4), (2, 0, 5, 5)], "k int, s int, e int, n int")
    assert rows(selecting.spread_placements(df, "k", "s", "e", "n", 2), "k", "s") == [(1, 0), (1, 20), (2, 0)]
    assert selecting.greedy_matching([("a", "b", 1.0), ("b", "c", 3.0), ("d", "a", 2.0), ("e", "e", 9.0)]) == [("b", "c", 3.0), ("d", "a", 2.0)]


def test_best_rows_and_duplicates(spark, rows):
    df = random_overlaps(spark, 200, 7)
    got = grouping.best_neighbours(df)
    data = [r.asDict() for r in df.collect()]
    best = {}
    for r in data:
        n = (r["a_end"] - r["a_start"] + r["b_end"] - r["b_start"]) // 2
        for x, y in ((r["a_id"], r["b_id"]), (r["b_id"], r["a_id"])):
            best[x, y] = min(best.get((x, y), (0, 1 << 60)), (-n, r["ol_id"]))
    assert rows(got, "read", "other", "ol_id") == sorted(((x, y, i) for (x, y), (_, i) in best.items()), key=repr)
    assert grouping.duplicates(df).where("rank > n").count() == 0


def test_anti_join_with_tolerance(spark, rows):
    o = spark.createDataFrame([(0, 1, 0, 100, 600, 600, 2, 0, 0, 500, 900, 95.0), (1, 1, 0, 0, 500, 600, 3, 1, 0, 500, 500, 95.0), (2, 4, 0, 0, 9, 9, 5, 0, 0, 9, 9, 1.0)], OVERLAP)
    assert [tuple(r) for r in pairs.offsets(o).orderBy("ol_id").select("b_on_a", "a_on_b").collect()] == [(100, -100), (500, 500), (0, 0)]

    def left(listed, **kw):
        return [r[0] for r in rows(pairs.without_inconsistent(o, spark.createDataFrame(listed, "t long, q long, strand int, offset int"), 50, **kw), "ol_id")]

    assert left([(1, 2, 0, 149)]) == [1, 2] and left([(1, 2, 0, 150)]) == [0, 1, 2] and left([(1, 2, 1, 100)]) == [0, 1, 2]
    assert left([(2, 1, 0, -80)]) == [1, 2]
    assert left([(1, 2, 0, 100)], strict=True) == [0, 1, 2] and left([(1, 2, 0, 100), (2, 1, 0, -100)], strict=True) == [1, 2]
    assert left([(1, 3, 1, 560)], rate=0.2) == [0, 2]
    shift = spark.createDataFrame([(1, 1000)], "read long, range_start int")
    assert left([(1, 2, 0, 1100)], ranges=shift) == [1, 2]


def test_base_calls(spark, rows):
    calls = spark.createDataFrame([("c", 1, r, b) for r, b in enumerate([0, 0, 0, 1, 1, 2])] + [("c", 9, r, 3) for r in range(6)], "ctg string, pos int, read int, base int")
    sites = snps.confirmed(snps.base_histogram(calls), 2, 100, 2, 2)
    assert rows(sites) == [("c", 1, 0, 1)]
    al = snps.alleles_of_reads(calls, sites)
    assert [r["choice"] for r in al.orderBy("read").collect()] == [0, 0, 0, 1, 1, -1]
    assert rows(snps.majority_vote(al)) == [("c", 1, 0)]
    assert rows(snps.agreement(spark.createDataFrame([(0, 1), (0, 3), (0, 5)], "a int, b int"), al)) == [(0, 1, 1, 0), (0, 3, 0, 1)]


def test_empty_tables(spark, rows):
    none = random_overlaps(spark, 5, 1).where("false")
    assert rows(grouping.best_neighbours(none)) == [] and rows(grouping.contained_reads(none)) == [] and rows(stats.read_fold(sides(none, "ol_id", "identity"))) == []
    assert rows(coverage.segments(none, ["a_id"], F.col("a_start"), F.col("a_end"))) == []
    assert rows(stats.n_values(none, "a_len")) == []
