import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import align, cigar, dna


def values(spark, xs, *cols, schema="x string"):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in xs], schema).select(*cols).collect()]


def test_sequences(spark):
    s = F.col("x")
    got = values(spark, ["ACGTN", "acgt", "", None, "AXG", "TTTTTTTT"], dna.reverse_complement(dna.reverse_complement(s)), dna.is_dna(s), dna.is_dna(s, n=False), dna.homopolymer(s, 4), F.size(dna.kmers(s, 3)))
    assert [r[0] for r in got] == ["ACGTN", "acgt", "", None, "AXG", "TTTTTTTT"]
    assert [r[1] for r in got] == [True, True, True, None, False, True]
    assert [r[2] for r in got] == [False, True, True, None, False, True]
    assert [r[3] for r in got] == [False, False, False, None, False, True]
    assert [r[4] for r in got] == [3, 2, 0, 0, 1, 6]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text("ACGT", min_size=1, max_size=31), min_size=1, max_size=20))
def test_codes_round_trip(spark, xs):
    got = values(spark, xs, F.col("x"), dna.encode(F.col("x")))
    for x, c in got:
        assert c == sum("ACGT".index(b) * 4 ** (len(x) - 1 - i) for i, b in enumerate(x))
    one = [x for x in xs if len(x) == len(xs[0])]
    assert [r[0] for r in values(spark, one, dna.decode(dna.encode(F.col("x")), len(xs[0])))] == one


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 255, 256, 259, 260, 261, 1000])
def test_kmers_over_chunks(spark, n):
    rnd = random.Random(n)
    s = "".join(rnd.choice("ACGT") for _ in range(n))
    want = [s[i : i + 5] for i in range(n - 4)]
    assert values(spark, [s], dna.kmers(F.col("x"), 5)) == [(want,)]
    df = spark.createDataFrame([(7, s)], "id int, x string")
    assert sorted(r["kmer"] for r in dna.explode_kmers(df, "x", 5).collect()) == sorted(want)


def test_names_and_numbers(spark):
    got = values(spark, ["4k", "3M", "2g", "17", "x", "", None], dna.size_number(F.col("x")))
    assert [r[0] for r in got] == [4096, 3 << 20, 2 << 30, 17, None, None, None]
    assert values(spark, ["a//b/", "", None], dna.words(F.col("x"), "/")) == [(["a", "b"],), ([],), (None,)]
    assert values(spark, [5], dna.numbered("b{}.txt", F.col("x")), dna.end_id(F.col("x"), F.lit(0)), dna.end_id(F.col("x"), F.lit(1)), schema="x int") == [("b5.txt", 6, -6)]
    v = spark.range(1).select(dna.vector_counts(F.array(*map(F.lit, (1, -1, 0, 1))), F.array(*map(F.lit, (1, 1, 1, 0)))).alias("v")).first()["v"]
    assert tuple(v) == (1, 1)


def test_cigars(spark):
    d = cigar.parse(F.col("x"))
    got = values(spark, ["5S10M2I3D4H", "", None, "7="], F.size(d), cigar.query_length(d), cigar.target_length(d), cigar.clips(d).lead, cigar.clips(d).tail)
    assert got == [(5, 12, 13, 5, 4), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (1, 7, 7, 0, 0)]


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[:], i
        for j, y in enumerate(b, 1):
            d[j] = min(p[j] + 1, d[j - 1] + 1, p[j - 1] + (x != y))
    return d[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("ACG", max_size=30), st.text("ACG", max_size=30))
def test_alignments_have_the_fewest_edits(a, b):
    e = lev(a, b)
    assert align.edit_distance(a, b) == e
    ops = align.edit_path(a, b)
    assert sum(n for n, op in ops if op != "=") == e
    x, y = align.rows_of(a, b, ops)
    assert (x.replace("-", ""), y.replace("-", "")) == (a, b)
    assert all((p == q) == (op == "=") for p, q, op in zip(x, y, "".join(op * n for n, op in ops), strict=True))
    u, v = align.shift_gaps(x, y)
    assert (u.replace("-", ""), v.replace("-", "")) == (a, b) and sum(p != q for p, q in zip(u, v, strict=True)) <= e
    assert align.edit_path(a, b, e - 1) is None or e == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ACG", max_size=12), st.text("ACG", max_size=12))
def test_affine_scores_are_those_of_the_path(a, b):
    score, ops = align.affine_path(a, b)
    assert score == sum(2 * n if op == "=" else -4 * n if op == "X" else -4 - 2 * n for n, op in ops)
    assert align.rows_of(a, b, ops)[0].replace("-", "") == a


def test_affine_prefers_one_long_gap():
    assert align.affine_path("AAAACCCC", "AAAAGGGGGGCCCC")[1] == [(4, "="), (6, "D"), (4, "=")]


def test_trimming_seeds_and_windows():
    assert align.trimmed("A-CGTACGTTA", "ATCGTACGTGA", run=4) == (2, 9)
    assert align.trimmed("AC", "GT") == (0, 0)
    assert align.seed("TTACGTACGT", "GGGTTACGTA", 5) == (0, 3)
    assert align.identities("AAAA", "AAAT", 2) == (75.0, 50.0)
    with pytest.raises(ValueError):
        align.aligner("other")


def test_udfs(spark):
    df = spark.createDataFrame([("ACGT", "AGT"), (None, "A"), ("", "")], "a string, b string")
    got = [tuple(r) for r in df.select(align.distance_udf(F.col("a"), F.col("b")), align.align_udf(F.col("a"), F.col("b")), align.quality_of(F.col("a"), F.col("b"))).collect()]
    assert got == [(1, "1=1I2=", 75.0), (None, None, None), (0, "", None)]


def test_worst_window_and_regions(spark):
    rnd = random.Random(4)
    data, want = [], []
    for _ in range(30):
        ops = [(rnd.randrange(1, 30), rnd.choice("=XID=")) for _ in range(rnd.randrange(1, 12))]
        columns = "".join(op * n for n, op in ops)
        bad = max(sum(c in "XID" for c in columns[i : i + 20]) for i in range(len(columns)))
        s, e = sorted((rnd.randrange(0, 80), rnd.randrange(0, 80)))
        at, count = 0, dict.fromkeys("=XID", 0)
        for c in columns:
            if s < at <= e:
                count[c] += 1
            at += c != "I"
        data.append((len(data), "5S" + "".join(f"{n}{op}" for n, op in ops) + "2H", s, e))
        want.append((bad, *count.values()))
    df = spark.createDataFrame(data, "id int, c string, s int, e int").withColumn("o", cigar.spans(cigar.parse(F.col("c"))))
    d = cigar.in_region(F.col("o"), F.col("s"), F.col("e"))
    got = df.orderBy("id").select(cigar.worst_window(F.col("o"), 20), d.mat, d.mis, d.ins, d["del"]).collect()
    assert [tuple(r) for r in got] == want
    assert spark.createDataFrame([("",), (None,)], "c string").select(cigar.worst_window(cigar.spans(cigar.parse(F.col("c"))), 5)).collect() == [(0,), (0,)]
