"""Kernel queries over whole tables, on small tables written for the tests."""

import random

import numpy as np
import pytest

from strandframe.functions import align
from strandframe.operators import consensus, phasing
from strandframe.plans import kernel_queries as k

_FLIP = str.maketrans("ACGT", "TGCA")


def lev(a, b):
    """The plain recurrence, a row at a time."""
    y, at = np.array(list(b)), np.arange(len(b) + 1)
    row = at.copy()
    for i, ch in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (y != ch), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def noisy(rnd, s, rate):
    return "".join(rnd.choice(["", c + rnd.choice("ACGT"), rnd.choice("ACGT")]) if rnd.random() < rate else c for c in s)


def edits(ops, a, b):
    """Edits of an alignment that spells both strings."""
    x, y = align.rows_of(a, b, ops)
    assert x.replace("-", "") == a and y.replace("-", "") == b
    assert all({"=": p == q, "X": p != q and "-" not in (p, q), "I": q == "-", "D": p == "-"}[op] for op, p, q in zip("".join(o * n for n, o in ops), x, y, strict=True))
    return sum(n for n, op in ops if op != "=")


@pytest.mark.parametrize("seed", range(60))
def test_least_path(seed):
    rnd = random.Random(seed)
    a = "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(0, 90)))
    b = noisy(rnd, a, 0.3) if seed % 2 else "".join(rnd.choice("ACG") for _ in range(rnd.randrange(0, 90)))
    assert edits(align.least_path(a, b), a, b) == lev(a, b) == align.edit_distance(a, b)


@pytest.fixture(scope="module")
def long_tables(spark, tmp_path_factory):
    """Overlaps with stretches of 400 to 2,500 bases: alike, on the other strand, and unlike."""
    rnd, d = random.Random(5), str(tmp_path_factory.mktemp("sf"))
    bases = "".join(rnd.choice("ACGT") for _ in range(2_500))
    seqs = {1: bases, 2: noisy(rnd, bases, 0.06), 3: noisy(rnd, bases, 0.06).translate(_FLIP)[::-1], 4: "".join(rnd.choice("ACGT") for _ in range(1_400)), 5: bases[:400], 6: noisy(rnd, bases[:400], 0.06)}
    want = {}
    ols = []
    for n, (q, t, strand) in enumerate([(1, 2, "+"), (3, 1, "-"), (4, 1, "+"), (5, 6, "+"), (5, 4, "+")]):
        x, y = seqs[q], seqs[t]
        ols.append((n, q, len(x), 0, len(x), strand, t, len(y), 0, len(y), 90, 100))
        want[n] = (x.translate(_FLIP)[::-1] if strand == "-" else x, y)
    spark.createDataFrame(ols, "ol_id long, qid long, qlen int, qstart int, qend int, strand string, tid long, tlen int, tstart int, tend int, matches int, alnlen int").write.parquet(f"{d}/read_overlaps.parquet")
    spark.createDataFrame([(i, f"r{i}", s) for i, s in seqs.items()], "read_id long, read_name string, seq string").selectExpr("*", "timestamp '2020-01-01' as loaded_at").write.parquet(f"{d}/seq_reads.parquet")
    return d, want


def test_long_stretches_are_aligned(spark, long_tables):
    d, want = long_tables
    dist = {n: lev(a, b) for n, (a, b) in want.items()}
    got = {r["ol_id"]: r["cigar"] for r in k.kern_align(spark, d).collect()}
    assert {n: edits(align.parse_ops(c), *want[n]) for n, c in got.items()} == dist
    assert {r["ol_id"]: r["distance"] for r in k.kern_distance(spark, d).collect()} == dist
    assert {r["ol_id"] for r in k.kern_refined(spark, d).collect()} == {0, 1, 3}


def every_window(seq, k=5, window=100, share=0.66):
    """Bases in windows of low complexity, looked at from every base."""
    got = set()
    for s in range(max(1, len(seq) - window + 1)):
        part = seq[s : s + window]
        words = [part[i : i + k] for i in range(len(part) - k + 1)]
        n = sorted(map(words.count, set(words)))
        if n and sum(n[-3:]) >= share * len(words):
            got |= set(range(s, s + len(part)))
    return got


@pytest.mark.parametrize("seed", range(12))
def test_low_complexity_at_every_base(seed):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    seq = some(rnd.randrange(0, 130)) + rnd.choice(["A", "AC", "ACG"]) * rnd.randrange(20, 60) + some(rnd.randrange(0, 130)) + "AC" * rnd.randrange(0, 60)
    got = phasing.low_complexity(seq)
    assert {i for a, b in got for i in range(a, b)} == every_window(seq)


def test_low_complexity_between_and_after_half_windows():
    some = "ACGTTGCATCGATTAGCCGTAAGCTTCGGATCCGATATCGGCTAAGTCCGATTGCAACCGGTTAGCATGCCTAGAATTCCGGATTACAGTCCAGGCTATA"
    assert len(some) == 100
    for seq in (some[:75] + "A" * 72 + some, some[:80] + "A" * 69):
        assert phasing.low_complexity(seq) and every_window(seq)
        assert {i for a, b in phasing.low_complexity(seq) for i in range(a, b)} == every_window(seq)


def test_a_deep_place_leaves_the_other_queries(spark):
    rnd = random.Random(3)
    target = "".join(rnd.choice("ACGT") for _ in range(600))
    parts = [(0, 300)] * 8 + [(300, 580)] * 3
    rows = [(i, i, 0, 0, e - s, e - s, 99, 0, s, e, 600, 90.0) for i, (s, e) in enumerate(parts)]
    seqs = [(99, target)] + [(i, target[s:e]) for i, (s, e) in enumerate(parts)]
    ov = spark.createDataFrame(rows, "ol_id long, a_id long, a_strand int, a_start int, a_end int, a_len int, b_id long, b_strand int, b_start int, b_end int, b_len int, identity double")
    got = consensus.correct_reads(ov, spark.createDataFrame(seqs, "read_id long, seq string"), most=4).collect()
    assert [(r["read"], r["seq"], r["range_start"], r["range_end"], r["used"]) for r in got] == [(99, target[:580], 0, 580, 7)]
