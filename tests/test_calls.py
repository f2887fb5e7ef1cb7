"""Base calls against plain walks letter by letter."""

import random
from collections import Counter

import pytest

from strandframe.functions import align
from strandframe.operators import calls

KINDS = {"A": 0, "C": 1, "G": 2, "T": 3}


def noisy(rnd, s, rate):
    return "".join(rnd.choice(["", c + rnd.choice("ACGT"), rnd.choice("ACGT")]) if rnd.random() < rate else c for c in s)


def plain_walk(q, t, ops, match):
    """(position, call) one operation and one letter at a time."""
    out, i, j, half = [], 0, 0, match // 2
    for n, op in ops:
        if op == "M":
            for x in range(half, n - half):
                if n >= match and q[i + x] in KINDS and all(q[i + y] == t[j + y] and t[j + y] in KINDS for y in range(x - half, x + half + 1) if y != x):
                    out.append((j + x, KINDS[q[i + x]]))
            i, j = i + n, j + n
        elif op == "D":
            out += [(j + x, 8) for x in range(n)]
            j += n
        elif op == "I":
            if q[i] in KINDS:
                out.append((j, 4 + KINDS[q[i]]))
            i += n
    return out


def joined(ops):
    """Equal and unequal letters as one operation."""
    out = []
    for n, op in ops:
        op = "M" if op in "=X" else op
        if out and out[-1][1] == op:
            out[-1] = (out[-1][0] + n, op)
        else:
            out.append((n, op))
    return out


def made(seed, n=40):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = "".join(rnd.choice("ACGT" if i % 5 else "ACGTN") for _ in range(rnd.randrange(0, 120)))
        rows.append((i % 4, i, rnd.randrange(0, 50), noisy(rnd, t, 0.1), t))
    return rows


@pytest.mark.parametrize("match", [1, 3, 7])
def test_walk(spark, rows, match):
    data, want = [], []
    for ctg, read, start, q, t in made(match):
        ops = joined(align.least_path(q, t))
        data.append((ctg, read, start, "".join(f"{n}{op}" for n, op in ops), q, t))
        want += [(ctg, start + p, read, c) for p, c in plain_walk(q, t, ops, match)]
    data += [(9, 9, 0, None, "ACGT", "ACGT"), (None, 9, 0, "4M", "ACGT", "ACGT"), (9, 9, 0, "", "", "ACGT"), (9, 8, 0, "3S2M2N1M1H", "ACG", "ACTTG")]
    df = spark.createDataFrame(data, "ctg long, read long, start int, cigar string, q string, t string").selectExpr("*", "1 as pos", "2 as base")
    clipped = [(9, p, 8, c) for p, c in ((0, 0), (1, 1), (4, 2))] if match == 1 else []
    assert rows(calls.walk(df, match)) == sorted(want + clipped, key=repr)
    assert rows(calls.walk(df.where("false"), match)) == []


@pytest.mark.parametrize("flank", [2, 4, 8])
def test_between_flanks(spark, rows, flank):
    data = made(flank)
    want = []
    for ctg, read, start, q, t in data:
        def windows(s, gap):
            return Counter((s[i : i + flank], s[i + flank + gap : i + 2 * flank + gap]) for i in range(len(s) - 2 * flank - gap + 1) if set(s[i : i + 2 * flank + gap]) <= set("ACGT"))

        tw, q1, q0 = windows(t, 1), windows(q, 1), windows(q, 0)
        for i in range(len(t) - 2 * flank):
            key = (t[i : i + flank], t[i + flank + 1 : i + 2 * flank + 1])
            if tw[key] == 1 and set(t[i : i + 2 * flank + 1]) <= set("ACGT"):
                if q1[key] == 1:
                    at = next(x for x in range(len(q)) if (q[x : x + flank], q[x + flank + 1 : x + 2 * flank + 1]) == key and set(q[x : x + 2 * flank + 1]) <= set("ACGT"))
                    want.append((ctg, start + i + flank, read, KINDS[q[at + flank]]))
                elif q0[key] == 1:
                    want.append((ctg, start + i + flank, read, 8))
    df = spark.createDataFrame([*data, (1, 1, 0, None, "ACGT")], "ctg long, read long, start int, q string, t string")
    assert want and rows(calls.between_flanks(df, flank)) == sorted(want, key=repr)
    with pytest.raises(ValueError):
        calls.between_flanks(df, 16)


def test_counts_and_misses(spark, rows):
    df = spark.createDataFrame([(1, 5, 10, 0), (1, 5, 11, 0), (1, 5, 12, 8), (1, 6, 10, 5), (1, 6, 11, 3)], "ctg long, pos long, read long, base int")
    assert rows(calls.counts(df)) == [(1, 5, 2, 0, 0, 0, 0, 1), (1, 6, 0, 0, 0, 1, 1, 0)]
    placed = spark.createDataFrame([(1, 10, 0, 6), (1, 11, 5, 3000), (1, 12, 7, 7), (2, 10, 0, 9), (1, 10, 0, 6)], "ctg long, read long, start int, end int")
    sites = spark.createDataFrame([(1, 5), (1, 2500), (2, 20)], "ctg long, pos long")
    got = calls.at_sites(df, placed, sites, bucket=100)
    assert rows(got) == [(1, 2500, 11, -1), (1, 5, 10, 0), (1, 5, 11, 0)]
    assert rows(calls.at_sites(df.where("false"), placed.where("false"), sites)) == []
