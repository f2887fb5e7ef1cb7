"""Window splitting against a walk in Python."""

import random

import pytest

from strandframe.llm.windows import split_items

JOBS = "job long, seq long, start long, end long"
JOINTS = "seq long, pos long, level int, depth double"


def walk(jobs, joints, limit, overlap):
    out = []
    for job, seq, start, end in jobs:
        if None in (job, seq, start, end) or end - start <= limit:
            continue
        ends = sorted((v or 0, d or 0.0, p) for s, p, v, d in joints if s == seq and p is not None)
        p = start
        while end - p > limit:
            fit = [e for e in ends if p + overlap < e[2] <= p + limit]
            b = fit[-1][2] if fit else p + limit
            out.append((job, p, b))
            p = b - overlap
        out.append((job, p, end))
    return sorted(out)


@pytest.mark.parametrize("flat", [True, False])
def test_random_against_walk(spark, rows, flat):
    rnd = random.Random(5)
    weight = (lambda: (0, 0.0)) if flat else (lambda: (rnd.randrange(2), rnd.choice([0.0, 0.5, 1.5])))
    joints = [(s, rnd.randrange(0, 4000), *weight()) for s in range(4) for _ in range((0, 3, 40, 300)[s])]
    joints += [(2, None, 1, 2.0), (2, 777, 0, 0.0), (2, 777, 0, 0.0)]
    jobs = [(i, rnd.randrange(5), a := rnd.randrange(0, 2000), a + rnd.randrange(0, 2500)) for i in range(120)]
    jobs += [(500, 3, 0, 100), (501, 3, 0, 101), (502, None, 0, 900), (503, 1, None, 900), (504, 1, 0, None), (505, 0, 100, 4500)]
    got = split_items(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(joints, JOINTS), 100, 7)
    assert rows(got, "job", "piece_start", "piece_end") == sorted(walk(jobs, joints, 100, 7), key=repr)


def test_empty(spark, rows):
    got = split_items(spark.createDataFrame([], JOBS), spark.createDataFrame([], JOINTS), 100, 7)
    assert rows(got) == []


def test_hot_sequence(spark, rows):
    jobs = [(i, 1, i % 3, 1000) for i in range(200)]
    joints = [(1, x, 0, 0.0) for x in range(0, 1000, 9)]
    got = split_items(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(joints, JOINTS), 120, 20)
    assert rows(got, "job", "piece_start", "piece_end") == sorted(walk(jobs, joints, 120, 20), key=repr)
