"""Link groups against union-find."""

import random

import pytest

from strandframe.llm.components import groups, links


def union_find(pairs):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is None or b is None or -1 in (a, b) or a == b:
            continue
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return sorted((x, top(x)) for x in list(up))


def star(c, n, base):
    return [(c, base + i) for i in range(n)]


CASES = {
    "path": [(i, i + 1) for i in range(40)],
    "ring": [(i, (i + 1) % 9) for i in range(9)],
    "two rings and a bridge": [(i, (i + 1) % 5) for i in range(5)] + [(10 + i, 10 + (i + 1) % 7) for i in range(7)] + [(3, 12)],
    "star": star(50, 60, 100),
    "clique": [(i, j) for i in range(8) for j in range(i)],
    "ids and nulls": [(None, 1), (-1, 2), (3, 3), (4, 5), (5, 4), (7, None), (6, -1)],
}


@pytest.mark.parametrize("name", CASES)
def test_shapes(spark, rows, name):
    df = spark.createDataFrame(CASES[name], "a long, b long")
    assert rows(groups(links(df, "a", "b"))) == sorted(union_find(CASES[name]), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, rows, seed):
    rnd = random.Random(seed)
    n = 300
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range((150, 280, 900)[seed])]
    pairs += [(1000 + i, 1000 + (i * 7 + 1) % 30) for i in range(30)] + star(5000, 80, 6000)
    df = spark.createDataFrame(pairs, "a long, b long")
    assert rows(groups(links(df, "a", "b"))) == sorted(union_find(pairs), key=repr)


def test_empty(spark, rows):
    assert rows(groups(links(spark.createDataFrame([], "a long, b long"), "a", "b"))) == []
