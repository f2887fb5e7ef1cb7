import itertools
import random

import pytest

from strandframe.llm import binfill, containers


def fewest(sizes, cap):
    """The least number of bins, by trying all placements."""
    best = len(sizes)
    sizes = sorted(sizes, reverse=True)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= cap and bins[j] not in bins[:j]:
                go(i + 1, [*bins[:j], bins[j] + sizes[i], *bins[j + 1 :]])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best


def check(counts, cap, patterns):
    got = {}
    for times, p in patterns:
        assert times > 0 and sum(s * m for s, m in p) <= cap
        for s, m in p:
            got[s] = got.get(s, 0) + m * times
    assert got == {s: n for s, n in counts.items() if n}
    return sum(t for t, _ in patterns)


@pytest.mark.parametrize("seed", range(40))
def test_small_packings_are_optimal(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 20, 37])
    sizes = [rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 10))]
    counts = {s: sizes.count(s) for s in sizes}
    assert check(counts, cap, binfill.complete(counts, cap)) == fewest(sizes, cap)


def test_bin_completion_beats_best_fit():
    counts, cap = {6: 1, 5: 2, 4: 2, 3: 2}, 15
    assert check(counts, cap, binfill.complete(counts, cap)) == fewest([6, 5, 5, 4, 4, 3, 3], cap) == 2
    assert check(counts, cap, binfill.best_fit(counts, cap)) >= 2


@pytest.mark.parametrize("seed", range(5))
def test_large_histograms_stay_close_to_the_bound(seed):
    rnd = random.Random(seed)
    cap = 512
    counts = {s: rnd.randrange(0, 2_000_000 // s) for s in range(1, cap + 1)}
    counts = {s: n for s, n in counts.items() if n}
    bins = check(counts, cap, binfill.complete(counts, cap, nodes=1500))
    assert bins <= 1.001 * binfill.lower_bound(counts, cap) + 1


def test_fillings_are_undominated_and_start_with_the_least_waste():
    got = [f for f in binfill.fillings({7: 1, 5: 2, 4: 1, 3: 3}, 10) if f]
    waste = [w for w, _ in got]
    assert waste == sorted(waste) and waste[0] == 0
    flat = [sorted(s for s, m in f for _ in range(m)) for _, f in got]
    for a, b in itertools.permutations(flat, 2):
        assert a != b and not (len(a) == len(b) and all(x <= y for x, y in zip(sorted(a), sorted(b), strict=True)) and flat.index(b) < flat.index(a))
    assert list(binfill.fillings({10: 4, 7: 1, 3: 1}, 10)) == [(0, ((10, 1),))]


def test_every_piece_once(spark, rows):
    rnd = random.Random(8)
    items = [(i, rnd.choice([0, 1, 5, 30, 30, 30, 64, 99, 100, 101, 250, 777])) for i in range(400)] + [(900, None), (901, 30), (901, 30), (None, 12)]
    df = spark.createDataFrame(items, "doc long, n int")
    out = containers.fill(df, "doc", "n", 100).collect()
    used, per = {}, {}
    for r in out:
        per.setdefault(r["doc"], []).append((r["piece_start"], r["piece_end"]))
        assert r["size"] == r["piece_end"] - r["piece_start"]
        assert (r["container"] is None) == (r["size"] == 0)
        if r["size"]:
            used.setdefault(r["container"], []).append(r["size"])
    assert all(sum(v) <= 100 for v in used.values()) and sorted(used) == list(range(len(used)))
    for doc, n in items:
        if doc != 901:
            n = n or 0
            assert sorted(per[doc]) == [(a, min(n, a + 100)) for a in range(0, max(n, 1), 100)]
    assert sorted(per[901]) == [(0, 30), (0, 30)]
    total = sum(n or 0 for _, n in items)
    assert len(used) <= 1.03 * -(-total // 100)
    got = rows(containers.fills(containers.fill(df, "doc", "n", 100)), "items", "used")
    assert sum(u for _, u in got) == total


def test_empty(spark, rows):
    assert rows(containers.fill(spark.createDataFrame([], "doc long, n int"), "doc", "n", 100)) == []
