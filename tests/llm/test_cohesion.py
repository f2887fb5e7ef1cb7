import os
import random
from collections import Counter
from math import sqrt

import pytest

from strandframe.llm import cohesion


def direct(units, block):
    weight = cohesion.weights(units)
    out = []
    for i in range(1, len(units)):
        a, b = (Counter(w for u in side for w in u) for side in (units[max(0, i - block) : i], units[i : i + block]))
        na, nb = (sum(x * x * weight[w] for w, x in side.items()) for side in (a, b))
        out.append(sum(n * b[w] * weight[w] for w, n in a.items()) / sqrt(na * nb) if na and nb else 0.0)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_similarities_in_one_pass(seed):
    rnd = random.Random(seed)
    units = [[rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 5))] for _ in range(rnd.randrange(1, 30))]
    for block in (1, 3, 6):
        assert cohesion.similarities(units, block) == pytest.approx(direct(units, block))


def split(spark, texts, limit, overlap):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    out = {}
    for r in cohesion.split_texts(df, "id", "text", limit, overlap).orderBy("id", "piece_no").collect():
        out.setdefault(r["id"], []).append((r["piece_start"], r["piece_end"]))
    return out


def topic(rnd, words, end=" "):
    return " ".join(" ".join(rnd.choice(words) for _ in range(8)) + "." for _ in range(30)) + end


def test_cuts_where_the_topic_changes(spark):
    rnd = random.Random(1)
    first, second = topic(rnd, "read graph edge node path".split()), topic(rnd, "soup salt pepper onion garlic".split())
    got = split(spark, [first + second], len(first) + 200, 20)
    assert abs(got[0][0][1] - len(first)) < 60


def test_rules_hold_on_any_text(spark):
    rnd = random.Random(2)
    texts = ["x" * 1000, "", "a. " * 500, "读段的组装。" * 300, "\n" * 900, "".join(rnd.choice("ab .!?\n。") for _ in range(3000)), "no border at all " * 60]
    out = split(spark, texts, 100, 10)
    for i, t in enumerate(texts):
        got = out.get(i, [])
        assert (got == []) == (t == "")
        if got:
            assert got[0][0] == 0 and got[-1][1] == len(t)
            assert all(0 < b - a <= 100 for a, b in got) and all(y[0] == x[1] - 10 for x, y in zip(got, got[1:], strict=False))


DATA = "/root/testdata/sf0.1/documents.parquet"


@pytest.mark.skipif(not os.path.isfile(DATA), reason="the driver's tables are not here")
def test_finds_planted_joins(spark):
    """Documents of two kinds put one after the other: the best border of the first window lies at the join for at least half
    of the pairs, where a random paragraph would in less than a tenth."""
    docs = spark.read.parquet(DATA).where("text is not null and n_chars between 3000 and 7500").select("doc_id", "text", "lang", "source").orderBy("doc_id").toPandas()
    english, other = docs[(docs.lang == "en") & (docs.source != "run_log")].text.tolist(), docs[docs.lang.isin(["de", "fr", "es"])].text.tolist()
    pairs = [(a, b) for a, b in zip(english, other, strict=False) if len(a) + len(b) > 8000][:40]
    hits = 0
    for a, b in pairs:
        best = max((level, depth, at) for at, level, depth in cohesion.borders(a + "\n\n" + b) if 200 < at <= 8000)
        hits += abs(best[2] - len(a) - 2) <= 150
    assert hits * 2 >= len(pairs) > 20


def test_frames(spark, rows):
    docs = [(1, "word here. " * 50), (2, "short"), (3, None), (4, ""), (5, "word here. " * 50), (5, "word here. " * 50), (None, "y" * 250)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "7 as piece_no")
    got = rows(cohesion.split_texts(df, "doc_id", "text", 100, 10))
    assert {r[0] for r in got} == {1, 5, None} and len([r for r in got if r[0] == 5]) == 2 * len([r for r in got if r[0] == 1])
    assert rows(cohesion.split_texts(df.where("false"), "doc_id", "text", 100, 10)) == []
