import random

from pyspark.sql import functions as F

from strandframe.llm.top_n import latest, top_n


def test_ties_nulls_and_small_groups(spark, rows):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([1, 2, 3, None]), i, "x") for i in range(500)] + [("one", None, 1000, "x")]
    df = spark.createDataFrame(data, "g string, s int, id long, extra string")
    got = rows(top_n(df, ["g"], [F.col("s")], "id", 3, part=50), "g", "id", "rank")
    want = []
    for g in {r[0] for r in data}:
        own = sorted((r for r in data if r[0] == g), key=lambda r: (-(r[1] if r[1] is not None else -99), r[2]))
        want += [(g, r[2], k + 1) for k, r in enumerate(own[:3])]
    assert got == sorted(want, key=repr)


def test_nan_ranks_first_and_bounds_drop_rows_before_the_shuffle(spark, rows):
    nan = float("nan")
    data = [("hot", float(i % 97) if i % 50 else nan, i) for i in range(2000)] + [("cold", None, 5000), ("cold", -0.0, 5001), ("cold", 0.0, 5002)]
    df = spark.createDataFrame(data, "g string, s double, id long").repartition(3)
    got = top_n(df, ["g"], [F.col("s")], "id", 2, part=400)
    assert rows(got, "g", "id", "rank") == [("cold", 5001, 1), ("cold", 5002, 2), ("hot", 0, 1), ("hot", 50, 2)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join LeftOuter")  # the join with the bounds lies below the ranking


def test_empty(spark, rows):
    assert rows(top_n(spark.createDataFrame([], "g string, s int, id long"), ["g"], [F.col("s")], "id", 3)) == []


def test_latest_takes_the_last_row_and_is_settled_on_ties(spark, rows):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (1, 7, "c"), (2, None, "d"), (2, None, None)], "k long, t int, v string")
    assert rows(latest(df, "k", "t"), "k", "v") == [(1, "c"), (2, "d")]


def test_clashing_names(spark, rows):
    df = spark.createDataFrame([("a", 1, 7, 0, 9, 8, "k"), ("a", 2, 6, 0, 9, 8, "k")], "g string, id long, s int, rank int, local int, slice int, `a.b` string")
    got = top_n(df, ["g"], [F.col("s")], "id", 1)
    assert rows(got, "g", "id", "local", "slice", "`a.b`", "rank") == [("a", 1, 9, 8, "k", 1)]
    assert latest(df, "g", "s").columns == ["g", "s", "id", "rank", "local", "slice", "a.b"]
