import math
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.llm import radix


def test_codes_are_the_bits_and_order(spark):
    xs = [0.0, -0.0, 1.0, -1.0, 1.5, 2.0, 1.9999999999999998, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), float("-inf"), 0.1, 3.0e-310, 2.0**1000, 2.0**-1000]
    rnd = random.Random(3)
    xs += [struct.unpack("d", rnd.randbytes(8))[0] for _ in range(3000)]
    xs = [x for x in xs if not math.isnan(x)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", radix.order_code(F.col("x")).alias("c"))
    got = df.select("x", "c", radix.from_code(F.col("c")).alias("back")).collect()
    for r in got:
        bits = struct.unpack("q", struct.pack("d", abs(r["x"])))[0]
        assert r["c"] == (-bits if r["x"] < 0 else bits)
        assert r["back"] == r["x"]
    missing = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(radix.order_code(F.col("x")).alias("c")).collect()
    assert [r["c"] for r in missing] == [None, None]


def disc(values, p):
    s = sorted(values)
    return s[max(1, -(-len(s) * p // 100)) - 1]


def run(spark, data, **kw):
    df = spark.createDataFrame(data, "lib string, day int, x double")
    long = radix.long_form(df, ["lib", "day"], {"x": F.col("x"), "neg": -F.col("x")})
    return {(r["lib"], r["day"], r["level"], r["metric"], r["percent"]): r for r in radix.percentiles(long, ["lib", "day"], ["lib"], [0, 50, 90, 99, 100], **kw).collect()}


def test_exact_with_ties_nulls_and_null_keys(spark):
    rnd = random.Random(2)
    data = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.choice([rnd.gauss(0, 100), 7.0, 0.0, None, float("nan")])) for _ in range(900)] + [("empty", 1, None)]
    got = run(spark, data)
    ok = [r for r in data if r[2] is not None and not math.isnan(r[2])]
    seen = set()
    for lib in ("a", "b", None):
        for day in (1, 2, None, "all"):
            vals = [x for a, d, x in ok if a == lib and (day == "all" or d == day)]
            key = (lib, None, "all") if day == "all" else (lib, day, "part")
            for metric, v in (("x", vals), ("neg", [-x for x in vals])):
                for p in (0, 50, 90, 99, 100):
                    r = got[(*key, metric, p)]
                    seen.add((*key, metric, p))
                    assert (r["value"], r["n"], r["max_error"]) == (disc(v, p), len(v), 0.0)
    assert seen == set(got)


def test_bounded_error_from_summaries(spark):
    data = [("a", d, float(x)) for d in (1, 2, 3) for x in range(1, 400)]
    got = run(spark, data, digits=radix.DIGITS[:1])
    for p in (50, 90, 99):
        r = got[("a", None, "all", "x", p)]
        true = disc([x for _, _, x in data], p)
        assert r["value"] <= true <= r["value"] + r["max_error"] and r["max_error"] <= true / 200
    df = spark.createDataFrame(data, "lib string, day int, x double")
    long = radix.long_form(df, ["lib", "day"], {"x": F.col("x")})
    days = radix.combine(radix.summary(long, ["lib", "day"]), ["lib"])
    whole = radix.summary(long, ["lib"])
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, whole.collect()))


def test_empty(spark):
    assert run(spark, []) == {}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=40))
def test_any_values(spark, xs):
    got = run(spark, [("a", 1, x) for x in xs])
    assert got[("a", None, "all", "x", 50)]["value"] == disc(xs, 50)


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 2.0, "x", 5)], "lib string, day int, x double, metric string, code int")
    got = radix.percentiles(radix.long_form(df, ["lib", "day"], {"x": F.col("x")}), ["lib", "day"], ["lib"], [50]).collect()
    assert {(r["level"], r["value"]) for r in got} == {("part", 2.0), ("all", 2.0)}
    with pytest.raises(ValueError):
        radix.long_form(df, ["metric"], {"x": F.col("x")})
