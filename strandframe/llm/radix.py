"""Percentiles per group by radix selection over order-preserving integers.

A float's bits, with the sign turned into the integer's sign, order like the float. Counts per leading digit (prefix) of
these integers are the summary of a part of the data: summaries of partitions or days are combined by adding counts, and
their error is the width of a prefix, at most 2**-(bits - 12) of the value. Where a smaller error is asked for, only rows
under a prefix that holds a wanted rank are read again, digit by digit, down to the exact value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandframe.session import broadcast_if_small, cut

#: Bits of each digit; sign, exponent and eight bits of the fraction first.
DIGITS = (20, 16, 14, 14)


@F.arrow_udf(LongType())
def order_code(x: pa.Array) -> pa.Array:
    """A signed 64-bit integer that orders like the double ``x``; null for null and NaN, equal for 0.0 and -0.0.

    The bits of a double above zero order like integers; below zero the magnitude is negated."""
    value = x.to_numpy(zero_copy_only=False)
    bits = value.view(np.int64)
    size = bits & np.int64(0x7FFFFFFFFFFFFFFF)
    return pa.array(np.where(bits < 0, -size, size), mask=np.isnan(value))


def from_code(code: Column) -> Column:
    """The double whose ``order_code`` is ``code``."""
    size = F.abs(code)
    e, f = F.shiftright(size, 52), size.bitwiseAND(F.lit((1 << 52) - 1)).cast("double")
    value = F.when(e >= 2047, F.lit(float("inf"))).when(e == 0, f * F.lit(2.0**-1074)).otherwise((F.lit(1.0) + f * F.lit(2.0**-52)) * F.pow(F.lit(2.0), (e - 1023).cast("double")))
    return F.when(code < 0, -value).otherwise(value)


def long_form(df: DataFrame, keys: Sequence[str], metrics: dict[str, Column]) -> DataFrame:
    """(keys, metric, code): one row per row and metric with a value; null and NaN values are left out, repeated rows count
    each. Other columns may have any name; a key named like a column of the results is an error."""
    if clash := {"metric", "code", "prefix", "n", "level", "percent", "value", "max_error"} & set(keys):
        raise ValueError(f"keys named like columns of the results: {sorted(clash)}")
    # one trip to Python for all metrics; they are put into rows afterwards
    codes = df.select(*keys, *[order_code(x.cast("double")).alias(f"_c{i}") for i, x in enumerate(metrics.values())])
    items = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"_c{i}").alias("code")) for i, name in enumerate(metrics)])
    return codes.select(*keys, F.explode(items).alias("_i")).select(*keys, "_i.metric", "_i.code").where("code is not null")


def summary(rows: DataFrame, keys: Sequence[str], bits: int = DIGITS[0]) -> DataFrame:
    """(keys, metric, prefix, n): the combinable result of a part of the data."""
    return rows.groupBy(*keys, "metric", F.shiftright("code", 64 - bits).alias("prefix")).agg(F.count("code").alias("n"))


def combine(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of several parts as one, per ``keys``."""
    return parts.groupBy(*keys, "metric", "prefix").agg(F.sum("n").alias("n"))


def _pick(hist: DataFrame, percents: Sequence[int] | None) -> DataFrame:
    """The prefix that holds each target rank, and the rank within it. hist: grp, metric, prefix, n and, after the first
    digit, under, percent, rank, total. The window of a target has one row per value of a digit at most."""
    if percents is not None:
        w = Window.partitionBy("grp", "metric")
        hist = hist.withColumn("upto", F.sum("n").over(w.orderBy("prefix"))).withColumn("total", F.sum("n").over(w))
        hist = hist.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("rank", F.greatest(F.lit(1).cast("long"), F.expr("(total * percent + 99) div 100")))
    else:
        hist = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("grp", "metric", "percent").orderBy("prefix")))
    held = hist.where("rank <= upto and rank > upto - n")
    return held.select("grp", "metric", "percent", "total", "prefix", F.expr("rank - (upto - n)").alias("rank"))


def percentiles(rows: DataFrame, keys: Sequence[str], over: Sequence[str], percents: Sequence[int], digits: Sequence[int] = DIGITS) -> DataFrame:
    """Nearest-rank percentiles (whole numbers from 0 to 100) of ``long_form`` rows per ``keys`` and per ``over``, a part
    of the keys whose results come from the combined summaries of the keys.

    ``rows`` are read once for the first digit and once more for the few of them that the further digits need.

    Returns keys, level ("part" or "all"; keys not in ``over`` are null in "all"), metric, percent, n, value and
    max_error: the true percentile lies in [value, value + max_error] for values >= 0 and is ``value`` if all 64 bits
    were followed. Null keys form groups of their own. Groups without values give no row."""
    rest = [k for k in keys if k not in over]
    types = {k: rows.schema[k].dataType for k in keys}

    def group(level: str) -> Column:
        return F.struct(F.lit(level).alias("level"), *[(F.lit(None).cast(types[k]) if level == "all" and k in rest else F.col(k)).alias(k) for k in keys])

    parts = cut(summary(rows, keys, digits[0]))
    hist = parts.select(group("part").alias("grp"), "metric", "prefix", "n")
    levels = ["part"]
    if list(over) != list(keys):
        hist = hist.unionByName(combine(parts, over).select(group("all").alias("grp"), "metric", "prefix", "n"))
        levels.append("all")
    targets = cut(_pick(hist, percents))
    alive = rows.select(F.explode(F.array(*[group(lv) for lv in levels])).alias("grp"), "metric", "code")
    bits = digits[0]
    for d in digits[1:]:
        active = broadcast_if_small(cut(targets.select("grp", "metric", F.col("prefix").alias("under")).distinct()))
        # after the first digit only the rows under a wanted prefix are kept
        alive = cut(alive.withColumn("under", F.shiftright("code", 64 - bits)).join(active, ["grp", "metric", "under"]).select("grp", "metric", "under", "code"))
        bits += d
        hist = alive.groupBy("grp", "metric", "under", F.shiftright("code", 64 - bits).alias("prefix")).agg(F.count("code").alias("n"))
        aim = broadcast_if_small(targets.withColumnRenamed("prefix", "under"))
        targets = cut(_pick(hist.join(aim, ["grp", "metric", "under"]), None))
        alive = alive.drop("under")
    shift = 64 - bits
    low = F.shiftleft("prefix", shift) if shift else F.col("prefix")
    high = F.shiftleft(F.col("prefix") + 1, shift) if shift else F.col("prefix")
    # of a negative value the prefix holds the values from high (its magnitude's floor) down to low
    value = from_code(low)
    return targets.select(*[F.col(f"grp.`{k}`").alias(k) for k in keys], F.col("grp.level").alias("level"), "metric", "percent", F.col("total").alias("n"), value.alias("value"), (from_code(high) - value).alias("max_error"))
