"""Per-key results when a few keys hold most of the rows: value-frequency compression.

Rows are grouped by (key, value) first. A heavy key is thereby spread over its distinct values, the map-side
combine shrinks each task's rows to those pairs, and a second, far smaller grouping by key works on weighted values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compress(df: DataFrame, keys: Sequence[str], value: Column, name: str = "value") -> DataFrame:
    """One row per (keys, value) with its number of rows, ``freq``. Null keys and null values are groups of their own."""
    out = df.select(*keys, value.alias(name))
    return out.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("freq"))


def totals(pairs: DataFrame, keys: Sequence[str], name: str = "value") -> DataFrame:
    """n_rows, total, n_distinct, mode (smallest of the most frequent values) per key from ``compress``.

    A null value counts in n_rows alone. A key with only null values has n_distinct 0, null total and null mode."""
    v, f = F.col(name), F.col("freq")
    return pairs.groupBy(*keys).agg(
        F.sum(f).alias("n_rows"),
        F.sum(v * f).alias("total"),
        F.count(v).alias("n_distinct"),
        F.max(F.when(v.isNotNull(), F.struct(f.alias("f"), (-v).alias("v")))).alias("_m"),
    ).withColumn("mode", -F.col("_m.v")).drop("_m")


def select_ranks(pairs: DataFrame, keys: Sequence[str], ranks: dict[str, str], name: str = "value", width: float = 1024) -> DataFrame:
    """The value at each rank (1 on, a SQL expression over the key's total frequency ``_n``) per key from ``compress``.

    Two steps keep the window of a heavy key small: the cumulative frequency over buckets of ``width`` tells each rank's
    bucket, then only the values of these buckets are accumulated. Returns keys, rank_name, n, value. Null values do not
    count, null keys form one group. A rank outside 1.._n gives no row."""
    v = F.col(name)
    p = pairs.where(v.isNotNull()).withColumn("_b", F.floor(v / width).cast("long"))
    buckets = p.groupBy(*keys, "_b").agg(F.sum("freq").alias("_bf"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    buckets = buckets.withColumn("_upto", F.sum("_bf").over(w.orderBy("_b"))).withColumn("_n", F.sum("_bf").over(w))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("rank_name"), F.expr(x).cast("long").alias("rank")) for k, x in ranks.items()]))
    targets = (
        buckets.select("*", wanted.alias("_w"))
        .select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_b").alias("_tb"), F.col("_n").alias("n"), "_w.rank_name", (F.col("_w.rank") - (F.col("_upto") - F.col("_bf"))).alias("_rank"), "_bf")
        .where("_rank between 1 and _bf")
        .drop("_bf")
    )
    on = F.col("_b") == F.col("_tb")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    inner = Window.partitionBy(*keys, "rank_name").orderBy(name)
    hit = p.join(targets, on).withColumn("_c", F.sum("freq").over(inner))
    return hit.where(F.col("_c") >= F.col("_rank")).groupBy(*keys, "rank_name", "n").agg(F.min(name).alias("value"))


def percentiles(pairs: DataFrame, keys: Sequence[str], percents: Sequence[int], name: str = "value", width: float = 1024) -> DataFrame:
    """Exact nearest-rank percentiles (percent in whole numbers) per key: keys, percent, value."""
    ranks = {str(p): f"greatest(1, (_n * {p} + 99) div 100)" for p in percents}
    return select_ranks(pairs, keys, ranks, name, width).select(*keys, F.col("rank_name").cast("int").alias("percent"), "value")


#: The element at n // 2 of the sorted values.
UPPER_MEDIAN = "_n div 2 + 1"
#: The first value at which the cumulative frequency reaches half of the total.
HALF_WEIGHT = "(_n + 1) div 2"


def median_deviation(pairs: DataFrame, keys: Sequence[str], rank: str = UPPER_MEDIAN, name: str = "value", width: float = 1024) -> DataFrame:
    """keys, n, median, mad: a median and the same median of the absolute deviations from it. At least one key; keys must
    not be null.

    ``freq`` may hold weights (whole numbers), with HALF_WEIGHT for a weighted median."""
    mid = select_ranks(pairs, keys, {"m": rank}, name, width).select(*keys, "n", F.col("value").alias("median"))
    dev = pairs.where(F.col(name).isNotNull()).join(mid, list(keys))
    dev = dev.groupBy(*keys, F.abs(F.col(name) - F.col("median")).alias("value")).agg(F.sum("freq").alias("freq"))
    mad = select_ranks(dev, keys, {"m": rank}, "value", width).select(*keys, F.col("value").alias("mad"))
    return mid.join(mad, list(keys))


def heavy(per_key: DataFrame, key: str, total_rows: int, percent: int) -> DataFrame:
    """Keys with at least ``percent`` per cent of ``total_rows`` (a number the caller counted)."""
    return per_key.where(F.col("n_rows") * 100 >= F.lit(int(total_rows)) * percent).select(key)
