"""Running sums and neighbours along a coordinate, in two levels.

A plain window sorts all rows of a key in one task. Here the coordinate is cut into buckets: sums and borders of the
buckets run over one row per bucket, and a task sorts one bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Coordinates in a bucket.
BUCKET = 1 << 16


def _bucketed(df: DataFrame, pos: str, bucket: int) -> DataFrame:
    return df.withColumn("_b", F.floor(F.col(pos) / bucket).cast("long"))


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, value: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows of the key up to this position. (keys, pos) must be unique and
    not null."""
    rows = _bucketed(df, pos, bucket)
    local = F.sum(value).over(Window.partitionBy(*keys, "_b").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("_local", local).join(sums, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_b", "_local", "_before")


def next_position(df: DataFrame, keys: Sequence[str], pos: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``name``: the next larger position of the key, null for the last. (keys, pos) must be unique and not null."""
    rows = _bucketed(df, pos, bucket)
    local = F.lead(pos).over(Window.partitionBy(*keys, "_b").orderBy(pos))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    firsts = rows.groupBy(*keys, "_b").agg(F.min(pos).alias("_first"))
    firsts = firsts.select(*keys, "_b", F.lead("_first").over(part.orderBy("_b")).alias("_after"))
    return rows.withColumn("_local", local).join(firsts, [*keys, "_b"]).withColumn(name, F.coalesce("_local", "_after")).drop("_b", "_local", "_after")


def haloed(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Every row once in its own bucket of positions (``_real``), and again in the buckets whose rows it lies within
    ``before`` positions before or ``after`` positions behind: a window over (keys, ``_b``) of that reach sees all it needs
    for the real rows. Buckets are at least as wide as the reach, so a row is in three of them at most. A null position
    stays alone."""
    width = max(bucket, before, after)
    own = F.floor(F.col(pos) / width).cast("long")
    near = F.array_distinct(F.array(F.floor((F.col(pos) - after) / width).cast("long"), own, F.floor((F.col(pos) + before) / width).cast("long")))
    return df.withColumn("_b", F.explode(near)).withColumn("_real", F.coalesce(F.col("_b") == own, F.lit(True)))


def running_max_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``name``: the largest ``value`` of the key's rows that come earlier in the order, null for the first one. The first
    column of the order is a position and not null."""
    rows = _bucketed(df, order[0], bucket)
    local = F.max(value).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    tops = rows.groupBy(*keys, "_b").agg(F.max(value).alias("_m"))
    tops = tops.select(*keys, "_b", F.max("_m").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return rows.withColumn("_local", local).join(tops, [*keys, "_b"]).withColumn(name, F.greatest("_before", "_local")).drop("_b", "_local", "_before")


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Adds ``name``: how many rows of the key up to this one in the order have a ``flag`` of 1; equal rows in any order."""
    rows = _bucketed(df, order[0], bucket)
    local = F.sum(flag).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sums = rows.groupBy(*keys, "_b").agg(F.sum(flag).alias("_s"))
    sums = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(part.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("_local", local).join(sums, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_b", "_local", "_before")
