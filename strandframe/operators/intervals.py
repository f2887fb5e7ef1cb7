"""Joins of intervals by bins instead of nested loops.

Both sides are laid on bins of fixed width; a pair meets in every bin that both touch and is kept in the first of them,
so no duplicate has to be removed. Long intervals touch many bins, so the width should be near the usual length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return df.where(F.col(start) < F.col(end)).withColumn("_first", first).withColumn("_bin", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, key: str, width: int = 10_000, more: Column | None = None) -> DataFrame:
    """Pairs with equal ``key`` whose intervals (l_start, l_end), (r_start, r_end) share a base, and that meet ``more``.

    Intervals that are empty or have null fields meet nothing. Other columns must have different names."""
    l = _binned(left, "l_start", "l_end", width).withColumnRenamed("_first", "_lf")
    r = _binned(right, "r_start", "r_end", width).withColumnRenamed("_first", "_rf")
    on = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (F.col("_bin") == F.greatest("_lf", "_rf"))
    out = l.join(r, [key, "_bin"]).where(on if more is None else on & more)
    return out.drop("_bin", "_lf", "_rf")


def common_bases() -> Column:
    return F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
