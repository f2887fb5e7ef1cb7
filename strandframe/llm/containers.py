"""Filling containers of fixed capacity with items of varying length.

Items longer than the capacity are cut into full pieces and a rest. The packing itself is computed on the histogram of
sizes, at most ``capacity`` rows on the driver whatever the corpus; items then look up their container by their rank
among the items of their size. Ranks are counted over hashed slices, so a size that a third of all items share is no
single task's work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm import binfill
from strandframe.session import cut

#: Slices of the items of one size that are ranked apart.
SLICES = 1024


def pieces(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """(item, piece_no, piece_start, piece_end, size): one row per piece; an item of size 0 or null has one empty piece."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("int")
    rows = items.select(F.col(item), n.alias("_n")).withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"(_n - 1) div {capacity}").cast("int")))))
    start = F.col("piece_no") * capacity
    end = F.least(start + capacity, F.col("_n"))
    return rows.select(item, "piece_no", start.alias("piece_start"), end.alias("piece_end"), (end - start).alias("size"))


def ranked(rows: DataFrame, by: str, order: list[str], slices: int = SLICES) -> DataFrame:
    """Adds ``rank``, 0 on, among the rows of the same ``by``, in an order fixed by the hash of ``order``."""
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = F.sum("_k").over(Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(by, "_slice").agg(F.count(F.lit(1)).alias("_k")).select(by, "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    local = rows.withColumn("_local", F.row_number().over(Window.partitionBy(by, "_slice").orderBy(*order)))
    return local.join(offsets, [by, "_slice"]).withColumn("rank", F.col("_before") + F.col("_local") - 1).drop("_slice", "_before", "_local")


def fill(items: DataFrame, item: str, size: str, capacity: int, nodes: int = binfill.NODES) -> DataFrame:
    """(item, piece_no, piece_start, piece_end, size, container) with containers numbered from 0.

    Every piece is in exactly one container; empty pieces have a null container. Repeated rows of an item are items of
    their own. An empty table gives an empty table."""
    rows = cut(pieces(items, item, size, capacity))
    full = rows.where(F.col("size") > 0)
    # at most ``capacity`` rows
    counts = {int(s): int(n) for s, n in full.groupBy("size").agg(F.count(F.lit(1))).collect()}
    first: dict[int, int] = {}
    table: list[tuple[int, int, int, int]] = []
    container = 0
    for times, pattern in binfill.complete(counts, capacity, nodes):
        for s, m in pattern:
            at = first.get(s, 0)
            table.append((s, at, container, m))
            first[s] = at + times * m
        container += times
    table.sort()
    sizes, starts, containers, per = (np.array(x, np.int64) for x in zip(*table, strict=True)) if table else (np.zeros(0, np.int64),) * 4
    keys = (sizes << 44) + starts

    @F.pandas_udf("long")
    def place(s: pd.Series, r: pd.Series) -> pd.Series:
        r = r.to_numpy(np.int64)
        i = np.searchsorted(keys, (s.to_numpy(np.int64) << 44) + r, side="right") - 1
        return pd.Series(containers[i] + (r - starts[i]) // per[i])

    placed = ranked(full, "size", [item, "piece_no"]).withColumn("container", place("size", "rank")).drop("rank")
    return placed.unionByName(rows.where(F.col("size") <= 0).withColumn("container", F.lit(None).cast("long")))


def fills(placed: DataFrame) -> DataFrame:
    """(container, items, used): the fill of each container."""
    return placed.where("container is not null").groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").cast("long").alias("used"))
