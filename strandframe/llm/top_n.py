"""The N best rows of every group by partition lower bounds.

Each partition sorts its own rows; the key of its local N-th row of a group is a lower bound of the group's N-th best key,
since N rows at least as good exist. The largest bound of a group is joined back to the rows before they are shuffled, rows
under it are dropped where they are and only the survivors are sent to their group and ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandframe.session import BROADCAST_ROWS, broadcast_if_small, cut, n_rows

#: Rows of a partition that are sorted at a time; each such part gives a bound.
PART = 500_000


def latest(df: DataFrame, key: str, when: str) -> DataFrame:
    """One row per ``key``: the one with the largest ``when`` (null lowest); equal times are settled by the other columns'
    order. A null key is a key like any other. Columns of any name are carried along."""
    rest = [c for c in df.columns if c not in (key, when)]
    best = df.groupBy(key).agg(F.max(F.struct(F.col(when), *[F.col(f"`{c}`") for c in rest])).alias("_r"))
    return best.select(key, *[F.col(f"_r.`{c}`").alias(c) for c in (when, *rest)])


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each row but the first differs from the row before; nulls are equal."""
    a, b = column[:-1], column[1:]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def _local_bounds(groups: int, n: int, part: int):
    """Of every group with at least n rows in a part of the partition: the n-th key and the number of rows."""

    def bounds(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        names = t.column_names
        keys = [(c, "ascending" if i < groups else "descending") for i, c in enumerate(names)]
        t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_end"))
        fresh = np.ones(t.num_rows, bool)
        fresh[1:] = reduce(np.logical_or, [_changes(t.column(i).combine_chunks()) for i in range(groups)])
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, t.num_rows))
        at, size = start[size >= n] + n - 1, size[size >= n]
        out = t.take(pa.array(at)).append_column("_rows", pa.array(size, pa.int64())).combine_chunks()
        return out.to_batches()[0] if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= part:
                if (out := bounds(held)) is not None:
                    yield out
                held, rows = [], 0
        if rows and (out := bounds(held)) is not None:
            yield out

    return run


def _ordered(order: Sequence[Column], df: DataFrame) -> list[Column]:
    """The order's columns; of a fraction first whether it is NaN, which ranks above every number."""
    out = []
    for c, kind in zip(order, df.select(*[c.alias(f"o{i}") for i, c in enumerate(order)]).schema, strict=True):
        if isinstance(kind.dataType, (T.FloatType, T.DoubleType)):
            nan = F.when(c.isNotNull(), F.isnan(c).cast("int"))
            out += [nan, F.when(nan == 1, F.lit(0.0)).otherwise(c)]
        else:
            out.append(c)
    return out


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], tie: str, n: int, part: int = PART) -> DataFrame:
    """The ``n`` rows of every group with the largest ``order`` (compared from left to right, null lowest, NaN highest).

    ``df`` is read twice and should be materialised. ``tie`` is a unique integer column; the smaller one wins among equal
    scores. Groups (of atomic columns) with fewer rows keep all, a null group is a group like any other, an empty table
    gives an empty table. Adds ``rank`` from 1 on, in place of a column of that name; other columns of any name are carried
    along. Bounds are kept of at most BROADCAST_ROWS groups, the largest ones; others are ranked without."""
    keys = [c.alias(f"k{i}") for i, c in enumerate([*_ordered(order, df), F.bitwise_not(F.col(tie))])]
    names = [f"g{i}" for i in range(len(group))]
    by = [F.col(f"`{c}`").alias(g) for c, g in zip(group, names, strict=True)]
    narrow = df.select(*by, *keys)
    local = narrow.mapInArrow(_local_bounds(len(group), n, part), T.StructType([*narrow.schema, T.StructField("_rows", T.LongType())]))
    key = F.struct(*[c for c in narrow.columns if c not in names])
    bounds = cut(local.groupBy(*names).agg(F.max(key).alias("bound"), F.sum("_rows").alias("_rows")))
    if n_rows(bounds) > BROADCAST_ROWS:
        total = bounds.agg(F.sum("_rows")).first()[0]
        bounds = bounds.where(F.col("_rows") > total / BROADCAST_ROWS)  # fewer than BROADCAST_ROWS groups
    bounds = broadcast_if_small(bounds.select(*[F.col(g).alias(f"b{g}") for g in names], "bound"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in group]).alias("row"), *by, F.struct(*keys).alias("key"))
    same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"b{g}")) for g in names])
    survivors = rows.join(bounds, same, "left").where(F.col("bound").isNull() | (F.col("key") >= F.col("bound"))).select("row", *names, "key")
    ranked = survivors.withColumn("place", F.row_number().over(Window.partitionBy(*names).orderBy(F.col("key").desc()))).where(F.col("place") <= n)
    held = dict(zip(group, names, strict=True))
    return ranked.select(*[(F.col(held[c]) if c in held else F.col(f"row.`{c}`")).alias(c) for c in df.columns if c != "rank"], F.col("place").alias("rank"))
