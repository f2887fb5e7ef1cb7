"""Selections by size, sampling, and greedy choices within bounded groups."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.prefix import running_sum
from strandframe.session import cut


def length_for_total(df: DataFrame, length: str, total: int) -> int:
    """The largest length such that all items at least as long hold ``total`` in sum; 0 if all items do not."""
    hist = df.where(F.col(length) > 0).groupBy((-F.col(length).cast("long")).alias("neg")).agg((F.count(F.lit(1)) * F.max(length)).cast("long").alias("bases"))
    found = running_sum(hist, [], "neg", "bases", "cum").where(F.col("cum") >= total).agg(F.min("neg")).first()[0]
    return 0 if found is None else -found


def longest_to_total(df: DataFrame, length: str, total: int) -> DataFrame:
    """The longest items that together reach ``total``; items as long as the shortest of them stay as well."""
    return df.where(F.col(length) >= length_for_total(df, length, total))


def drawn(key: Column, seed: int = 0) -> Column:
    """A number from 0 to 2**30 - 1 that depends on the key and the seed alone and is the same in any engine: the first eight
    digits of the MD5 of ``key:seed``, less two bits."""
    return F.shiftright(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long"), 2)


def sample_to_total(df: DataFrame, key: Column, length: str, total: int, seed: int = 0) -> DataFrame:
    """Items drawn by a seeded hash of ``key`` with the share that gives about ``total`` in sum; the draw of an item does
    not depend on the others or on the partitioning."""
    whole = df.agg(F.sum(length)).first()[0] or 0
    if whole <= total:
        return df
    return df.where(drawn(key, seed) < int(total / whole * (1 << 30)))


def serpentine(df: DataFrame, order: Sequence[Column], bins: int) -> DataFrame:
    """Items in order dealt to ``bins`` bins forth and back."""
    r = F.col("_r")
    turn, k = F.floor(r / bins), r % bins
    return numbered(df, order, "_r").withColumn("bin", F.when(turn % 2 == 0, k).otherwise(bins - 1 - k).cast("int")).drop("_r")


def blocks(df: DataFrame, order: str, size: str, block: int, shards: int = 64) -> DataFrame:
    """Adds ``shard`` and ``block``: consecutive items in the same block until their sum reaches ``block``, then a new one.

    This is a walk, not a division of the running sum, so it runs per shard (by hash of ``order``) over sorted batches and
    keeps no more than a running sum; numbers are unique as (shard, block)."""
    rows = df.withColumn("shard", F.pmod(drawn(F.col(order)), F.lit(shards)).cast("int"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, block int"

    def walk(parts):
        shard, held, number = None, 0, 0
        for p in parts:
            out = []
            for s, n in zip(p["shard"], p[size].fillna(0), strict=True):
                if s != shard:
                    shard, held, number = s, 0, 0
                out.append(number)
                held += n
                if held >= block:
                    held, number = 0, number + 1
            yield p.assign(block=pd.array(out, dtype="int32"))

    return rows.repartition("shard").sortWithinPartitions("shard", order).mapInPandas(walk, schema)


def first_matching_set(df: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """Every row with the first set (smallest ``place``) that holds the name in ``a`` or ``b``; rows of no set are left out.

    ``sets`` has (name, place)."""
    first = sets.groupBy("name").agg(F.min("place").alias("place"))
    x = first.select(F.col("name").alias(a), F.col("place").alias("_pa"))
    y = first.select(F.col("name").alias(b), F.col("place").alias("_pb"))
    return df.join(x, a, "left").join(y, b, "left").withColumn("place", F.least("_pa", "_pb")).where("place is not null").drop("_pa", "_pb")


def spread_placements(df: DataFrame, key: str, start: str, end: str, order: str, most: int, share: float = 0.5) -> DataFrame:
    """Per key at most ``most`` placements, best ``order`` first, none of which shares more than ``share`` of its length with
    one chosen before. A key is a read; its placements fit one task."""
    schema = df.schema

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([order, start, end], ascending=[False, True, True], kind="stable")
        taken: list[tuple[int, int]] = []
        keep = []
        for i, (s, e) in enumerate(zip(p[start], p[end], strict=True)):
            if len(taken) < most and all(min(e, y) - max(s, x) <= share * (e - s) for x, y in taken):
                taken.append((s, e))
                keep.append(i)
        return p.iloc[keep]

    return df.groupBy(key).applyInPandas(choose, schema)


def greedy_matching(links: Sequence[tuple[object, object, float]]) -> list[tuple[object, object, float]]:
    """Links by falling score, ties by ends, each end used once. For the condensed contig graph, on the driver."""
    used: set[object] = set()
    out = []
    for a, b, s in sorted(links, key=lambda x: (-x[2], str(x[0]), str(x[1]))):
        if a != b and a not in used and b not in used:
            used |= {a, b}
            out.append((a, b, s))
    return out


def neighbour_groups(neighbours: dict[object, list[object]], sizes: dict[object, int], most: int) -> list[list[object]]:
    """Items in groups of at most ``most`` in sum, taken breadth first from the largest item left; ties by name.

    For names and sizes that fit the driver (the blocks of one correction job); an item larger than ``most`` is alone."""
    left = dict(sizes)
    out: list[list[object]] = []
    while left:
        start = min(left, key=lambda n: (-left[n], str(n)))
        group, total, queue = [], 0, [start]
        while queue:
            n = queue.pop(0)
            if n not in left or (group and total + left[n] > most):
                continue
            total += left.pop(n)
            group.append(n)
            queue.extend(sorted((x for x in neighbours.get(n, ()) if x in left), key=lambda x: (-left[x], str(x))))
        out.append(group)
    return out


def numbered(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds ``name``: the rank of every row from 0 on in the order of ``order``, ties in any order.

    Rows are sorted by ranges; ranges are counted and each starts where the ones before it end, so no task sees all rows."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_p")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))  # one row per range
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = ranged.withColumn("_p", part).join(F.broadcast(before), "_p")
    return out.select(*df.columns, (F.col("_before") + F.col("_at") - F.shiftleft("_p", 33)).alias(name))
