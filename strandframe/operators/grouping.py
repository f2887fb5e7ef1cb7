"""Grouping overlaps by read, ranking within pairs, and containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.overlap import CONTAINED, CONTAINING, EQUAL, aligned_length, location


def best_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], tie: str) -> DataFrame:
    """The row with the largest ``order``, then the smallest ``tie``, per group, by one aggregation with map-side combine.

    Nulls come last in the order; null keys form groups."""
    key = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.bitwise_not(F.col(tie)).alias("_t"))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), key).alias("_r")).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def both_sides(df: DataFrame) -> DataFrame:
    """Every overlap under both of its reads: ``read``, ``other`` and the columns of the overlap."""
    return df.withColumn("_s", F.explode(F.array(F.struct(F.col("a_id").alias("read"), F.col("b_id").alias("other")), F.struct(F.col("b_id").alias("read"), F.col("a_id").alias("other"))))).select("_s.*", *df.columns)


def best_neighbours(df: DataFrame) -> DataFrame:
    """The longest overlap of every read with every other read, seen from both."""
    return best_per_group(both_sides(df).withColumn("aligned", aligned_length()), ["read", "other"], [F.col("aligned")], "ol_id")


def duplicates(df: DataFrame) -> DataFrame:
    """Every overlap with ``rank`` in its unordered pair (1 for the best by aligned size, then id) and ``n`` of the pair."""
    pair = [F.least("a_id", "b_id"), F.greatest("a_id", "b_id")]
    w = Window.partitionBy(*pair)
    size = aligned_length() * F.col("identity")
    return df.withColumn("rank", F.row_number().over(w.orderBy(size.desc_nulls_last(), "ol_id"))).withColumn("n", F.count(F.lit(1)).over(w))


def duplicate_lists(df: DataFrame) -> DataFrame:
    """(a, b, ol_ids): the overlaps of pairs with more than one, longest first."""
    item = F.struct((-aligned_length()).alias("n"), F.col("ol_id").alias("id"))
    out = df.groupBy(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).agg(F.sort_array(F.collect_list(item)).alias("l"))
    return out.where(F.size("l") > 1).select("a", "b", F.transform("l", lambda x: x.id).alias("ol_ids"))


def two_way_index(df: DataFrame) -> DataFrame:
    """(read, side, place, ol_id): the overlaps of a read as query (side 0) and target (side 1), longest first; ties by
    aligned size, direction and id."""
    size = (F.col("identity") * aligned_length()).cast("long")
    rows = df.select("ol_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a_id").alias("read")), F.struct(F.lit(1).alias("side"), F.col("b_id").alias("read")))).alias("_s"), aligned_length().alias("n"), size.alias("size"), (F.col("a_strand") == F.col("b_strand")).alias("same"))
    w = Window.partitionBy("_s.read", "_s.side").orderBy(F.col("n").desc(), F.col("size").desc(), F.col("same").desc(), "ol_id")
    return rows.select("_s.read", "_s.side", F.row_number().over(w).alias("place"), "ol_id")


def contained_reads(df: DataFrame, err: int = 0) -> DataFrame:
    """(read, container): reads inside another one; of two equal reads the larger id. The smallest container is kept."""
    loc = location(err)
    read = F.when(loc == EQUAL, F.greatest("a_id", "b_id")).when(loc == CONTAINED, F.col("a_id")).when(loc == CONTAINING, F.col("b_id"))
    other = F.when(loc == EQUAL, F.least("a_id", "b_id")).when(loc == CONTAINED, F.col("b_id")).when(loc == CONTAINING, F.col("a_id"))
    return df.where("a_id != b_id").select(read.alias("read"), other.alias("container")).where("read is not null").groupBy("read").agg(F.min("container").alias("container"))


def reasons(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Every overlap with the reason it falls: ``removed`` (read, reason) by side a first, then b; null where it stays."""
    a = removed.select(F.col("read").alias("a_id"), F.col("reason").alias("_ra"))
    b = removed.select(F.col("read").alias("b_id"), F.col("reason").alias("_rb"))
    return df.join(a, "a_id", "left").join(b, "b_id", "left").withColumn("reason", F.coalesce("_ra", "_rb")).drop("_ra", "_rb")
