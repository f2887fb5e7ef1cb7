"""CIGAR strings as arrays of (len, op)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(cigar: Column) -> Column:
    """array<struct<len int, op string>>; an empty or null string gives an empty array."""
    n = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(1))
    op = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit(r"(\d+)([MIDNSHPX=])"), F.lit(2))
    return F.zip_with(n, op, lambda x, y: F.struct(x.cast("int").alias("len"), y.alias("op")))


def bases(detail: Column, ops: str, at_least: int = 0) -> Column:
    """Bases in operations of these kinds that are at least so long."""
    kept = F.filter(detail, lambda d: d.op.isin(*ops) & (d.len >= at_least))
    return F.aggregate(kept, F.lit(0), lambda s, d: s + d.len)


def query_length(detail: Column) -> Column:
    return bases(detail, "MI=X")


def target_length(detail: Column) -> Column:
    return bases(detail, "MDN=X")


def clips(detail: Column) -> Column:
    """struct(lead, tail): clipped bases at both ends."""
    size = F.size(detail)

    def clip(d: Column) -> Column:
        return F.when(d.op.isin("S", "H"), d.len).otherwise(0)

    lead = F.when(size > 0, clip(F.get(detail, F.lit(0)))).otherwise(0)
    tail = F.when(size > 1, clip(F.get(detail, size - 1))).otherwise(0)
    return F.struct(lead.alias("lead"), tail.alias("tail"))


def identity_ignoring_indels(at_least: int) -> Column:
    """The identity if indels of at least this length had not been part of the alignment (columns cigar, b_start, b_end,
    identity); matches are truncated to whole bases."""
    d = F.col("cigar")
    length = F.col("b_end") - F.col("b_start") + bases(d, "I")
    match = (length * F.col("identity") / 100).cast("int")
    rest = length - bases(d, "I", at_least) - bases(d, "D", at_least)
    return match * F.lit(100.0) / F.nullif(rest, F.lit(0))


def spans(detail: Column) -> Column:
    """array<struct<op, len, col, t>>: every operation of a CIGAR with its first column and its first target base; clips and
    padding have no columns and are left out."""
    kept = F.filter(detail, lambda d: d.op.isin("M", "I", "D", "N", "=", "X"))
    empty = F.struct(F.lit(0).alias("col"), F.lit(0).alias("t"), F.array().cast("array<struct<op:string,len:int,col:int,t:int>>").alias("out"))

    def add(s: Column, d: Column) -> Column:
        on = F.when(d.op == "I", 0).otherwise(d.len)
        return F.struct((s.col + d.len).alias("col"), (s.t + on).alias("t"), F.concat(s.out, F.array(F.struct(d.op.alias("op"), d.len.alias("len"), s.col.alias("col"), s.t.alias("t")))).alias("out"))

    return F.aggregate(kept, empty, add, lambda s: s.out)


def worst_window(ops: Column, width: int) -> Column:
    """The most columns that are no matches (X, I, D) within ``width`` columns in a row, from ``spans``; 0 for none.

    Errors grow in straight pieces, so the worst window begins where an operation begins or ends where one ends."""
    size = lambda o: o.col + o.len

    def errors(at: Column) -> Column:
        hit = F.filter(ops, lambda o: o.op.isin("X", "I", "D"))
        return F.aggregate(hit, F.lit(0), lambda n, o: n + F.greatest(F.lit(0), F.least(size(o), at + width) - F.greatest(o.col, at)))

    starts = F.concat(F.transform(ops, lambda o: o.col), F.transform(ops, lambda o: F.greatest(F.lit(0), size(o) - width)))
    return F.coalesce(F.array_max(F.transform(starts, errors)), F.lit(0))


def in_region(ops: Column, start: Column, end: Column) -> Column:
    """struct(mat, mis, ins, del): columns of each kind at the target bases after ``start`` up to and with ``end``, counted from
    the first base of the alignment; an insertion stands at the base after it."""

    start, end = start.cast("int"), end.cast("int")

    def n(op: str, point: bool = False) -> Column:
        part = F.filter(ops, lambda o: o.op == op)
        if point:
            return F.aggregate(part, F.lit(0), lambda s, o: s + F.when((o.t > start) & (o.t <= end), o.len).otherwise(0))
        return F.aggregate(part, F.lit(0), lambda s, o: s + F.greatest(F.lit(0), F.least(o.t + o.len, end + 1) - F.greatest(o.t, start + 1)))

    return F.struct(n("=").alias("mat"), n("X").alias("mis"), n("I", True).alias("ins"), n("D").alias("del"))
