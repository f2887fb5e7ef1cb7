"""Writers: lines (value) from frames, and saving them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.overlap import aligned_length


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _number(c: str) -> Column:
    """A float with up to four places and no trailing zeros."""
    return F.call_function("format_number", F.col(c), F.lit("0.####"))


def fasta(df: DataFrame) -> DataFrame:
    """``>name sub_head``, a blank after the name in any case, and the sequence."""
    return df.select(F.concat(F.lit(">"), F.col("name"), F.lit(" "), F.coalesce("sub_head", F.lit("")), F.lit("\n"), F.coalesce("seq", F.lit(""))).alias("value"))


def fastq(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("@"), F.col("name"), F.lit(" "), F.coalesce("sub_head", F.lit("")), F.lit("\n"), F.coalesce("seq", F.lit("")), F.lit("\n+\n"), F.coalesce("quality", F.lit(""))).alias("value"))


def m4a(df: DataFrame) -> DataFrame:
    cols = [_s("a_name"), _s("b_name"), _number("identity"), _s(-aligned_length()), _s("a_strand"), _s("a_start"), _s("a_end"), _s("a_len"), _s("b_strand"), _s("b_start"), _s("b_end"), _s("b_len")]
    return df.select(F.concat_ws(" ", *cols).alias("value"))


m4 = m4a


def paf(df: DataFrame) -> DataFrame:
    """Matches are identity times aligned length, truncated; mapping quality 0."""
    n = aligned_length()
    match = (n * F.col("identity") / 100).cast("int")
    same = F.when(F.col("a_strand") == F.col("b_strand"), "+").otherwise("-")
    cols = [_s("a_name"), _s("a_len"), _s("a_start"), _s("a_end"), same, _s("b_name"), _s("b_len"), _s("b_start"), _s("b_end"), _s(match), _s(n), F.lit("0")]
    return df.select(F.concat_ws("\t", *cols).alias("value"))


def table_lines(df: DataFrame, *columns: str, sep: str = " ", null: str = "-") -> DataFrame:
    """Columns joined by a separator: read infos, filtered overlaps, edges, paths, variants, selection scores, names."""
    return df.select(F.concat_ws(sep, *[F.coalesce(_s(c), F.lit(null)) for c in columns or df.columns]).alias("value"))


def inconsistent(df: DataFrame) -> DataFrame:
    """``t:q|strand|offset,...`` with queries in order."""
    item = F.struct("q", "strand", "offset")
    joined = F.array_join(F.transform(F.sort_array(F.collect_set(item)), lambda x: F.concat_ws("|", x.q.cast("string"), x.strand.cast("string"), x.offset.cast("string"))), ",")
    return df.groupBy("t").agg(joined.alias("v")).select(F.concat(_s("t"), F.lit(":"), F.col("v")).alias("value"))


def read_variants(df: DataFrame) -> DataFrame:
    """``ctg read direction offset pos|base|pos ...`` from rows per site, sites in order."""
    item = F.struct("ctg_pos", "base", "rd_pos")
    joined = F.array_join(F.transform(F.sort_array(F.collect_set(item)), lambda x: F.concat_ws("|", x.ctg_pos.cast("string"), x.base.cast("string"), x.rd_pos.cast("string"))), " ")
    return df.groupBy("ctg", "read", "direction", "offset").agg(joined.alias("v")).select(F.concat_ws(" ", _s("ctg"), _s("read"), _s("direction"), _s("offset"), "v").alias("value"))


def tiles(df: DataFrame) -> DataFrame:
    """``ctg edge=read:B~read:E`` in order of ``tile_no``, one row per tile."""
    return df.select("ctg", "tile_no", F.concat(_s("ctg"), F.lit(" edge="), F.col("from_read"), F.lit(":"), F.col("from_end"), F.lit("~"), F.col("to_read"), F.lit(":"), F.col("to_end")).alias("value"))


def poa_links(df: DataFrame) -> DataFrame:
    """Links of a consensus graph as comma-separated rows."""
    return table_lines(df, sep=",")


def save(lines: DataFrame, path: str, where: Column | None = None, gzip: bool = False) -> None:
    """Write lines in parallel, those that meet ``where`` only."""
    out = lines if where is None else lines.where(where)
    w = out.select("value").write.mode("overwrite")
    (w.option("compression", "gzip") if gzip else w).text(path)


def save_parts(lines: DataFrame, part: str, path: str) -> None:
    """One folder per value of ``part``, written in parallel."""
    lines.select(part, "value").write.mode("overwrite").partitionBy(part).text(path)
