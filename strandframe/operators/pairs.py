"""Joins over overlaps and lists of read pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.overlap import ABNORMAL, LEFT, RIGHT, _carry, location, mapping
from strandframe.operators.grouping import both_sides
from strandframe.session import cut, n_rows, sized, skew_join


def with_sequences(df: DataFrame, reads: DataFrame) -> DataFrame:
    """Overlaps with both sequences, ``a_seq`` and ``b_seq``; only reads that are named are joined."""
    a = reads.select(F.col("read_id").alias("a_id"), F.col("seq").alias("a_seq"))
    b = reads.select(F.col("read_id").alias("b_id"), F.col("seq").alias("b_seq"))
    return df.join(a, "a_id", "left").join(b, "b_id", "left")


def to_blocks(df: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every overlap once for each block that either of its reads is in; ``assigned`` has (read, block)."""
    rows = both_sides(df).join(assigned, "read").select("ol_id", "block")
    return rows.dropDuplicates(["ol_id", "block"])


def with_named_read(df: DataFrame, named: DataFrame) -> DataFrame:
    """Overlaps with either read among ``named`` (read)."""
    a, b = (named.select(F.col("read").alias(f"{x}_id")).where(f"{x}_id is not null").distinct().withColumn(f"_{x}", F.lit(True)) for x in "ab")
    return df.join(a, "a_id", "left").join(b, "b_id", "left").where("_a or _b").drop("_a", "_b")


def opposite_counts(members: DataFrame, listed: DataFrame) -> DataFrame:
    """(ctg, read, n): reads of each contig, ``members`` (ctg, read), that are listed with ``read`` as inconsistent, in either
    order of ``listed`` (t, q)."""
    both = listed.select("t", "q").union(listed.select("q", "t")).distinct()
    return members.select("ctg", F.col("read").alias("t")).distinct().join(both, "t").groupBy("ctg", F.col("q").alias("read")).agg(F.count(F.lit(1)).alias("n"))


def without_opposite(df: DataFrame, members: DataFrame, listed: DataFrame, count: int) -> DataFrame:
    """Reads on contigs (a_id on b_id) less those that at least ``count`` of the contig's reads are inconsistent with."""
    bad = opposite_counts(members, listed).where(F.col("n") >= count).select(F.col("ctg").alias("b_id"), F.col("read").alias("a_id"))
    return df.join(bad, ["a_id", "b_id"], "left_anti")


def without_outvoted(df: DataFrame, votes: DataFrame) -> DataFrame:
    """Reads on contigs (a_id on b_id) less those whose calls disagree with the contig's majority more often than they agree;
    ``votes`` has (read, ctg, agree, disagree)."""
    bad = votes.where("disagree > agree").select(F.col("read").alias("a_id"), F.col("ctg").alias("b_id"))
    return df.join(bad, ["a_id", "b_id"], "left_anti")


def supported_ways(links: DataFrame) -> DataFrame:
    """(node, before, after, reads): reads that a contig's way in and way out share, over links (a, b, read) from a to b. A read
    is on few contigs, so the join runs on (contig, read)."""
    one = links.select("a", "b", "read").distinct()
    x, y = one.select(F.col("a").alias("before"), F.col("b").alias("node"), "read"), one.select(F.col("a").alias("node"), F.col("b").alias("after"), "read")
    return x.join(y, ["node", "read"]).where("before != after").groupBy("node", "before", "after").agg(F.count_distinct("read").alias("reads"))


def split_by_sets(df: DataFrame, sets: DataFrame, key: str) -> DataFrame:
    """Every row once for each of the ``sets`` (part, name) that hold its ``key``."""
    return df.join(sets.select("part", F.col("name").alias(key)).distinct(), key)


def pair_known(df: DataFrame, pairs: DataFrame, how: str = "left_semi") -> DataFrame:
    """Overlaps whose two reads are in ``pairs`` (t, q) in either order."""
    lo, hi = F.least("a_id", "b_id"), F.greatest("a_id", "b_id")
    known = pairs.select(F.least("t", "q").alias("_lo"), F.greatest("t", "q").alias("_hi")).distinct()
    return df.join(known, (lo == F.col("_lo")) & (hi == F.col("_hi")), how)


def offsets(df: DataFrame) -> DataFrame:
    """Adds ``a_on_b`` and ``b_on_a``: where each read's start lies on the other, in the other's coordinates."""
    zero = F.lit(0)
    same = F.col("a_strand") == F.col("b_strand")
    return df.withColumn("b_on_a", mapping(zero, "a", "b")).withColumn("a_on_b", _carry(zero, F.col("b_start"), F.col("b_end"), F.col("a_start"), F.col("a_end"), same))


def distances(df: DataFrame, listed: DataFrame, both: bool) -> DataFrame:
    """(ol_id, distance): how far an overlap is from the nearest listed placement of its pair with the same direction.

    ``listed`` has (t, q, strand, offset): q on t. Both ways are measured where listed; ``both`` takes the larger of the
    two, else the smaller. Overlaps of pairs that are not listed have no row."""
    o = offsets(df).withColumn("_st", (F.col("a_strand") != F.col("b_strand")).cast("int"))
    way_a = o.select("ol_id", F.lit(0).alias("way"), F.col("a_id").alias("t"), F.col("b_id").alias("q"), F.col("_st").alias("strand"), F.col("b_on_a").alias("_off"))
    way_b = o.select("ol_id", F.lit(1).alias("way"), F.col("b_id").alias("t"), F.col("a_id").alias("q"), F.col("_st").alias("strand"), F.col("a_on_b").alias("_off"))
    near = way_a.unionByName(way_b).join(listed, ["t", "q", "strand"]).groupBy("ol_id", "way").agg(F.min(F.abs(F.col("_off") - F.col("offset"))).alias("d"))
    per = near.groupBy("ol_id").agg(F.max("d").alias("_hi"), F.min("d").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    if both:  # a way that is not listed is infinitely far
        return per.where("_n = 2").select("ol_id", F.col("_hi").alias("distance"))
    return per.select("ol_id", F.col("_lo").alias("distance"))


def without_inconsistent(df: DataFrame, listed: DataFrame, threshold: int, rate: float = 0.0, strict: bool = False, ranges: DataFrame | None = None) -> DataFrame:
    """Overlaps less those within a tolerance of a listed placement of the same pair and direction.

    The tolerance is the larger of ``threshold`` and ``rate`` times the larger offset; ``strict`` asks for both ways to be
    listed. ``ranges`` (read, range_start) shifts offsets of reads that were cut from longer ones."""
    o = offsets(df)
    if ranges is not None:
        a = ranges.select(F.col("read").alias("a_id"), F.col("range_start").alias("_ra"))
        b = ranges.select(F.col("read").alias("b_id"), F.col("range_start").alias("_rb"))
        o = o.join(a, "a_id", "left").join(b, "b_id", "left").withColumn("b_on_a", F.col("b_on_a") + F.coalesce("_ra", F.lit(0)) - F.coalesce("_rb", F.lit(0))).withColumn("a_on_b", F.col("a_on_b") + F.coalesce("_rb", F.lit(0)) - F.coalesce("_ra", F.lit(0)))
    tol = F.greatest(F.lit(threshold), (F.lit(rate) * F.greatest("a_on_b", "b_on_a")).cast("int"))
    o = o.withColumn("_st", (F.col("a_strand") != F.col("b_strand")).cast("int")).withColumn("_tol", tol)
    ways = o.select("ol_id", "_tol", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("a_id").alias("t"), F.col("b_id").alias("q"), F.col("b_on_a").alias("off")), F.struct(F.lit(1).alias("way"), F.col("b_id").alias("t"), F.col("a_id").alias("q"), F.col("a_on_b").alias("off")))).alias("_w"), F.col("_st").alias("strand"))
    ways = ways.select("ol_id", "_tol", "strand", "_w.*")
    near = ways.join(listed, ["t", "q", "strand"]).where(F.abs(F.col("off") - F.col("offset")) < F.col("_tol"))
    hit = near.groupBy("ol_id").agg(F.countDistinct("way").alias("_n")).where(F.col("_n") >= (2 if strict else 1))
    return df.join(hit.select("ol_id"), "ol_id", "left_anti")


def rescued(all_overlaps: DataFrame, kept: DataFrame, err: int = 0) -> DataFrame:
    """Overlaps that were dropped but give a read its only neighbour to the left or to the right: the longest each."""

    def ends(df: DataFrame) -> DataFrame:
        loc = location(err)
        same = F.col("a_strand") == F.col("b_strand")
        other = F.when(loc == LEFT, F.when(same, RIGHT).otherwise(LEFT)).when(loc == RIGHT, F.when(same, LEFT).otherwise(RIGHT))
        proper = df.where(loc.isin(LEFT, RIGHT))
        n = F.expr("(a_end - a_start + b_end - b_start) div 2")
        return proper.select("ol_id", n.alias("n"), F.explode(F.array(F.struct(F.col("a_id").alias("read"), loc.alias("end")), F.struct(F.col("b_id").alias("read"), other.alias("end")))).alias("_e")).select("ol_id", "n", "_e.*")

    missing = ends(all_overlaps).join(ends(kept).select("read", "end").distinct(), ["read", "end"], "left_anti")
    return missing.groupBy("read", "end").agg(F.min_by("ol_id", F.struct(-F.col("n"), F.col("ol_id"))).alias("ol_id")).select("ol_id").distinct()


def triangles(links: DataFrame) -> DataFrame:
    """(lo, mid, hi, ab, ac, bc): every three links (lo, hi, item) among three vertices, lo < hi, with the items of the links
    from lo to mid, lo to hi and mid to hi. Several links of the same two vertices make several rows.

    Every link belongs to its end of fewer links, of equal ones the smaller; a triangle is found at the vertex that owns two
    of its links. A vertex owns no more links than the square root of twice their number, however many it has, so the pairs
    that are looked up stay far below the square of the degrees."""
    links = cut(links.select("lo", "hi", "item"))
    ends = links.select(F.col("lo").alias("v")).unionByName(links.select(F.col("hi").alias("v")))
    deg = cut(ends.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    known = skew_join(links, deg.select(F.col("v").alias("lo"), F.col("n").alias("_nl")), ["lo"])
    known = skew_join(sized(known, n_rows(links)), deg.select(F.col("v").alias("hi"), F.col("n").alias("_nh")), ["hi"])
    low = F.col("_nl") <= F.col("_nh")
    owned = known.select(F.when(low, F.col("lo")).otherwise(F.col("hi")).alias("v"), F.when(low, F.col("hi")).otherwise(F.col("lo")).alias("far"), "item")
    wedge = owned.select("v", F.col("far").alias("lo"), F.col("item").alias("x")).join(owned.select("v", F.col("far").alias("hi"), F.col("item").alias("y")), "v").where("lo < hi")
    closed = wedge.join(links.withColumnRenamed("item", "z"), ["lo", "hi"])
    # the owner v stands before, between or behind the two others
    first, last = F.col("v") < F.col("lo"), F.col("v") > F.col("hi")
    mid = F.when(first, F.col("lo")).when(last, F.col("hi")).otherwise(F.col("v"))
    ab, ac, bc = F.when(last, F.col("z")).otherwise(F.col("x")), F.when(first, F.col("y")).when(last, F.col("x")).otherwise(F.col("z")), F.when(first, F.col("z")).otherwise(F.col("y"))
    # rows of their own, as the choices would be repeated in every later use of a link otherwise
    row = F.struct(F.least("v", "lo").alias("lo"), mid.alias("mid"), F.greatest("v", "hi").alias("hi"), ab.alias("ab"), ac.alias("ac"), bc.alias("bc"))
    return closed.select(F.explode(F.array(row)).alias("t")).select("t.*")


def consistent_triangles(df: DataFrame, err: int) -> DataFrame:
    """(a, b, c, ok) of reads that overlap each other, a < b < c: whether b's ends carried to a directly and by way of c
    agree within ``err``. One overlap per pair is expected."""
    turned = F.col("a_id") > F.col("b_id")
    names = ("start", "end", "len")

    def view(x: str, y: str) -> Column:
        """The overlap as seen from read x."""
        return F.struct(*[F.col(f"{x}_{n}").alias(f"x_{n}") for n in names], *[F.col(f"{y}_{n}").alias(f"y_{n}") for n in names], (F.col("a_strand") == F.col("b_strand")).alias("same"))

    links = df.where("a_id != b_id").select(F.least("a_id", "b_id").alias("lo"), F.greatest("a_id", "b_id").alias("hi"), F.when(turned, view("b", "a")).otherwise(view("a", "b")).alias("item"))
    tri = triangles(links).select(F.col("lo").alias("a"), F.col("mid").alias("b"), F.col("hi").alias("c"), "ab", "ac", "bc")

    def carry(pos: Column, p: str, x: str = "x", y: str = "y") -> Column:
        return _carry(pos, F.col(f"{p}.{x}_start"), F.col(f"{p}.{x}_end"), F.col(f"{p}.{y}_start"), F.col(f"{p}.{y}_end"), F.col(f"{p}.same"))

    ends = {"p0": F.lit(0), "p1": F.col("ab.y_len")}

    def rows(at: dict[str, Column], *keep: str) -> DataFrame:
        """Positions as values of their own: nested, the rules would be repeated within one another."""
        return tri.select("a", "b", "c", *keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in at.items()]))).alias("_p")).select("a", "b", "c", *keep, "_p.*")

    tri = rows({n: carry(p, "bc", "y", "x") for n, p in ends.items()}, "ab", "ac")
    tri = rows({f"by_{n}": carry(F.col(n), "ac") for n in ends} | {n: carry(p, "ab") for n, p in ends.items()})
    return tri.select("a", "b", "c", (F.greatest(*[F.abs(F.col(n) - F.col(f"by_{n}")) for n in ends]) <= err).alias("ok"))


def shared_reads(alignments: DataFrame) -> DataFrame:
    """(ctg0, ctg1, reads): contigs linked by reads aligned to both, ctg0 < ctg1.

    Reads on many contigs are repeats; the pairs of a read grow with the square of its contigs, which are few."""
    on = alignments.select(F.col("a_id").alias("read"), F.col("b_id").alias("ctg")).distinct()
    return on.select("read", F.col("ctg").alias("ctg0")).join(on.select("read", F.col("ctg").alias("ctg1")), "read").where("ctg0 < ctg1").groupBy("ctg0", "ctg1").agg(F.count(F.lit(1)).alias("reads"))


def joining_reads(alignments: DataFrame, err: int) -> DataFrame:
    """(ctg0, ctg1, read) where a read can join two contigs, ctg0 < ctg1: it hangs over the right end of one and the left end of
    the other, or lies properly on both and covers one of them or is covered by it."""
    loc = location(err)
    ends = alignments.where(loc != ABNORMAL).select(F.col("a_id").alias("read"), F.col("b_id").alias("ctg"), F.when(loc == LEFT, 2).when(loc == RIGHT, 4).otherwise(1).alias("end")).distinct()
    # of each read and contig the ends seen, as bits: 1 covered, 2 left, 4 right
    seen = ends.groupBy("read", "ctg").agg(F.sum("end").cast("int").alias("e"))
    x, y = seen.select("read", F.col("ctg").alias("ctg0"), F.col("e").alias("e0")), seen.select("read", F.col("ctg").alias("ctg1"), F.col("e").alias("e1"))
    bit = lambda c, n: F.col(c).bitwiseAND(F.lit(n)) != 0
    ok = bit("e0", 1) | bit("e1", 1) | (bit("e0", 2) & bit("e1", 4)) | (bit("e0", 4) & bit("e1", 2))
    return x.join(y, "read").where("ctg0 < ctg1").where(ok).select("ctg0", "ctg1", "read")


def conflicting_classes(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Overlaps less those between reads of opposite classes (read, cls in -1, 0, 1)."""
    a = classes.select(F.col("read").alias("a_id"), F.col("cls").alias("_ca"))
    b = classes.select(F.col("read").alias("b_id"), F.col("cls").alias("_cb"))
    return df.join(a, "a_id", "left").join(b, "b_id", "left").where("coalesce(_ca * _cb, 0) != -1").drop("_ca", "_cb")
