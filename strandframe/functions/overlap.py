"""Geometry and filters of overlaps as Columns.

An overlap row has the sides a and b: ``a_id, a_strand, a_start, a_end, a_len`` and the same for b, half-open positions on
the read's forward strand, and ``identity`` in percent. Everything here compiles to built-in expressions, so it stays in
generated code, is pushed down as far as the source allows and runs unchanged on streams.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT, EQUAL, CONTAINING, CONTAINED, ABNORMAL = "left", "right", "equal", "containing", "contained", "abnormal"


def c(name: str) -> Column:
    return F.col(name)


def same_direction() -> Column:
    return c("a_strand") == c("b_strand")


def aligned_length() -> Column:
    return F.expr("(a_end - a_start + b_end - b_start) div 2").cast("int")


def aligned_size() -> Column:
    """Identity times aligned length, truncated."""
    return (c("identity") * aligned_length()).cast("long")


def ideal_aligned_length() -> Column:
    """Aligned length if the overlap ran to the nearer read ends."""
    a_tail, b_tail = c("a_len") - c("a_end"), c("b_len") - c("b_end")
    lead = F.when(same_direction(), F.least("a_start", "b_start")).otherwise(F.least(c("a_start"), b_tail))
    tail = F.when(same_direction(), F.least(a_tail, b_tail)).otherwise(F.least(a_tail, c("b_start")))
    return lead + aligned_length() + tail


def _side(column: Column, target: Column, err: int) -> Column:
    """-1, 0 or 1: before, within ``err`` of, or after the target."""
    return F.when(column < target - err, -1).when(column > target + err, 1).otherwise(0)


def location(err: int = 0) -> Column:
    """How b lies on a: left and right are proper overlaps at a's right and left end as seen along a's strand."""
    a0, a1 = _side(c("a_start"), F.lit(0), err), _side(c("a_end"), c("a_len"), err)
    b0, b1 = _side(c("b_start"), F.lit(0), err), _side(c("b_end"), c("b_len"), err)
    a_full, b_full = (a0 == 0) & (a1 == 0), (b0 == 0) & (b1 == 0)
    same = same_direction()
    left = F.when(same, (a0 > 0) & (a1 == 0) & (b0 == 0) & (b1 < 0)).otherwise((a0 == 0) & (a1 < 0) & (b0 == 0) & (b1 < 0))
    right = F.when(same, (a0 == 0) & (a1 < 0) & (b0 > 0) & (b1 == 0)).otherwise((a0 > 0) & (a1 == 0) & (b0 > 0) & (b1 == 0))
    within_a, within_b = (a0 >= 0) & (a1 <= 0), (b0 >= 0) & (b1 <= 0)
    return F.when(left, LEFT).when(right, RIGHT).when(a_full & b_full, EQUAL).when(b_full & within_a, CONTAINING).when(a_full & within_b, CONTAINED).otherwise(ABNORMAL)


def reverse_location(loc: Column, same: Column) -> Column:
    """The same relation seen from b."""
    return (
        F.when(loc == LEFT, F.when(same, RIGHT).otherwise(LEFT))
        .when(loc == RIGHT, F.when(same, LEFT).otherwise(RIGHT))
        .when(loc == CONTAINING, CONTAINED)
        .when(loc == CONTAINED, CONTAINING)
        .otherwise(loc)
    )


def location_of(read: Column, err: int = 0) -> Column:
    """The relation seen from ``read``, which is a_id or b_id."""
    return F.when(read == c("a_id"), location(err)).otherwise(reverse_location(location(err), same_direction()))


def is_containing(err: int = 0) -> Column:
    return location(err).isin(EQUAL, CONTAINING)


def is_contained(err: int = 0) -> Column:
    return location(err).isin(EQUAL, CONTAINED)


def is_proper(err: int = 0) -> Column:
    return location(err).isin(LEFT, RIGHT)


def check_end(err: int) -> Column:
    """Neither junction leaves more than ``err`` bases hanging on both reads, in strand coordinates."""

    def ends(s: str) -> tuple[Column, Column]:
        fwd = c(f"{s}_strand") == 0
        return F.when(fwd, c(f"{s}_start")).otherwise(c(f"{s}_len") - c(f"{s}_end")), F.when(fwd, c(f"{s}_end")).otherwise(c(f"{s}_len") - c(f"{s}_start"))

    (a0, a1), (b0, b1) = ends("a"), ends("b")
    return ~(((a0 > err) & (b0 > err)) | ((a1 < c("a_len") - err) & (b1 < c("b_len") - err)))


def overhang_of(loc: Column) -> Column:
    """struct(a, b): unaligned bases at the joined ends for a relation, -1 where there is none to speak of."""
    same = same_direction()
    a0, a1, b0, b1 = c("a_start"), c("a_len") - c("a_end"), c("b_start"), c("b_len") - c("b_end")
    none = F.lit(-1)
    a = F.when(loc == LEFT, F.when(same, a1).otherwise(a0)).when(loc == RIGHT, F.when(same, a0).otherwise(a1)).when(loc.isin(CONTAINED, EQUAL), F.greatest(a0, a1)).otherwise(none)
    b = F.when(loc == LEFT, b0).when(loc == RIGHT, b1).when(loc.isin(CONTAINING, EQUAL), F.greatest(b0, b1)).otherwise(none)
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def _cheapest_join() -> tuple[Column, Column, Column, Column, Column]:
    """(which, a0, a1, b0, b1): 1 a left with b's far end, 2 a right with b's near end, 3 a within b, 4 b within a."""
    a0, a1, b0, b1 = c("a_start"), c("a_len") - c("a_end"), c("b_start"), c("b_len") - c("b_end")
    sums = F.array(a0 + F.when(same_direction(), b1).otherwise(b0), a1 + F.when(same_direction(), b0).otherwise(b1), a0 + a1, b0 + b1)
    return F.array_position(sums, F.array_min(sums)), a0, a1, b0, b1


def overhang() -> Column:
    """struct(a, b): unaligned bases under the relation that leaves the fewest."""
    k, a0, a1, b0, b1 = _cheapest_join()
    same = same_direction()
    a = F.when(k == 1, a0).when(k == 2, a1).when(k == 3, F.greatest(a0, a1)).otherwise(0)
    b = F.when(k == 1, F.when(same, b1).otherwise(b0)).when(k == 2, F.when(same, b0).otherwise(b1)).when(k == 3, 0).otherwise(F.greatest(b0, b1))
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))


def overhang_sides() -> Column:
    """struct(a, b): bit 1 for a left, bit 2 for a right overhang under the relation that leaves the fewest bases."""
    k, *_ = _cheapest_join()
    same = same_direction()
    a = F.when(k == 1, 1).when(k == 2, 2).when(k == 3, 3).otherwise(0)
    b = F.when(k == 1, F.when(same, 2).otherwise(1)).when(k == 2, F.when(same, 1).otherwise(2)).when(k == 3, 0).otherwise(3)
    return F.struct(a.alias("a"), b.alias("b"))


def mapping(pos: Column, to: str, of: str, same: Column | None = None) -> Column:
    """A position on side ``of`` carried over to side ``to``: in proportion inside, by offset outside the overlap."""
    t0, t1, o0, o1 = (c(f"{to}_start"), c(f"{to}_end"), c(f"{of}_start"), c(f"{of}_end"))
    return _carry(pos, t0, t1, o0, o1, same_direction() if same is None else same)


def _carry(pos: Column, t0: Column, t1: Column, o0: Column, o1: Column, same: Column) -> Column:
    def share(x: Column) -> Column:  # the integer division truncates towards zero
        return F.call_function("div", x.cast("long") * (t1 - t0), F.nullif((o1 - o0).cast("long"), F.lit(0).cast("long")))

    forward = F.when(pos < o0, t0 + (pos - o0)).when(pos < o1, t0 + share(pos - o0)).otherwise(t1 + (pos - o1))
    backward = F.when(pos > o1, t0 - (pos - o1)).when(pos > o0, t0 - share(pos - o1)).otherwise(t1 - (pos - o0))
    return F.when(same, forward).otherwise(backward).cast("long")


def extended(max_overhang: int) -> Column:
    """struct of the four positions with ends within ``max_overhang`` snapped to the read ends; null where the relation
    stays abnormal. Overlaps that are regular already are left as they are."""
    m = F.lit(max_overhang)
    a0, a1, b0, b1 = c("a_start"), c("a_end"), c("b_start"), c("b_end")
    at, bt = c("a_len") - a1, c("b_len") - b1
    a0n, b0n, a1n, b1n = a0 <= m, b0 <= m, at <= m, bt <= m
    fwd = (
        F.when(a0n, 0).when(b0n, a0 - b0).otherwise(a0),
        F.when(a1n, c("a_len")).when(b1n, a1 + bt).otherwise(a1),
        F.when(b0n, 0).when(a0n, b0 - a0).otherwise(b0),
        F.when(b1n, c("b_len")).when(a1n, b1 + at).otherwise(b1),
    )
    rev = (
        F.when(a0n, 0).when(b1n, a0 - bt).otherwise(a0),
        F.when(a1n, c("a_len")).when(b0n, a1 + b0).otherwise(a1),
        F.when(b0n, 0).when(a1n, b0 - at).otherwise(b0),
        F.when(b1n, c("b_len")).when(a0n, b1 + a0).otherwise(b1),
    )
    names = ("a_start", "a_end", "b_start", "b_end")
    snapped = F.struct(*[F.when(same_direction(), f).otherwise(r).cast("int").alias(n) for n, f, r in zip(names, fwd, rev, strict=True)])
    kept = F.struct(*[c(n).cast("int").alias(n) for n in names])
    return F.when(location(0) != ABNORMAL, kept).when(location(max_overhang) != ABNORMAL, snapped)


def extension(of: str, end: int) -> Column:
    """Bases that the other read adds beyond ``end`` (0 or 1) of side ``of``."""
    o = "b" if of == "a" else "a"
    lead, tail = c(f"{of}_start"), c(f"{of}_len") - c(f"{of}_end")
    o_lead, o_tail = c(f"{o}_start"), c(f"{o}_len") - c(f"{o}_end")
    gain = (F.when(same_direction(), o_lead).otherwise(o_tail) - lead) if end == 0 else (F.when(same_direction(), o_tail).otherwise(o_lead) - tail)
    return F.greatest(F.lit(0), gain)


def sides(df: DataFrame, *extra: str) -> DataFrame:
    """Both views of every overlap: read, r_start, r_end, r_len, other, o_start, o_end, o_len, same_dir."""
    from_a = [c("a_id").alias("read"), c("a_start").alias("r_start"), c("a_end").alias("r_end"), c("a_len").alias("r_len"), c("b_id").alias("other"), c("b_start").alias("o_start"), c("b_end").alias("o_end"), c("b_len").alias("o_len")]
    from_b = [c("b_id").alias("read"), c("b_start").alias("r_start"), c("b_end").alias("r_end"), c("b_len").alias("r_len"), c("a_id").alias("other"), c("a_start").alias("o_start"), c("a_end").alias("o_end"), c("a_len").alias("o_len")]
    rest = [same_direction().alias("same_dir"), *[c(x) for x in extra]]
    view = F.explode(F.array(F.struct(*from_a, *rest, F.lit(0).alias("side")), F.struct(*from_b, *rest, F.lit(1).alias("side"))))
    return df.select(view.alias("_s")).select("_s.*")


@dataclass(frozen=True)
class Filter:
    """The filter mini-language ``l=..:i=..:al=..:alr=..:oh=..:ohr=..:aal=..:aalr=..:ilid=..``.

    l: least length of both reads; i: least identity in percent; al, alr: aligned length and share of a read, of which one
    must hold; oh, ohr: largest overhang as length and share, the smaller holds; aal, aalr: aligned length and share from
    which the overhang does not matter; ilid: indels of at least this length do not count in the identity (0: all do).
    A negative value turns its rule off."""

    l: int = 0
    i: float = 0.0
    al: int = 0
    alr: float = 1.0
    oh: int = 10_000_000
    ohr: float = 1.0
    aal: int = 10_000_000
    aalr: float = 1.0
    ilid: int = 0

    @classmethod
    def parse(cls, text: str) -> Filter:
        kinds = {f.name: int if f.type == "int" else float for f in fields(cls)}
        got = {}
        for part in filter(None, (text or "").split(":")):
            key, eq, value = part.partition("=")
            if not eq or key not in kinds:
                raise ValueError(f"not a filter rule: {part!r}")
            got[key] = int(float(value)) if kinds[key] is int else float(value)
        if "aalr" in got:
            got["aalr"] = float(np.float32(got["aalr"]))  # this rule has single precision
        return cls(**got)

    def __str__(self) -> str:
        return ":".join(f"{f.name}={getattr(self, f.name):g}" for f in fields(self))

    def max_overhang(self, length: Column) -> Column:
        """Overhang allowed on a read of this length, -1 if the rule is off."""
        by_rate = (length * F.lit(float(self.ohr))).cast("int")
        if self.oh >= 0 and self.ohr >= 0:
            return F.least(F.lit(self.oh), by_rate)
        return F.lit(self.oh) if self.oh >= 0 else by_rate if self.ohr >= 0 else F.lit(-1)

    def identity(self) -> Column:
        from strandframe.functions.cigar import identity_ignoring_indels

        return identity_ignoring_indels(self.ilid) if self.ilid > 0 else c("identity")

    def valid(self, replen: Column | None = None, both_sides: bool = True) -> Column:
        """The overlap passes. Where ``replen``, the length of a repeat, is given it stretches the aligned length and the
        overhangs allowed. Null fields make the result null, which filters drop."""
        rep = F.lit(0) if replen is None else replen
        vlen = aligned_length() if replen is None else F.greatest(aligned_length(), rep)
        ok = (c("a_id") != c("b_id")) & (c("a_len") >= self.l) & (c("b_len") >= self.l) & (self.identity() >= self.i)
        if self.alr >= 0:
            ok = ok & ~((vlen < self.al) & (vlen < c("a_len") * F.lit(float(self.alr))) & (vlen < c("b_len") * F.lit(float(self.alr))))
        accept = F.lit(False)
        if self.aal >= 0:
            accept = accept | (vlen >= self.aal)
        if self.aalr >= 0:
            accept = accept | (vlen >= c("a_len") * F.lit(float(self.aalr))) | (vlen >= c("b_len") * F.lit(float(self.aalr)))
        if self.oh < 0 and self.ohr < 0:
            return ok
        a_oh, b_oh = self.max_overhang(c("a_len")) + rep, self.max_overhang(c("b_len")) + rep
        a0, a1 = c("a_start") > a_oh, c("a_len") - c("a_end") > a_oh
        b0, b1 = c("b_start") > b_oh, c("b_len") - c("b_end") > b_oh
        near, far = F.when(same_direction(), b0).otherwise(b1), F.when(same_direction(), b1).otherwise(b0)
        bad = (a0 & near) | (a1 & far) if both_sides else a0 & near & a1 & far
        return ok & (accept | ~bad)


def threshold(cov: Column, low: float, high: float, at_low: float, at_high: float, out_of_range: float | None = None) -> Column:
    """A threshold that grows in a straight line from ``at_low`` at coverage ``low`` to ``at_high`` at ``high`` and stays
    constant beyond; ``out_of_range`` holds below ``low`` where given."""
    line = F.lit(float(at_low)) + (cov - low) * F.lit((at_high - at_low) / (high - low))
    below = F.lit(float(at_low if out_of_range is None else out_of_range))
    return F.when(cov < low, below).when(cov > high, F.lit(float(at_high))).otherwise(line)


def exact_filter(min_length: int, min_rate: float, min_identity: float, max_overhang: int) -> Column:
    """The check after an alignment: length, share of the shorter read, identity and overhang (columns as above)."""
    length = aligned_length()
    shorter = F.least("a_len", "b_len")
    return (length >= min_length) & (length >= shorter * F.lit(min_rate)) & (c("identity") >= min_identity) & (F.greatest(overhang().a, overhang().b) <= max_overhang)
