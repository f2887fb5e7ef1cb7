"""Mixing sources to target weights along a time-varying curriculum.

Every source has a share of all tokens and a tilt g: at time t of the training (0 to 1) its weight is
share * (1 + g * (2 t - 1)), and tilts are shifted so that the weights add up to one at every time. The weight's integral,
share * ((1 - g) t + g t**2), is the source's cumulative demand, and at t = 1 all of it. The documents of a source stand one
behind the other, pass after pass; a use gets the time at which the demand reaches its tokens, and a document is used as
often as that happens within the training. Uses are range-sorted by that time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import broadcast_if_small, cut

#: Slices of a source, by hash, over which running sums are taken in two steps.
SLICES = 4096


def running(docs: DataFrame, by: str, doc: str, size: str, seed: int = 0, slices: int = SLICES) -> DataFrame:
    """Adds ``before``: the sizes of the documents of the same ``by`` that come earlier in a seeded hash order."""
    h = docs.withColumn("_h", F.xxhash64(F.col(doc), F.lit(seed))).withColumn("_slice", F.pmod("_h", F.lit(slices)))
    earlier = Window.unboundedPreceding, -1
    sums = h.groupBy(by, "_slice").agg(F.sum(size).alias("_s"))
    sums = sums.select(by, "_slice", F.coalesce(F.sum("_s").over(Window.partitionBy(by).orderBy("_slice").rowsBetween(*earlier)), F.lit(0)).alias("_before"))
    local = F.coalesce(F.sum(size).over(Window.partitionBy(by, "_slice").orderBy("_h", doc).rowsBetween(*earlier)), F.lit(0))
    return h.withColumn("_local", local).join(sums, [by, "_slice"]).withColumn("before", F.col("_before") + F.col("_local")).drop("_h", "_slice", "_before", "_local")


def plan(docs: DataFrame, targets: DataFrame, source: str = "source", size: str = "tokens", total: float | None = None) -> DataFrame:
    """(source, target_share, share, max_repeats, available, demand) per source with a target, documents and repeats.

    Shares of targets without tokens or repeats are spread over the others in proportion (``share``). Without ``total`` the
    mixture is as large as the caps allow with every share met; with it, capped sources stay below their share."""
    have = docs.where(F.col(source).isNotNull()).groupBy(source).agg(F.sum(size).alias("available"))
    want = targets.where(F.col(source).isNotNull()).groupBy(source).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    usable = have.join(broadcast_if_small(cut(want)), source).where("available > 0 and max_repeats > 0 and target_share > 0")
    every = Window.partitionBy(F.lit(0))  # as many rows as targets
    usable = usable.withColumn("share", F.col("target_share") / F.sum("target_share").over(every))
    most = F.min(F.col("available") * F.col("max_repeats") / F.col("share")).over(every) if total is None else F.lit(float(total))
    return usable.withColumn("demand", F.least(F.col("share") * most, (F.col("available") * F.col("max_repeats")).cast("double")))


def scheduled(sources: DataFrame, wanted: dict[str, float] | None, source: str = "source") -> DataFrame:
    """Adds ``tilt`` to the sources of ``plan`` (one row each): the wanted tilts, centred by their shares of the demand."""
    rows = sources.select(source, "demand").collect()  # one row per source with a target
    g = tilts({r[0]: float(r[1]) for r in rows}, wanted or {}) if rows else {}
    tilt = F.create_map(*[F.lit(x) for kv in g.items() for x in kv])[F.col(source)] if g else F.lit(0.0)
    return sources.withColumn("tilt", tilt)


def draw(
    docs: DataFrame, targets: DataFrame, doc: str = "doc_id", source: str = "source", size: str = "tokens", seed: int = 0, total: float | None = None, wanted: dict[str, float] | None = None
) -> DataFrame:
    """Every document (doc, source, tokens) with ``uses``, 0 on, ``before``, its place in its source's order, and its source's
    ``available`` tokens, ``demand`` and ``tilt``.

    The demand is the source's schedule integrated over the training. Documents stand in hash order; the n-th use of a
    document exists if the middle of its tokens in the n-th pass lies within the demand. Documents without tokens, source or
    target are not used. Document ids should be unique; repeated rows are documents of their own."""
    rows = cut(docs.select(doc, source, F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size)))
    sources = cut(scheduled(cut(plan(rows, targets, source, size, total)), wanted, source))
    some = running(rows.join(broadcast_if_small(sources.select(source)), source, "left_semi"), source, doc, size, seed)
    placed = some.join(broadcast_if_small(sources.select(source, "available", "demand", "max_repeats", "tilt")), source)
    # passes whose part before this document's middle the demand still covers; 1e-9 for shares that add up with an error
    passes = F.floor((F.col("demand") - F.col("before") - F.col(size) / 2) / F.col("available") + 1e-9).cast("long") + 1
    uses = F.greatest(F.lit(0), F.least(passes, F.col("max_repeats").cast("long")))
    used = placed.withColumn("uses", F.when(F.col(size) > 0, uses).otherwise(0).cast("int")).select(doc, source, size, "uses", "before", "available", "demand", "tilt")
    unused = rows.join(broadcast_if_small(sources.select(source)), source, "left_anti")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("before", "long"), ("available", "long"), ("demand", "double"), ("tilt", "double"))]
    return used.unionByName(unused.select(doc, source, size, F.lit(0).alias("uses"), *none))


def shares(drawn: DataFrame, targets: DataFrame, source: str = "source", size: str = "tokens") -> DataFrame:
    """(source, target_share, used_tokens, reached_share) of every source of documents or targets."""
    got = drawn.groupBy(source).agg(F.sum(F.col(size) * F.col("uses")).alias("used_tokens"))
    all_tokens = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))  # one row per source
    return got.join(targets.select(source, "target_share"), source, "full").select(
        source, "target_share", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce(F.col("used_tokens") / all_tokens, F.lit(0.0)).alias("reached_share")
    )


def tilts(shares_by_source: dict[str, float], wanted: dict[str, float]) -> dict[str, float]:
    """The wanted tilts less their share-weighted mean, so that the weights add up to one at every time."""
    mean = sum(shares_by_source[s] * wanted.get(s, 0.0) for s in shares_by_source) / (sum(shares_by_source.values()) or 1.0)
    out = {s: wanted.get(s, 0.0) - mean for s in shares_by_source}
    if any(abs(g) > 1 for g in out.values()):
        raise ValueError("a weight would be negative: tilts must stay within -1 and 1 after centring")
    return out


def when(part: Column, tilt: Column) -> Column:
    """The time t at which (1 - g) t + g t**2 reaches ``part`` (0 to 1) of the source's demand."""
    a = F.lit(1.0) - tilt
    # the root that also holds for g = 0
    return F.when(part <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * part / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 4 * tilt * part)))))


def positions(drawn: DataFrame, doc: str = "doc_id", source: str = "source", size: str = "tokens") -> DataFrame:
    """(doc, source, tokens, use_no, position) of every use, range-sorted by position in the training (0 to 1)."""
    use = drawn.where("uses > 0").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    # uses of one pass stand one behind the other; the place is the middle of the document
    part = F.least(F.lit(1.0), ((F.col("use_no") - 1) * F.col("available") + F.col("before") + F.col(size) / 2) / F.col("demand"))
    out = use.select(doc, source, size, "use_no", when(part, F.col("tilt")).alias("position"))
    return out.repartitionByRange("position", doc, "use_no").sortWithinPartitions("position", doc, "use_no")


def shares_by_time(drawn: DataFrame, parts: int = 10, source: str = "source", size: str = "tokens") -> DataFrame:
    """(part, source, wanted_share, reached_share): the schedule and what the uses of each of ``parts`` equal stretches of the
    training hold of every source."""
    part = F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int")
    got = positions(drawn, drawn.columns[0], source, size).groupBy(part.alias("part"), source).agg(F.sum(size).alias("_n"))
    weight = cut(drawn.where("demand is not null").groupBy(source).agg(F.max("demand").alias("demand"), F.max("tilt").alias("tilt")))  # one row per source
    times = weight.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    rows = times.join(got, ["part", source], "left")
    w = F.col("demand") * (1 + F.col("tilt") * ((2 * F.col("part") + 1) / parts - 1))
    whole = Window.partitionBy("part")  # one row per source
    return rows.select("part", source, (w / F.sum(w).over(whole)).alias("wanted_share"), (F.coalesce("_n", F.lit(0)) / F.sum("_n").over(whole)).alias("reached_share"))
