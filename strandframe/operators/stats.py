"""Length statistics, robust thresholds, folds over overlaps and evaluation counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.prefix import running_sum


def n_values(df: DataFrame, length: str, percents: Sequence[int] = (25, 50, 75), strict: bool = True) -> DataFrame:
    """(percent, n_value, l_value): the length at which the sum over longer and equal items passes a share of the total
    (or, not strict, reaches it), and the number of items that takes. Nulls are left out; no items give no rows."""
    hist = df.where(F.col(length).isNotNull()).groupBy((-F.col(length).cast("long")).alias("neg")).agg(F.count(F.lit(1)).alias("k"))
    hist = hist.withColumn("bases", -F.col("neg") * F.col("k"))
    run = running_sum(running_sum(hist, [], "neg", "bases", "cum"), [], "neg", "k", "items")
    rows = run.withColumn("total", hist.agg(F.sum("bases")).scalar()).withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    before = F.col("cum") - F.col("bases")
    edge = F.col("total") * F.col("percent")
    # items of the length in question needed to pass the edge
    missing = edge - before * 100
    per = -F.col("neg") * 100
    need = (F.call_function("div", missing, F.nullif(per, F.lit(0))) + 1) if strict else F.call_function("div", missing + per - 1, F.nullif(per, F.lit(0)))
    hit = rows.where((F.col("cum") * 100 > edge if strict else F.col("cum") * 100 >= edge) & (before * 100 <= edge if strict else before * 100 < edge))
    first = hit.groupBy("percent").agg(F.min(F.struct("neg", (F.col("items") - F.col("k") + need).alias("l"))).alias("m"))
    return first.select("percent", (-F.col("m.neg")).alias("n_value"), F.col("m.l").cast("long").alias("l_value"))


def length_summary(df: DataFrame, length: str) -> DataFrame:
    return df.agg(F.count(length).alias("count"), F.sum(length).alias("total"), F.max(length).alias("longest"), F.min(length).alias("shortest"))


def mean_deviation(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, mean, mad): mean and mean absolute deviation, weighted where a weight is given. Keys must not be null."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = df.where(F.col(value).isNotNull())
    mean = rows.groupBy(*keys).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("mean"))
    dev = rows.join(mean, list(keys)) if keys else rows.withColumn("mean", mean.scalar())
    return dev.groupBy(*keys, "mean").agg((F.sum(F.abs(F.col(value) - F.col("mean")) * w) / F.sum(w)).alias("mad"))


def robust_threshold(median: Column, median_dev: Column, mean: Column, mean_dev: Column, k: float) -> Column:
    """median + k * 1.4826 * MAD; mean + k * 1.253 * MAD where the median's deviation is zero."""
    return F.when(median_dev != 0, median + F.lit(k * 1.4826) * median_dev).otherwise(mean + F.lit(k * 1.253) * mean_dev)


def trimmed(df: DataFrame, keys: Sequence[str], value: str, least: int) -> DataFrame:
    """Rows within three standard deviations (truncated) of their group's mean (truncated), of groups that keep ``least``."""
    stat = df.groupBy(*keys).agg(F.avg(value).cast("int").alias("_m"), F.stddev_pop(value).cast("int").alias("_sd"))
    kept = df.join(stat, list(keys)).where(F.abs(F.col(value) - F.col("_m")) <= 3 * F.col("_sd")).drop("_m", "_sd")
    size = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return kept.join(size.drop("_n"), list(keys), "left_semi")


def read_fold(sides: DataFrame) -> DataFrame:
    """Per read over its overlaps: number, aligned bases, best identity by aligned length, largest overhang (partial and
    final aggregation come with the engine)."""
    aligned = F.col("r_end") - F.col("r_start")
    hang = F.greatest(F.least("r_start", "o_start"), F.least(F.col("r_len") - F.col("r_end"), F.col("o_len") - F.col("o_end")))
    return sides.groupBy("read").agg(
        F.count(F.lit(1)).alias("overlaps"), F.sum(aligned).alias("aligned_bases"), F.max_by("identity", F.struct(aligned, F.col("ol_id"))).alias("best_identity"), F.max(hang).alias("overhang")
    )


def binned_identity(sides: DataFrame, width: int = 1000) -> DataFrame:
    """(read, bin, n, identity, threshold): per stretch of ``width`` bases the rounded mean identity of the overlaps over
    it, and the mean less six mean deviations by the usual factor."""
    rows = sides.where("identity is not null and r_end > r_start").select("read", "identity", F.explode(F.sequence(F.call_function("div", "r_start", F.lit(width)), F.call_function("div", F.col("r_end") - 1, F.lit(width)))).alias("bin"))
    # the mean by a window and the deviations by a grouping on the same keys: one shuffle; a place's rows are its coverage
    rows = rows.withColumn("_m", F.avg("identity").over(Window.partitionBy("read", "bin")))
    got = rows.groupBy("read", "bin").agg(F.count(F.lit(1)).alias("n"), F.max("_m").alias("_m"), F.avg(F.abs(F.col("identity") - F.col("_m"))).alias("_d"))
    return got.select("read", "bin", "n", F.round("_m", 6).alias("identity"), F.round(F.col("_m") - F.lit(6 * 1.253) * F.col("_d"), 6).alias("threshold"))


def mapping_accuracy(best: DataFrame, matches: str, aligned: str, length: str) -> DataFrame:
    """One row from the best record of every read: reads, matches over aligned bases and over all bases."""
    return best.agg(F.count(F.lit(1)).alias("reads"), F.sum(matches).alias("matches"), F.sum(aligned).alias("aligned"), F.sum(length).alias("bases")).select(
        "reads", "matches", "aligned", "bases", (F.col("matches") / F.nullif("aligned", F.lit(0))).alias("rate_aligned"), (F.col("matches") / F.nullif("bases", F.lit(0))).alias("rate_all")
    )


def confusion(df: DataFrame, keys: Sequence[str], truth: Column, called: Column) -> DataFrame:
    """(keys, tp, fp, fn, tn, precision, recall, f1) of two flags; null flags count as false."""
    t, c = F.coalesce(truth, F.lit(False)), F.coalesce(called, F.lit(False))

    def n(x: Column) -> Column:
        return F.sum(x.cast("long"))

    got = df.groupBy(*keys).agg(n(t & c).alias("tp"), n(~t & c).alias("fp"), n(t & ~c).alias("fn"), n(~t & ~c).alias("tn"))
    zero = F.lit(0)
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), zero), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), zero)
    return got.withColumns({"precision": p, "recall": r, "f1": 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), zero)})


def pair_classes(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs of like (product 1), unlike (-1) and unknown (0 or null) classes of -1, 0, 1."""
    p = F.coalesce(F.col(a) * F.col(b), F.lit(0))
    return pairs.agg(F.sum((p > 0).cast("long")).alias("like"), F.sum((p < 0).cast("long")).alias("unlike"), F.sum((p == 0).cast("long")).alias("unknown"))


def hamming_error(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """(keys, error): the share of the smaller of two counts in their sum over all rows, in percent."""
    return df.groupBy(*keys).agg((F.sum(F.least(a, b)) * 100 / F.nullif(F.sum(F.col(a) + F.col(b)), F.lit(0))).alias("error"))


def stage_seconds(df: DataFrame, stage: str, begin: str, end: str) -> DataFrame:
    """(stage, runs, seconds) from begin and end times; runs without an end count no time."""
    return df.groupBy(stage).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.unix_timestamp(end) - F.unix_timestamp(begin)).alias("seconds"))


def best_reference_share(best: DataFrame, group: str, ref: str, weight: str) -> DataFrame:
    """(group, ref, weight, share) of every reference within its group."""
    per = best.groupBy(group, ref).agg(F.sum(weight).alias("weight"))
    total = per.groupBy(group).agg(F.sum("weight").alias("_t"))
    return per.join(total, group).select(group, ref, "weight", (F.col("weight") / F.nullif("_t", F.lit(0))).alias("share"))


