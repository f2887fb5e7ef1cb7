"""Coverage along coordinates from interval ends: events, running sums, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.overlap import sides
from strandframe.operators.prefix import haloed, next_position, running_count, running_max_before, running_sum
from strandframe.session import cut, skew_join


def segments(intervals: DataFrame, keys: Sequence[str], start: Column, end: Column, length: Column | None = None) -> DataFrame:
    """(keys, start, end, depth): stretches of constant depth, zero depth included between 0 and ``length`` where given.

    Intervals with start >= end or null fields cover nothing. Equal intervals count each."""
    iv = intervals.select(*keys, start.cast("long").alias("_s"), end.cast("long").alias("_e"), (F.lit(None) if length is None else length).cast("long").alias("_l"))
    real = F.col("_s") < F.col("_e")
    ends = F.array(F.struct(F.col("_s").alias("pos"), F.when(real, 1).otherwise(0).alias("d")), F.struct(F.col("_e").alias("pos"), F.when(real, -1).otherwise(0).alias("d")))
    border = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).alias("d")), F.struct(F.col("_l").alias("pos"), F.lit(0).alias("d")))
    points = iv.withColumn("_p", F.explode(F.concat(F.when(real, ends).otherwise(F.array().cast(ends_type)), F.when(F.col("_l").isNotNull(), border).otherwise(F.array().cast(ends_type)))))
    events = points.groupBy(*keys, F.col("_p.pos").alias("start")).agg(F.sum("_p.d").alias("_d"))
    out = next_position(running_sum(events, keys, "start", "_d", "depth"), keys, "start", "end")
    return out.where(F.col("end").isNotNull()).select(*keys, "start", "end", "depth")


ends_type = "array<struct<pos:bigint,d:int>>"


def _thirds() -> list[Column]:
    """Mean depths in the three thirds of ``_len``, truncated; the last third takes the rest."""
    third = F.expr("_len div 3")

    def part(k: int) -> Column:
        a, b = F.greatest(F.col("start"), third * k), F.least(F.col("end"), third * (k + 1) if k < 2 else F.col("_len"))
        return F.call_function("div", F.sum(F.greatest(F.lit(0), b - a) * F.col("depth")), F.nullif(F.max(third), F.lit(0))).alias(f"c{k}")

    return [part(k) for k in range(3)]


def core(segs: DataFrame, keys: Sequence[str], lo: Column, hi: Column, length: Column | None = None) -> DataFrame:
    """(keys, min_depth, max_depth, bases, sum_depth) within [lo, hi) of every key, and with ``length`` the columns of
    ``thirds`` from the same grouping. Keys without a base inside are left out."""
    n = F.least(F.col("end"), hi) - F.greatest(F.col("start"), lo)
    rows = segs.withColumn("_n", F.when(n > 0, n)).withColumn("_len", (F.lit(None) if length is None else length).cast("long"))
    inside = F.when(F.col("_n").isNotNull(), F.col("depth"))
    got = rows.groupBy(*keys).agg(F.min(inside).alias("min_depth"), F.max(inside).alias("max_depth"), F.sum("_n").alias("bases"), F.sum(inside * F.col("_n")).alias("sum_depth"), *([] if length is None else _thirds()))
    return got.where("min_depth is not null")


def thirds(segs: DataFrame, keys: Sequence[str], length: Column) -> DataFrame:
    """(keys, c0, c1, c2): mean depth in the three thirds, truncated; the last third takes the rest of the length."""
    return segs.withColumn("_len", length.cast("long")).groupBy(*keys).agg(*_thirds())


def longest_run(segs: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """(keys, start, end) of the longest stretch with depth at least ``least``, the first of equal ones."""
    ok = segs.where(F.col("depth") >= least)
    runs = merge(ok, keys, gap=0)
    key = F.struct((F.col("end") - F.col("start")).alias("n"), (-F.col("start")).alias("s"), F.col("end").alias("e"))
    return runs.groupBy(*keys).agg(F.max(key).alias("_r")).select(*keys, (-F.col("_r.s")).alias("start"), F.col("_r.e").alias("end"))


def merge(intervals: DataFrame, keys: Sequence[str], gap: int = 0) -> DataFrame:
    """(keys, start, end, n): intervals joined where the next starts at most ``gap`` after the ones before end.

    Starts and ends must not be null. Runs are found in buckets of starts, so a key with very many intervals is no single
    task's work."""
    order = ["start", "end"]
    rows = running_max_before(intervals.select(*keys, "start", "end"), keys, order, "end", "_reach")
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + gap)).cast("int"))
    # a run opens at the least of its starts, so runs can be told by the number of openings up to a start
    rows = running_count(rows.drop("_reach"), keys, order, "_new", "_run")
    return rows.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


def moving_mean(rows: DataFrame, keys: Sequence[str], pos: str, value: str, size: int, name: str = "mean") -> DataFrame:
    """Mean of ``value`` over this and the next ``size`` - 1 rows; rows with fewer are left out. (keys, pos) must be unique."""
    ranked = haloed(running_sum(rows.withColumn("_one", F.lit(1)), keys, pos, "_one", "_k").drop("_one"), keys, "_k", 0, size - 1)
    w = Window.partitionBy(*keys, "_b").orderBy("_k").rowsBetween(0, size - 1)
    out = ranked.withColumn(name, F.avg(value).over(w)).withColumn("_n", F.count(value).over(w))
    return out.where(F.col("_real") & (F.col("_n") == size)).drop("_k", "_n", "_b", "_real")


def _summed(rows: DataFrame, keys: Sequence[str], pos: str, value: str, width: int) -> DataFrame:
    """Adds ``_s``: the sum of ``value`` over rows within ``width`` up to a row, in buckets with a halo."""
    w = Window.partitionBy(*keys, "_b").orderBy(pos).rangeBetween(-width, 0)
    return haloed(rows.select(*keys, pos, value), keys, pos, width).withColumn("_s", F.sum(value).over(w)).where("_real")


def sliding_min(rows: DataFrame, keys: Sequence[str], pos: str, value: str, width: int) -> DataFrame:
    """(keys, least, at): the smallest sum of ``value`` over rows within ``width`` up to a row, and the row's position."""
    sums = _summed(rows, keys, pos, value, width)
    return sums.groupBy(*keys).agg(F.min(F.struct(F.col("_s").alias("s"), F.col(pos).alias("p"))).alias("_m")).select(*keys, F.col("_m.s").alias("least"), F.col("_m.p").alias("at"))


def best_window(rows: DataFrame, keys: Sequence[str], pos: str, score: str, width: int) -> DataFrame:
    """(keys, best, at): the largest sum of ``score`` over positions within ``width`` up to a row, the first of equal ones."""
    sums = _summed(rows, keys, pos, score, width)
    return sums.groupBy(*keys).agg(F.max(F.struct(F.col("_s").alias("s"), (-F.col(pos)).alias("p"))).alias("_m")).select(*keys, F.col("_m.s").alias("best"), (-F.col("_m.p")).alias("at"))


def crowded(rows: DataFrame, keys: Sequence[str], pos: str, width: int, least: int) -> DataFrame:
    """Rows that lie in some stretch of ``width`` with at least ``least`` rows."""
    w = Window.partitionBy(*keys, "_b").orderBy(pos)
    # rows up to ``width`` behind a row matter, and for their counts those up to ``width`` before them
    both = haloed(rows, keys, pos, width, width).withColumn("_n", F.count(pos).over(w.rangeBetween(-width, 0)))
    return both.withColumn("_most", F.max("_n").over(w.rangeBetween(0, width))).where(F.col("_real") & (F.col("_most") >= least)).drop("_n", "_most", "_b", "_real")


def covers(overlaps: DataFrame) -> DataFrame:
    """(read, least, middle): of every read of the overlaps the least and the middle of the mean coverages of its thirds, its id as
    text."""
    segs = cut(segments(sides(overlaps, "ol_id"), ["read"], F.col("r_start"), F.col("r_end"), F.col("r_len")))
    third = thirds(skew_join(segs, segs.groupBy("read").agg(F.max("end").alias("len")), ["read"]), ["read"], F.col("len"))
    return cut(third.select(F.col("read").cast("string").alias("read"), F.least("c0", "c1", "c2").alias("least"), F.col("c1").alias("middle")))


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def hist_percentile(hist: DataFrame, percent: float) -> DataFrame:
    """One row: the smallest value whose cumulative frequency reaches n * percent / 100."""
    run = running_sum(hist, [], "value", "freq", "_c")
    total = hist.agg(F.sum("freq")).scalar()
    return run.where(F.col("_c") >= total * F.lit(percent) / 100).agg(F.min("value").alias("value"))


def first_trough(hist: DataFrame, last: int, k: int) -> DataFrame:
    """One row (trough): the first trough of a histogram (value, freq) smoothed over ``k`` values, looked for within ``last``
    values from the least one on; counted from there, at least 1.

    The search begins where a count first falls within the first tenth. The smoothed line is lowest where it next fails to
    fall, and the trough is the least count in that window, moved back over neighbours that lie within 15 % of the next and
    50 % of the least. No more than ``last`` + 2 ``k`` rows are looked at, so these windows have no keys."""
    if k % 2 == 0 or k < 1:
        raise ValueError("k must be odd")
    spark = hist.sparkSession
    low = hist.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    near = hist.join(F.broadcast(low)).select((F.col("value") - F.col("low")).alias("i"), "freq").where(F.col("i") < last + 2 * k)
    c = spark.range(last + 2 * k).withColumnRenamed("id", "i").join(near, "i", "left").select("i", F.coalesce("freq", F.lit(0)).alias("c"))
    w = Window.orderBy("i")
    n = low.select(F.greatest(F.col("high") - F.col("low") + 1, F.lit(k)).alias("n"))
    line = c.join(F.broadcast(n)).select("i", "n", "c", F.lag("c").over(w).alias("p"), F.sum("c").over(w.rowsBetween(0, k - 1)).alias("s"), F.sum("c").over(w.rowsBetween(1, k)).alias("s1"))
    line = cut(line)
    start = line.where((F.col("p") > F.col("c")) & (F.col("i") < F.least(F.lit(last // 10), F.col("n")))).agg(F.coalesce(F.min(F.col("i") - 1), F.lit(0)).alias("start"))
    end = (F.col("s1") >= F.col("s")) | (F.col("i") + 1 >= F.least("n", F.lit(last)))
    at = line.join(F.broadcast(start)).where((F.col("i") >= F.col("start")) & end).agg(F.min("i").alias("at"))
    bottom = line.join(F.broadcast(at)).where(F.col("i").between(F.col("at"), F.col("at") + k - 1)).agg(F.min(F.struct("c", "i")).alias("b"))
    flat = F.col("p").between(F.col("c") * 0.85, F.col("c") * 1.15) & F.col("p").between(F.col("b.c") * 0.5, F.col("b.c") * 1.5)
    stop = line.join(F.broadcast(bottom)).where((F.col("i") <= F.col("b.i")) & ((F.col("i") == 0) | ~flat)).agg(F.max("i").alias("i"))
    return stop.select(F.greatest(F.coalesce("i", F.lit(1)), F.lit(1)).cast("int").alias("trough"))


def trough_of(df: DataFrame, value: str, last: int, k: int) -> DataFrame:
    """``first_trough`` of a column; nulls do not count."""
    return first_trough(histogram(df, value), last, k)


def least_cover(intervals: DataFrame, keys: Sequence[str], start: str, end: str, trim: int) -> DataFrame:
    """(keys, least, from, to): the least coverage by intervals trimmed at both ends, between the first trimmed start and the
    last trimmed end of the key; keys of whose intervals nothing is left give no row."""
    segs = segments(intervals, keys, F.col(start) + trim, F.col(end) - trim)
    return segs.groupBy(*keys).agg(F.min("depth").alias("least"), F.min("start").alias("from"), F.max("end").alias("to"))


def cliffs(mean: Sequence[float], step: int) -> tuple[int, int]:
    """(left, right): the end of a rise at the start and the start of a fall at the end of a smoothed line, -1 for none.

    The line is cut into slopes of ``step`` entries; a first slope that rises by more than half of the line's range makes
    a left cliff, a last one that falls as much a right cliff."""
    if len(mean) <= step:
        return -1, -1
    span = (max(mean) - min(mean)) / 2 or 1.0
    slopes = [(i, min(i + step, len(mean) - 1)) for i in range(0, len(mean) - 1, step)]
    rise = next((b for a, b in slopes[:2] if mean[b] - mean[a] > span), -1)
    fall = next((a for a, b in slopes[-2:] if mean[a] - mean[b] > span), -1)
    return rise, fall
