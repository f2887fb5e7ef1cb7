"""Base calls of reads at contig positions: histograms, confirmed variants, agreement of reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions.overlap import threshold
from strandframe.session import cut, n_rows


def base_histogram(calls: DataFrame) -> DataFrame:
    """(ctg, pos, n_a, n_c, n_g, n_t, n_del, cov) from (ctg, pos, base) with bases 0 to 3 and 8 for a deletion.

    Grouping by contig and position spreads a deep contig over its positions; counts combine before the shuffle."""

    def n(b: int) -> Column:
        return F.sum((F.col("base") == b).cast("int"))

    return calls.groupBy("ctg", "pos").agg(n(0).alias("n_a"), n(1).alias("n_c"), n(2).alias("n_g"), n(3).alias("n_t"), n(8).alias("n_del"), F.count("base").alias("cov"))


def confirmed(hist: DataFrame, low: float, high: float, at_low: float, at_high: float) -> DataFrame:
    """Positions whose two commonest bases both reach the coverage's threshold: ctg, pos, var0, var1 with var0 the commoner,
    equal counts by base. Coverages outside [low, high] do not count."""
    tops = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"n_{b}").alias("n"), F.lit(3 - i).alias("order"), F.lit(i).alias("base")) for i, b in enumerate("acgt")])))
    rows = hist.where(F.col("cov").between(low, high)).withColumn("_t", tops).withColumn("_th", threshold(F.col("cov"), low, high, at_low, at_high))
    return rows.where(F.col("_t")[1].n >= F.col("_th")).select("ctg", "pos", F.col("_t")[0].base.alias("var0"), F.col("_t")[1].base.alias("var1"))


def alleles_of_reads(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls at confirmed sites: ctg, pos, read, base, choice (0, 1, or -1 for a third base)."""
    return calls.join(sites, ["ctg", "pos"]).select("ctg", "pos", "read", "base", F.when(F.col("base") == F.col("var0"), 0).when(F.col("base") == F.col("var1"), 1).otherwise(-1).alias("choice"))


def agreement(pairs: DataFrame, alleles: DataFrame) -> DataFrame:
    """(a, b, same, different) over the sites both reads of a pair cover; calls of -1 count for neither."""
    left = alleles.where("choice != -1").select(F.col("read").alias("a"), "ctg", "pos", F.col("choice").alias("_x"))
    right = alleles.where("choice != -1").select(F.col("read").alias("b"), "ctg", "pos", F.col("choice").alias("_y"))
    both = pairs.select("a", "b").distinct().join(left, "a").join(right, ["b", "ctg", "pos"])
    return both.groupBy("a", "b").agg(F.sum((F.col("_x") == F.col("_y")).cast("long")).alias("same"), F.sum((F.col("_x") != F.col("_y")).cast("long")).alias("different"))


def shared_sites(alleles: DataFrame, least: int) -> DataFrame:
    """(ctg, t, q, n) of reads of a contig with calls at ``least`` sites in common, t < q. Reads that overlap on the contig meet at
    its sites, so the pairs of a site are bounded by the coverage there."""
    ok = alleles.where("choice != -1").select("ctg", "pos", "read").distinct()
    both = ok.select("ctg", "pos", F.col("read").alias("t")).join(ok.select("ctg", "pos", F.col("read").alias("q")), ["ctg", "pos"]).where("t < q")
    return both.groupBy("ctg", "t", "q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def majority_vote(alleles: DataFrame) -> DataFrame:
    """(ctg, pos, choice) by more than half of the calls other than -1."""
    n = alleles.where("choice != -1").groupBy("ctg", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("choice").alias("ones"))
    return n.where("ones * 2 != n").select("ctg", "pos", F.when(F.col("ones") * 2 > F.col("n"), 1).otherwise(0).alias("choice"))


def read_votes(alleles: DataFrame, truth: DataFrame) -> DataFrame:
    """(read, ctg, agree, disagree) of a read's calls with (ctg, pos, choice)."""
    t = truth.select("ctg", "pos", F.col("choice").alias("_t"))
    rows = alleles.where("choice != -1").join(t, ["ctg", "pos"])
    return rows.groupBy("read", "ctg").agg(F.sum((F.col("choice") == F.col("_t")).cast("long")).alias("agree"), F.sum((F.col("choice") != F.col("_t")).cast("long")).alias("disagree"))


def linkage(alleles: DataFrame, ctg: str, near: int, reads: int, span: int) -> DataFrame:
    """(ctg, pos0, pos1, n, concordance) of site pairs at least ``near`` and at most ``span`` apart that share ``reads``
    reads: the larger diagonal of their 2 x 2 table over its sum."""
    # positions are binned by the span, so a read's sites meet those of their own bin and the next one only
    ok = alleles.where("choice != -1").withColumn("_b", F.floor(F.col("pos") / span))
    x = ok.select("read", ctg, F.col("pos").alias("pos0"), F.col("choice").alias("c0"), F.explode(F.array("_b", F.col("_b") + 1)).alias("_b"))
    y = ok.select("read", ctg, F.col("pos").alias("pos1"), F.col("choice").alias("c1"), "_b")
    both = x.join(y, ["read", ctg, "_b"]).where((F.col("pos1") - F.col("pos0")).between(near, span))
    t = both.groupBy(ctg, "pos0", "pos1").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("c0") == F.col("c1")).cast("long")).alias("diag"))
    return t.where(F.col("n") >= reads).select(ctg, "pos0", "pos1", "n", (F.greatest(F.col("diag"), F.col("n") - F.col("diag")) / F.col("n")).alias("concordance"))


def nearest_placement(rows: DataFrame, keys: list[str], wanted: str, offered: str, score: str, slack: int = 500) -> DataFrame:
    """Per key the row whose ``offered`` lies nearest to ``wanted``; among those within ``slack`` of the nearest the best
    ``score``, then the nearer, then the smaller offer."""
    d = F.abs(F.col(wanted) - F.col(offered))
    near = rows.withColumn("_d", d).withColumn("_least", F.min("_d").over(Window.partitionBy(*keys))).where(F.col("_d") <= F.col("_least") + slack)
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "_d", offered)
    return near.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_d", "_least")


def compatible(offset_a: Column, offset_b: Column, same: Column, length: Column) -> Column:
    """Two placements agree: same direction and offsets within the larger of 1000 bases and a tenth of the length."""
    return same & (F.abs(offset_a - offset_b) <= F.greatest(F.lit(1000), (length * F.lit(0.1)).cast("int")))


def kmer_classes(read_kmers: DataFrame, pat: DataFrame, mat: DataFrame, margin: float = 1.0) -> DataFrame:
    """(read, pat, mat, cls): distinct windows of every read in two k-mer sets, and the class (1 or -1) of the larger share
    of its set, 0 within the margin. ``read_kmers`` has (read, kmer); sets have kmer, counted once."""
    pat, mat = (cut(s.select("kmer").distinct()) for s in (pat, mat))
    sizes = {n: max(1, n_rows(s)) for n, s in (("pat", pat), ("mat", mat))}
    flags = pat.select("kmer", F.lit(1).alias("p"), F.lit(0).alias("m")).union(mat.select("kmer", F.lit(0), F.lit(1))).groupBy("kmer").agg(F.max("p").alias("p"), F.max("m").alias("m"))
    got = read_kmers.join(flags, "kmer").groupBy("read").agg(F.sum("p").alias("pat"), F.sum("m").alias("mat"))
    x, y = F.col("pat") / sizes["pat"], F.col("mat") / sizes["mat"]
    return got.withColumn("cls", F.when(x > y * margin, 1).when(y > x * margin, -1).otherwise(0))
