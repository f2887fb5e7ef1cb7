"""Grouping, coverage, windows and statistics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions.overlap import aligned_length, sides
from strandframe.operators import coverage, grouping, intervals, selecting, stats, weighted
from strandframe.plans.views import AL, LEN, OV, READS, SIDES, alignments, overlaps, reads
from strandframe.session import cut, skew_join, table


def grp_best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest overlap of every read with every other (A1, A2)."""
    return grouping.best_neighbours(overlaps(spark, sf_dir)).select("read", "other", "ol_id", "aligned")


def grp_best_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the best alignment of every contig and read (A4)."""
    al = alignments(spark, sf_dir)
    top = F.max(F.struct(aligned_length().alias("aligned"), (-F.col("ol_id")).alias("id")))
    return al.groupBy("b_id", "a_id").agg(F.count(F.lit(1)).alias("n"), top.alias("t")).select("b_id", "a_id", (-F.col("t.id")).alias("ol_id"), "t.aligned", "n")


def grp_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every overlap among those of its pair (A3, A5)."""
    return grouping.duplicates(overlaps(spark, sf_dir)).select("ol_id", "rank", "n")


def grp_duplicate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlaps of pairs with several, longest first (A3)."""
    return grouping.duplicate_lists(overlaps(spark, sf_dir)).select("a", "b", F.array_join(F.transform("ol_ids", lambda x: x.cast("string")), ",").alias("ol_ids"))


def grp_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of overlaps in the index of their query and their target."""
    return grouping.two_way_index(overlaps(spark, sf_dir))


def grp_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contained reads and a container."""
    return grouping.contained_reads(overlaps(spark, sf_dir), 20)


def grp_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of contained reads carried over to their overlaps."""
    ov = overlaps(spark, sf_dir)
    gone = grouping.contained_reads(ov, 20).select("read", F.concat(F.lit("contained:"), F.col("container").cast("string")).alias("reason"))
    return grouping.reasons(ov, gone).select("ol_id", "reason")


def _trim() -> F.Column:
    return F.least(F.lit(500), F.expr("(r_len + 1) div 10"))


def _read_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sides(overlaps(spark, sf_dir), "ol_id")
    return coverage.segments(rows, ["read"], F.col("r_start") + _trim(), F.col("r_end") - _trim(), F.col("r_len"))


def cov_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of constant coverage of every read by trimmed overlaps."""
    return _read_segments(spark, sf_dir)


def cov_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of constant coverage of every contig."""
    return coverage.segments(alignments(spark, sf_dir), ["b_id"], F.col("b_start"), F.col("b_end"))


def cov_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and most coverage inside the trimmed core, and the means of the thirds."""
    segs = cut(_read_segments(spark, sf_dir))
    s = skew_join(segs, segs.groupBy("read").agg(F.max("end").alias("len")), ["read"])
    lo = F.least(F.lit(500), F.expr("(len + 1) div 10"))
    # reads covered too thinly or too deeply in their core are left out
    return coverage.core(s, ["read"], lo, F.col("len") - lo, F.col("len")).where("min_depth >= 1 and max_depth <= 12")


def cov_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value at 99.99 % of the contigs' coverages by histogram."""
    segs = cov_contigs(spark, sf_dir)
    return coverage.hist_percentile(coverage.histogram(segs, "depth"), 99.99)


def cov_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest stretch of every contig with coverage of two or more."""
    return coverage.longest_run(cov_contigs(spark, sf_dir), ["b_id"], 2)


def cov_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of a contig joined over gaps of up to 1000 bases."""
    al = alignments(spark, sf_dir).select("b_id", F.col("b_start").alias("start"), F.col("b_end").alias("end"))
    return coverage.merge(al, ["b_id"], gap=1000)


def win_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sum of aligned bases of alignments that begin within 5000 bases."""
    al = alignments(spark, sf_dir).withColumn("n", aligned_length())
    return coverage.best_window(al, ["b_id"], "b_start", "n", 5000)


def win_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments that begin within 10 kb of five others or more."""
    return coverage.crowded(alignments(spark, sf_dir), ["b_id"], "b_start", 10_000, 6).select("ol_id")


def win_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretch of 1000 bases with the fewest aligned bases begun."""
    al = alignments(spark, sf_dir).withColumn("n", aligned_length())
    return coverage.sliding_min(al, ["b_id"], "b_start", "n", 1000)


def win_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving mean of tile lengths of every sequence."""
    t = table(spark, sf_dir, "contig_tiles").where("seq_id is not null and tile_no is not null").select("seq_id", "tile_no", (F.col("tile_end") - F.col("tile_start")).alias("n")).groupBy("seq_id", "tile_no").agg(F.max("n").alias("n"))
    return coverage.moving_mean(t, ["seq_id"], "tile_no", "n", 5).select("seq_id", "tile_no", F.round("mean", 6).alias("mean"))


def win_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that do not go on from the node where the one before ends."""
    from pyspark.sql import Window

    t = table(spark, sf_dir, "contig_tiles").where("seq_id is not null and tile_no is not null").groupBy("seq_id", "tile_no").agg(F.max("edge_path").alias("edge"))
    before = F.lag("edge").over(Window.partitionBy("seq_id").orderBy("tile_no"))
    return t.withColumn("before", before).where(F.element_at(F.split("before", "~"), 2) != F.element_at(F.split("edge", "~"), 1)).select("seq_id", "tile_no", "before", "edge")


def win_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of 4000 bases every 3000 over every contig."""
    c = table(spark, sf_dir, "contigs").where("ctg_len > 0")
    w = c.select("ctg_id", "ctg_len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ctg_len") - 1, F.lit(3000).cast("long"))).alias("win_start"))
    return w.select("ctg_id", "win_start", F.least("ctg_len", F.col("win_start") + 4000).alias("win_end"))


def win_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned bases within a region of every contig by interval join."""
    regions = table(spark, sf_dir, "contigs").select(F.col("ctg_id").alias("b_id"), F.expr("ctg_len div 4").alias("r_start"), F.expr("ctg_len div 4 + 20000").alias("r_end"))
    al = alignments(spark, sf_dir).select("ol_id", "b_id", F.col("b_start").cast("long").alias("l_start"), F.col("b_end").cast("long").alias("l_end"))
    got = intervals.interval_join(al, regions, "b_id").withColumn("n", intervals.common_bases())
    return got.groupBy("b_id").agg(F.count(F.lit(1)).alias("alignments"), F.sum("n").alias("bases"))


def stat_n50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N25, N50, N75 of the reads with their numbers."""
    return stats.n_values(reads(spark, sf_dir), "len")


def stat_n50_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N50 of the contigs where half needs to be reached only."""
    return stats.n_values(table(spark, sf_dir, "contigs"), "ctg_len", [50], strict=False)


def stat_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_summary(reads(spark, sf_dir), "len")


def stat_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and its absolute deviation of aligned lengths per library."""
    df = table(spark, sf_dir, "read_stats").where("lib_name is not null")
    return weighted.median_deviation(weighted.compress(df, ["lib_name"], F.col("aligned_len").cast("long")), ["lib_name"])


def stat_weighted_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median overhang weighted by aligned length."""
    df = table(spark, sf_dir, "read_stats").where("lib_name is not null and overhang_l >= 0 and aligned_len is not null")
    pairs = df.groupBy("lib_name", F.col("overhang_l").cast("long").alias("value")).agg(F.sum("aligned_len").alias("freq"))
    return weighted.median_deviation(pairs, ["lib_name"], rank=weighted.HALF_WEIGHT).select("lib_name", "median", "mad")


def stat_mean_dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and mean absolute deviation of aligned lengths per library."""
    df = table(spark, sf_dir, "read_stats").where("lib_name is not null")
    return stats.mean_deviation(df, ["lib_name"], "aligned_len").select("lib_name", F.round("mean", 6).alias("mean"), F.round("mad", 6).alias("mad"))


def stat_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned length under which an overlap of a library is an outlier."""
    both = stat_mad(spark, sf_dir).withColumnRenamed("mad", "dev").join(stats.mean_deviation(table(spark, sf_dir, "read_stats").where("lib_name is not null"), ["lib_name"], "aligned_len"), "lib_name")
    return both.select("lib_name", F.round(stats.robust_threshold(F.col("median"), F.col("dev"), F.col("mean"), F.col("mad"), -2.0), 4).alias("threshold"))


def stat_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps, aligned bases, best identity and largest overhang per read."""
    return stats.read_fold(sides(overlaps(spark, sf_dir), "ol_id", "identity"))


def stat_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity thresholds per thousand bases of every read."""
    return stats.binned_identity(sides(overlaps(spark, sf_dir), "ol_id", "identity"))


def stat_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every read's best overlap over aligned and over all bases."""
    ov = table(spark, sf_dir, "read_overlaps").where("qid is not null and qid != -1").select("ol_id", "qid", "matches", "alnlen", "qlen").distinct()
    best = grouping.best_per_group(ov, ["qid"], [F.col("matches")], "ol_id")
    out = stats.mapping_accuracy(best, "matches", "alnlen", "qlen")
    return out.select("reads", "matches", "aligned", "bases", F.round("rate_aligned", 9).alias("rate_aligned"), F.round("rate_all", 9).alias("rate_all"))


def stat_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within three deviations, of libraries that keep a hundred."""
    df = table(spark, sf_dir, "read_stats").where("lib_name is not null and stat_id is not null and mate_len is not null").select("stat_id", "lib_name", "mate_len").distinct()
    return stats.trimmed(df, ["lib_name"], "mate_len", 100).select("stat_id")


def stat_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overhang against identity as a call per library, with precision and recall."""
    df = table(spark, sf_dir, "read_stats").where("lib_name is not null and not isnan(coalesce(identity_pct, 0))")
    out = stats.confusion(df, ["lib_name"], F.col("identity_pct") > 95, F.col("overhang_l") < 50)
    return out.select("lib_name", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def stat_pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like and unlike pairs by a class of read ids."""
    ov = overlaps(spark, sf_dir).withColumn("x", (F.col("a_id") % 3 - 1)).withColumn("y", (F.col("b_id") % 3 - 1))
    return stats.pair_classes(ov, "x", "y")


def stat_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller of two counts in their sum per reduce type."""
    df = table(spark, sf_dir, "graph_edges").where("reduce_type is not null and snp_same is not null and snp_diff is not null")
    return stats.hamming_error(df, ["reduce_type"], "snp_same", "snp_diff").select("reduce_type", F.round("error", 9).alias("error"))


def stat_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds between rise and storage per library."""
    df = table(spark, sf_dir, "read_stats").select("lib_name", F.date_trunc("second", "made_at").alias("b"), F.date_trunc("second", "loaded_at").alias("e"))
    return stats.stage_seconds(df, "lib_name", "b", "e")


def stat_ref_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of contigs in the aligned bases of each kind of read."""
    al = alignments(spark, sf_dir).withColumn("n", aligned_length())
    best = grouping.best_per_group(al, ["a_id"], [F.col("n")], "ol_id").withColumn("kind", F.col("a_id") % 5)
    return stats.best_reference_share(best, "kind", "b_id", "n").select("kind", "b_id", "weight", F.round("share", 9).alias("share"))


def top_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest reads up to a million bases, ties kept."""
    return selecting.longest_to_total(reads(spark, sf_dir), "len", 300_000).select("read_id", "len")


def top_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs by length, dealt to seven bins forth and back."""
    return selecting.serpentine(table(spark, sf_dir, "contigs"), [F.col("ctg_len").desc(), F.col("ctg_id")], 7).select("ctg_id", "bin")


def top_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten contigs with the greatest work count^2 / max(1, len / 10^6)."""
    n = alignments(spark, sf_dir).groupBy("b_id").agg(F.count(F.lit(1)).alias("n"), F.max("b_len").alias("len"))
    w = F.round(F.col("n") * F.col("n") / F.greatest(F.lit(1.0), F.col("len") / 1e6), 6)
    return n.select("b_id", w.alias("weight")).orderBy(F.col("weight").desc(), "b_id").limit(10)


def top_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by the first of three name sets that holds a side."""
    df = table(spark, sf_dir, "read_overlaps").where("qname is not null and tname is not null").select("ol_id", "qname", "tname").distinct()
    names = table(spark, sf_dir, "seq_reads").where("read_id is not null and read_name is not null").select(F.col("read_name").alias("name"), F.when(F.col("quality").isNotNull(), 0).when(F.col("sub_head").isNotNull(), 1).when(F.col("seq_len") >= 1500, 2).alias("place")).where("place is not null")
    return selecting.first_matching_set(df, names, "qname", "tname").select("ol_id", "place")


def top_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three placements of every read without much overlap on the read (T5)."""
    al = alignments(spark, sf_dir).where("a_start < a_end").select("ol_id", "a_id", "a_start", "a_end", (F.col("a_end") - F.col("a_start")).alias("n"))
    return selecting.spread_placements(al, "a_id", "a_start", "a_end", "n", 3).groupBy("a_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("bases"))


def top_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads in blocks of at least 50,000 bases."""
    return selecting.blocks(reads(spark, sf_dir).select("read_id", "len"), "read_id", "len", 50_000, shards=4).groupBy("shard", "block").agg(F.count(F.lit(1)).alias("reads"), F.sum("len").alias("bases"))


def top_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded draw of reads of about 200,000 bases."""
    return selecting.sample_to_total(reads(spark, sf_dir), F.col("read_id"), "len", 200_000, seed=7).select("read_id", "len")


QUERIES = {
    f.__name__: f
    for f in (
        grp_best_pair, grp_best_by_target, grp_duplicates, grp_duplicate_lists, grp_index, grp_contained, grp_reasons, cov_reads, cov_contigs, cov_core, cov_percentile, cov_longest, cov_merged, win_best, win_crowded, win_least, win_mean, win_breaks, win_analysis, win_regions,
        stat_n50, stat_n50_reached, stat_lengths, stat_mad, stat_weighted_mad, stat_mean_dev, stat_threshold, stat_fold, stat_bins, stat_accuracy, stat_trimmed, stat_confusion, stat_pair_classes, stat_hamming, stat_runtime, stat_ref_share,
        top_longest, top_contigs, top_weighted, top_split, top_placements, top_blocks, top_sample,
    )
}

_CONTAINED = """cont AS (SELECT read, min(container) AS container FROM (
        SELECT CASE WHEN af AND bf THEN greatest(a_id, b_id) WHEN af AND bin THEN a_id WHEN bf AND ain THEN b_id END AS read, CASE WHEN af AND bf THEN least(a_id, b_id) WHEN af AND bin THEN b_id WHEN bf AND ain THEN a_id END AS container
        FROM (SELECT *, abs(a_start) <= 20 AND abs(a_len - a_end) <= 20 AS af, abs(b_start) <= 20 AND abs(b_len - b_end) <= 20 AS bf, a_start >= -20 AND a_end <= a_len + 20 AS ain, b_start >= -20 AND b_end <= b_len + 20 AS bin FROM ov WHERE a_id <> b_id)) WHERE read IS NOT NULL GROUP BY read)"""
_TRIM = "least(500, (r_len + 1) // 10)"
_READ_SEGS = f"""iv AS (SELECT read, CAST(r_start + {_TRIM} AS BIGINT) AS s, CAST(r_end - {_TRIM} AS BIGINT) AS e, CAST(r_len AS BIGINT) AS l FROM sides),
    ev AS (SELECT read, pos, CAST(sum(d) AS BIGINT) AS d FROM (SELECT read, s AS pos, 1 AS d FROM iv WHERE s < e UNION ALL SELECT read, e, -1 FROM iv WHERE s < e UNION ALL SELECT read, 0, 0 FROM iv WHERE l IS NOT NULL UNION ALL SELECT read, l, 0 FROM iv WHERE l IS NOT NULL) GROUP BY read, pos),
    segs AS (SELECT * FROM (SELECT read, pos AS start, lead(pos) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY read ORDER BY pos)) WHERE "end" IS NOT NULL)"""
_CTG_SEGS = """ev AS (SELECT b_id, pos, CAST(sum(d) AS BIGINT) AS d FROM (SELECT b_id, CAST(b_start AS BIGINT) AS pos, 1 AS d FROM al WHERE b_start < b_end UNION ALL SELECT b_id, b_end, -1 FROM al WHERE b_start < b_end) GROUP BY b_id, pos),
    segs AS (SELECT * FROM (SELECT b_id, pos AS start, lead(pos) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY b_id ORDER BY pos)) WHERE "end" IS NOT NULL)"""
_N = """r AS (SELECT len, sum(len) OVER (ORDER BY len DESC, id ROWS UNBOUNDED PRECEDING) AS cum, row_number() OVER (ORDER BY len DESC, id) AS k, sum(len) OVER () AS total FROM x), p AS (SELECT unnest([{0}]) AS percent),
    f AS (SELECT percent, min(k) AS k FROM r, p WHERE cum * 100 {1} total * percent GROUP BY percent)
    SELECT CAST(f.percent AS INTEGER) AS percent, CAST(r.len AS BIGINT) AS n_value, f.k AS l_value FROM f JOIN r ON r.k = f.k"""
_TILES = "t AS (SELECT seq_id, tile_no, max(tile_end - tile_start) AS n, max(tile_start) AS tile_start, max(tile_end) AS tile_end FROM contig_tiles WHERE seq_id IS NOT NULL AND tile_no IS NOT NULL GROUP BY seq_id, tile_no)"
_MAD = """v AS (SELECT lib_name, CAST(aligned_len AS BIGINT) AS x FROM read_stats WHERE lib_name IS NOT NULL AND aligned_len IS NOT NULL), m AS (SELECT lib_name, x AS median, n FROM (SELECT *, row_number() OVER (PARTITION BY lib_name ORDER BY x) AS rn, count(*) OVER (PARTITION BY lib_name) AS n FROM v) WHERE rn = n // 2 + 1),
    d AS (SELECT lib_name, abs(x - median) AS y, median, n FROM v JOIN m USING (lib_name)), mad AS (SELECT lib_name, n, median, y AS mad FROM (SELECT *, row_number() OVER (PARTITION BY lib_name ORDER BY y) AS rn FROM d) WHERE rn = n // 2 + 1)"""
_MEAN = "mn AS (SELECT lib_name, avg(aligned_len) AS mean FROM read_stats WHERE lib_name IS NOT NULL GROUP BY lib_name), md AS (SELECT lib_name, mean, avg(abs(aligned_len - mean)) AS mad FROM read_stats JOIN mn USING (lib_name) WHERE aligned_len IS NOT NULL GROUP BY lib_name, mean)"

_DRAWN = "(CAST('0x' || substr(md5(CAST(read_id AS VARCHAR) || ':{0}'), 1, 8) AS BIGINT) >> 2)"

SQL = {
    "top_sample": f"WITH {READS}, w AS (SELECT sum(len) AS w FROM reads) SELECT read_id, CAST(len AS INTEGER) AS len FROM reads, w WHERE w <= 200000 OR {_DRAWN.format(7)} < CAST(trunc(200000 / w * (1 << 30)) AS BIGINT)",
    "top_blocks": f"""WITH RECURSIVE {READS}, r AS (SELECT read_id, len, CAST({_DRAWN.format(0)} % 4 AS INTEGER) AS shard FROM reads), o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY read_id) AS k FROM r),
        w AS (SELECT shard, k, len, CAST(len AS BIGINT) AS held, 0 AS block FROM o WHERE k = 1 UNION ALL SELECT o.shard, o.k, o.len, CASE WHEN w.held >= 50000 THEN o.len ELSE w.held + o.len END, CASE WHEN w.held >= 50000 THEN w.block + 1 ELSE w.block END FROM w JOIN o ON o.shard = w.shard AND o.k = w.k + 1)
        SELECT shard, block, count(*) AS reads, CAST(sum(len) AS BIGINT) AS bases FROM w GROUP BY shard, block""",
    "top_placements": f"""WITH RECURSIVE {AL}, p AS (SELECT a_id, a_start AS s, a_end AS e, row_number() OVER (PARTITION BY a_id ORDER BY a_end - a_start DESC, a_start, a_end) AS k FROM al WHERE a_start < a_end),
        g AS (SELECT a_id, k, [{{'s': s, 'e': e}}] AS t FROM p WHERE k = 1 UNION ALL
            SELECT p.a_id, p.k, CASE WHEN len(t) < 3 AND len(list_filter(t, lambda x: least(p.e, x.e) - greatest(p.s, x.s) > 0.5::DOUBLE * (p.e - p.s))) = 0 THEN list_append(t, {{'s': p.s, 'e': p.e}}) ELSE t END FROM g JOIN p ON p.a_id = g.a_id AND p.k = g.k + 1),
        l AS (SELECT a_id, arg_max(t, k) AS t FROM g GROUP BY a_id) SELECT a_id, CAST(len(t) AS BIGINT) AS kept, CAST(list_sum(list_transform(t, lambda x: x.e - x.s)) AS BIGINT) AS bases FROM l""",
    "grp_best_pair": f"WITH {OV}, s AS (SELECT a_id AS read, b_id AS other, ol_id, {LEN} AS aligned FROM ov UNION ALL SELECT b_id, a_id, ol_id, {LEN} FROM ov) SELECT read, other, ol_id, CAST(aligned AS INTEGER) AS aligned FROM (SELECT *, row_number() OVER (PARTITION BY read, other ORDER BY aligned DESC NULLS LAST, ol_id) AS rn FROM s) WHERE rn = 1",
    "grp_best_by_target": f"WITH {AL} SELECT b_id, a_id, ol_id, CAST(n0 AS INTEGER) AS aligned, n FROM (SELECT *, {LEN} AS n0, row_number() OVER (PARTITION BY b_id, a_id ORDER BY {LEN} DESC NULLS LAST, ol_id) AS rn, count(*) OVER (PARTITION BY b_id, a_id) AS n FROM al) WHERE rn = 1",
    "grp_duplicates": f"WITH {OV} SELECT ol_id, CAST(row_number() OVER (PARTITION BY least(a_id, b_id), greatest(a_id, b_id) ORDER BY {LEN} * identity DESC NULLS LAST, ol_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY least(a_id, b_id), greatest(a_id, b_id)) AS n FROM ov",
    "grp_duplicate_lists": f"WITH {OV} SELECT least(a_id, b_id) AS a, greatest(a_id, b_id) AS b, string_agg(CAST(ol_id AS VARCHAR), ',' ORDER BY {LEN} DESC, ol_id) AS ol_ids FROM ov GROUP BY 1, 2 HAVING count(*) > 1",
    "grp_index": f"WITH {OV}, s AS (SELECT a_id AS read, 0 AS side, * FROM ov UNION ALL SELECT b_id, 1, * FROM ov) SELECT read, side, CAST(row_number() OVER (PARTITION BY read, side ORDER BY {LEN} DESC, CAST(trunc(identity * {LEN}) AS BIGINT) DESC NULLS LAST, (a_strand = b_strand) DESC, ol_id) AS INTEGER) AS place, ol_id FROM s",
    "grp_contained": f"WITH {OV}, {_CONTAINED} SELECT read, container FROM cont",
    "grp_reasons": f"WITH {OV}, {_CONTAINED} SELECT ol_id, 'contained:' || coalesce(x.container, y.container) AS reason FROM ov LEFT JOIN cont x ON x.read = a_id LEFT JOIN cont y ON y.read = b_id",
    "cov_reads": f"WITH {OV}, {SIDES}, {_READ_SEGS} SELECT * FROM segs",
    "cov_contigs": f"WITH {AL}, {_CTG_SEGS} SELECT * FROM segs",
    "cov_core": f"""WITH {OV}, {SIDES}, {_READ_SEGS}, n AS (SELECT *, max("end") OVER (PARTITION BY read) AS len FROM segs), c AS (SELECT *, least(500, (len + 1) // 10) AS lo, len // 3 AS t FROM n),
        k AS (SELECT read, min(depth) AS min_depth, max(depth) AS max_depth, CAST(sum(least("end", len - lo) - greatest(start, lo)) AS BIGINT) AS bases, CAST(sum(depth * (least("end", len - lo) - greatest(start, lo))) AS BIGINT) AS sum_depth FROM c WHERE least("end", len - lo) > greatest(start, lo) GROUP BY read),
        h AS (SELECT read, CAST(sum(depth * greatest(0, least("end", t) - start)) // nullif(max(t), 0) AS BIGINT) AS c0, CAST(sum(depth * greatest(0, least("end", 2 * t) - greatest(start, t))) // nullif(max(t), 0) AS BIGINT) AS c1, CAST(sum(depth * greatest(0, "end" - greatest(start, 2 * t))) // nullif(max(t), 0) AS BIGINT) AS c2 FROM c GROUP BY read)
        SELECT * FROM k JOIN h USING (read) WHERE min_depth >= 1 AND max_depth <= 12""",
    "cov_percentile": f"WITH {AL}, {_CTG_SEGS}, h AS (SELECT depth, count(*) AS k FROM segs GROUP BY depth), c AS (SELECT depth, sum(k) OVER (ORDER BY depth) AS cum, sum(k) OVER () AS n FROM h) SELECT min(depth) AS value FROM c WHERE cum >= n * 99.99::DOUBLE / 100",
    "cov_longest": f"""WITH {AL}, {_CTG_SEGS}, ok AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY b_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM segs WHERE depth >= 2), g AS (SELECT *, sum(f) OVER (PARTITION BY b_id ORDER BY start) AS r FROM ok),
        m AS (SELECT b_id, min(start) AS start, max("end") AS "end" FROM g GROUP BY b_id, r) SELECT b_id, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY "end" - start DESC, start) AS rn FROM m) WHERE rn = 1""",
    "cov_merged": f"""WITH {AL}, o AS (SELECT b_id, b_start AS start, b_end AS "end", CASE WHEN b_start > max(b_end) OVER (PARTITION BY b_id ORDER BY b_start, b_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1000 THEN 1 ELSE 0 END AS f FROM al), g AS (SELECT *, sum(f) OVER (PARTITION BY b_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS r FROM o)
        SELECT b_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM g GROUP BY b_id, r""",
    "win_best": f"WITH {AL}, w AS (SELECT b_id, b_start, CAST(sum({LEN}) OVER (PARTITION BY b_id ORDER BY b_start RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM al) SELECT b_id, max(s) AS best, min(b_start) FILTER (s = m) AS at FROM (SELECT *, max(s) OVER (PARTITION BY b_id) AS m FROM w) GROUP BY b_id",
    "win_crowded": f"WITH {AL}, n AS (SELECT *, count(*) OVER (PARTITION BY b_id ORDER BY b_start RANGE BETWEEN 10000 PRECEDING AND CURRENT ROW) AS k FROM al) SELECT ol_id FROM (SELECT *, max(k) OVER (PARTITION BY b_id ORDER BY b_start RANGE BETWEEN CURRENT ROW AND 10000 FOLLOWING) AS m FROM n) WHERE m >= 6",
    "win_least": f"WITH {AL}, w AS (SELECT b_id, b_start, CAST(sum({LEN}) OVER (PARTITION BY b_id ORDER BY b_start RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM al) SELECT b_id, min(s) AS least, min(b_start) FILTER (s = m) AS at FROM (SELECT *, min(s) OVER (PARTITION BY b_id) AS m FROM w) GROUP BY b_id",
    "win_mean": f"WITH {_TILES} SELECT seq_id, tile_no, round(m, 6) AS mean FROM (SELECT *, avg(n) OVER w AS m, count(n) OVER w AS k FROM t WINDOW w AS (PARTITION BY seq_id ORDER BY tile_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5",
    "win_breaks": "WITH t AS (SELECT seq_id, tile_no, max(edge_path) AS edge FROM contig_tiles WHERE seq_id IS NOT NULL AND tile_no IS NOT NULL GROUP BY seq_id, tile_no), b AS (SELECT *, lag(edge) OVER (PARTITION BY seq_id ORDER BY tile_no) AS \"before\" FROM t) SELECT * FROM b WHERE split_part(\"before\", '~', 2) <> split_part(edge, '~', 1)",
    "win_analysis": "SELECT ctg_id, CAST(s AS BIGINT) AS win_start, least(ctg_len, CAST(s AS BIGINT) + 4000) AS win_end FROM contigs, unnest(range(0, ctg_len, 3000)) AS t(s) WHERE ctg_len > 0",
    "win_regions": f"WITH {AL}, g AS (SELECT ctg_id, ctg_len // 4 AS s, ctg_len // 4 + 20000 AS e FROM contigs) SELECT b_id, count(*) AS alignments, CAST(sum(least(b_end, e) - greatest(b_start, s)) AS BIGINT) AS bases FROM al JOIN g ON b_id = ctg_id AND b_start < e AND s < b_end WHERE b_start < b_end GROUP BY b_id",
    "stat_n50": f"WITH {READS}, x AS (SELECT len, read_id AS id FROM reads), " + _N.format("25, 50, 75", ">"),
    "stat_n50_reached": "WITH x AS (SELECT ctg_len AS len, ctg_id AS id FROM contigs), " + _N.format("50", ">="),
    "stat_lengths": f'WITH {READS} SELECT count(len) AS "count", CAST(sum(len) AS BIGINT) AS total, CAST(max(len) AS INTEGER) AS longest, CAST(min(len) AS INTEGER) AS shortest FROM reads',
    "stat_mad": f"WITH {_MAD} SELECT lib_name, n, median, mad FROM mad",
    "stat_weighted_mad": """WITH v AS (SELECT lib_name, CAST(overhang_l AS BIGINT) AS x, aligned_len AS w FROM read_stats WHERE lib_name IS NOT NULL AND overhang_l >= 0 AND aligned_len IS NOT NULL), c AS (SELECT *, sum(w) OVER (PARTITION BY lib_name ORDER BY x) AS cum, sum(w) OVER (PARTITION BY lib_name) AS t FROM v),
        m AS (SELECT lib_name, min(x) AS median FROM c WHERE cum * 2 >= t GROUP BY lib_name), d AS (SELECT lib_name, median, abs(x - median) AS y, w FROM v JOIN m USING (lib_name)), e AS (SELECT *, sum(w) OVER (PARTITION BY lib_name ORDER BY y) AS cum, sum(w) OVER (PARTITION BY lib_name) AS t FROM d)
        SELECT lib_name, max(median) AS median, min(y) AS mad FROM e WHERE cum * 2 >= t GROUP BY lib_name""",
    "stat_mean_dev": f"WITH {_MEAN} SELECT lib_name, round(mean, 6) AS mean, round(mad, 6) AS mad FROM md",
    "stat_threshold": f"WITH {_MAD}, {_MEAN} SELECT lib_name, round(CASE WHEN mad.mad <> 0 THEN median - 2 * 1.4826::DOUBLE * mad.mad ELSE mean - 2 * 1.253::DOUBLE * md.mad END, 4) AS threshold FROM mad JOIN md USING (lib_name)",
    "stat_fold": f"""WITH {OV}, {SIDES} SELECT read, count(*) AS overlaps, CAST(sum(r_end - r_start) AS BIGINT) AS aligned_bases, arg_max(identity, (r_end - r_start, ol_id)) AS best_identity, max(greatest(least(r_start, o_start), least(r_len - r_end, o_len - o_end))) AS overhang FROM sides GROUP BY read""",
    "stat_bins": f"""WITH {OV}, {SIDES}, b AS (SELECT read, identity, CAST(k AS INTEGER) AS bin FROM sides, unnest(range(CAST(r_start // 1000 AS BIGINT), CAST((r_end - 1) // 1000 AS BIGINT) + 1)) AS t(k) WHERE identity IS NOT NULL AND r_end > r_start),
        m AS (SELECT read, bin, count(*) AS n, avg(identity) AS mean FROM b GROUP BY read, bin), d AS (SELECT read, bin, any_value(n) AS n, any_value(mean) AS mean, avg(abs(identity - mean)) AS mad FROM b JOIN m USING (read, bin) GROUP BY read, bin)
        SELECT read, bin, n, round(mean, 6) AS identity, round(mean - 6 * 1.253::DOUBLE * mad, 6) AS threshold FROM d""",
    "stat_accuracy": """WITH o AS (SELECT DISTINCT ol_id, qid, matches, alnlen, qlen FROM read_overlaps WHERE qid IS NOT NULL AND qid <> -1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY matches DESC NULLS LAST, ol_id) AS rn FROM o) WHERE rn = 1)
        SELECT count(*) AS reads, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(alnlen) AS BIGINT) AS aligned, CAST(sum(qlen) AS BIGINT) AS bases, round(sum(matches) / sum(alnlen), 9) AS rate_aligned, round(sum(matches) / sum(qlen), 9) AS rate_all FROM b""",
    "stat_trimmed": """WITH d AS (SELECT DISTINCT stat_id, lib_name, mate_len FROM read_stats WHERE lib_name IS NOT NULL AND stat_id IS NOT NULL AND mate_len IS NOT NULL), s AS (SELECT lib_name, CAST(trunc(avg(mate_len)) AS INTEGER) AS m, CAST(trunc(stddev_pop(mate_len)) AS INTEGER) AS sd FROM d GROUP BY lib_name),
        k AS (SELECT stat_id, lib_name, count(*) OVER (PARTITION BY lib_name) AS n FROM d JOIN s USING (lib_name) WHERE abs(mate_len - m) <= 3 * sd) SELECT stat_id FROM k WHERE n >= 100""",
    "stat_confusion": """WITH d AS (SELECT lib_name, coalesce(identity_pct > 95, FALSE) AS t, coalesce(overhang_l < 50, FALSE) AS c FROM read_stats WHERE lib_name IS NOT NULL AND (identity_pct IS NULL OR NOT isnan(identity_pct))),
        n AS (SELECT lib_name, count(*) FILTER (t AND c) AS tp, count(*) FILTER (NOT t AND c) AS fp, count(*) FILTER (t AND NOT c) AS fn, count(*) FILTER (NOT t AND NOT c) AS tn FROM d GROUP BY lib_name)
        SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM n""",
    "stat_pair_classes": f"WITH {OV}, p AS (SELECT (a_id % 3 - 1) * (b_id % 3 - 1) AS p FROM ov) SELECT count(*) FILTER (p > 0) AS like, count(*) FILTER (p < 0) AS unlike, count(*) FILTER (p = 0) AS unknown FROM p".replace(" AS like", ' AS "like"'),
    "stat_hamming": "SELECT reduce_type, round(sum(least(snp_same, snp_diff)) * 100 / nullif(sum(snp_same + snp_diff), 0), 9) AS error FROM graph_edges WHERE reduce_type IS NOT NULL AND snp_same IS NOT NULL AND snp_diff IS NOT NULL GROUP BY reduce_type",
    "stat_runtime": "SELECT lib_name, count(*) AS runs, CAST(sum(epoch(date_trunc('second', loaded_at)) - epoch(date_trunc('second', made_at))) AS BIGINT) AS seconds FROM read_stats GROUP BY lib_name",
    "stat_ref_share": f"""WITH {AL}, b AS (SELECT a_id % 5 AS kind, b_id, n FROM (SELECT *, {LEN} AS n, row_number() OVER (PARTITION BY a_id ORDER BY {LEN} DESC NULLS LAST, ol_id) AS rn FROM al) WHERE rn = 1), p AS (SELECT kind, b_id, CAST(sum(n) AS BIGINT) AS weight FROM b GROUP BY kind, b_id)
        SELECT kind, b_id, weight, round(weight / sum(weight) OVER (PARTITION BY kind), 9) AS share FROM p""",
    "top_longest": f"WITH {READS}, r AS (SELECT len, sum(len) OVER (ORDER BY len DESC, read_id ROWS UNBOUNDED PRECEDING) - len AS before FROM reads), m AS (SELECT min(len) AS m FROM r WHERE before < 300000) SELECT read_id, CAST(len AS INTEGER) AS len FROM reads, m WHERE len >= m",
    "top_contigs": "WITH r AS (SELECT ctg_id, row_number() OVER (ORDER BY ctg_len DESC NULLS LAST, ctg_id) - 1 AS r FROM contigs) SELECT ctg_id, CAST(CASE WHEN r // 7 % 2 = 0 THEN r % 7 ELSE 6 - r % 7 END AS INTEGER) AS bin FROM r",
    "top_weighted": f"WITH {AL}, n AS (SELECT b_id, count(*) AS n, max(b_len) AS len FROM al GROUP BY b_id) SELECT b_id, round(n * n / greatest(1.0::DOUBLE, len / 1e6), 6) AS weight FROM n ORDER BY weight DESC, b_id LIMIT 10",
    "top_split": """WITH o AS (SELECT DISTINCT ol_id, qname, tname FROM read_overlaps WHERE qname IS NOT NULL AND tname IS NOT NULL), n AS (SELECT read_name AS name, min(CASE WHEN quality IS NOT NULL THEN 0 WHEN sub_head IS NOT NULL THEN 1 WHEN seq_len >= 1500 THEN 2 END) AS place FROM seq_reads WHERE read_id IS NOT NULL AND read_name IS NOT NULL GROUP BY read_name)
        SELECT ol_id, least(x.place, y.place) AS place FROM o LEFT JOIN n x ON x.name = qname LEFT JOIN n y ON y.name = tname WHERE least(x.place, y.place) IS NOT NULL""",
}
