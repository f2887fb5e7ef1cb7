"""Joins over overlaps, base calls and sets over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.functions import dna
from strandframe.functions.overlap import Filter, aligned_length
from strandframe.operators import calls, graph, grouping, pairs, snps
from strandframe.plans.column_queries import FILTER, SQL as COLUMN_SQL, _carry, _loc, _rev
from strandframe.plans.views import AL, LEN, OV, READS, alignments, overlaps, reads
from strandframe.session import cut, table

#: Distance between the positions at which base calls are made up.
#: Coverages that count, and the calls of the second base asked for at the least and the largest of them.
CONFIRMED = (3, 400, 1, 1)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements of poorly mapped overlaps, as a list of inconsistent pairs: t, q, strand, offset."""
    low = table(spark, sf_dir, "read_overlaps").where("mapq < 60").select("ol_id").distinct()
    o = pairs.offsets(overlaps(spark, sf_dir).join(low, "ol_id", "left_semi"))
    return o.select(F.col("a_id").alias("t"), F.col("b_id").alias("q"), (F.col("a_strand") != F.col("b_strand")).cast("int").alias("strand"), (F.col("b_on_a") + F.col("ol_id") % 9 * 40).alias("offset")).distinct()


def join_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps less those near a listed placement of their pair."""
    return pairs.without_inconsistent(overlaps(spark, sf_dir), _listed(spark, sf_dir), 150, 0.1).select("ol_id")


def join_inconsistent_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With both ways to be listed."""
    both = _listed(spark, sf_dir)
    return pairs.without_inconsistent(overlaps(spark, sf_dir), both, 200, 0.05, strict=True).select("ol_id")


def join_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of overlaps to the nearest listed placement."""
    return pairs.distances(overlaps(spark, sf_dir), _listed(spark, sf_dir), both=False)


def join_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of listed pairs in either order."""
    return pairs.pair_known(overlaps(spark, sf_dir), _listed(spark, sf_dir)).select("ol_id")


def join_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps sent to the blocks of both their reads, once each."""
    assigned = reads(spark, sf_dir).select(F.col("read_id").alias("read"), (F.col("read_id") % 8).alias("block"))
    return pairs.to_blocks(overlaps(spark, sf_dir), assigned).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("ol_id").alias("ids"))


def join_rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dropped overlaps that are a read's only neighbour on a side."""
    ov = overlaps(spark, sf_dir)
    return pairs.rescued(ov, ov.where(Filter.parse(FILTER).valid()), 100)


def _single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.duplicates(overlaps(spark, sf_dir).where("a_id != b_id")).where("rank = 1")


def join_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of direct and indirect placements of three reads."""
    return pairs.consistent_triangles(_single(spark, sf_dir), 100)


def join_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contig pairs by shared reads."""
    return pairs.shared_reads(alignments(spark, sf_dir))


def join_hanging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that hang over the ends of two contigs."""
    return pairs.joining_reads(alignments(spark, sf_dir), 400)


def join_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with the bases of both reads at their starts."""
    got = pairs.with_sequences(overlaps(spark, sf_dir), reads(spark, sf_dir))
    b = dna.slice_of(F.col("b_seq"), F.col("b_start"), F.col("b_start") + 12, F.col("b_strand"))
    return got.select("ol_id", F.substring("a_seq", F.col("a_start") + 1, F.lit(12)).alias("a_part"), b.alias("b_part"))


def join_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of names, -1 for an unknown one."""
    names = reads(spark, sf_dir).where("name is not null").select("name", "read_id")
    ov = table(spark, sf_dir, "read_overlaps").select("ol_id", F.col("qname").alias("name")).distinct()
    return ov.join(names, "name", "left").select("ol_id", F.coalesce("read_id", F.lit(-1).cast("long")).alias("read_id"))


def join_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps less those of opposite classes."""
    cls = reads(spark, sf_dir).select(F.col("read_id").alias("read"), F.when(F.col("len") > 1500, 1).when(F.col("len") < 800, -1).otherwise(0).alias("cls"))
    return pairs.conflicting_classes(overlaps(spark, sf_dir), cls).select("ol_id")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both reads of every overlap as target (ctg) and query (read): start and end on the target, ``t`` the target's stretch
    and ``q`` the query's on the same strand."""
    got = pairs.with_sequences(overlaps(spark, sf_dir).where("a_id != b_id"), reads(spark, sf_dir)).where("a_seq is not null and b_seq is not null")
    turned = (F.col("a_strand") != F.col("b_strand")).cast("int")

    def side(t: str, q: str) -> Column:
        stretch = [dna.slice_of(F.upper(f"{x}_seq"), F.col(f"{x}_start"), F.col(f"{x}_end"), turn).alias(n) for x, n, turn in ((t, "t", F.lit(0)), (q, "q", turned))]
        return F.struct(F.col(f"{t}_id").alias("ctg"), F.col(f"{q}_id").alias("read"), F.col(f"{t}_start").alias("start"), F.col(f"{t}_end").alias("end"), *stretch)

    return got.select(F.explode(F.array(side("b", "a"), side("a", "b"))).alias("_s")).select("_s.*")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base calls of overlapping reads on each other, from their sequences: ctg, pos, read, base."""
    return calls.between_flanks(_placed(spark, sf_dir)).distinct()


def snp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every position with calls."""
    return snps.base_histogram(_calls(spark, sf_dir))


def snp_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with two bases above the threshold."""
    return snps.confirmed(snp_histogram(spark, sf_dir), *CONFIRMED)


def _alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = cut(_calls(spark, sf_dir))
    sites = cut(snps.confirmed(snps.base_histogram(made), *CONFIRMED))
    return snps.alleles_of_reads(calls.at_sites(made, _placed(spark, sf_dir), sites), sites)


def snp_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of reads at confirmed positions, -1 for a read that has none there."""
    return _alleles(spark, sf_dir)


def snp_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same and different calls of overlapping reads."""
    listed = overlaps(spark, sf_dir).where("a_id != b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    return snps.agreement(listed, _alleles(spark, sf_dir))


def snp_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of a target with three sites in common or more."""
    return snps.shared_sites(_alleles(spark, sf_dir), 3)


def ctg_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs of which a fifth of the reads are listed against reads of another contig."""
    al = alignments(spark, sf_dir).select(F.col("b_id").alias("ctg"), F.col("a_id").alias("read")).distinct()
    return graph.grouped_contigs(al, _listed(spark, sf_dir).select("t", "q"), 0.2).select("a", "b", "n", F.round("rate", 9).alias("rate"))


def _contig_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs one behind the other along a read: a, b, the place on a where the read leaves it, and aligned bases."""
    al = alignments(spark, sf_dir).groupBy(F.col("a_id").alias("read"), F.col("b_id").alias("ctg")).agg(F.min(F.struct("a_start", "b_end", aligned_length().alias("n"))).alias("t")).select("read", "ctg", "t.*")
    w = Window.partitionBy("read").orderBy("a_start", "ctg")
    return al.withColumns({"b": F.lead("ctg").over(w), "m": F.lead("n").over(w)}).where("b is not null").select(F.col("ctg").alias("a"), "b", F.col("b_end").alias("pos"), F.least("n", "m").alias("score"))


def ctg_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of links between two contigs."""
    return graph.link_scores(_contig_links(spark, sf_dir), 2000)


def ctg_best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best way out of every contig by supporting reads."""
    n = _contig_links(spark, sf_dir).where("a != b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("reads"))
    return n.groupBy("a").agg(F.max(F.struct("reads", (-F.col("b")).alias("b"))).alias("t")).select("a", (-F.col("t.b")).alias("b"), "t.reads")


def ctg_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences spelled from the first 60 bases of the reads of a contig's tiles."""
    t = table(spark, sf_dir, "contig_tiles").where("seq_name is not null and tile_no is not null and edge_path is not null").groupBy("seq_name", "tile_no").agg(F.max("edge_path").alias("e"))
    node = F.element_at(F.split("e", "~"), 2)
    tiles = t.select(F.col("seq_name").alias("ctg"), "tile_no", F.expr("substring(split(e, '~')[1], 1, length(split(e, '~')[1]) - 2)").alias("read"), F.when(F.endswith(node, F.lit("E")), 0).otherwise(1).alias("strand"), F.lit(0).alias("start"), F.lit(60).alias("end"))
    r = reads(spark, sf_dir).where("name is not null").select(F.col("name").alias("read"), F.upper(F.coalesce("seq", F.lit(""))).alias("seq"))
    got = graph.contig_sequences(tiles, r)
    return got.select("ctg", F.length("seq").alias("bases"), F.md5("seq").alias("md5"))


def snp_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads against their contigs' majority."""
    al = _alleles(spark, sf_dir)
    return snps.read_votes(al, snps.majority_vote(al))


def snp_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linkage of positions within 2000 bases."""
    out = snps.linkage(_alleles(spark, sf_dir), "ctg", 1, 3, 2000)
    return out.select("ctg", "pos0", "pos1", "n", F.round("concordance", 9).alias("concordance"))


def snp_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several alignments of a read to a contig the one nearest to its query offset."""
    al = alignments(spark, sf_dir).withColumn("n", aligned_length())
    out = snps.nearest_placement(al.withColumn("wanted", F.col("a_start") * 3), ["a_id", "b_id"], "wanted", "b_start", "n")
    ok = snps.compatible(F.col("wanted"), F.col("b_start"), F.col("a_strand") == F.col("b_strand"), F.col("n"))
    return out.select("a_id", "b_id", "b_start", "n", ok.alias("ok")).distinct()


def snp_kmer_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every read by two sets of k-mers of either strand."""
    r = reads(spark, sf_dir).select(F.col("read_id").alias("read"), "len", "seq")
    k = cut(dna.read_codes(r, "read", "seq", 11))
    pat, mat = (k.join(r.where(w).select("read"), "read", "left_semi").select("kmer") for w in ("len > 1500", "len < 800"))
    return snps.kmer_classes(k, pat, mat)


def set_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in reads, in overlaps, and in both."""
    r = table(spark, sf_dir, "seq_reads").select(F.col("read_name").alias("name")).where("name is not null")
    o = table(spark, sf_dir, "read_overlaps").select(F.col("qname").alias("name")).unionByName(table(spark, sf_dir, "read_overlaps").select(F.col("tname").alias("name"))).where("name is not null")
    one = r.intersect(o).select("name", F.lit("both").alias("where"))
    return one.unionByName(r.subtract(o).select("name", F.lit("reads").alias("where"))).unionByName(o.subtract(r).select("name", F.lit("overlaps").alias("where")))


def set_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common, extra and subset tests of the contigs of two reads that overlap."""
    on = alignments(spark, sf_dir).groupBy("a_id").agg(F.collect_set("b_id").alias("s"))  # a read is on few contigs
    p = overlaps(spark, sf_dir).where("a_id != b_id").select(F.col("a_id").alias("x"), F.col("b_id").alias("y")).distinct()
    both = p.join(on.select(F.col("a_id").alias("x"), F.col("s").alias("sx")), "x").join(on.select(F.col("a_id").alias("y"), F.col("s").alias("sy")), "y")
    return both.select("x", "y", F.arrays_overlap("sx", "sy").alias("common"), F.size(F.array_intersect("sx", "sy")).alias("n"), (F.size(F.array_except("sx", "sy")) == 0).alias("subset"), F.size(F.array_except("sy", "sx")).alias("extra"))


def set_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions confirmed under two thresholds, with the share of the second base."""
    h = cut(snp_histogram(spark, sf_dir))
    x, y = (snps.confirmed(h, *CONFIRMED[:2], t, t).select("ctg", "pos", "var1") for t in (1, 2))
    second = F.element_at(F.array("n_a", "n_c", "n_g", "n_t"), F.col("var1") + 1)
    return x.join(y.select("ctg", "pos", F.lit(True).alias("in_second")), ["ctg", "pos"], "left").join(h, ["ctg", "pos"]).select("ctg", "pos", F.coalesce("in_second", F.lit(False)).alias("in_second"), F.round(second / F.col("cov"), 9).alias("share"))


def join_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments split by kind of contig."""
    sets = table(spark, sf_dir, "contigs").select(F.col("ctg_kind").alias("part"), F.col("ctg_name").alias("name")).where("part is not null")
    al = table(spark, sf_dir, "alignments").select("aln_id", "tname").distinct()
    return pairs.split_by_sets(al, sets, "tname").select("part", "aln_id")


def join_outvoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps less those of reads that a target's majority speaks against."""
    al = cut(_alleles(spark, sf_dir))
    return pairs.without_outvoted(overlaps(spark, sf_dir), snps.read_votes(al, snps.majority_vote(al))).select("ol_id")


def join_opposite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments less those of reads that two reads of the contig or more are listed against."""
    al = alignments(spark, sf_dir)
    listed = _listed(spark, sf_dir)
    return pairs.without_opposite(al, al.select(F.col("b_id").alias("ctg"), F.col("a_id").alias("read")), listed, 2).select("ol_id")


def join_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that are one of the two alleles of a confirmed position, with the depth there."""
    made = cut(_calls(spark, sf_dir))
    hist = cut(snps.base_histogram(made))
    sites = snps.confirmed(hist, *CONFIRMED)
    return made.join(sites, ["ctg", "pos"]).where("base in (var0, var1)").join(hist.select("ctg", "pos", "cov"), ["ctg", "pos"]).select("ctg", "pos", "read", "base", "cov")


def join_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads shared by the ways in and out of a contig, where contigs follow each other along a read."""
    al = alignments(spark, sf_dir).groupBy(F.col("a_id").alias("read"), F.col("b_id").alias("ctg")).agg(F.min("a_start").alias("at"))
    after = Window.partitionBy("read").orderBy("at", "ctg")
    links = al.withColumn("b", F.lead("ctg").over(after)).where("b is not null").select(F.col("ctg").alias("a"), "b", "read")
    return pairs.supported_ways(links)


def snp_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean offset of every read on every contig over its alignments."""
    al = alignments(spark, sf_dir)
    same = F.col("a_strand") == F.col("b_strand")
    return al.groupBy("a_id", "b_id").agg(dna.mean_offset(F.col("b_start"), F.col("a_start"), same).alias("offset"))


def vec_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and equality of the contig lists of the reads of an overlap, and whether their hashes agree."""
    on = alignments(spark, sf_dir).groupBy("a_id").agg(F.sort_array(F.collect_set("b_id")).alias("s"))  # a read is on few contigs
    p = overlaps(spark, sf_dir).where("a_id != b_id").select("ol_id", "a_id", "b_id")
    both = p.join(on.withColumnRenamed("s", "x"), "a_id").join(on.select(F.col("a_id").alias("b_id"), F.col("s").alias("y")), "b_id")
    return both.select("ol_id", (F.col("x") == F.col("y")).alias("equal"), (F.col("x") < F.col("y")).alias("less"), (F.xxhash64("x") == F.xxhash64("y")).alias("same_hash"))


QUERIES = {
    f.__name__: f
    for f in (
        snp_shared, ctg_grouped, ctg_links, ctg_best_links, ctg_sequences, join_split, join_outvoted, join_opposite, join_variants, join_ways, snp_offsets, vec_compare,
        join_inconsistent, join_inconsistent_strict, join_distance, join_known, join_blocks, join_rescued, join_triangles, join_shared, join_hanging, join_sequences, join_names, join_classes,
        snp_histogram, snp_confirmed, snp_alleles, snp_agreement, snp_vote, snp_linkage, snp_nearest, snp_kmer_classes, set_names, set_contigs, set_variants,
    )
}


def _sides_swapped(x: str) -> str:
    return x.replace("a_", "@_").replace("b_", "a_").replace("@_", "b_")


_OFF = f"off AS (SELECT *, {_carry('0')} AS b_on_a, {_sides_swapped(_carry('0'))} AS a_on_b, CASE WHEN a_strand <> b_strand THEN 1 ELSE 0 END AS st FROM ov)"
_LIST = "listed AS (SELECT DISTINCT a_id AS t, b_id AS q, st AS strand, b_on_a + ol_id % 9 * 40 AS off FROM off WHERE ol_id IN (SELECT ol_id FROM read_overlaps WHERE mapq < 60))"
_WAYS = "ways AS (SELECT ol_id, 0 AS way, a_id AS t, b_id AS q, st AS strand, b_on_a AS o, greatest(a_on_b, b_on_a) AS m FROM off UNION ALL SELECT ol_id, 1, b_id, a_id, st, a_on_b, greatest(a_on_b, b_on_a) FROM off), near AS (SELECT w.*, abs(w.o - l.off) AS d FROM ways w JOIN listed l USING (t, q, strand))"


def _without(th: int, rate: float, least: int) -> str:
    return f"WITH {OV}, {_OFF}, {_LIST}, {_WAYS}, hit AS (SELECT ol_id FROM near WHERE d < greatest({th}, CAST(trunc({rate}::DOUBLE * m) AS BIGINT)) GROUP BY ol_id HAVING count(DISTINCT way) >= {least}) SELECT ol_id FROM ov WHERE ol_id NOT IN (SELECT ol_id FROM hit)"


_KEPT = COLUMN_SQL["ov_filter"].partition(" WHERE a_id <> b_id AND a_len >= 500")
_KEPT = "kept AS (SELECT * FROM ov WHERE a_id <> b_id AND a_len >= 500" + _KEPT[2] + ")"
_ENDS = "{0} AS (SELECT ol_id, n, read, loc FROM (SELECT ol_id, {1} AS n, a_id AS read, {2} AS loc FROM {3} UNION ALL SELECT ol_id, {1}, b_id, {4} FROM {3}) WHERE loc IN ('left', 'right'))"
_SINGLE = f"single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(a_id, b_id), greatest(a_id, b_id) ORDER BY {LEN} * identity DESC NULLS LAST, ol_id) AS rn FROM ov WHERE a_id <> b_id) WHERE rn = 1)"
_VIEW = "v AS (SELECT a_id AS r, b_id AS o, a_start AS xs, a_end AS xe, b_start AS ys, b_end AS ye, b_len AS yl, a_strand = b_strand AS same FROM single UNION ALL SELECT b_id, a_id, b_start, b_end, a_start, a_end, a_len, a_strand = b_strand FROM single)"


def _via(p: str, t: str) -> str:
    x = _carry(p)
    for a, b in (("a_strand = b_strand", f"{t}.same"), ("a_start", f"{t}.xs"), ("a_end", f"{t}.xe"), ("b_start", f"{t}.ys"), ("b_end", f"{t}.ye")):
        x = x.replace(a, b)
    return x


_TURN = "CASE WHEN a_strand <> b_strand THEN translate(reverse({0}), 'ACGT', 'TGCA') ELSE {0} END"
_SA, _SB = "substr(upper(x.seq), a_start + 1, a_end - a_start)", "substr(upper(y.seq), b_start + 1, b_end - b_start)"
_CALLS = f"""pl AS (SELECT row_number() OVER () AS id, * FROM (SELECT b_id AS ctg, a_id AS read, b_start AS "start", b_end AS "end", {_SB} AS t, {_TURN.format(_SA)} AS q FROM ov JOIN reads x ON x.read_id = a_id JOIN reads y ON y.read_id = b_id WHERE a_id <> b_id AND x.seq IS NOT NULL AND y.seq IS NOT NULL
        UNION ALL SELECT a_id, b_id, a_start, a_end, {_SA}, {_TURN.format(_SB)} FROM ov JOIN reads x ON x.read_id = a_id JOIN reads y ON y.read_id = b_id WHERE a_id <> b_id AND x.seq IS NOT NULL AND y.seq IS NOT NULL)),
    tw AS (SELECT id, k, min(i) AS i FROM (SELECT id, i, substr(t, i + 1, 8) || substr(t, i + 10, 8) AS k, substr(t, i + 1, 17) AS w FROM pl, unnest(range(CAST(0 AS BIGINT), CAST(length(t) - 16 AS BIGINT))) AS u(i)) WHERE regexp_full_match(w, '[ACGT]+') GROUP BY id, k HAVING count(*) = 1),
    q1 AS (SELECT id, k, min(instr('ACGT', m) - 1) AS base FROM (SELECT id, substr(q, i + 1, 8) || substr(q, i + 10, 8) AS k, substr(q, i + 9, 1) AS m, substr(q, i + 1, 17) AS w FROM pl, unnest(range(CAST(0 AS BIGINT), CAST(length(q) - 16 AS BIGINT))) AS u(i)) WHERE regexp_full_match(w, '[ACGT]+') GROUP BY id, k HAVING count(*) = 1),
    q0 AS (SELECT id, k FROM (SELECT id, substr(q, i + 1, 16) AS k FROM pl, unnest(range(CAST(0 AS BIGINT), CAST(length(q) - 15 AS BIGINT))) AS u(i)) WHERE regexp_full_match(k, '[ACGT]+') GROUP BY id, k HAVING count(*) = 1),
    calls AS (SELECT DISTINCT ctg, "start" + i + 8 AS pos, read, CAST(coalesce(q1.base, 8) AS INTEGER) AS base FROM tw JOIN pl USING (id) LEFT JOIN q1 USING (id, k) LEFT JOIN q0 USING (id, k) WHERE q1.k IS NOT NULL OR q0.k IS NOT NULL)"""
_HIST = "hist AS (SELECT ctg, pos, count(*) FILTER (base = 0) AS n_a, count(*) FILTER (base = 1) AS n_c, count(*) FILTER (base = 2) AS n_g, count(*) FILTER (base = 3) AS n_t, count(*) FILTER (base = 8) AS n_del, count(*) AS cov FROM calls GROUP BY ctg, pos)"


def _conf(name: str, at_low: int) -> str:
    return f"""{name}l AS (SELECT ctg, pos, cov, b, n, row_number() OVER (PARTITION BY ctg, pos ORDER BY n DESC, b) AS rn FROM (SELECT ctg, pos, cov, 0 AS b, n_a AS n FROM hist UNION ALL SELECT ctg, pos, cov, 1, n_c FROM hist UNION ALL SELECT ctg, pos, cov, 2, n_g FROM hist UNION ALL SELECT ctg, pos, cov, 3, n_t FROM hist) WHERE cov BETWEEN 3 AND 400),
    {name} AS (SELECT x.ctg, x.pos, x.b AS var0, y.b AS var1 FROM {name}l x JOIN {name}l y ON x.ctg = y.ctg AND x.pos = y.pos AND x.rn = 1 AND y.rn = 2 WHERE y.n >= {at_low})"""


_ALL = """under AS (SELECT DISTINCT conf.ctg, conf.pos, pl.read, var0, var1 FROM conf JOIN pl ON pl.ctg = conf.ctg AND pl."start" <= conf.pos AND conf.pos < pl."end"),
    alleles AS (SELECT u.ctg, u.pos, u.read, coalesce(base, -1) AS base, CASE base WHEN var0 THEN 0 WHEN var1 THEN 1 ELSE -1 END AS choice FROM under u LEFT JOIN calls c ON c.ctg = u.ctg AND c.pos = u.pos AND c.read = u.read)"""
_SNP = f"WITH {OV}, {READS}, {_CALLS}, {_HIST}, {_conf('conf', 1)}, {_ALL}"

_VOTES = "mj AS (SELECT ctg, pos, CASE WHEN sum(choice) * 2 > count(*) THEN 1 ELSE 0 END AS t FROM alleles WHERE choice <> -1 GROUP BY ctg, pos HAVING sum(choice) * 2 <> count(*)), vt AS (SELECT read, ctg, count(*) FILTER (choice = t) AS agree, count(*) FILTER (choice <> t) AS disagree FROM alleles JOIN mj USING (ctg, pos) WHERE choice <> -1 GROUP BY read, ctg)"

_CTG_LINKS = f"""pa AS (SELECT * FROM (SELECT a_id AS read, b_id AS ctg, a_start AS s, b_end AS pos, {LEN} AS n, row_number() OVER (PARTITION BY a_id, b_id ORDER BY a_start, b_end, {LEN}) AS rn FROM al) WHERE rn = 1),
    cl AS (SELECT ctg AS a, b, pos, least(n, m) AS score FROM (SELECT *, lead(ctg) OVER w AS b, lead(n) OVER w AS m FROM pa WINDOW w AS (PARTITION BY read ORDER BY s, ctg)) WHERE b IS NOT NULL)"""

SQL = {
    "snp_shared": f"{_SNP} SELECT x.ctg, x.read AS t, y.read AS q, count(*) AS n FROM alleles x JOIN alleles y ON x.ctg = y.ctg AND x.pos = y.pos AND x.read < y.read WHERE x.choice <> -1 AND y.choice <> -1 GROUP BY x.ctg, x.read, y.read HAVING count(*) >= 3",
    "ctg_grouped": f"""WITH {OV}, {_OFF}, {_LIST}, {AL}, mb AS (SELECT DISTINCT b_id AS ctg, a_id AS read FROM al), sz AS (SELECT ctg, count(*) AS size FROM mb GROUP BY ctg), li AS (SELECT DISTINCT t, q FROM listed),
        h AS (SELECT x.ctg AS a, y.ctg AS b, count(DISTINCT t) AS n FROM li JOIN mb x ON x.read = t JOIN mb y ON y.read = q WHERE x.ctg <> y.ctg GROUP BY x.ctg, y.ctg) SELECT a, b, n, round(n / size, 9) AS rate FROM h JOIN sz ON ctg = a WHERE (n / size >= 0.2::DOUBLE AND n >= 3) OR n / size >= 1""",
    "ctg_links": f"WITH {AL}, {_CTG_LINKS}, w AS (SELECT a, b, pos, CAST(sum(score) OVER (PARTITION BY a, b ORDER BY pos RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM cl WHERE a <> b) SELECT a, b, max(s) AS best, min(pos) FILTER (s = m) AS at FROM (SELECT *, max(s) OVER (PARTITION BY a, b) AS m FROM w) GROUP BY a, b",
    "ctg_best_links": f"WITH {AL}, {_CTG_LINKS}, n AS (SELECT a, b, count(*) AS reads FROM cl WHERE a <> b GROUP BY a, b) SELECT a, b, reads FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY reads DESC, b) AS rn FROM n) WHERE rn = 1",
    "ctg_sequences": f"""WITH {READS}, t AS (SELECT seq_name AS ctg, tile_no, split_part(max(edge_path), '~', 2) AS node FROM contig_tiles WHERE seq_name IS NOT NULL AND tile_no IS NOT NULL AND edge_path IS NOT NULL GROUP BY seq_name, tile_no),
        p AS (SELECT ctg, tile_no, CASE WHEN node LIKE '%E' THEN substr(upper(coalesce(seq, '')), 1, 60) ELSE translate(reverse(substr(upper(coalesce(seq, '')), 1, 60)), 'ACGT', 'TGCA') END AS s FROM t JOIN reads ON name = left(node, length(node) - 2)), g AS (SELECT ctg, string_agg(s, '' ORDER BY tile_no) AS s FROM p GROUP BY ctg)
        SELECT ctg, CAST(length(s) AS INTEGER) AS bases, md5(s) AS md5 FROM g""",
    "join_split": "SELECT ctg_kind AS part, aln_id FROM (SELECT DISTINCT aln_id, tname FROM alignments) JOIN (SELECT DISTINCT ctg_kind, ctg_name FROM contigs WHERE ctg_kind IS NOT NULL) ON ctg_name = tname",
    "join_outvoted": f"{_SNP}, {_VOTES} SELECT ol_id FROM ov WHERE NOT EXISTS (SELECT 1 FROM vt WHERE read = a_id AND ctg = b_id AND disagree > agree)",
    "join_opposite": f"""WITH {OV}, {_OFF}, {_LIST}, {AL}, bo AS (SELECT t, q FROM listed UNION SELECT q, t FROM listed), mb AS (SELECT DISTINCT b_id AS ctg, a_id AS t FROM al), n AS (SELECT ctg, q FROM mb JOIN bo USING (t) GROUP BY ctg, q HAVING count(*) >= 2)
        SELECT ol_id FROM al WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ctg = b_id AND n.q = a_id)""",
    "join_variants": f"{_SNP} SELECT c.ctg, c.pos, c.read, c.base, h.cov FROM calls c JOIN conf f ON f.ctg = c.ctg AND f.pos = c.pos JOIN hist h ON h.ctg = c.ctg AND h.pos = c.pos WHERE c.base IN (var0, var1)",
    "join_ways": f"""WITH {AL}, s AS (SELECT a_id AS read, b_id AS ctg, min(a_start) AS pos0 FROM al GROUP BY a_id, b_id), l AS (SELECT * FROM (SELECT read, ctg AS a, lead(ctg) OVER (PARTITION BY read ORDER BY pos0, ctg) AS b FROM s) WHERE b IS NOT NULL)
        SELECT x.b AS node, x.a AS "before", y.b AS "after", count(DISTINCT x.read) AS reads FROM l x JOIN l y ON y.a = x.b AND y.read = x.read WHERE x.a <> y.b GROUP BY x.b, x.a, y.b""",
    "snp_offsets": f'WITH {AL} SELECT a_id, b_id, CAST(trunc((CASE WHEN max(CASE WHEN a_strand = b_strand THEN 1 ELSE 0 END) = 1 THEN sum(b_start - a_start) ELSE sum(b_start + a_start) END)::DOUBLE / count(*)) AS BIGINT) AS "offset" FROM al GROUP BY a_id, b_id',
    "vec_compare": f"""WITH {AL}, {OV}, s AS (SELECT a_id, list_sort(list(DISTINCT b_id)) AS s FROM al GROUP BY a_id) SELECT ol_id, x.s = y.s AS equal, x.s < y.s AS "less", x.s = y.s AS same_hash FROM ov JOIN s x ON x.a_id = ov.a_id JOIN s y ON y.a_id = ov.b_id WHERE ov.a_id <> ov.b_id""",
    "join_inconsistent": _without(150, 0.1, 1),
    "join_inconsistent_strict": _without(200, 0.05, 2),
    "join_distance": f"WITH {OV}, {_OFF}, {_LIST}, {_WAYS} SELECT ol_id, min(d) AS distance FROM near GROUP BY ol_id",
    "join_known": f"WITH {OV}, {_OFF}, {_LIST} SELECT ol_id FROM ov WHERE EXISTS (SELECT 1 FROM listed WHERE least(t, q) = least(a_id, b_id) AND greatest(t, q) = greatest(a_id, b_id))",
    "join_blocks": f"WITH {OV}, {READS}, b AS (SELECT DISTINCT ol_id, read_id % 8 AS block FROM ov JOIN reads ON read_id = a_id OR read_id = b_id) SELECT block, count(*) AS n, CAST(sum(ol_id) AS BIGINT) AS ids FROM b GROUP BY block",
    "join_rescued": f"""WITH {OV}, {_KEPT}, {_ENDS.format("every", LEN, _loc(100), "ov", _rev(_loc(100)))}, {_ENDS.format("have", LEN, _loc(100), "kept", _rev(_loc(100)))},
        m AS (SELECT *, row_number() OVER (PARTITION BY read, loc ORDER BY n DESC, ol_id) AS rn FROM every e WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.read = e.read AND h.loc = e.loc)) SELECT DISTINCT ol_id FROM m WHERE rn = 1""",
    "join_triangles": f"""WITH {OV}, {_SINGLE}, {_VIEW} SELECT ab.r AS a, ab.o AS b, ac.o AS c, abs({_via('0', 'ab')} - {_via('(' + _via('0', 'cb') + ')', 'ac')}) <= 100 AND abs({_via('ab.yl', 'ab')} - {_via('(' + _via('ab.yl', 'cb') + ')', 'ac')}) <= 100 AS ok
        FROM v ab JOIN v ac ON ac.r = ab.r AND ab.o < ac.o JOIN v cb ON cb.r = ac.o AND cb.o = ab.o WHERE ab.r < ab.o""",
    "join_shared": f"WITH {AL}, o AS (SELECT DISTINCT a_id, b_id FROM al) SELECT x.b_id AS ctg0, y.b_id AS ctg1, count(*) AS reads FROM o x JOIN o y ON x.a_id = y.a_id AND x.b_id < y.b_id GROUP BY x.b_id, y.b_id",
    "join_hanging": f"""WITH {AL}, e AS (SELECT DISTINCT a_id, b_id, {_loc(400)} AS l FROM al) SELECT DISTINCT x.b_id AS ctg0, y.b_id AS ctg1, x.a_id AS read FROM e x JOIN e y ON x.a_id = y.a_id AND x.b_id < y.b_id
        WHERE x.l <> 'abnormal' AND y.l <> 'abnormal' AND ((x.l = 'left' AND y.l = 'right') OR (x.l = 'right' AND y.l = 'left') OR x.l NOT IN ('left', 'right') OR y.l NOT IN ('left', 'right'))""",
    "join_sequences": f"""WITH {OV}, {READS} SELECT ol_id, substr(x.seq, a_start + 1, 12) AS a_part, CASE WHEN b_strand = 1 THEN translate(reverse(substr(y.seq, b_start + 1, 12)), 'ACGTacgt', 'TGCAtgca') ELSE substr(y.seq, b_start + 1, 12) END AS b_part FROM ov LEFT JOIN reads x ON x.read_id = a_id LEFT JOIN reads y ON y.read_id = b_id""",
    "join_names": f"WITH {READS}, o AS (SELECT DISTINCT ol_id, qname FROM read_overlaps) SELECT ol_id, coalesce(read_id, -1) AS read_id FROM o LEFT JOIN reads ON name = qname",
    "join_classes": f"WITH {OV}, {READS}, c AS (SELECT read_id, CASE WHEN len > 1500 THEN 1 WHEN len < 800 THEN -1 ELSE 0 END AS cls FROM reads) SELECT ol_id FROM ov LEFT JOIN c x ON x.read_id = a_id LEFT JOIN c y ON y.read_id = b_id WHERE coalesce(x.cls * y.cls, 0) <> -1",
    "snp_histogram": f"WITH {OV}, {READS}, {_CALLS}, {_HIST} SELECT * FROM hist",
    "snp_confirmed": f"WITH {OV}, {READS}, {_CALLS}, {_HIST}, {_conf('conf', 1)} SELECT * FROM conf",
    "snp_alleles": _SNP + " SELECT * FROM alleles",
    "snp_agreement": f"{_SNP}, p AS (SELECT DISTINCT a_id AS a, b_id AS b FROM ov WHERE a_id <> b_id) SELECT a, b, count(*) FILTER (x.choice = y.choice) AS same, count(*) FILTER (x.choice <> y.choice) AS different FROM p JOIN alleles x ON x.read = a JOIN alleles y ON y.read = b AND x.ctg = y.ctg AND x.pos = y.pos WHERE x.choice <> -1 AND y.choice <> -1 GROUP BY a, b",
    "snp_vote": f"{_SNP}, m AS (SELECT ctg, pos, CASE WHEN sum(choice) * 2 > count(*) THEN 1 ELSE 0 END AS t FROM alleles WHERE choice <> -1 GROUP BY ctg, pos HAVING sum(choice) * 2 <> count(*)) SELECT read, ctg, count(*) FILTER (choice = t) AS agree, count(*) FILTER (choice <> t) AS disagree FROM alleles JOIN m USING (ctg, pos) WHERE choice <> -1 GROUP BY read, ctg",
    "snp_linkage": f"{_SNP}, t AS (SELECT x.ctg, x.pos AS pos0, y.pos AS pos1, count(*) AS n, count(*) FILTER (x.choice = y.choice) AS d FROM alleles x JOIN alleles y ON x.read = y.read AND x.ctg = y.ctg AND y.pos - x.pos BETWEEN 1 AND 2000 WHERE x.choice <> -1 AND y.choice <> -1 GROUP BY x.ctg, x.pos, y.pos) SELECT ctg, pos0, pos1, n, round(greatest(d, n - d) / n, 9) AS concordance FROM t WHERE n >= 3",
    "snp_nearest": f"""WITH {AL}, d AS (SELECT *, {LEN} AS n, a_start * 3 AS w, abs(a_start * 3 - b_start) AS d FROM al), m AS (SELECT *, min(d) OVER (PARTITION BY a_id, b_id) AS l FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY n DESC, d, b_start) AS rn FROM m WHERE d <= l + 500)
        SELECT a_id, b_id, b_start, CAST(n AS INTEGER) AS n, a_strand = b_strand AND abs(w - b_start) <= greatest(1000, CAST(trunc(n * 0.1::DOUBLE) AS INTEGER)) AS ok FROM r WHERE rn = 1""",
    "snp_kmer_classes": f"""WITH {READS}, k0 AS (SELECT DISTINCT read_id AS read, len, substr(upper(seq), CAST(i AS BIGINT), 11) AS w FROM reads, unnest(range(1, length(seq) - 9)) AS t(i) WHERE length(seq) >= 11), k AS (SELECT DISTINCT read, len, least(w, translate(reverse(w), 'ACGT', 'TGCA')) AS kmer FROM k0 WHERE regexp_full_match(w, '[ACGT]+')), p AS (SELECT DISTINCT kmer FROM k WHERE len > 1500), m AS (SELECT DISTINCT kmer FROM k WHERE len < 800),
        c AS (SELECT read, count(p.kmer) AS pat, count(m.kmer) AS mat FROM k LEFT JOIN p ON p.kmer = k.kmer LEFT JOIN m ON m.kmer = k.kmer GROUP BY read), s AS (SELECT greatest(1, (SELECT count(*) FROM p)) AS np, greatest(1, (SELECT count(*) FROM m)) AS nm)
        SELECT read, pat, mat, CASE WHEN pat / np > mat / nm THEN 1 WHEN mat / nm > pat / np THEN -1 ELSE 0 END AS cls FROM c, s WHERE pat + mat > 0""",
    "set_names": """WITH r AS (SELECT DISTINCT read_name AS name FROM seq_reads WHERE read_name IS NOT NULL), o AS (SELECT qname AS name FROM read_overlaps WHERE qname IS NOT NULL UNION SELECT tname FROM read_overlaps WHERE tname IS NOT NULL)
        SELECT coalesce(r.name, o.name) AS name, CASE WHEN r.name IS NULL THEN 'overlaps' WHEN o.name IS NULL THEN 'reads' ELSE 'both' END AS "where" FROM r FULL JOIN o ON r.name = o.name""",
    "set_contigs": f"""WITH {AL}, {OV}, s AS (SELECT a_id, list(DISTINCT b_id) AS s FROM al GROUP BY a_id), p AS (SELECT DISTINCT a_id AS x, b_id AS y FROM ov WHERE a_id <> b_id), b AS (SELECT x, y, sx.s AS sx, sy.s AS sy FROM p JOIN s sx ON sx.a_id = x JOIN s sy ON sy.a_id = y)
        SELECT x, y, len(list_intersect(sx, sy)) > 0 AS common, CAST(len(list_intersect(sx, sy)) AS INTEGER) AS n, len(sx) = len(list_intersect(sx, sy)) AS subset, CAST(len(sy) - len(list_intersect(sx, sy)) AS INTEGER) AS extra FROM b""",
    "set_variants": f"WITH {OV}, {READS}, {_CALLS}, {_HIST}, {_conf('x', 1)}, {_conf('y', 2)} SELECT x.ctg, x.pos, y.ctg IS NOT NULL AS in_second, round((CASE x.var1 WHEN 0 THEN n_a WHEN 1 THEN n_c WHEN 2 THEN n_g ELSE n_t END) / cov, 9) AS share FROM x LEFT JOIN y ON x.ctg = y.ctg AND x.pos = y.pos JOIN hist h ON h.ctg = x.ctg AND h.pos = x.pos",
}
