"""Predicates, projections and scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar, dna, overlap
from strandframe.plans.views import AL, LEN, OV, READS, alignments, overlaps, reads
from strandframe.session import table

FILTER = "l=500:i=90:al=400:alr=0.5:oh=300:ohr=0.2:aal=6000:aalr=0.99"


def ov_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps that pass the filter language."""
    return overlaps(spark, sf_dir).where(overlap.Filter.parse(FILTER).valid()).select("ol_id")


def ov_filter_one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With some rules off and all four ends needed to reject."""
    return overlaps(spark, sf_dir).where(overlap.Filter.parse("i=80:oh=50:ohr=-1:aal=-1:aalr=-1").valid(both_sides=False)).select("ol_id")


def ov_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths, relation, overhangs and extensions of every overlap."""
    same = overlap.same_direction()
    return overlaps(spark, sf_dir).select(
        "ol_id",
        overlap.aligned_length().alias("aligned"),
        overlap.aligned_size().alias("aligned_size"),
        overlap.ideal_aligned_length().alias("ideal"),
        overlap.location(0).alias("loc0"),
        overlap.location(200).alias("loc200"),
        overlap.reverse_location(overlap.location(200), same).alias("loc_b"),
        overlap.location_of(F.greatest("a_id", "b_id"), 50).alias("loc_max"),
        overlap.is_containing(200).alias("containing"),
        overlap.is_contained(200).alias("contained"),
        overlap.is_proper(200).alias("proper"),
        overlap.check_end(200).alias("ends_ok"),
        overlap.overhang_of(overlap.location(200)).a.alias("oh_a"),
        overlap.overhang_of(overlap.location(200)).b.alias("oh_b"),
        overlap.overhang().a.alias("min_oh_a"),
        overlap.overhang().b.alias("min_oh_b"),
        overlap.overhang_sides().a.alias("sides_a"),
        overlap.overhang_sides().b.alias("sides_b"),
        overlap.extension("a", 0).alias("ext_a0"),
        overlap.extension("a", 1).alias("ext_a1"),
        overlap.extension("b", 0).alias("ext_b0"),
        overlap.extension("b", 1).alias("ext_b1"),
        overlap.Filter.parse(FILTER).max_overhang(F.col("a_len")).alias("allowed_oh"),
    )


def ov_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends and the middle of b carried over to a, on whole alignments."""
    m = F.expr("b_len div 2")
    return alignments(spark, sf_dir).select("ol_id", overlap.mapping(F.lit(0), "a", "b").alias("at_start"), overlap.mapping(F.col("b_len"), "a", "b").alias("at_end"), overlap.mapping(m, "a", "b").alias("at_middle"))


def ov_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends snapped to read ends within 200 bases."""
    e = overlap.extended(200)
    return overlaps(spark, sf_dir).select("ol_id", *[e[n].alias(n) for n in ("a_start", "a_end", "b_start", "b_end")])


def ov_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage thresholds in a straight line between two coverages."""
    cov = alignments(spark, sf_dir).groupBy("b_id").agg(F.count("ol_id").alias("cov"))
    return cov.select("b_id", "cov", F.round(overlap.threshold(F.col("cov"), 20, 60, 3, 9), 6).alias("th"), F.round(overlap.threshold(F.col("cov"), 20, 60, 3, 9, 2**31 - 1), 6).alias("branch_th"))


def ov_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check after an alignment."""
    return alignments(spark, sf_dir).where(overlap.exact_filter(400, 0.6, 90.0, 100)).select("ol_id")


def read_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, reverse complement, slices and homopolymers of every read."""
    s = F.col("seq")
    return reads(spark, sf_dir).select(
        "read_id", dna.is_dna(s).alias("dna_n"), dna.is_dna(s, n=False).alias("dna"), F.md5(dna.reverse_complement(s)).alias("revcomp"), dna.slice_of(s, F.lit(100), F.lit(140), F.lit(1)).alias("part"), dna.homopolymer(s, 8).alias("poly"), F.upper(F.trim(F.substring(s, 1, 10))).alias("head")
    )


def read_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of canonical 9-mers over all reads, with their numbers."""
    out = dna.count_codes(reads(spark, sf_dir), "seq", 9).select(dna.decode(F.col("code"), 9).alias("kmer"), "n", "code")
    return out.select("kmer", "n", "code", (dna.encode(F.col("kmer")) == F.col("code")).alias("round_trip"))


def read_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name parts, numbered patterns, size strings and end numbers."""
    df = table(spark, sf_dir, "seq_reads").where("read_id is not null").select("read_id", "read_name").distinct()
    parts = dna.words(F.col("read_name"), "[/_-]")
    eid = dna.end_id(F.col("read_id"), F.col("read_id") % 2)
    return df.select(
        "read_id", F.size(parts).alias("parts"), F.concat_ws("+", parts).alias("joined"), dna.numbered("block{}.txt", F.col("read_id") % 7).alias("file"), dna.size_number(F.concat((F.col("read_id") % 100).cast("string"), F.lit("k"))).alias("bytes"),
        eid.alias("eid"), dna.end_reverse(eid).alias("reverse"), (dna.end_read(eid) == F.col("read_id")).alias("back"), dna.end_side(eid).alias("side"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same and different places of -1, 0, 1 vectors, and array arithmetic."""
    df = table(spark, sf_dir, "read_stats").where("stat_id is not null").select("stat_id", "aln_start", "aln_end", "aligned_len").distinct()
    a = F.array(*[F.col(c) % 3 - 1 for c in ("aln_start", "aln_end", "aligned_len")])
    b = F.array(*[F.col(c) % 2 * 2 - 1 for c in ("aln_end", "aln_start", "aligned_len")])
    v = dna.vector_counts(a, b)
    return df.where("aln_start is not null and aln_end is not null and aligned_len is not null").select("stat_id", v.same.alias("same"), v.different.alias("different"), F.greatest(F.lit(0), F.least(F.lit(1000), F.abs(F.col("aln_end") - 2000))).alias("clamped"))


def cigar_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations and identities of CIGARs made from the alignments' own lengths."""
    al = alignments(spark, sf_dir).where("a_end > a_start and b_end - b_start > 40")
    text = F.concat((F.col("a_start")).cast("string"), F.lit("S"), F.lit("20M3I"), (F.col("b_end") - F.col("b_start") - 35).cast("string"), F.lit("M15D"))
    al = al.withColumn("cigar", cigar.parse(text))
    return al.select("ol_id", F.size("cigar").alias("ops"), cigar.query_length(F.col("cigar")).alias("q"), cigar.target_length(F.col("cigar")).alias("t"), cigar.clips(F.col("cigar")).lead.alias("lead"), F.round(cigar.identity_ignoring_indels(10), 6).alias("without_large"))


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with the spans of a CIGAR of their own lengths: matches, mismatches, an insertion, matches, a deletion."""
    al = alignments(spark, sf_dir).where("b_end - b_start > 60")
    n = F.expr("b_end - b_start")
    parts = [(F.expr("(b_end - b_start) div 3"), "="), (F.expr("2 + ol_id % 9"), "X"), (F.expr("3 + ol_id % 5"), "I"), (n - F.expr("(b_end - b_start) div 3 + 2 + ol_id % 9 + ol_id % 13"), "="), (F.expr("ol_id % 13"), "D")]
    text = F.concat(*[F.when(k > 0, F.concat(k.cast("int").cast("string"), F.lit(op))).otherwise("") for k, op in parts])
    return al.withColumn("_s", cigar.spans(cigar.parse(text)))


def cigar_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst 1000 columns of every alignment, as errors and as local identity."""
    got = _made(spark, sf_dir).select("ol_id", cigar.worst_window(F.col("_s"), 1000).alias("errors"))
    return got.select("ol_id", "errors", F.round(1 - F.col("errors") / 1000, 6).alias("identity"))


def cigar_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, mismatches and indels of alignments inside a region of every contig."""
    region = table(spark, sf_dir, "contigs").select(F.col("ctg_id").alias("b_id"), F.expr("ctg_len div 4").alias("r_start"), F.expr("ctg_len div 4 + 20000").alias("r_end"))
    al = _made(spark, sf_dir).join(region, "b_id").where("r_end > b_start and r_start < b_end")
    s, e = F.greatest("r_start", "b_start") - F.col("b_start"), F.least("r_end", "b_end") - F.col("b_start")
    got = al.select("b_id", cigar.in_region(F.col("_s"), s, e).alias("_d"))
    return got.groupBy("b_id").agg(*[F.sum(f"_d.{k}").alias(k) for k in ("mat", "mis", "ins", "del")])


QUERIES = {f.__name__: f for f in (cigar_worst, cigar_regions, ov_filter, ov_filter_one_sided, ov_geometry, ov_mapping, ov_extended, ov_threshold, ov_exact, read_bases, read_kmers, read_names, vectors, cigar_identity)}


def _loc(err: int) -> str:
    a0, a1, b0, b1 = f"abs(a_start) <= {err}", f"a_len - a_end <= {err} AND a_end - a_len <= {err}", f"abs(b_start) <= {err}", f"b_len - b_end <= {err} AND b_end - b_len <= {err}"
    A0, A1, B0, B1 = f"a_start > {err}", f"a_len - a_end > {err}", f"b_start > {err}", f"b_len - b_end > {err}"
    return f"""CASE WHEN a_strand = b_strand AND {A0} AND ({a1}) AND {b0} AND {B1} THEN 'left' WHEN a_strand <> b_strand AND {a0} AND {A1} AND {b0} AND {B1} THEN 'left'
        WHEN a_strand = b_strand AND {a0} AND {A1} AND {B0} AND ({b1}) THEN 'right' WHEN a_strand <> b_strand AND {A0} AND ({a1}) AND {B0} AND ({b1}) THEN 'right'
        WHEN {a0} AND ({a1}) AND {b0} AND ({b1}) THEN 'equal' WHEN {b0} AND ({b1}) AND a_start >= -{err} AND a_end <= a_len + {err} THEN 'containing'
        WHEN {a0} AND ({a1}) AND b_start >= -{err} AND b_end <= b_len + {err} THEN 'contained' ELSE 'abnormal' END"""


def _rev(x: str, same: str = "a_strand = b_strand") -> str:
    return f"CASE {x} WHEN 'left' THEN CASE WHEN {same} THEN 'right' ELSE 'left' END WHEN 'right' THEN CASE WHEN {same} THEN 'left' ELSE 'right' END WHEN 'containing' THEN 'contained' WHEN 'contained' THEN 'containing' ELSE {x} END"


_OH = """sums AS (SELECT *, a_strand = b_strand AS same, a_start AS a0, a_len - a_end AS a1, b_start AS b0, b_len - b_end AS b1, a_start + CASE WHEN a_strand = b_strand THEN b_len - b_end ELSE b_start END AS s1,
    a_len - a_end + CASE WHEN a_strand = b_strand THEN b_start ELSE b_len - b_end END AS s2, a_start + a_len - a_end AS s3, b_start + b_len - b_end AS s4 FROM {0}),
    best AS (SELECT *, CASE least(s1, s2, s3, s4) WHEN s1 THEN 1 WHEN s2 THEN 2 WHEN s3 THEN 3 ELSE 4 END AS k FROM sums)"""
_MIN_A = "CASE k WHEN 1 THEN a0 WHEN 2 THEN a1 WHEN 3 THEN greatest(a0, a1) ELSE 0 END"
_MIN_B = "CASE WHEN k = 1 THEN CASE WHEN same THEN b1 ELSE b0 END WHEN k = 2 THEN CASE WHEN same THEN b0 ELSE b1 END WHEN k = 3 THEN 0 ELSE greatest(b0, b1) END"


def _carry(p: str) -> str:
    def div(x: str) -> str:
        return f"CAST(sign(({x})::HUGEINT * (a_end - a_start)) AS BIGINT) * (abs(({x})::BIGINT * (a_end - a_start)) // (b_end - b_start))"

    return f"""CAST(CASE WHEN a_strand = b_strand THEN CASE WHEN {p} < b_start THEN a_start + ({p} - b_start) WHEN {p} < b_end THEN a_start + {div(f"{p} - b_start")} ELSE a_end + ({p} - b_end) END
        ELSE CASE WHEN {p} > b_end THEN a_start - ({p} - b_end) WHEN {p} > b_start THEN a_start - {div(f"{p} - b_end")} ELSE a_end - ({p} - b_start) END END AS BIGINT)"""


_A_OH, _B_OH = "least(300, CAST(trunc(a_len * 0.2::DOUBLE) AS INTEGER))", "least(300, CAST(trunc(b_len * 0.2::DOUBLE) AS INTEGER))"
_F32 = "CAST(CAST(0.99 AS FLOAT) AS DOUBLE)"

_OPS = """o AS (SELECT ol_id, b_id, b_start, b_end, (b_end - b_start) // 3 AS n, 2 + ol_id % 9 AS x, 3 + ol_id % 5 AS i, ol_id % 13 AS d, b_end - b_start AS l FROM al WHERE b_end - b_start > 60)"""


def _common(a: str, b: str, c: str, d: str) -> str:
    return f"greatest(0, least({b}, {d}) - greatest({a}, {c}))"


_WORST = " , ".join(f"({_common('n', 'n + x + i', w, w + ' + 1000')} + {_common('l + i - d', 'l + i', w, w + ' + 1000')})" for w in ("n", "(l + i - d)", "greatest(0, n + x + i - 1000)", "greatest(0, l + i - 1000)", "0"))

SQL = {
    "cigar_worst": f"WITH {AL}, {_OPS}, e AS (SELECT ol_id, CAST(greatest({_WORST}) AS INTEGER) AS errors FROM o) SELECT ol_id, errors, round(1 - errors / 1000::DOUBLE, 6) AS identity FROM e",
    "cigar_regions": f"""WITH {AL}, {_OPS}, r AS (SELECT o.*, greatest(ctg_len // 4, b_start) - b_start AS s, least(ctg_len // 4 + 20000, b_end) - b_start AS e FROM o JOIN contigs ON ctg_id = b_id WHERE ctg_len // 4 + 20000 > b_start AND ctg_len // 4 < b_end)
        SELECT b_id, CAST(sum({_common('0', 'n', 's + 1', 'e + 1')} + {_common('n + x', 'l - d', 's + 1', 'e + 1')}) AS BIGINT) AS mat, CAST(sum({_common('n', 'n + x', 's + 1', 'e + 1')}) AS BIGINT) AS mis,
            CAST(sum(CASE WHEN n + x > s AND n + x <= e THEN i ELSE 0 END) AS BIGINT) AS ins, CAST(sum({_common('l - d', 'l', 's + 1', 'e + 1')}) AS BIGINT) AS del FROM r GROUP BY b_id""",
    "ov_filter": f"""WITH {OV} SELECT ol_id FROM ov WHERE a_id <> b_id AND a_len >= 500 AND b_len >= 500 AND identity >= 90 AND NOT ({LEN} < 400 AND {LEN} < a_len * 0.5::DOUBLE AND {LEN} < b_len * 0.5::DOUBLE)
        AND ({LEN} >= 6000 OR {LEN} >= a_len * {_F32} OR {LEN} >= b_len * {_F32} OR NOT CASE WHEN a_strand = b_strand
            THEN (a_start > {_A_OH} AND b_start > {_B_OH}) OR (a_len - a_end > {_A_OH} AND b_len - b_end > {_B_OH})
            ELSE (a_start > {_A_OH} AND b_len - b_end > {_B_OH}) OR (a_len - a_end > {_A_OH} AND b_start > {_B_OH}) END)""",
    "ov_filter_one_sided": f"WITH {OV} SELECT ol_id FROM ov WHERE a_id <> b_id AND identity >= 80 AND NOT ({LEN} < 0) AND NOT (a_start > 50 AND b_start > 50 AND a_len - a_end > 50 AND b_len - b_end > 50)",
    "ov_geometry": f"""WITH {OV}, {_OH.format("ov")}, l AS (SELECT *, {_loc(0)} AS loc0, {_loc(200)} AS loc200, {_loc(50)} AS loc50 FROM best)
        SELECT ol_id, CAST({LEN} AS INTEGER) AS aligned, CAST(trunc(identity * {LEN}) AS BIGINT) AS aligned_size,
            CAST(CASE WHEN same THEN least(a0, b0) + {LEN} + least(a1, b1) ELSE least(a0, b1) + {LEN} + least(a1, b0) END AS INTEGER) AS ideal, loc0, loc200, {_rev("loc200")} AS loc_b,
            CASE WHEN a_id >= b_id THEN loc50 ELSE {_rev("loc50")} END AS loc_max, loc200 IN ('equal', 'containing') AS containing, loc200 IN ('equal', 'contained') AS contained, loc200 IN ('left', 'right') AS proper,
            NOT ((a0 > 200 AND (CASE b_strand WHEN 0 THEN b0 ELSE b1 END) > 200) OR (a1 > 200 AND (CASE b_strand WHEN 0 THEN b1 ELSE b0 END) > 200)) AS ends_ok,
            CAST(CASE loc200 WHEN 'left' THEN CASE WHEN same THEN a1 ELSE a0 END WHEN 'right' THEN CASE WHEN same THEN a0 ELSE a1 END WHEN 'contained' THEN greatest(a0, a1) WHEN 'equal' THEN greatest(a0, a1) ELSE -1 END AS INTEGER) AS oh_a,
            CAST(CASE loc200 WHEN 'left' THEN b0 WHEN 'right' THEN b1 WHEN 'containing' THEN greatest(b0, b1) WHEN 'equal' THEN greatest(b0, b1) ELSE -1 END AS INTEGER) AS oh_b,
            CAST({_MIN_A} AS INTEGER) AS min_oh_a, CAST({_MIN_B} AS INTEGER) AS min_oh_b, CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS sides_a,
            CASE WHEN k = 1 THEN CASE WHEN same THEN 2 ELSE 1 END WHEN k = 2 THEN CASE WHEN same THEN 1 ELSE 2 END WHEN k = 3 THEN 0 ELSE 3 END AS sides_b,
            greatest(0, CASE WHEN same THEN b0 ELSE b1 END - a0) AS ext_a0, greatest(0, CASE WHEN same THEN b1 ELSE b0 END - a1) AS ext_a1, greatest(0, CASE WHEN same THEN a0 ELSE a1 END - b0) AS ext_b0, greatest(0, CASE WHEN same THEN a1 ELSE a0 END - b1) AS ext_b1,
            {_A_OH} AS allowed_oh FROM l""",
    "ov_mapping": f"WITH {AL} SELECT ol_id, {_carry('0')} AS at_start, {_carry('b_len')} AS at_end, {_carry('(b_len // 2)')} AS at_middle FROM al",
    "ov_extended": f"""WITH {OV}, n AS (SELECT *, {_loc(0)} AS l0, {_loc(200)} AS lm, a_start <= 200 AS a0n, b_start <= 200 AS b0n, a_len - a_end <= 200 AS a1n, b_len - b_end <= 200 AS b1n, a_strand = b_strand AS same FROM ov),
        s AS (SELECT ol_id, l0, lm, a_start, a_end, b_start, b_end,
            CASE WHEN a0n THEN 0 WHEN same AND b0n THEN a_start - b_start WHEN NOT same AND b1n THEN a_start - (b_len - b_end) ELSE a_start END AS as2, CASE WHEN a1n THEN a_len WHEN same AND b1n THEN a_end + b_len - b_end WHEN NOT same AND b0n THEN a_end + b_start ELSE a_end END AS ae2,
            CASE WHEN b0n THEN 0 WHEN same AND a0n THEN b_start - a_start WHEN NOT same AND a1n THEN b_start - (a_len - a_end) ELSE b_start END AS bs2, CASE WHEN b1n THEN b_len WHEN same AND a1n THEN b_end + a_len - a_end WHEN NOT same AND a0n THEN b_end + a_start ELSE b_end END AS be2 FROM n)
        SELECT ol_id, CASE WHEN l0 <> 'abnormal' THEN a_start WHEN lm <> 'abnormal' THEN as2 END AS a_start, CASE WHEN l0 <> 'abnormal' THEN a_end WHEN lm <> 'abnormal' THEN ae2 END AS a_end,
            CASE WHEN l0 <> 'abnormal' THEN b_start WHEN lm <> 'abnormal' THEN bs2 END AS b_start, CASE WHEN l0 <> 'abnormal' THEN b_end WHEN lm <> 'abnormal' THEN be2 END AS b_end FROM s""",
    "ov_threshold": f"""WITH {AL}, c AS (SELECT b_id, count(*) AS cov FROM al GROUP BY b_id) SELECT b_id, cov, round(CASE WHEN cov < 20 THEN 3 WHEN cov > 60 THEN 9 ELSE 3 + (cov - 20) * 0.15 END::DOUBLE, 6) AS th,
        round(CASE WHEN cov < 20 THEN 2147483647 WHEN cov > 60 THEN 9 ELSE 3 + (cov - 20) * 0.15 END::DOUBLE, 6) AS branch_th FROM c""",
    "ov_exact": f"WITH {AL}, {_OH.format('al')} SELECT ol_id FROM best WHERE {LEN} >= 400 AND {LEN} >= least(a_len, b_len) * 0.6::DOUBLE AND identity >= 90 AND greatest({_MIN_A}, {_MIN_B}) <= 100",
    "read_bases": f"""WITH {READS} SELECT read_id, regexp_full_match(seq, '[ACGTNacgtn]*') AS dna_n, regexp_full_match(seq, '[ACGTacgt]*') AS dna, md5(translate(reverse(seq), 'ACGTacgt', 'TGCAtgca')) AS revcomp,
        translate(reverse(substr(seq, 101, 40)), 'ACGTacgt', 'TGCAtgca') AS part, regexp_matches(upper(seq), 'A{{8}}|C{{8}}|G{{8}}|T{{8}}') AS poly, upper(trim(substr(seq, 1, 10))) AS head FROM reads""",
    "read_kmers": f"""WITH {READS}, k AS (SELECT substr(upper(seq), CAST(i AS BIGINT), 9) AS k FROM reads, unnest(range(1, length(seq) - 7)) AS t(i) WHERE length(seq) >= 9), c AS (SELECT least(k, translate(reverse(k), 'ACGT', 'TGCA')) AS kmer FROM k WHERE regexp_full_match(k, '[ACGT]*'))
        SELECT kmer, count(*) AS n, CAST(list_sum(list_transform(range(0, 9), lambda i: (strpos('ACGT', substr(kmer, CAST(i + 1 AS BIGINT), 1)) - 1) * (4 ** (8 - i)))) AS BIGINT) AS code, TRUE AS round_trip FROM c GROUP BY kmer""",
    "read_names": """WITH r AS (SELECT DISTINCT read_id, read_name FROM seq_reads WHERE read_id IS NOT NULL), p AS (SELECT *, list_filter(regexp_split_to_array(read_name, '[/_-]'), lambda x: x <> '') AS parts, CASE WHEN read_id % 2 = 0 THEN read_id + 1 ELSE -read_id - 1 END AS eid FROM r)
        SELECT read_id, coalesce(len(parts), -1)::INTEGER AS parts, array_to_string(parts, '+') AS joined, 'block' || (read_id % 7) || '.txt' AS file, (read_id % 100) * 1024 AS bytes, eid, -eid AS reverse, TRUE AS back, CASE WHEN eid > 0 THEN 0 ELSE 1 END AS side FROM p""",
    "vectors": """WITH r AS (SELECT DISTINCT stat_id, aln_start, aln_end, aligned_len FROM read_stats WHERE stat_id IS NOT NULL AND aln_start IS NOT NULL AND aln_end IS NOT NULL AND aligned_len IS NOT NULL),
        v AS (SELECT *, [(aln_start % 3 - 1) * (aln_end % 2 * 2 - 1), (aln_end % 3 - 1) * (aln_start % 2 * 2 - 1), (aligned_len % 3 - 1) * (aligned_len % 2 * 2 - 1)] AS p FROM r)
        SELECT stat_id, CAST(len(list_filter(p, lambda x: x > 0)) AS INTEGER) AS same, CAST(len(list_filter(p, lambda x: x < 0)) AS INTEGER) AS different, greatest(0, least(1000, abs(aln_end - 2000))) AS clamped FROM v""",
    "cigar_identity": f"""WITH {AL}, x AS (SELECT *, b_end - b_start + 3 AS length FROM al WHERE a_end > a_start AND b_end - b_start > 40)
        SELECT ol_id, 5 AS ops, b_end - b_start - 12 AS q, b_end - b_start AS t, a_start AS lead, round(CAST(trunc(length * identity / 100) AS INTEGER) * 100.0::DOUBLE / (length - 15), 6) AS without_large FROM x""",
}
