"""Alignment, consensus and phasing kernels over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import align, dna
from strandframe.functions.overlap import Filter, sides
from strandframe.operators import calls, consensus, coverage, pairs, phasing
from strandframe.plans.pair_queries import _alleles, _placed, _single
from strandframe.plans.views import AL, LEN, OV, READS, SIDES, alignments, overlaps, reads
from strandframe.session import table


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both aligned stretches of every overlap, on the same strand."""
    got = pairs.with_sequences(overlaps(spark, sf_dir).where("a_start < a_end and b_start < b_end"), reads(spark, sf_dir))
    a = dna.slice_of(F.upper("a_seq"), F.col("a_start"), F.col("a_end"), (F.col("a_strand") != F.col("b_strand")).cast("int"))
    rows = got.select("ol_id", a.alias("a"), F.substring(F.upper("b_seq"), F.col("b_start") + 1, F.col("b_end") - F.col("b_start")).alias("b")).where("a is not null and b is not null")
    # a pair costs far more than its bytes tell, so partitions are not merged by size
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ol_id")


def kern_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance and quality of the aligned stretches of every overlap."""
    d = _stretches(spark, sf_dir).select("ol_id", F.length("a").alias("_a"), F.length("b").alias("_b"), align.distance_udf(F.col("a"), F.col("b")).alias("distance"))
    return d.select("ol_id", "distance", F.round(align.quality_from(F.col("distance"), F.col("_a"), F.col("_b")), 6).alias("quality"))


def kern_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of these stretches with the fewest edits."""
    return _stretches(spark, sf_dir).select("ol_id", align.align_udf(F.col("a"), F.col("b"), "edit").alias("cigar"))


def kern_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps whose realigned identity passes a filter."""
    d = kern_distance(spark, sf_dir).where("quality >= 90")
    return overlaps(spark, sf_dir).join(d, "ol_id").where(Filter.parse("oh=1000:ohr=0.5").valid()).select("ol_id", "quality")


def kern_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of every kind at each position of a read, along the realigned overlaps."""
    got = _placed(spark, sf_dir).where("length(t) > 0 and length(q) > 0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ctg", "read", "start")
    return calls.counts(calls.walk(got.withColumn("cigar", align.align_udf(F.col("q"), F.col("t"), "edit"))))


def kern_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of every read that two others cover."""
    out = consensus.correct_reads(_single(spark, sf_dir), reads(spark, sf_dir))
    return out.select("read", F.length("seq").alias("bases"), "range_start", "range_end", "used")


def kern_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of correction candidates (T4)."""
    return consensus.candidate_weights(sides(overlaps(spark, sf_dir)))


def phase_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the same and the other haplotype (H1 to H8)."""
    return phasing.phase(_alleles(spark, sf_dir), options=phasing.Options(count=2, same=2))


def phase_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-complexity stretches of every read."""
    return phasing.masked_regions(reads(spark, sf_dir), "read_id", "seq")


def cov_trough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first trough of the contigs' coverages."""
    return coverage.trough_of(coverage.segments(alignments(spark, sf_dir), ["b_id"], F.col("b_start"), F.col("b_end")), "depth", 100, 3)


def cov_group_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least coverage of every contig between its trimmed alignments."""
    return coverage.least_cover(alignments(spark, sf_dir), ["b_id"], "b_start", "b_end", 100)


def cov_genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases of all reads over the upper median of their middle coverages."""
    from strandframe.operators import weighted

    segs = coverage.segments(sides(overlaps(spark, sf_dir)), ["read"], F.col("r_start"), F.col("r_end"), F.col("r_len"))
    segs = segs.join(segs.groupBy("read").agg(F.max("end").alias("len")), "read")
    mid = coverage.thirds(segs, ["read"], F.col("len")).where("c1 > 0").withColumn("one", F.lit(1))
    med = weighted.select_ranks(weighted.compress(mid, ["one"], F.col("c1")), ["one"], {"m": weighted.UPPER_MEDIAN}).select("value")
    bases = reads(spark, sf_dir).agg(F.sum("len").alias("bases"))
    return bases.withColumn("median", med.scalar()).select("bases", "median", F.expr("bases div median").alias("size"))


QUERIES = {f.__name__: f for f in (kern_distance, kern_align, kern_refined, kern_calls, kern_corrected, kern_weights, phase_pairs, phase_masked, cov_trough, cov_group_least, cov_genome)}

_STRETCH = f"""{OV}, {READS}, st AS (SELECT ol_id, CASE WHEN a_strand <> b_strand THEN translate(reverse(substr(upper(x.seq), a_start + 1, a_end - a_start)), 'ACGT', 'TGCA') ELSE substr(upper(x.seq), a_start + 1, a_end - a_start) END AS a, substr(upper(y.seq), b_start + 1, b_end - b_start) AS b
    FROM ov JOIN reads x ON x.read_id = a_id JOIN reads y ON y.read_id = b_id WHERE a_end > a_start AND b_end > b_start AND x.seq IS NOT NULL AND y.seq IS NOT NULL)"""

_OHA, _OHB = (f"least(1000, CAST(trunc({x}_len * 0.5::DOUBLE) AS INTEGER))" for x in "ab")

def _events(trim: int) -> str:
    """Coverage of contigs by alignments trimmed at both ends."""
    iv = f"iv AS (SELECT b_id, CAST(b_start AS BIGINT) + {trim} AS s, CAST(b_end AS BIGINT) - {trim} AS e FROM al)"
    ev = "ev AS (SELECT b_id, pos, CAST(sum(d) AS BIGINT) AS d FROM (SELECT b_id, s AS pos, 1 AS d FROM iv WHERE s < e UNION ALL SELECT b_id, e, -1 FROM iv WHERE s < e) GROUP BY b_id, pos)"
    return iv + ", " + ev + ', segs AS (SELECT * FROM (SELECT b_id, pos AS start, lead(pos) OVER w AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM ev WINDOW w AS (PARTITION BY b_id ORDER BY pos)) WHERE "end" IS NOT NULL)'


SQL = {
    "cov_group_least": f'WITH {AL}, {_events(100)} SELECT b_id, min(depth) AS least, min(start) AS "from", max("end") AS "to" FROM segs GROUP BY b_id',
    "cov_trough": f"""WITH {AL}, {_events(0)}, h AS (SELECT depth AS v, count(*) AS f FROM segs GROUP BY depth), lo AS (SELECT min(v) AS lo, greatest(max(v) - min(v) + 1, 3) AS n FROM h),
        c AS (SELECT i, n, coalesce(f, 0) AS c FROM unnest(range(CAST(0 AS BIGINT), CAST(106 AS BIGINT))) AS t(i), lo LEFT JOIN h ON v = lo + i), l AS (SELECT *, lag(c) OVER (ORDER BY i) AS p, sum(c) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s, sum(c) OVER (ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS s1 FROM c),
        st AS (SELECT coalesce(min(i - 1), 0) AS st FROM l WHERE p > c AND i < least(10, n)), at_ AS (SELECT min(i) AS a FROM l, st WHERE i >= st AND (s1 >= s OR i + 1 >= least(n, 100))), bt AS (SELECT i AS bi, c AS bc FROM l, at_ WHERE i BETWEEN a AND a + 2 ORDER BY c, i LIMIT 1)
        SELECT CAST(greatest(coalesce(max(i), 1), 1) AS INTEGER) AS trough FROM l, bt WHERE i <= bi AND (i = 0 OR NOT (p BETWEEN c * 0.85::DOUBLE AND c * 1.15::DOUBLE AND p BETWEEN bc * 0.5::DOUBLE AND bc * 1.5::DOUBLE))""",
    "kern_distance": f"WITH {_STRETCH} SELECT ol_id, CAST(levenshtein(a, b) AS INTEGER) AS distance, round(100.0::DOUBLE - levenshtein(a, b) * 100.0::DOUBLE / nullif(greatest(length(a), length(b)), 0), 6) AS quality FROM st",
    "kern_refined": f"""WITH {_STRETCH}, d AS (SELECT ol_id, round(100.0::DOUBLE - levenshtein(a, b) * 100.0::DOUBLE / nullif(greatest(length(a), length(b)), 0), 6) AS quality FROM st)
        SELECT ol_id, quality FROM ov JOIN d USING (ol_id) WHERE quality >= 90 AND a_id <> b_id AND a_len >= 0 AND b_len >= 0 AND identity >= 0 AND NOT ({LEN} < 0)
        AND ({LEN} >= 10000000 OR {LEN} >= a_len OR {LEN} >= b_len OR NOT CASE WHEN a_strand = b_strand
            THEN (a_start > {_OHA} AND b_start > {_OHB}) OR (a_len - a_end > {_OHA} AND b_len - b_end > {_OHB})
            ELSE (a_start > {_OHA} AND b_len - b_end > {_OHB}) OR (a_len - a_end > {_OHA} AND b_start > {_OHB}) END)""",
    "kern_weights": f"WITH {OV}, {SIDES} SELECT read, other, max(r_end - r_start - 0.5::DOUBLE * (least(r_start, o_start) + least(r_len - r_end, o_len - o_end))) AS weight FROM sides GROUP BY read, other",
    "cov_genome": f"""WITH {OV}, {SIDES}, ev AS (SELECT read, pos, sum(d) AS d FROM (SELECT read, r_start AS pos, 1 AS d FROM sides WHERE r_start < r_end UNION ALL SELECT read, r_end, -1 FROM sides WHERE r_start < r_end UNION ALL SELECT read, 0, 0 FROM sides UNION ALL SELECT read, r_len, 0 FROM sides) WHERE pos IS NOT NULL GROUP BY read, pos),
        s AS (SELECT * FROM (SELECT read, pos AS start, lead(pos) OVER w AS "end", sum(d) OVER w AS depth FROM ev WINDOW w AS (PARTITION BY read ORDER BY pos)) WHERE "end" IS NOT NULL), n AS (SELECT *, max("end") OVER (PARTITION BY read) // 3 AS t FROM s),
        m AS (SELECT read, CAST(sum(depth * greatest(0, least("end", 2 * t) - greatest(start, t))) AS BIGINT) // nullif(max(t), 0) AS c1 FROM n GROUP BY read), k AS (SELECT c1, row_number() OVER (ORDER BY c1) AS rn, count(*) OVER () AS n FROM m WHERE c1 > 0), {READS}, b AS (SELECT CAST(sum(len) AS BIGINT) AS bases FROM reads)
        SELECT bases, c1 AS median, bases // c1 AS size FROM k, b WHERE rn = n // 2 + 1""",
}
