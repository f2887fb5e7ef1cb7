"""Queries of problem 2: target ids that hold most alignment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import weighted
from strandframe.session import table

#: Share of all stored rows, in per cent, from which a target counts as heavy.
HEAVY_PERCENT = 2


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted.compress(table(spark, sf_dir, "alignments"), ["tid"], F.col("tend").cast("long") - F.col("tstart"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, other than null and -1, of at least HEAVY_PERCENT of all stored rows."""
    per_key = weighted.totals(_pairs(spark, sf_dir), ["tid"]).select("tid", "n_rows")
    total = table(spark, sf_dir, "alignments").count()
    return weighted.heavy(per_key.where("tid is not null and tid != -1"), "tid", total, HEAVY_PERCENT)


def p2_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target, null and -1 included: rows, aligned bases (tend - tstart), distinct and most frequent length."""
    out = weighted.totals(_pairs(spark, sf_dir), ["tid"])
    return out.select("tid", "n_rows", F.col("total").alias("aligned_bases"), F.col("n_distinct").alias("distinct_lengths"), F.col("mode").alias("mode_length"))


def p2_length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median and 90th percentile of the aligned length of every target."""
    return weighted.percentiles(_pairs(spark, sf_dir), ["tid"], [50, 90]).select("tid", "percent", F.col("value").alias("aligned_length"))


QUERIES = {"p2_found": p2_found, "p2_targets": p2_targets, "p2_length_percentiles": p2_length_percentiles}

SQL = {
    "p2_found": "SELECT tid FROM alignments WHERE tid IS NOT NULL AND tid <> -1 GROUP BY tid HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM alignments)",
    "p2_targets": """
        WITH v AS (SELECT tid, CAST(tend AS BIGINT) - tstart AS len FROM alignments),
        f AS (SELECT tid, len, count(*) AS freq FROM v GROUP BY tid, len),
        m AS (SELECT tid, len, row_number() OVER (PARTITION BY tid ORDER BY freq DESC, len) AS rn FROM f WHERE len IS NOT NULL)
        SELECT v.tid, v.n_rows, v.aligned_bases, v.distinct_lengths, m.len AS mode_length
        FROM (SELECT tid, count(*) AS n_rows, CAST(sum(len) AS BIGINT) AS aligned_bases, count(DISTINCT len) AS distinct_lengths FROM v GROUP BY tid) v
        LEFT JOIN m ON m.tid IS NOT DISTINCT FROM v.tid AND m.rn = 1""",
    "p2_length_percentiles": """
        WITH v AS (SELECT tid, CAST(tend AS BIGINT) - tstart AS len FROM alignments WHERE tend IS NOT NULL AND tstart IS NOT NULL),
        r AS (SELECT tid, len, row_number() OVER (PARTITION BY tid ORDER BY len) AS rn, count(*) OVER (PARTITION BY tid) AS n FROM v),
        p AS (SELECT unnest([50, 90]) AS percent)
        SELECT tid, CAST(percent AS INTEGER) AS percent, len AS aligned_length FROM r JOIN p ON rn = greatest(1, (n * percent + 99) // 100)""",
}
