"""Domain views of the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.session import table

#: SQL of the views, to be put after WITH.
OV = """ov AS (SELECT DISTINCT ol_id, qid AS a_id, 0 AS a_strand, qstart AS a_start, qend AS a_end, qlen AS a_len, tid AS b_id, CASE WHEN strand = '-' THEN 1 ELSE 0 END AS b_strand,
    tstart AS b_start, tend AS b_end, tlen AS b_len, CAST(matches AS DOUBLE) * 100 / nullif(alnlen, 0) AS identity FROM read_overlaps WHERE qid IS NOT NULL AND tid IS NOT NULL AND qid <> -1 AND tid <> -1)"""
AL = """al AS (SELECT DISTINCT aln_id AS ol_id, qid AS a_id, qstrand AS a_strand, qstart AS a_start, qend AS a_end, qlen AS a_len, tid AS b_id, tstrand AS b_strand, tstart AS b_start, tend AS b_end, tlen AS b_len, identity_pct AS identity
    FROM alignments WHERE qid IS NOT NULL AND tid IS NOT NULL AND qid <> -1 AND tid <> -1)"""
#: Aligned length and both directions of same strands.
LEN = "((a_end - a_start + b_end - b_start) // 2)"
SIDES = """sides AS (SELECT ol_id, identity, a_id AS read, a_start AS r_start, a_end AS r_end, a_len AS r_len, b_id AS other, b_start AS o_start, b_end AS o_end, b_len AS o_len, a_strand = b_strand AS same_dir, 0 AS side FROM ov
    UNION ALL SELECT ol_id, identity, b_id, b_start, b_end, b_len, a_id, a_start, a_end, a_len, a_strand = b_strand, 1 FROM ov)"""
EDGES = """e AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM graph_edges) WHERE rn = 1 AND in_node IS NOT NULL AND out_node IS NOT NULL AND in_node <> out_node),
    edges AS (SELECT in_node, out_node, max(tile_end - tile_start) AS len, max(score) AS score FROM e GROUP BY in_node, out_node)"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_overlaps with both ids known, without repeated rows."""
    df = table(spark, sf_dir, "read_overlaps").where("qid is not null and tid is not null and qid != -1 and tid != -1")
    return df.select(
        "ol_id", F.col("qid").alias("a_id"), F.lit(0).alias("a_strand"), F.col("qstart").alias("a_start"), F.col("qend").alias("a_end"), F.col("qlen").alias("a_len"),
        F.col("tid").alias("b_id"), F.when(F.col("strand") == "-", 1).otherwise(0).alias("b_strand"), F.col("tstart").alias("b_start"), F.col("tend").alias("b_end"), F.col("tlen").alias("b_len"),
        (F.col("matches").cast("double") * 100 / F.nullif("alnlen", F.lit(0))).alias("identity"),
    ).distinct()


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """alignments (read on contig) with both ids known, without repeated rows."""
    df = table(spark, sf_dir, "alignments").where("qid is not null and tid is not null and qid != -1 and tid != -1")
    return df.select(
        F.col("aln_id").alias("ol_id"), F.col("qid").alias("a_id"), F.col("qstrand").alias("a_strand"), F.col("qstart").alias("a_start"), F.col("qend").alias("a_end"), F.col("qlen").alias("a_len"),
        F.col("tid").alias("b_id"), F.col("tstrand").alias("b_strand"), F.col("tstart").alias("b_start"), F.col("tend").alias("b_end"), F.col("tlen").alias("b_len"), F.col("identity_pct").alias("identity"),
    ).distinct()


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per read id: name, sequence and its length in letters."""
    df = table(spark, sf_dir, "seq_reads").where("read_id is not null")
    return df.groupBy("read_id").agg(F.max(F.struct("loaded_at", "read_name", "seq")).alias("r")).select("read_id", F.col("r.read_name").alias("name"), F.col("r.seq").alias("seq"), F.coalesce(F.length("r.seq"), F.lit(0)).alias("len"))


READS = "reads AS (SELECT read_id, max(read_name) AS name, max(seq) AS seq, coalesce(max(length(seq)), 0) AS len FROM seq_reads WHERE read_id IS NOT NULL GROUP BY read_id)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of every edge between two nodes, one edge per pair of nodes: in_node, out_node, len, score."""
    df = table(spark, sf_dir, "graph_edges")
    last = df.groupBy("edge_id").agg(F.max(F.struct("loaded_at", "in_node", "out_node", "tile_start", "tile_end", "score")).alias("r")).select("r.*")
    return last.where("in_node is not null and out_node is not null and in_node != out_node").groupBy("in_node", "out_node").agg(F.max(F.col("tile_end") - F.col("tile_start")).alias("len"), F.max("score").alias("score"))
