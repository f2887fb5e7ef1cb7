"""Parsers and writers over lines made from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.plans.views import reads
from strandframe.session import table
from strandframe.sources import readers, writers

PAF = ("qname", "qlen", "qstart", "qend", "strand", "tname", "tlen", "tstart", "tend", "matches", "alnlen", "mapq")
M4A = ("qname", "tname", "identity_pct", "score", "qstrand", "qstart", "qend", "qlen", "tstrand", "tstart", "tend", "tlen")


def _whole(columns: tuple[str, ...]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)


def src_paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PAF lines with their tags, parsed."""
    t = table(spark, sf_dir, "read_overlaps").where(_whole(PAF)).select(*PAF, "tags").distinct()
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in PAF], "tags")
    return readers.parse_paf(t.select(line.alias("value"))).select(*[c for c in readers.OVERLAP if c not in ("identity", "cigar")], F.round("identity", 6).alias("identity"), F.size("cigar").alias("ops"))


def src_m4a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4A lines, parsed."""
    t = table(spark, sf_dir, "alignments").where(_whole(M4A)).select(*M4A).distinct()
    got = readers.parse_m4a(t.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in M4A]).alias("value")))
    return got.select("a_name", "b_name", "identity", "a_strand", "a_start", "a_end", "a_len", "b_strand", "b_start", "b_end", "b_len")


def src_paf_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as PAF and read again (K2)."""
    t = table(spark, sf_dir, "alignments").where(_whole(M4A)).select(*M4A).distinct()
    names = dict(zip(("a_name", "b_name", "identity", "a_strand", "a_start", "a_end", "a_len", "b_strand", "b_start", "b_end", "b_len"), ("qname", "tname", "identity_pct", "qstrand", "qstart", "qend", "qlen", "tstrand", "tstart", "tend", "tlen"), strict=True))
    got = readers.parse_paf(writers.paf(t.select(*[F.col(v).alias(k) for k, v in names.items()])))
    return got.select("a_name", "a_start", "a_end", "b_name", "b_start", "b_end", "b_strand", F.round("identity", 6).alias("identity"))


def src_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTA records and read again."""
    r = reads(spark, sf_dir).where("name is not null").withColumn("sub_head", F.lit(None).cast("string"))
    got = readers.parse_fasta(writers.fasta(r).select(F.substring("value", 2, 1 << 30).alias("value")))
    return got.select("name", F.md5("seq").alias("md5"), F.length("seq").alias("bases"))


def src_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph edges dumped and read again (K7)."""
    t = table(spark, sf_dir, "graph_edges").where("in_node is not null and out_node is not null and tile_start is not null and tile_end is not null and score is not null and identity_pct is not null")
    t = t.select("in_node", "out_node", "tile_start", "tile_end", "score", "identity_pct", F.coalesce("reduce_type", F.lit("-")).alias("reduce_type")).distinct()
    return readers.parse_edges(writers.table_lines(t))


def src_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and ends of the tiles' edges."""
    t = table(spark, sf_dir, "contig_tiles").where("seq_name is not null and edge_path is not null").select("seq_name", "edge_path").distinct()
    return readers.parse_tiles(t.select(F.concat("seq_name", F.lit(" edge="), "edge_path").alias("value"))).drop("rest")


QUERIES = {f.__name__: f for f in (src_paf, src_m4a, src_paf_written, src_fasta, src_edges, src_tiles)}

_AL = f"al AS (SELECT DISTINCT {', '.join(M4A)} FROM alignments WHERE {_whole(M4A)})"
_N = "((qend - qstart + tend - tstart) // 2)"

SQL = {
    "src_paf": f"""WITH d AS (SELECT DISTINCT {', '.join(PAF)}, tags FROM read_overlaps WHERE {_whole(PAF)}), r AS (SELECT *, coalesce(TRY_CAST(nullif(regexp_extract('\t' || tags, '\trl:i:([0-9]+)', 1), '') AS INTEGER), 0) AS rep, nullif(regexp_extract('\t' || tags, '\tcg:Z:([^\\s]+)', 1), '') AS cg FROM d)
        SELECT qname AS a_name, 0 AS a_strand, qstart AS a_start, qend AS a_end, qlen AS a_len, tname AS b_name, CASE WHEN strand = '-' THEN 1 ELSE 0 END AS b_strand, tstart AS b_start, tend AS b_end, tlen AS b_len, rep AS replen,
            round(CASE WHEN rep > 0 AND cg IS NULL AND alnlen > rep THEN (matches - least(matches, rep))::DOUBLE * 100 / (alnlen - rep) ELSE matches::DOUBLE * 100 / nullif(alnlen, 0) END, 6) AS identity, CAST(coalesce(len(regexp_extract_all(cg, '[0-9]+[MIDNSHPX=]')), 0) AS INTEGER) AS ops FROM r""",
    "src_m4a": f"WITH {_AL} SELECT qname AS a_name, tname AS b_name, identity_pct AS identity, qstrand AS a_strand, qstart AS a_start, qend AS a_end, qlen AS a_len, tstrand AS b_strand, tstart AS b_start, tend AS b_end, tlen AS b_len FROM al",
    "src_paf_written": f"WITH {_AL} SELECT qname AS a_name, qstart AS a_start, qend AS a_end, tname AS b_name, tstart AS b_start, tend AS b_end, CASE WHEN qstrand = tstrand THEN 0 ELSE 1 END AS b_strand, round(CAST(trunc({_N} * identity_pct / 100) AS INTEGER)::DOUBLE * 100 / nullif({_N}, 0), 6) AS identity FROM al",
    "src_fasta": "WITH r AS (SELECT read_id, max(read_name) AS name, coalesce(max(seq), '') AS seq FROM seq_reads WHERE read_id IS NOT NULL GROUP BY read_id) SELECT name, md5(seq) AS md5, CAST(length(seq) AS INTEGER) AS bases FROM r WHERE name IS NOT NULL",
    "src_edges": "SELECT DISTINCT in_node, out_node, tile_start, tile_end, score, identity_pct AS identity, coalesce(reduce_type, '-') AS reduce_type FROM graph_edges WHERE in_node IS NOT NULL AND out_node IS NOT NULL AND tile_start IS NOT NULL AND tile_end IS NOT NULL AND score IS NOT NULL AND identity_pct IS NOT NULL",
    "src_tiles": """WITH t AS (SELECT DISTINCT seq_name, edge_path FROM contig_tiles WHERE seq_name IS NOT NULL AND edge_path IS NOT NULL) SELECT seq_name AS ctg, regexp_extract(edge_path, '^([^:\\s]+):([BE])~([^:\\s]+):([BE])', 1) AS from_read, regexp_extract(edge_path, '^([^:\\s]+):([BE])~([^:\\s]+):([BE])', 2) AS from_end,
        regexp_extract(edge_path, '^([^:\\s]+):([BE])~([^:\\s]+):([BE])', 3) AS to_read, regexp_extract(edge_path, '^([^:\\s]+):([BE])~([^:\\s]+):([BE])', 4) AS to_end FROM t WHERE regexp_matches(edge_path, '^[^:\\s]+:[BE]~[^:\\s]+:[BE]')""",
}
