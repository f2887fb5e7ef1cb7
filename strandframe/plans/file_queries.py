"""Readers and writers over files and lines made from whole tables: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import pairs, selecting, snps
from strandframe.plans.pair_queries import _CALLS, _HIST, _calls
from strandframe.plans.source_queries import M4A, PAF, _whole
from strandframe.plans.views import OV, READS, overlaps, reads
from strandframe.session import shared_folder, table
from strandframe.sources import formats, readers, writers


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _line(*columns: Column | str, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("value")


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads with their heads: name, sub_head, seq, quality."""
    t = table(spark, sf_dir, "seq_reads").where("read_name is not null").groupBy("read_name").agg(F.max(F.struct("loaded_at", "sub_head", "seq", "quality")).alias("r"))
    return t.select(F.col("read_name").alias("name"), "r.sub_head", "r.seq", "r.quality")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments with all their columns, once each."""
    return table(spark, sf_dir, "alignments").where(_whole(M4A)).where("qid is not null and tid is not null").select("aln_id", "qid", "tid", *M4A).distinct()


def src_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as a FASTQ file and read again."""
    path = _path(spark, "reads.fastq")
    writers.save(writers.fastq(_named(spark, sf_dir)), path)
    return readers.read_fastq(spark, path).select("name", "sub_head", F.md5("seq").alias("seq"), F.md5("quality").alias("quality"))


def src_read_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of a FASTA and a gzipped FASTQ file; sequences of the reads that overlaps name only."""
    r, folder = _named(spark, sf_dir), _path(spark, "")
    writers.save(writers.fasta(r.where("quality is null")), f"{folder}plain.fa")
    writers.save(writers.fastq(r.where("quality is not null")), f"{folder}scored.fq", gzip=True)
    writers.save(spark.createDataFrame([("plain.fa",), ("scored.fq",)], "value string"), f"{folder}all.fofn")
    wanted = table(spark, sf_dir, "read_overlaps").select(F.col("qname").alias("name")).where("name is not null")
    return readers.read_reads(spark, f"{folder}all.fofn", names=wanted).select("name", "sub_head", F.md5("seq").alias("seq"))


def src_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges in the heads of corrected reads."""
    path = _path(spark, "corrected.fasta")
    writers.save(writers.fasta(_named(spark, sf_dir)), path)
    return readers.read_ranges(spark, path)


def src_m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as M4, by number, and read again."""
    t = _mapped(spark, sf_dir)
    names = {"a_name": "qid", "b_name": "tid", "identity": "identity_pct", "a_strand": "qstrand", "a_start": "qstart", "a_end": "qend", "a_len": "qlen", "b_strand": "tstrand", "b_start": "tstart", "b_end": "tend", "b_len": "tlen"}
    path = _path(spark, "all.m4")
    writers.save(writers.m4(t.select(*[F.col(v).alias(k) for k, v in names.items()])), path)
    return readers.read_overlaps(spark, path).select("a_name", "a_strand", "a_start", "a_end", "a_len", "b_name", "b_strand", "b_start", "b_end", "b_len", F.round("identity", 3).alias("identity"))


def src_sam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SAM lines with clips and indels under a header of contigs, parsed."""
    t = table(spark, sf_dir, "alignments").where(" AND ".join(f"{c} IS NOT NULL" for c in M4A if c != "tname")).select("aln_id", *M4A).distinct()
    head = table(spark, sf_dir, "contigs").where("ctg_name is not null").groupBy("ctg_name").agg(F.max("ctg_len").alias("n")).select(F.concat(F.lit("@SQ\tSN:"), "ctg_name", F.lit("\tLN:"), F.col("n").cast("string")).alias("value"))
    rev = F.col("qstrand") != F.col("tstrand")
    q, x = F.col("qend") - F.col("qstart"), F.col("tend") - F.col("tstart")
    lead, tail = F.when(rev, F.col("qlen") - F.col("qend")).otherwise(F.col("qstart")), F.when(rev, F.col("qstart")).otherwise(F.col("qlen") - F.col("qend"))

    def op(n: Column, kind: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(kind))).otherwise(F.lit(""))

    cigar = F.concat(op(lead, "S"), op(F.least(q, x), "M"), op(q - x, "I"), op(x - q, "D"), op(tail, "H"))
    body = t.where(q > 0).where(x > 0).select(_line(F.concat("qname", F.lit("/"), "aln_id"), F.when(rev, 16).otherwise(0), F.coalesce("tname", F.lit("*")), F.col("tstart") + 1, F.lit(60), cigar, F.lit("*\t0\t0\t*\t*"), F.concat(F.lit("NM:i:"), (F.abs(q - x) + F.col("aln_id") % 7).cast("string"))))
    return readers.parse_sam(head.unionByName(body)).select(*[c for c in readers.OVERLAP if c not in ("identity", "cigar", "replen")], F.round("identity", 6).alias("identity"), F.size("cigar").alias("ops"))


def src_overlap_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of a PAF and an M4A file, saved and loaded under a condition each."""
    t, folder = _mapped(spark, sf_dir), _path(spark, "")
    names = dict(zip(("a_name", "b_name", "identity", "a_strand", "a_start", "a_end", "a_len", "b_strand", "b_start", "b_end", "b_len"), ("qname", "tname", "identity_pct", "qstrand", "qstart", "qend", "qlen", "tstrand", "tstart", "tend", "tlen"), strict=True))
    t = t.select("aln_id", *[F.col(v).alias(k) for k, v in names.items()])
    writers.save(writers.paf(t.where("aln_id % 2 = 0")), f"{folder}even.paf", where=F.col("value").rlike("\tctg"))
    writers.save(writers.m4a(t.where("aln_id % 2 = 1")), f"{folder}odd.m4a", gzip=True)
    writers.save(spark.createDataFrame([("even.paf",), ("odd.m4a",)], "value string"), f"{folder}all.txt")
    got = readers.read_overlaps(spark, f"{folder}all.txt", where=(F.col("a_end") - F.col("a_start") >= 500) & (F.col("b_len") > 10_000))
    return got.select("a_name", "a_start", "a_end", "b_name", "b_start", "b_end")


def src_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VCF lines at the alignments' starts, parsed."""
    b = ["A", "C", "G", "T"]
    letter = lambda k: F.element_at(F.array(*map(F.lit, b)), (F.expr(k) % 4 + 1).cast("int"))
    alt = F.when(F.col("aln_id") % 3 == 0, F.concat(letter("aln_id + 1"), F.lit(","), letter("aln_id div 4 + 2"))).when(F.col("aln_id") % 11 == 0, F.lit("GT")).otherwise(letter("aln_id + 1"))
    gt = F.when(F.col("aln_id") % 3 == 0, F.lit("1|2")).when(F.col("aln_id") % 7 == 0, F.lit("1/1")).otherwise(F.lit("0/1"))
    t = _mapped(spark, sf_dir).select(_line("tname", F.col("tstart") + 1, F.lit("."), letter("aln_id"), alt, F.lit("30"), F.when(F.col("aln_id") % 5 == 0, "LowQual").otherwise("PASS"), F.lit("."), F.lit("GT:DP"), F.concat(gt, F.lit(":"), "qlen")))
    return readers.parse_vcf(spark.createDataFrame([("##fileformat=VCFv4.2",)], "value string").unionByName(t))


def src_inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements of reads on each other, dumped as lines per target and read again."""
    t = overlaps(spark, sf_dir).where("a_id != b_id").select(F.col("b_id").alias("t"), F.col("a_id").alias("q"), (F.col("a_strand") != F.col("b_strand")).cast("int").alias("strand"), (F.col("b_start") - F.col("a_start")).alias("offset"))
    return readers.parse_inconsistent(writers.inconsistent(t))


def src_read_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base calls of reads on contigs, dumped per read and read again."""
    t = _mapped(spark, sf_dir).select(F.col("tname").alias("ctg"), F.col("qname").alias("read"), F.col("qstrand").alias("direction"), (F.col("tstart") - F.col("qstart")).alias("offset"), F.col("tstart").alias("ctg_pos"), (F.col("aln_id") % 5 - 1).cast("int").alias("base"), F.col("qstart").alias("rd_pos"))
    return readers.parse_read_variants(writers.read_variants(t)).distinct()


def src_read_snps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines without the misses."""
    t = _mapped(spark, sf_dir).select(_line("tname", "qname", "qstrand", F.col("tstart") - F.col("qstart"), _line("tstart", F.col("aln_id") % 5 - 1, "qstart", sep="|"), sep=" "))
    return readers.parse_snps_in_reads(t).distinct()


def src_contig_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of positions dumped in 13 columns and read again."""
    h = snps.base_histogram(_calls(spark, sf_dir)).withColumn("zero", F.lit(0)).withColumn("valid", (F.col("cov") >= 3).cast("int"))
    lines = writers.table_lines(h, "ctg", "pos", "n_a", "n_c", "n_g", "n_t", *["zero"] * 4, "n_del", "cov", "valid")
    return readers.parse_contig_variants(lines).select("ctg", "pos", "n_a", "n_c", "n_g", "n_t", "n_del", "cov", "var0", "var1")


def src_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of first windows of reads with their counts, dumped and read again."""
    k = reads(spark, sf_dir).where("len >= 15").groupBy(F.substring("seq", 1, 15).alias("kmer")).agg(F.count(F.lit(1)).alias("n"))
    return readers.parse_kmers(writers.table_lines(k))


def src_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as BED rows, among rows of other forms, parsed."""
    t = table(spark, sf_dir, "contig_tiles").where("seq_name is not null").select("seq_name", "tile_start", "tile_end", "tile_no").distinct()
    other = t.select(_line("seq_name", "tile_start", "tile_end", "tile_no"))
    return readers.parse_bed(t.select(_line("seq_name", F.coalesce(F.col("tile_start").cast("string"), F.lit(".")), F.coalesce(F.col("tile_end").cast("string"), F.lit(".")))).unionByName(other.where(F.size(F.split("value", "\t")) == 4)))


def src_hic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles of both mates of a pair, in nested lines, parsed."""
    t = _mapped(spark, sf_dir)
    alleles = F.concat_ws(";", F.concat_ws("-", F.col("tstart").cast("string"), (F.col("aln_id") % 4).cast("string")), F.concat_ws("-", F.col("tend").cast("string"), (F.col("aln_id") % 3).cast("string")))
    one = F.concat_ws("_", F.regexp_replace("tname", "_", "."), F.col("qstart").cast("string"), alleles)
    mates = t.select(F.concat(F.regexp_replace("qname", ",", "."), F.lit(","), one, F.lit("|"), F.when(F.col("aln_id") % 2 == 0, one).otherwise(F.lit(""))).alias("value"))
    return readers.parse_hic(mates)


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "read_stats").where("stat_id is not null and read_id is not null and mate_len is not null").select("stat_id", "mate_len", "aln_start", "aln_end", "aligned_len").distinct()
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return readers.parse_kmer_bins(t.select(_line("stat_id", "mate_len", n("aln_start") % 50, n("aln_end") % 50, n("aligned_len"), F.col("stat_id") % 9, F.col("stat_id") % 3 - 1, sep=" ")))


def src_kmer_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of k-mer counts per read, parsed."""
    return _bins(spark, sf_dir)


def stat_kmer_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All k-mers, missing ones, those of either parent and those of the minor one, over all reads."""
    b = _bins(spark, sf_dir).withColumns({"minor": F.least("pat", "mat"), "hap": F.col("pat") + F.col("mat")})
    got = b.agg(F.sum(F.col("found") + F.col("missing")).alias("every"), F.sum("missing").alias("wrong"), F.sum("hap").alias("hap"), F.sum("minor").alias("hap_wrong"))
    return got.withColumns({"wrong_rate": F.round(F.col("wrong") / F.col("every"), 9), "hap_wrong_rate": F.round(F.col("hap_wrong") / F.col("hap"), 9)})


def src_id_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and names dumped and read again."""
    t = table(spark, sf_dir, "seq_reads").where("read_id is not null and read_name is not null").select("read_id", "read_name").distinct()
    path = _path(spark, "id2name")
    writers.save(writers.table_lines(t), path)
    return readers.parse_id_names(formats.lines(spark, path))


def sink_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of overlaps of at least 1,000 bases, passed on as they were (K4)."""
    t = table(spark, sf_dir, "read_overlaps").where(_whole(PAF)).select(*PAF, "tags").distinct()
    path = _path(spark, "all.paf")
    writers.save(t.select(_line(*PAF, "tags")), path)
    kept = readers.read_overlaps(spark, path, where=F.col("b_end") - F.col("b_start") >= 1000, keep_lines=True)
    return kept.select(F.md5("raw").alias("line"))


def sink_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in one folder per contig kind, read again (K5)."""
    path = _path(spark, "names")
    t = table(spark, sf_dir, "contigs").where("ctg_kind is not null and ctg_name is not null")
    writers.save_parts(t.select(F.col("ctg_kind").alias("part"), F.col("ctg_name").alias("value")), "part", path)
    return spark.read.text(path).select(F.col("part").cast("string").alias("part"), "value")


def sink_read_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read infos, reasons of filtered overlaps and selection scores as lines."""
    r = reads(spark, sf_dir).where("name is not null").select(F.lit("read").alias("kind"), F.concat_ws(" ", "name", "len").alias("x"))
    o = overlaps(spark, sf_dir).where("a_id = b_id or identity < 80")
    o = o.select(F.lit("overlap").alias("kind"), F.concat_ws(" ", "a_id", "b_id", F.when(F.col("a_id") == F.col("b_id"), "self").otherwise("identity"), "ol_id").alias("x"))
    return writers.table_lines(r.unionByName(o), sep=" ").select(F.col("value").alias("line"))


def read_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads whose names a list holds."""
    names = table(spark, sf_dir, "read_overlaps").select(F.col("tname").alias("name")).where("name is not null")
    return _named(spark, sf_dir).join(names, "name", "left_semi").select("name", F.length("seq").alias("bases"))


def ov_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with a corrected read on either side."""
    return pairs.with_named_read(overlaps(spark, sf_dir), table(spark, sf_dir, "seq_reads").where("sub_head like 'range=%'").select(F.col("read_id").alias("read"))).select("ol_id")


def read_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial numbers in place of names, in the order of names."""
    return selecting.numbered(_named(spark, sf_dir).select("name"), ["name"], "number")


QUERIES = {
    f.__name__: f
    for f in (
        src_fastq, src_read_list, src_ranges, src_m4, src_sam, src_overlap_list, src_vcf, src_inconsistent, src_read_variants, src_read_snps, src_contig_variants, src_kmers, src_bed, src_hic,
        src_kmer_bins, stat_kmer_errors, src_id_names, sink_raw_lines, sink_parts, sink_read_infos, read_subset, ov_subset, read_numbers,
    )
}

_NAMED = "nm AS (SELECT read_name AS name, max(sub_head) AS sub_head, max(seq) AS seq, max(quality) AS quality FROM seq_reads WHERE read_name IS NOT NULL GROUP BY read_name)"
_AL = f"al AS (SELECT DISTINCT aln_id, qid, tid, {', '.join(M4A)} FROM alignments WHERE {_whole(M4A)} AND qid IS NOT NULL AND tid IS NOT NULL)"
_BINS = """b AS (SELECT CAST(stat_id AS VARCHAR) AS read, mate_len AS len, CAST(coalesce(aln_start, 0) % 50 AS BIGINT) AS pat, CAST(coalesce(aln_end, 0) % 50 AS BIGINT) AS mat, CAST(coalesce(aligned_len, 0) AS BIGINT) AS found, stat_id % 9 AS missing, CAST(stat_id % 3 - 1 AS INTEGER) AS cls
    FROM (SELECT DISTINCT stat_id, mate_len, aln_start, aln_end, aligned_len FROM read_stats WHERE stat_id IS NOT NULL AND read_id IS NOT NULL AND mate_len IS NOT NULL))"""
_SAM_Q, _SAM_T = "(qend - qstart)", "(tend - tstart)"

SQL = {
    "src_fastq": f"WITH {_NAMED} SELECT name, nullif(trim(sub_head), '') AS sub_head, md5(coalesce(seq, '')) AS seq, md5(coalesce(quality, '')) AS quality FROM nm",
    "src_read_list": f"WITH {_NAMED} SELECT name, nullif(trim(sub_head), '') AS sub_head, CASE WHEN name IN (SELECT qname FROM read_overlaps WHERE qname IS NOT NULL) THEN md5(coalesce(seq, '')) END AS seq FROM nm",
    "src_ranges": f"WITH {_NAMED} SELECT name, CAST(regexp_extract(sub_head, 'range=([0-9]+)-([0-9]+)', 1) AS BIGINT) AS range_start, CAST(regexp_extract(sub_head, 'range=([0-9]+)-([0-9]+)', 2) AS BIGINT) AS range_end FROM nm WHERE regexp_matches(sub_head, 'range=[0-9]+-[0-9]+')",
    "src_m4": f"WITH {_AL} SELECT CAST(qid AS VARCHAR) AS a_name, 0 AS a_strand, qstart AS a_start, qend AS a_end, qlen AS a_len, CAST(tid AS VARCHAR) AS b_name, CASE WHEN qstrand = 1 THEN 1 - tstrand ELSE tstrand END AS b_strand, tstart AS b_start, tend AS b_end, tlen AS b_len, round(identity_pct, 3) AS identity FROM al",
    "src_sam": f"""WITH a AS (SELECT DISTINCT aln_id, {', '.join(M4A)} FROM alignments WHERE {" AND ".join(f"{c} IS NOT NULL" for c in M4A)}), h AS (SELECT ctg_name, CAST(max(ctg_len) AS INTEGER) AS n FROM contigs WHERE ctg_name IS NOT NULL GROUP BY ctg_name)
        SELECT qname || '/' || aln_id AS a_name, CASE WHEN qstrand <> tstrand THEN 1 ELSE 0 END AS a_strand, qstart AS a_start, qend AS a_end, qlen AS a_len, tname AS b_name, 0 AS b_strand, tstart AS b_start, tend AS b_end, n AS b_len,
            round((greatest({_SAM_Q}, {_SAM_T}) - (abs({_SAM_Q} - {_SAM_T}) + aln_id % 7)) * 100.0::DOUBLE / greatest({_SAM_Q}, {_SAM_T}), 6) AS identity,
            CAST(1 + (CASE WHEN {_SAM_Q} <> {_SAM_T} THEN 1 ELSE 0 END) + (CASE WHEN qstart > 0 THEN 1 ELSE 0 END) + (CASE WHEN qlen > qend THEN 1 ELSE 0 END) AS INTEGER) AS ops
        FROM a LEFT JOIN h ON ctg_name = tname WHERE {_SAM_Q} > 0 AND {_SAM_T} > 0 AND tname <> '*'""",
    "src_overlap_list": f"WITH {_AL} SELECT qname AS a_name, qstart AS a_start, qend AS a_end, tname AS b_name, tstart AS b_start, tend AS b_end FROM al WHERE qend - qstart >= 500 AND tlen > 10000 AND (aln_id % 2 = 1 OR tname LIKE 'ctg%')",
    "src_vcf": f"""WITH {_AL}, v AS (SELECT tname AS ctg, tstart AS pos, substr('ACGT', CAST(aln_id % 4 + 1 AS BIGINT), 1) AS r, substr('ACGT', CAST((aln_id + 1) % 4 + 1 AS BIGINT), 1) AS x, substr('ACGT', CAST((aln_id // 4 + 2) % 4 + 1 AS BIGINT), 1) AS y, aln_id FROM al WHERE aln_id % 5 <> 0)
        SELECT ctg, pos, least(x, y) AS base0, greatest(x, y) AS base1 FROM v WHERE aln_id % 3 = 0 UNION ALL SELECT ctg, pos, least(r, x), greatest(r, x) FROM v WHERE aln_id % 3 <> 0 AND aln_id % 7 <> 0 AND aln_id % 11 <> 0""",
    "src_inconsistent": f"WITH {OV} SELECT DISTINCT CAST(b_id AS VARCHAR) AS t, CAST(a_id AS VARCHAR) AS q, CASE WHEN a_strand <> b_strand THEN 1 ELSE 0 END AS strand, b_start - a_start AS \"offset\" FROM ov WHERE a_id <> b_id",
    "src_read_variants": f"WITH {_AL} SELECT DISTINCT tname AS ctg, qname AS read, qstrand AS direction, tstart - qstart AS \"offset\", tstart AS ctg_pos, CAST(aln_id % 5 - 1 AS INTEGER) AS base, qstart AS rd_pos FROM al",
    "src_read_snps": f"WITH {_AL} SELECT DISTINCT tname AS ctg, qname AS read, tstart AS pos, CAST(aln_id % 5 - 1 AS INTEGER) AS base FROM al WHERE aln_id % 5 <> 0",
    "src_contig_variants": f"""WITH {OV}, {READS}, {_CALLS}, {_HIST}, o AS (SELECT *, list_sort([{{'n': -n_a, 'b': 0}}, {{'n': -n_c, 'b': 1}}, {{'n': -n_g, 'b': 2}}, {{'n': -n_t, 'b': 3}}]) AS l FROM hist WHERE cov >= 3)
        SELECT CAST(ctg AS VARCHAR) AS ctg, CAST(pos AS INTEGER) AS pos, CAST(n_a AS INTEGER) AS n_a, CAST(n_c AS INTEGER) AS n_c, CAST(n_g AS INTEGER) AS n_g, CAST(n_t AS INTEGER) AS n_t, CAST(n_del AS INTEGER) AS n_del, CAST(cov AS INTEGER) AS cov, l[1].b AS var0, l[2].b AS var1 FROM o""",
    "src_kmers": f"WITH {READS} SELECT substr(seq, 1, 15) AS kmer, count(*) AS cnt FROM reads WHERE len >= 15 GROUP BY 1",
    "src_bed": "SELECT seq_name AS ctg, CAST(tile_start AS INTEGER) AS start, CAST(tile_end AS INTEGER) AS \"end\" FROM (SELECT DISTINCT seq_name, tile_start, tile_end, tile_no FROM contig_tiles WHERE seq_name IS NOT NULL AND tile_start IS NOT NULL AND tile_end IS NOT NULL)",
    "src_hic": f"""WITH {_AL}, m AS (SELECT *, unnest(CASE WHEN aln_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS mate FROM al)
        SELECT replace(qname, ',', '.') AS read, mate, replace(tname, '_', '.') AS ctg, qstart AS "offset", tstart AS pos, CAST(aln_id % 4 AS INTEGER) AS base FROM m UNION ALL SELECT replace(qname, ',', '.'), mate, replace(tname, '_', '.'), qstart, tend, CAST(aln_id % 3 AS INTEGER) FROM m""",
    "src_kmer_bins": f"WITH {_BINS} SELECT * FROM b",
    "stat_kmer_errors": f"""WITH {_BINS}, s AS (SELECT CAST(sum(found + missing) AS BIGINT) AS every, CAST(sum(missing) AS BIGINT) AS wrong, CAST(sum(pat + mat) AS BIGINT) AS hap, CAST(sum(least(pat, mat)) AS BIGINT) AS hap_wrong FROM b)
        SELECT *, round(wrong / every, 9) AS wrong_rate, round(hap_wrong / hap, 9) AS hap_wrong_rate FROM s""",
    "src_id_names": "SELECT DISTINCT read_id AS id, read_name AS name FROM seq_reads WHERE read_id IS NOT NULL AND read_name IS NOT NULL",
    "sink_raw_lines": f"SELECT md5({' || chr(9) || '.join(f'CAST({c} AS VARCHAR)' for c in PAF)} || coalesce(chr(9) || tags, '')) AS line FROM (SELECT DISTINCT {', '.join(PAF)}, tags FROM read_overlaps WHERE {_whole(PAF)}) WHERE tend - tstart >= 1000",
    "sink_parts": "SELECT ctg_kind AS part, ctg_name AS value FROM contigs WHERE ctg_kind IS NOT NULL AND ctg_name IS NOT NULL",
    "sink_read_infos": f"WITH {OV}, {READS} SELECT 'read ' || name || ' ' || len AS line FROM reads WHERE name IS NOT NULL UNION ALL SELECT 'overlap ' || a_id || ' ' || b_id || ' ' || CASE WHEN a_id = b_id THEN 'self' ELSE 'identity' END || ' ' || ol_id FROM ov WHERE a_id = b_id OR identity < 80",
    "read_subset": f"WITH {_NAMED} SELECT name, CAST(length(seq) AS INTEGER) AS bases FROM nm WHERE name IN (SELECT tname FROM read_overlaps WHERE tname IS NOT NULL)",
    "ov_subset": f"WITH {OV}, c AS (SELECT read_id FROM seq_reads WHERE sub_head LIKE 'range=%' AND read_id IS NOT NULL) SELECT ol_id FROM ov WHERE a_id IN (SELECT * FROM c) OR b_id IN (SELECT * FROM c)",
    "read_numbers": f"WITH {_NAMED} SELECT name, row_number() OVER (ORDER BY name) - 1 AS number FROM nm",
}
