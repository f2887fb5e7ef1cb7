"""Readers and writers on small files and on stored lines."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandframe.sources import formats, readers, writers


def frame(spark, *lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_fasta(spark, rows, tmp_path):
    (tmp_path / "a.fasta").write_text(">r1 range=3-90\nACGT\nAC\n>r2\n\n>r3 x y\r\nTT\r\n")
    got = readers.read_reads(spark, str(tmp_path / "a.fasta"))
    assert rows(got) == [("r1", "range=3-90", "ACGTAC", None), ("r2", None, "", None), ("r3", "x y", "TT", None)]
    assert rows(readers.read_ranges(spark, str(tmp_path / "a.fasta"))) == [("r1", 3, 90)]
    out = str(tmp_path / "o")
    writers.save(writers.fasta(got), out)
    assert rows(readers.read_fasta(spark, out)) == rows(got)


def test_fastq_over_many_blocks(spark, rows, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        text = "".join(f"@r{i} s{i}\nACGT\n+\n@!I{i % 10}\n" for i in range(50))
        (tmp_path / "a.fq").write_text(text)
        with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
            f.write("@z\nA\n+z\nI\n")
        (tmp_path / "all.fofn").write_text("a.fq\n\nmore.txt\n")
        (tmp_path / "more.txt").write_text(str(tmp_path / "b.fastq.gz") + "\n")
        got = rows(readers.read_reads(spark, str(tmp_path / "all.fofn")))
        assert got == sorted([(f"r{i}", f"s{i}", "ACGT", f"@!I{i % 10}") for i in range(50)] + [("z", None, "A", "I")], key=repr)
        (tmp_path / "bad.fq").write_text("@r\nA\nx\nI\n")
        with pytest.raises(Exception, match="not a FASTQ record"):
            readers.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_sequences_only_for_wanted_names(spark, rows, tmp_path):
    (tmp_path / "a.fa").write_text(">r1\nAC\n>r2\nGT\n")
    got = readers.read_reads(spark, str(tmp_path / "a.fa"), names=spark.createDataFrame([("r2",)], "name string"))
    assert rows(got, "name", "seq") == [("r1", None), ("r2", "GT")]


def test_types():
    assert formats.file_type("x/y.FA.gz".lower(), formats.READ_TYPES) == "fasta"
    assert formats.file_type("reads", formats.READ_TYPES, "fasta") == "fasta"
    with pytest.raises(ValueError):
        formats.file_type("x.bam", formats.OVERLAP_TYPES)


def test_paf_and_m4a_round_trip(spark, rows, tmp_path):
    paf = frame(spark, "q\t100\t0\t50\t-\tt\t200\t10\t60\t45\t50\t60", "q\t100\t0\t50\t+\tt\t200\t10\t60\t45\t50\t60\trl:i:30", "q\t100\t0\t50\t+\tt\t200\t10\t60\t45\t50\t0\ttp:A:P\trl:i:30\tcg:Z:20M5I25M", "short\tline")
    got = readers.parse_paf(paf)
    assert [r["identity"] for r in got.orderBy("replen", F.size("cigar")).collect()] == [90.0, 15 * 100 / 20, 90.0]
    assert rows(got.where(F.size("cigar") > 0), "replen", "cigar") == [(30, [(20, "M"), (5, "I"), (25, "M")])]
    out = str(tmp_path / "o.m4a")
    writers.save(writers.m4a(got), out)
    again = readers.parse_m4a(formats.lines(spark, out))
    keep = [c for c in readers.OVERLAP if c not in ("replen", "cigar")]
    assert rows(again.select(*keep)) == rows(got.select(*keep))
    assert rows(writers.paf(got.limit(1)))[0][0].split("\t")[9] == "45"


def test_m4_turns_strands(spark, rows):
    got = readers.parse_m4(frame(spark, "1 2 99.5 -50 1 0 50 100 0 10 60 200", "1 2 99.5 -50 0 0 50 100 1 10 60 200"))
    assert rows(got, "a_name", "a_strand", "b_strand") == [("1", 0, 1), ("1", 0, 1)]


def test_sam(spark, rows):
    got = readers.parse_sam(frame(spark, "@HD\tVN:1", "@SQ\tSN:c1\tLN:900", "r1\t16\tc1\t11\t60\t5S20M2D10I30M7H\t*\t0\t0\tA\tI\tNM:i:12", "r2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI", "r3\t0\tc1\t1\t60\t10=2X\t*\t0\t0\tA\tI"))
    assert rows(got, "a_name", "a_strand", "a_start", "a_end", "a_len", "b_start", "b_end", "b_len") == [("r1", 1, 7, 67, 72, 10, 62, 900), ("r3", 0, 0, 12, 12, 0, 12, 900)]
    assert [round(x[0], 4) for x in rows(got, "identity")] == [round(50 / 62 * 100, 4), round(1000 / 12, 4)]


def test_lines_are_passed_on_as_they_are(spark, rows, tmp_path):
    (tmp_path / "a.paf").write_text("q\t100\t0\t50\t-\tt\t200\t10\t60\t45\t50\t60\tx:y\nq\t9\t0\t9\t-\tt\t200\t10\t19\t9\t9\t60\n")
    got = readers.read_overlaps(spark, str(tmp_path / "a.paf"), where=F.col("a_len") >= 50, keep_lines=True)
    assert rows(got, "raw") == [("q\t100\t0\t50\t-\tt\t200\t10\t60\t45\t50\t60\tx:y",)]


def test_vcf(spark, rows):
    base = "c\t{}\t.\t{}\t{}\t9\t{}\t.\tGT:DP\t{}:7"
    got = readers.parse_vcf(frame(spark, "#h", base.format(5, "T", "A", "PASS", "0/1"), base.format(6, "T", "A,C", "PASS", "1|2"), base.format(7, "T", "A", "LowQual", "0/1"), base.format(8, "TT", "A", "PASS", "0/1"), base.format(9, "T", "A", "PASS", "1/1")))
    assert rows(got) == [("c", 4, "A", "T"), ("c", 5, "A", "C")]


def test_phasing_lines_round_trip(spark, rows):
    got = readers.parse_inconsistent(frame(spark, "t1:q1|0|5,q2|1|-7", "t2:-1|0|0", "junk"))
    assert rows(got) == [("t1", "q1", 0, 5), ("t1", "q2", 1, -7)]
    assert rows(readers.parse_inconsistent(writers.inconsistent(got))) == rows(got)
    rv = readers.parse_read_variants(frame(spark, "c r 0 15 10|2|3 20|-1|9"))
    assert rows(rv) == [("c", "r", 0, 15, 10, 2, 3), ("c", "r", 0, 15, 20, -1, 9)]
    assert rows(readers.parse_read_variants(writers.read_variants(rv))) == rows(rv)
    assert rows(readers.parse_snps_in_reads(frame(spark, "c r 0 15 10|2|3 20|-1|9"))) == [("c", "r", 10, 2)]


def test_small_tables(spark, rows):
    assert rows(readers.parse_contig_variants(frame(spark, "c 5 1 9 9 0 0 0 0 0 2 21 1", "c 6 1 1 1 1 0 0 0 0 0 4 0")), "pos", "var0", "var1") == [(5, 1, 2)]
    assert rows(readers.parse_tiles(frame(spark, "ctg1 edge=12:B~13:E more", "x"))) == [("ctg1", "12", "B", "13", "E", "more")]
    assert rows(readers.parse_kmers(frame(spark, "ACG 5", "TTT"))) == [("ACG", 5), ("TTT", 1)]
    assert rows(readers.parse_bed(frame(spark, "c\t5\t9", "c 1 2 3", "c x y"))) == [("c", 5, 9)]
    assert rows(readers.parse_kmer_bins(frame(spark, "r 100 5 6 7 8 -1"))) == [("r", 100, 5, 6, 7, 8, -1)]
    assert rows(readers.parse_id_names(frame(spark, "3,abc", "4 d"))) == [(3, "abc"), (4, "d")]
    assert rows(readers.parse_hic(frame(spark, "r,c1_5_10-2;12-3|c2_7_"))) == [("r", 0, "c1", 5, 10, 2), ("r", 0, "c1", 5, 12, 3)]
    edge = "a:B b:E 5 9 100 99.5 active"
    assert rows(readers.parse_edges(frame(spark, edge))) == [("a:B", "b:E", 5, 9, 100, 99.5, "active")]
    assert rows(writers.table_lines(readers.parse_edges(frame(spark, edge)))) == [(edge,)]


def test_parts(spark, rows, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("z", 1)], "value string, grp int")
    writers.save_parts(df, "grp", str(tmp_path / "o"))
    assert rows(spark.read.text(str(tmp_path / "o" / "grp=1"))) == [("x",), ("z",)]
