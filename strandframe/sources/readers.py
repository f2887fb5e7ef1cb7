"""Readers: each has a parser over a frame of lines (column value), so it also runs on streams and stored lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import cigar as cg
from strandframe.sources.formats import OVERLAP_TYPES, READ_TYPES, expand, lines


def _parts(sep: str = r"\s+") -> Column:
    return F.split(F.trim("value"), sep)


def _at(parts: Column, i: int, kind: str = "string") -> Column:
    return F.get(parts, F.lit(i)).try_cast(kind)


# -- reads


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, sub_head, seq, quality (null). Records begin with > at the start of a line; a sequence may be empty or run
    over several lines. Files are split at records, so one file is read by many tasks."""
    raw = spark.read.text(paths, lineSep="\n>").select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("value")).where("trim(value) != ''")
    return parse_fasta(raw)


def parse_fasta(records: DataFrame) -> DataFrame:
    """From records (value) without their leading >."""
    rows = F.split("value", "\n", 2)
    head = F.split(F.trim(F.get(rows, F.lit(0))), r"\s+", 2)
    seq = F.regexp_replace(F.coalesce(F.get(rows, F.lit(1)), F.lit("")), r"\s+", "")
    return records.select(_at(head, 0).alias("name"), F.nullif(F.trim(F.coalesce(F.get(head, F.lit(1)), F.lit(""))), F.lit("")).alias("sub_head"), seq.alias("seq"), F.lit(None).cast("string").alias("quality"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, sub_head, seq, quality of records of four lines. A record whose third line does not begin with + is an error.

    Lines are numbered from the lines of the blocks before them in their file, so a file is read by many tasks; the four
    lines of a record then meet by their number."""
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("id"))
    from pyspark.sql import Window

    blocks = raw.groupBy("f", "b").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = raw.join(blocks.select("f", "b", "first", before.alias("before")), ["f", "b"]).withColumn("k", F.col("id") - F.col("first") + F.col("before"))
    value = F.regexp_replace("value", "\r$", "")

    def line(i: int) -> Column:
        return F.max(F.when(F.col("k") % 4 == i, value))

    rec = numbered.groupBy("f", F.expr("k div 4").alias("r")).agg(*[line(i).alias(f"l{i}") for i in range(4)]).where("trim(l0) != ''")
    bad = ~(F.startswith("l0", F.lit("@")) & F.startswith(F.coalesce("l2", F.lit("")), F.lit("+")))
    head = F.split(F.trim(F.substring("l0", 2, 1 << 30)), r"\s+", 2)
    name = F.when(bad, F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.col("l0")))).otherwise(_at(head, 0))
    return rec.select(name.alias("name"), F.nullif(F.coalesce(F.get(head, F.lit(1)), F.lit("")), F.lit("")).alias("sub_head"), F.coalesce("l1", F.lit("")).alias("seq"), F.coalesce("l3", F.lit("")).alias("quality"))


def read_reads(spark: SparkSession, path: str, kind: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Reads of a file, or of a list of files; FASTA unless the suffix says otherwise. With ``names`` (name) all names stay
    but only these have sequences."""
    got = [(p, kind) for p in [path]] if kind else expand(spark, path, READ_TYPES, "fasta")
    if not got:
        raise ValueError(f"no read files in {path}")
    frames = []
    for k, reader in (("fasta", read_fasta), ("fastq", read_fastq)):
        if paths := [p for p, t in got if t == k]:
            frames.append(reader(spark, paths))
    out = reduce(DataFrame.unionByName, frames)
    if names is None:
        return out
    wanted = names.select("name").distinct().withColumn("_w", F.lit(True))
    return out.join(wanted, "name", "left").withColumn("seq", F.when(F.col("_w"), F.col("seq"))).withColumn("quality", F.when(F.col("_w"), F.col("quality"))).drop("_w")


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(name, range_start, range_end) of corrected reads, from ``range=start-end`` in their heads."""
    got = read_fasta(spark, path)
    return got.select("name", _match("sub_head", r"range=(\d+)-(\d+)", 1, "long").alias("range_start"), _match("sub_head", r"range=(\d+)-(\d+)", 2, "long").alias("range_end")).where("range_start is not null")


def _raw(df: DataFrame) -> list[str]:
    """The line itself where the frame carries it along."""
    return [c for c in df.columns if c == "raw"]


def _match(col: str, pattern: str, group: int, kind: str = "string") -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(F.col(col), F.lit("")), pattern, group), F.lit("")).try_cast(kind)


# -- overlaps

OVERLAP = ("a_name", "a_strand", "a_start", "a_end", "a_len", "b_name", "b_strand", "b_start", "b_end", "b_len", "identity", "replen", "cigar")


def parse_m4(raw: DataFrame) -> DataFrame:
    """Names are numbers from 1 on; strands are turned so that a is forward."""
    p = _parts()
    rows = raw.where(F.size(p) >= 12)
    a_rev = _at(p, 4, "int") == 1
    flip = F.when(a_rev, 1 - _at(p, 8, "int")).otherwise(_at(p, 8, "int"))
    return rows.select(
        _at(p, 0).alias("a_name"), F.lit(0).alias("a_strand"), _at(p, 5, "int").alias("a_start"), _at(p, 6, "int").alias("a_end"), _at(p, 7, "int").alias("a_len"),
        _at(p, 1).alias("b_name"), flip.alias("b_strand"), _at(p, 9, "int").alias("b_start"), _at(p, 10, "int").alias("b_end"), _at(p, 11, "int").alias("b_len"),
        _at(p, 2, "double").alias("identity"), F.lit(0).alias("replen"), cg.parse(F.lit("")).alias("cigar"), *_raw(raw),
    )


def parse_m4a(raw: DataFrame) -> DataFrame:
    """Named reads, strands as they are, an optional CIGAR in the thirteenth column."""
    p = _parts()
    rows = raw.where(F.size(p) >= 12)
    return rows.select(
        _at(p, 0).alias("a_name"), _at(p, 4, "int").alias("a_strand"), _at(p, 5, "int").alias("a_start"), _at(p, 6, "int").alias("a_end"), _at(p, 7, "int").alias("a_len"),
        _at(p, 1).alias("b_name"), _at(p, 8, "int").alias("b_strand"), _at(p, 9, "int").alias("b_start"), _at(p, 10, "int").alias("b_end"), _at(p, 11, "int").alias("b_len"),
        _at(p, 2, "double").alias("identity"), F.lit(0).alias("replen"), cg.parse(_at(p, 12)).alias("cigar"), *_raw(raw),
    )


def parse_paf(raw: DataFrame) -> DataFrame:
    """Identity is matches over aligned length in percent. Of the tags, ``cg:Z:`` is the CIGAR and ``rl:i:`` the length of
    repeats; without a CIGAR the repeats are taken out of matches and length alike."""
    p = _parts("\t")
    rows = raw.where(F.size(p) >= 12)
    rep = F.coalesce(_match("value", r"\trl:i:(\d+)", 1, "int"), F.lit(0))
    text = _match("value", r"\tcg:Z:(\S+)", 1)
    match, length = _at(p, 9, "double"), _at(p, 10, "double")
    adjust = (rep > 0) & text.isNull() & (length > rep)
    identity = F.when(adjust, (match - F.least(match, rep)) * 100 / (length - rep)).otherwise(match * 100 / F.nullif(length, F.lit(0.0)))
    return rows.select(
        _at(p, 0).alias("a_name"), F.lit(0).alias("a_strand"), _at(p, 2, "int").alias("a_start"), _at(p, 3, "int").alias("a_end"), _at(p, 1, "int").alias("a_len"),
        _at(p, 5).alias("b_name"), F.when(_at(p, 4) == "-", 1).otherwise(0).alias("b_strand"), _at(p, 7, "int").alias("b_start"), _at(p, 8, "int").alias("b_end"), _at(p, 6, "int").alias("b_len"),
        identity.alias("identity"), rep.alias("replen"), cg.parse(text).alias("cigar"), *_raw(raw),
    )


def sam_targets(raw: DataFrame) -> DataFrame:
    """(b_name, b_len) of the header; as many rows as targets."""
    head = raw.where(F.startswith("value", F.lit("@SQ")))
    return head.select(_match("value", r"\tSN:(\S+)", 1).alias("b_name"), _match("value", r"\tLN:(\d+)", 1, "int").alias("b_len"))


def parse_sam(raw: DataFrame) -> DataFrame:
    """Flag 16 is the strand of a, positions come from POS, CIGAR and clips, target lengths from the header; rows without a
    target are left out. Identity is that of matching columns where the CIGAR tells = from X, else from NM, else 100."""
    p = _parts("\t")
    rows = raw.where(~F.startswith("value", F.lit("@"))).where(F.size(p) >= 11).where(_at(p, 2) != "*").withColumn("cigar", cg.parse(_at(p, 5)))
    d = F.col("cigar")
    rev = _at(p, 1, "int").bitwiseAND(F.lit(16)) != 0
    q, t, clip = cg.query_length(d), cg.target_length(d), cg.clips(d)
    a_start = F.when(rev, clip.tail).otherwise(clip.lead)
    start = _at(p, 3, "int") - 1
    columns = cg.bases(d, "MID=X")
    wrong = F.when(cg.bases(d, "=X") > 0, columns - cg.bases(d, "=")).otherwise(F.coalesce(_match("value", r"\tNM:i:(\d+)", 1, "int"), F.lit(0)))
    out = rows.select(
        _at(p, 0).alias("a_name"), rev.cast("int").alias("a_strand"), a_start.alias("a_start"), (a_start + q).alias("a_end"), (clip.lead + q + clip.tail).alias("a_len"),
        _at(p, 2).alias("b_name"), F.lit(0).alias("b_strand"), start.alias("b_start"), (start + t).alias("b_end"),
        ((columns - wrong) * 100.0 / F.nullif(columns, F.lit(0))).alias("identity"), F.lit(0).alias("replen"), "cigar", *_raw(raw),
    )
    return out.join(sam_targets(raw).groupBy("b_name").agg(F.max("b_len").alias("b_len")), "b_name", "left").select(*OVERLAP, *_raw(raw))


PARSERS = {"m4": parse_m4, "m4a": parse_m4a, "paf": parse_paf, "sam": parse_sam}


def read_overlaps(spark: SparkSession, path: str, kind: str | None = None, where: Column | None = None, keep_lines: bool = False) -> DataFrame:
    """Overlaps of a file or a list of files; ``where`` is evaluated in the scan's stage. ``keep_lines`` adds ``raw`` for
    filters that pass lines on as they are."""
    got = [(path, kind)] if kind else expand(spark, path, OVERLAP_TYPES)
    frames = []
    for k in PARSERS:
        if paths := [p for p, t in got if t == k]:
            raw = lines(spark, paths)
            frames.append(PARSERS[k](raw.withColumn("raw", F.col("value")) if keep_lines else raw))
    if not frames:
        raise ValueError(f"no overlap files in {path}")
    out = reduce(DataFrame.unionByName, frames)
    return out if where is None else out.where(where)


# -- variants, phasing, graphs, k-mers


def parse_vcf(raw: DataFrame) -> DataFrame:
    """(ctg, pos, base0, base1) of passed heterozygous single-base calls: genotype 0/1 with single REF and ALT, or 1/2 with
    two single ALTs. Positions from 0 on, bases in order."""
    p = _parts("\t")
    rows = raw.where(~F.startswith("value", F.lit("#"))).where((F.size(p) >= 10) & (_at(p, 6) == "PASS"))
    gt = F.regexp_replace(F.regexp_extract(_at(p, 9), r"^([^:]*)", 1), r"\|", "/")
    ref, alt = _at(p, 3), F.split(_at(p, 4), ",")
    one, two = (gt.isin("0/1", "1/0") & (F.length(ref) == 1) & (F.size(alt) == 1) & (F.length(F.get(alt, F.lit(0))) == 1)), (gt.isin("1/2", "2/1") & (F.size(alt) == 2) & (F.length(F.get(alt, F.lit(0))) == 1) & (F.length(F.get(alt, F.lit(1))) == 1))
    x, y = F.when(one, ref).otherwise(F.get(alt, F.lit(0))), F.when(one, F.get(alt, F.lit(0))).otherwise(F.get(alt, F.lit(1)))
    return rows.where(one | two).select(_at(p, 0).alias("ctg"), (_at(p, 1, "int") - 1).alias("pos"), F.least(x, y).alias("base0"), F.greatest(x, y).alias("base1"))


def parse_inconsistent(raw: DataFrame) -> DataFrame:
    """(t, q, strand, offset) of lines ``t:q|strand|offset,...``; a query of -1 was removed."""
    head = F.split("value", ":", 2)
    items = F.explode(F.split(F.get(head, F.lit(1)), ","))
    rows = raw.where(F.contains("value", F.lit(":"))).select(F.trim(F.get(head, F.lit(0))).alias("t"), items.alias("i"))
    f = F.split("i", r"\|")
    return rows.where(F.size(f) == 3).select("t", F.trim(_at(f, 0)).alias("q"), _at(f, 1, "int").alias("strand"), _at(f, 2, "int").alias("offset")).where("q != '-1'")


def parse_read_variants(raw: DataFrame) -> DataFrame:
    """(ctg, read, direction, offset, ctg_pos, base, rd_pos) of lines ``ctg read direction offset pos|base|pos...``."""
    p = _parts()
    rows = raw.where(F.size(p) > 4).select(_at(p, 0).alias("ctg"), _at(p, 1).alias("read"), _at(p, 2, "int").alias("direction"), _at(p, 3, "int").alias("offset"), F.explode(F.slice(p, 5, 1 << 30)).alias("i"))
    f = F.split("i", r"\|")
    return rows.select("ctg", "read", "direction", "offset", _at(f, 0, "int").alias("ctg_pos"), _at(f, 1, "int").alias("base"), _at(f, 2, "int").alias("rd_pos"))


def parse_snps_in_reads(raw: DataFrame) -> DataFrame:
    """(ctg, read, pos, base) of the same lines, without calls of -1."""
    return parse_read_variants(raw).where("base != -1").select("ctg", "read", F.col("ctg_pos").alias("pos"), "base")


def parse_contig_variants(raw: DataFrame) -> DataFrame:
    """(ctg, pos, n_a .. n_t, ins_a .. ins_t, n_del, cov, var0, var1) of valid rows of 13 columns; the vars are the two
    commonest bases, equal counts by base."""
    p = _parts()
    names = ("n_a", "n_c", "n_g", "n_t", "ins_a", "ins_c", "ins_g", "ins_t", "n_del", "cov")
    rows = raw.where((F.size(p) == 13) & (_at(p, 12) == "1")).select(_at(p, 0).alias("ctg"), _at(p, 1, "int").alias("pos"), *[_at(p, i + 2, "int").alias(n) for i, n in enumerate(names)])
    top = F.reverse(F.array_sort(F.array(*[F.struct(F.col(n).alias("n"), F.lit(3 - i).alias("o"), F.lit(i).alias("b")) for i, n in enumerate(names[:4])])))
    return rows.withColumn("var0", top[0].b).withColumn("var1", top[1].b)


def parse_tiles(raw: DataFrame) -> DataFrame:
    """(ctg, from_read, from_end, to_read, to_end, rest) of lines ``ctg edge=read:B~read:E ...``."""
    pattern = r"^(\S+)\s+edge=([^:\s]+):([BE])~([^:\s]+):([BE])\s*(.*)$"
    rows = raw.where(F.col("value").rlike(pattern))
    return rows.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(("ctg", "from_read", "from_end", "to_read", "to_end", "rest"))])


def parse_kmers(raw: DataFrame) -> DataFrame:
    """(kmer, cnt); k is the length of the first row and others of another length are an error."""
    p = _parts()
    return raw.where(F.size(p) >= 1).where("trim(value) != ''").select(_at(p, 0).alias("kmer"), F.coalesce(_at(p, 1, "long"), F.lit(1).cast("long")).alias("cnt"))


def parse_bed(raw: DataFrame) -> DataFrame:
    """(ctg, start, end) of rows of three columns."""
    p = _parts()
    return raw.where(F.size(p) == 3).select(_at(p, 0).alias("ctg"), _at(p, 1, "int").alias("start"), _at(p, 2, "int").alias("end")).where("start is not null and end is not null")


def parse_hic(raw: DataFrame) -> DataFrame:
    """(read, mate, ctg, offset, pos, base) of lines ``read,placements|placements``: a placement is ``ctg_offset_alleles``,
    alleles are ``pos-base`` joined by ``-`` pairs of ``;``."""
    head = F.split("value", ",", 2)
    rows = raw.where(F.contains("value", F.lit(","))).select(_at(head, 0).alias("read"), F.posexplode(F.split(F.get(head, F.lit(1)), r"\|")).alias("mate", "m"))
    places = rows.select("read", "mate", F.explode(F.split("m", ",")).alias("x")).where("x != ''")
    f = F.split("x", "_")
    per = places.select("read", "mate", _at(f, 0).alias("ctg"), _at(f, 1, "int").alias("offset"), F.explode(F.split(F.coalesce(_at(f, 2), F.lit("")), ";")).alias("al"))
    g = F.split("al", "-")
    return per.where("al != ''").select("read", "mate", "ctg", "offset", _at(g, 0, "int").alias("pos"), _at(g, 1, "int").alias("base"))


def parse_kmer_bins(raw: DataFrame) -> DataFrame:
    """(read, len, pat, mat, found, missing, cls) of rows of seven columns."""
    p = _parts()
    names = (("len", "int"), ("pat", "long"), ("mat", "long"), ("found", "long"), ("missing", "long"), ("cls", "int"))
    return raw.where(F.size(p) == 7).select(_at(p, 0).alias("read"), *[_at(p, i + 1, k).alias(n) for i, (n, k) in enumerate(names)])


def parse_id_names(raw: DataFrame) -> DataFrame:
    """(id, name) of rows ``id name`` or ``id,name``."""
    p = F.split(F.trim("value"), r"[\s,]+")
    return raw.where(F.size(p) >= 2).select(_at(p, 0, "long").alias("id"), _at(p, 1).alias("name")).where("id is not null")


def parse_edges(raw: DataFrame) -> DataFrame:
    """(in_node, out_node, tile_start, tile_end, score, identity, reduce_type) of dumped graph edges."""
    p = _parts()
    kinds = ("string", "string", "int", "int", "int", "double", "string")
    names = ("in_node", "out_node", "tile_start", "tile_end", "score", "identity", "reduce_type")
    return raw.where(F.size(p) >= 7).select(*[_at(p, i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))])
