"""python -m strandframe.cli COMMAND ...: the tools as commands over files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import align, dna
from strandframe.functions.overlap import Filter, aligned_length
from strandframe.operators import calls, consensus, coverage, grouping, pairs, phasing, selecting, snps, stats
from strandframe.plans import assembly
from strandframe.plans.assembly import Options
from strandframe.session import cut
from strandframe.sources import formats, readers, writers


def _ids(df: DataFrame) -> DataFrame:
    """Overlaps with names as ids and a number per row, as the operators want them."""
    return df.withColumns({"a_id": F.col("a_name"), "b_id": F.col("b_name"), "ol_id": F.monotonically_increasing_id()})


def _names(spark: SparkSession, path: str) -> DataFrame:
    return formats.lines(spark, path).select(F.trim("value").alias("name")).where("name != ''")


def _with_len(spark: SparkSession, path: str) -> DataFrame:
    return readers.read_reads(spark, path).withColumn("len", F.length("seq"))


def check(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Reads with letters other than A, C, G, T and N."""
    return _with_len(spark, a.reads).where(~dna.is_dna(F.col("seq"))).select("name")


def n50(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Number, total, longest, shortest, N25, N50 and N75."""
    r = _with_len(spark, a.reads)
    return stats.length_summary(r, "len").select(F.explode(F.array(*[F.concat(F.lit(f"{c} "), F.col(c).cast("string")) for c in ("count", "total", "longest", "shortest")])).alias("value")).union(
        stats.n_values(r, "len").select(F.concat(F.lit("N"), F.col("percent").cast("string"), F.lit(" "), F.col("n_value").cast("string"), F.lit(" L "), F.col("l_value").cast("string")))
    )


def longest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The longest reads to a number of bases."""
    return writers.fasta(selecting.longest_to_total(_with_len(spark, a.reads), "len", a.bases))


def sample(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A seeded draw of reads of about a number of bases."""
    return writers.fasta(selecting.sample_to_total(_with_len(spark, a.reads), F.col("name"), "len", a.bases, a.seed))


def sub(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Reads with given names."""
    return writers.fasta(readers.read_reads(spark, a.reads).join(_names(spark, a.names), "name", "left_semi"))


def split(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Read names with their blocks of a number of bases (shard and block)."""
    return writers.table_lines(selecting.blocks(_with_len(spark, a.reads).select("name", "len"), "name", "len", a.bases), "name", "shard", "block")


def overlap_filter(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lines of overlaps that pass the rules, less those near inconsistent placements where a list is given."""
    ol = _ids(readers.read_overlaps(spark, a.overlaps, keep_lines=True)).where(Filter.parse(a.rules).valid())
    if a.inconsistent:
        ol = pairs.without_inconsistent(ol, readers.parse_inconsistent(formats.lines(spark, a.inconsistent)), a.threshold, a.rate, a.strict)
    return ol.select(F.col("raw").alias("value"))


def overlap_sub(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lines of overlaps with a named read on either side."""
    ol, n = readers.read_overlaps(spark, a.overlaps, keep_lines=True), _names(spark, a.names).distinct()
    flagged = ol.join(n.select(F.col("name").alias("a_name"), F.lit(True).alias("_a")), "a_name", "left").join(n.select(F.col("name").alias("b_name"), F.lit(True).alias("_b")), "b_name", "left")
    return flagged.where("_a or _b").select(F.col("raw").alias("value"))


def accuracy(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Matches of every read's best record over aligned and over all bases."""
    ol = _ids(readers.read_overlaps(spark, a.overlaps)).withColumn("n", aligned_length()).withColumn("m", (F.col("n") * F.col("identity") / 100).cast("long"))
    return writers.table_lines(stats.mapping_accuracy(grouping.best_per_group(ol.drop("cigar"), ["a_name"], [F.col("m")], "ol_id"), "m", "n", "a_len"))


def depth(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Stretches of constant coverage of every target."""
    return writers.table_lines(coverage.segments(readers.read_overlaps(spark, a.overlaps), ["b_name"], F.col("b_start"), F.col("b_end"), F.col("b_len")))


def kmer_bin(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Reads with their k-mers in two sets and their class."""
    pat, mat = (readers.parse_kmers(formats.lines(spark, p)) for p in (a.pat, a.mat))
    first = pat.first()
    k = len(first["kmer"]) if first else 21
    rows = dna.explode_kmers(readers.read_reads(spark, a.reads).select(F.col("name").alias("read"), F.upper("seq").alias("s")), "s", k)
    rows = rows.select("read", dna.canonical(F.col("kmer")).alias("kmer")).distinct()
    sets = (s.select(dna.canonical(F.col("kmer")).alias("kmer")) for s in (pat, mat))
    return writers.table_lines(snps.kmer_classes(rows, *sets))


def hamming(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The share of the minor class over all lines of k-mer counts, in percent."""
    return writers.table_lines(stats.hamming_error(readers.parse_kmer_bins(formats.lines(spark, a.bins)), [], "pat", "mat"))


def _placed(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Overlaps with ids by name and both sequences."""
    ol = _ids(readers.read_overlaps(spark, a.overlaps, keep_lines=True))
    seqs = readers.read_reads(spark, a.reads).select(F.col("name").alias("read_id"), F.upper("seq").alias("seq"))
    return pairs.with_sequences(ol, seqs)


def refine(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lines of overlaps whose stretches, aligned again, reach a quality and pass the rules."""
    got = _placed(spark, a).where("a_seq is not null and b_seq is not null").where(Filter.parse(a.rules).valid())
    turned = (F.col("a_strand") != F.col("b_strand")).cast("int")
    x, y = dna.slice_of(F.col("a_seq"), F.col("a_start"), F.col("a_end"), turned), dna.slice_of(F.col("b_seq"), F.col("b_start"), F.col("b_end"), F.lit(0))
    rows = got.select("raw", x.alias("x"), y.alias("y")).withColumn("d", align.distance_udf(F.col("x"), F.col("y")))
    return rows.where(align.quality_from(F.col("d"), F.length("x"), F.length("y")) >= a.quality).select(F.col("raw").alias("value"))


def purge(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Lines of reads on contigs without those of a read that a number of the contig's own reads are inconsistent with."""
    ol = _ids(readers.read_overlaps(spark, a.overlaps, keep_lines=True))
    names = readers.parse_id_names(formats.lines(spark, a.names)) if a.names else None
    members = readers.parse_tiles(formats.lines(spark, a.tiles)).select(F.col("ctg"), F.explode(F.array("from_read", "to_read")).alias("read")).distinct()
    if names is not None:
        members = members.join(names.select(F.col("id").cast("string").alias("read"), "name"), "read").select("ctg", F.col("name").alias("read"))
    listed = readers.parse_inconsistent(formats.lines(spark, a.inconsistent)).select("t", "q")
    return pairs.without_opposite(ol, members, listed, a.count).select(F.col("raw").alias("value"))


def correct(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Consensus of every read that others cover, as FASTA with its range on the read."""
    seqs = selecting.numbered(readers.read_reads(spark, a.reads).select("name", "seq"), ["name"], "read_id").select("name", "seq", F.col("read_id").cast("long").alias("read_id"))
    ol = readers.read_overlaps(spark, a.overlaps).withColumn("ol_id", F.monotonically_increasing_id())
    for x in "ab":
        ol = ol.join(seqs.select(F.col("name").alias(f"{x}_name"), F.col("read_id").alias(f"{x}_id")), f"{x}_name")
    best = grouping.best_per_group(ol.withColumn("n", aligned_length()).drop("cigar"), ["a_id", "b_id"], [F.col("n")], "ol_id")
    out = consensus.correct_reads(best, seqs.select("read_id", "seq"), least=a.least).where("seq != ''")
    head = F.concat(F.lit("range="), F.col("range_start").cast("string"), F.lit("-"), F.col("range_end").cast("string"))
    return writers.fasta(out.join(seqs.select(F.col("read_id").alias("read"), "name"), "read").select("name", head.alias("sub_head"), "seq"))


def haplotype(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Inconsistent placements of reads, from their base calls on one another at sites where they differ."""
    got = _placed(spark, a).where("a_id != b_id and a_seq is not null and b_seq is not null")
    turned = (F.col("a_strand") != F.col("b_strand")).cast("int")
    placed = got.select(
        F.col("b_id").alias("ctg"), F.col("a_id").alias("read"), F.col("b_start").alias("start"), F.col("b_end").alias("end"), turned.alias("turned"), F.col("a_start").alias("q_start"),
        dna.slice_of(F.col("b_seq"), F.col("b_start"), F.col("b_end"), F.lit(0)).alias("t"), dna.slice_of(F.col("a_seq"), F.col("a_start"), F.col("a_end"), turned).alias("q"),
    )
    # names travel as numbers through the calls
    ids = cut(selecting.numbered(placed.select(F.col("ctg").alias("name")).union(placed.select("read")).distinct(), ["name"], "id").withColumn("id", F.col("id").cast("long")))
    for x in ("ctg", "read"):
        placed = placed.join(ids.select(F.col("name").alias(x), F.col("id").alias(f"{x}_id")), x).drop(x).withColumnRenamed(f"{x}_id", x)
    placed = cut(placed)
    made = cut(calls.between_flanks(placed).distinct())
    sites = cut(snps.confirmed(snps.base_histogram(made), a.least, a.most, a.second, a.second))
    phased = phasing.phase(snps.alleles_of_reads(calls.at_sites(made, placed, sites), sites), options=phasing.Options.parse(a.rules))
    where = placed.select("ctg", "read", F.col("turned").alias("direction"), (F.col("start") - F.col("q_start")).alias("offset"))
    out = phasing.placements(phased, where)
    for x in "tq":
        out = out.join(ids.select(F.col("id").alias(x), F.col("name").alias(f"{x}_name")), x).drop(x).withColumnRenamed(f"{x}_name", x)
    return writers.inconsistent(out)


def assemble(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Contigs as FASTA; --stage writes another table of the run as lines instead."""
    seqs = readers.read_reads(spark, a.reads).select(F.col("name").alias("read_id"), "seq")
    options = Options.parse("\n".join(r[0] for r in formats.lines(spark, a.options).collect()) if a.options else "")
    out = assembly.assemble(_ids(readers.read_overlaps(spark, a.overlaps)).drop("cigar"), seqs, options)
    if a.stage != "contigs":
        return writers.table_lines(out[a.stage])
    return writers.fasta(out["contigs"].select(F.col("ctg").alias("name"), F.lit("").alias("sub_head"), "seq"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandframe")
    subs = p.add_subparsers(dest="command", required=True)

    def add(name: str, run, *positional: str) -> argparse.ArgumentParser:
        c = subs.add_parser(name, help=run.__doc__)
        for x in positional:
            c.add_argument(x)
        c.add_argument("output")
        c.set_defaults(run=run)
        return c

    add("check", check, "reads")
    add("n50", n50, "reads")
    for name, run in (("longest", longest), ("split", split)):
        add(name, run, "reads").add_argument("--bases", type=int, required=True)
    c = add("sample", sample, "reads")
    c.add_argument("--bases", type=int, required=True)
    c.add_argument("--seed", type=int, default=0)
    add("sub", sub, "reads", "names")
    c = add("filter", overlap_filter, "overlaps")
    c.add_argument("--rules", default="")
    c.add_argument("--inconsistent")
    c.add_argument("--threshold", type=int, default=1000)
    c.add_argument("--rate", type=float, default=0.05)
    c.add_argument("--strict", action="store_true")
    add("sub-overlaps", overlap_sub, "overlaps", "names")
    add("accuracy", accuracy, "overlaps")
    add("depth", depth, "overlaps")
    add("kmer-bin", kmer_bin, "reads", "pat", "mat")
    add("hamming", hamming, "bins")
    c = add("refine", refine, "reads", "overlaps")
    c.add_argument("--rules", default="")
    c.add_argument("--quality", type=float, default=90.0)
    c = add("purge", purge, "overlaps", "tiles", "inconsistent")
    c.add_argument("--names")
    c.add_argument("--count", type=int, default=2)
    add("correct", correct, "reads", "overlaps").add_argument("--least", type=int, default=2)
    c = add("haplotype", haplotype, "reads", "overlaps")
    for name, value in (("least", 4), ("most", 400), ("second", 2)):
        c.add_argument(f"--{name}", type=int, default=value)
    c.add_argument("--rules", default="")
    c = add("assemble", assemble, "reads", "overlaps")
    c.add_argument("--options")
    c.add_argument("--stage", default="contigs", choices=("kept", "contained", "edges", "reduced", "paths", "tiles", "contigs"))
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("strandframe").getOrCreate()
    out = a.run(spark, a)
    writers.save(out if "value" in out.columns else writers.table_lines(out), a.output)


if __name__ == "__main__":
    main(sys.argv[1:])
