import random

from strandframe import cli
from strandframe.operators.selecting import neighbour_groups


def run(spark, tmp_path, *args):
    out = str(tmp_path / "out")
    cli.main([*args[:1], *map(str, args[1:]), out] if "--" not in " ".join(map(str, args)) else [*map(str, args), out], spark)
    return sorted(r[0] for r in spark.read.text(out).collect())


def test_read_tools(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a\nACGT\n>b\nACGTACGT\n>c\nAXX\n")
    (tmp_path / "n.txt").write_text("b\n")
    assert run(spark, tmp_path, "check", tmp_path / "r.fa") == ["c"]
    assert run(spark, tmp_path, "n50", tmp_path / "r.fa") == ["N25 8 L 1", "N50 8 L 1", "N75 4 L 2", "count 3", "longest 8", "shortest 3", "total 15"]
    assert run(spark, tmp_path, "longest", "--bases", 9, tmp_path / "r.fa") == [">a ", ">b ", "ACGT", "ACGTACGT"]
    assert run(spark, tmp_path, "sub", tmp_path / "r.fa", tmp_path / "n.txt") == [">b ", "ACGTACGT"]
    assert len(run(spark, tmp_path, "split", "--bases", 5, tmp_path / "r.fa")) == 3
    assert len(run(spark, tmp_path, "sample", "--bases", 1000, tmp_path / "r.fa")) == 6


def test_overlap_tools(spark, tmp_path):
    line = "{}\t1000\t{}\t1000\t+\t{}\t900\t0\t500\t490\t500\t60"
    good, other = line.format("a", 500, "b"), line.format("c", 400, "d")
    (tmp_path / "o.paf").write_text(f"{good}\n{other}\n{line.format('e', 500, 'e')}\n")
    (tmp_path / "n.txt").write_text("d\n")
    (tmp_path / "i.txt").write_text("a:b|0|500\n")
    assert run(spark, tmp_path, "filter", "--rules", "oh=10", tmp_path / "o.paf") == sorted([good, other])
    assert run(spark, tmp_path, "filter", "--inconsistent", tmp_path / "i.txt", "--threshold", 10, tmp_path / "o.paf") == [other]
    assert run(spark, tmp_path, "sub-overlaps", tmp_path / "o.paf", tmp_path / "n.txt") == [other]
    assert run(spark, tmp_path, "depth", tmp_path / "o.paf")[0] == "b 0 500 1"
    assert len(run(spark, tmp_path, "accuracy", tmp_path / "o.paf")) == 1


def test_kmer_bins(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">a\nAACAA\n>b\nCCGCC\n")
    (tmp_path / "p.txt").write_text("AAC 5\nACA 1\n")
    (tmp_path / "m.txt").write_text("CCG 5\nCGC 2\n")
    assert run(spark, tmp_path, "kmer-bin", tmp_path / "r.fa", tmp_path / "p.txt", tmp_path / "m.txt") == ["a 2 0 1", "b 0 2 -1"]
    (tmp_path / "b.txt").write_text("r 9 3 1 0 0 1\nr2 9 0 4 0 0 -1\n")
    assert run(spark, tmp_path, "hamming", tmp_path / "b.txt") == ["12.5"]


def test_groups_of_neighbours():
    got = neighbour_groups({"a": ["b", "c"], "b": ["a"], "c": ["a"], "d": []}, {"a": 5, "b": 4, "c": 3, "d": 20}, 10)
    assert got == [["d"], ["a", "b"], ["c"]]


FLIP = str.maketrans("ACGT", "TGCA")


def genome_files(tmp_path, seed=11, copies=1):
    """Reads of a random genome, or of two that differ at every 90th base, and their overlaps as PAF."""
    rnd = random.Random(seed)
    first = "".join(rnd.choice("ACGT") for _ in range(3000))
    genomes = [first, "".join(c.translate(str.maketrans("ACGT", "CATG")) if i % 90 == 45 else c for i, c in enumerate(first))][:copies]
    places = [(g, s := rnd.randrange(0, 2400), s + rnd.randrange(500, 600), rnd.randrange(2)) for g in range(copies) for _ in range(60)] + [(0, 0, 600, 0), (0, 2400, 3000, 1)]
    reads = []
    for g, a, b, s in places:
        seq = genomes[g][a:b]
        reads.append(seq if s == 0 else seq.translate(FLIP)[::-1])
    lines = []
    for i, (_, a0, a1, s) in enumerate(places):
        for j, (_, b0, b1, t) in enumerate(places[:i]):
            lo, hi = max(a0, b0), min(a1, b1)
            if hi - lo >= 150:
                x = (lo - a0, hi - a0) if s == 0 else (a1 - hi, a1 - lo)
                y = (lo - b0, hi - b0) if t == 0 else (b1 - hi, b1 - lo)
                n = hi - lo
                lines.append("\t".join(map(str, (f"q{i}", a1 - a0, *x, "+" if s == t else "-", f"q{j}", b1 - b0, *y, n, n, 60))))
    (tmp_path / "g.fa").write_text("".join(f">q{i}\n{r}\n" for i, r in enumerate(reads)))
    (tmp_path / "g.paf").write_text("\n".join(lines) + "\n")
    return first, places, lines


def test_assemble_and_correct(spark, tmp_path):
    genome, _, lines = genome_files(tmp_path)
    (tmp_path / "o.txt").write_text("overlap = i=90:al=100\nmax_overhang = 0\nstrategy = transitive:fuzz=10|quality|best|extend|phase|bridge|\n")
    got = run(spark, tmp_path, "assemble", "--options", tmp_path / "o.txt", tmp_path / "g.fa", tmp_path / "g.paf")
    longest = max(got, key=len)
    assert longest in genome or longest.translate(FLIP)[::-1] in genome and len(longest) > 2000
    assert run(spark, tmp_path, "assemble", "--options", tmp_path / "o.txt", "--stage", "contained", tmp_path / "g.fa", tmp_path / "g.paf")
    assert len(run(spark, tmp_path, "refine", "--quality", "99", tmp_path / "g.fa", tmp_path / "g.paf")) == len(lines)
    fixed = run(spark, tmp_path, "correct", tmp_path / "g.fa", tmp_path / "g.paf")
    seqs = [x for x in fixed if not x.startswith(">")]
    assert len(seqs) > 20 and all(x in genome or x.translate(FLIP)[::-1] in genome for x in seqs)


def test_haplotype_and_purge(spark, tmp_path):
    _, places, _ = genome_files(tmp_path, copies=2)
    got = run(spark, tmp_path, "haplotype", "--least", "3", "--second", "2", "--rules", "icc=2:sc=2", tmp_path / "g.fa", tmp_path / "g.paf")
    side = {f"q{i}": g for i, (g, *_) in enumerate(places)}
    pairs = [(line.split(":")[0], x.split("|")[0]) for line in got for x in line.split(":")[1].split(",")]
    assert len(pairs) > 50 and all(side[t] != side[q] for t, q in pairs)
    (tmp_path / "t.txt").write_text("c1 edge=a:B~b:E\nc1 edge=b:E~c:B\n")
    (tmp_path / "i.txt").write_text("a:x|0|5,y|0|7\nx:b|0|9\n")
    row = "{}\t100\t0\t100\t+\tc1\t900\t0\t100\t99\t100\t60"
    (tmp_path / "m.paf").write_text("\n".join(row.format(n) for n in "xyz") + "\n")
    assert run(spark, tmp_path, "purge", "--count", "2", tmp_path / "m.paf", tmp_path / "t.txt", tmp_path / "i.txt") == [row.format("y"), row.format("z")]
