"""A simulated genome goes in as overlaps and comes out as one contig."""

import random

import pytest

from strandframe.plans.assembly import Options, assemble
from tests_data import OVERLAP

FLIP = str.maketrans("ACGT", "TGCA")


def test_a_genome_comes_back(spark):
    rnd = random.Random(11)
    genome = "".join(rnd.choice("ACGT") for _ in range(6000))
    places = sorted((s := rnd.randrange(0, 5400), s + rnd.randrange(500, 700), rnd.randrange(2)) for _ in range(150)) + [(0, 600, 0), (5400, 6000, 1)]
    places = [(a, min(b, 6000), s) for a, b, s in places]
    reads = [(i, genome[a:b] if s == 0 else genome[a:b].translate(FLIP)[::-1]) for i, (a, b, s) in enumerate(places)]
    rows = []
    for i, (a0, a1, s) in enumerate(places):
        for j, (b0, b1, t) in enumerate(places[:i]):
            lo, hi = max(a0, b0), min(a1, b1)
            if hi - lo < 150:
                continue

            def on(x0, x1, strand):
                return (lo - x0, hi - x0, x1 - x0) if strand == 0 else (x1 - hi, x1 - lo, x1 - x0)

            rows.append((len(rows), i, 0, *on(a0, a1, s), j, int(s != t), *on(b0, b1, t), 99.0))
    out = assemble(spark.createDataFrame(rows, OVERLAP), spark.createDataFrame(reads, "read_id long, seq string"), Options(overlap="i=90:al=100", max_overhang=0, strategy="transitive:fuzz=10"))
    contigs = sorted((r["seq"] for r in out["contigs"].collect()), key=len)
    assert contigs[-1] in (genome, genome.translate(FLIP)[::-1])
    assert out["contained"].count() > 0 and out["reduced"].count() > 0


def test_options():
    o = Options.parse("# rules\noverlap = i=90:l=500\n\nmax_overhang=7\n")
    assert (o.overlap, o.max_overhang) == ("i=90:l=500", 7)
    with pytest.raises(ValueError):
        Options.parse("nope = 1")
