"""Overlap geometry on hand-made and random rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandframe.functions import overlap as ov

SCHEMA = "ol_id long, a_id long, a_strand int, a_start int, a_end int, a_len int, b_id long, b_strand int, b_start int, b_end int, b_len int, identity double"


def frame(spark, rows):
    return spark.createDataFrame([(i, 1, 0, *r[:3], 2, r[3], *r[4:7], r[7] if len(r) > 7 else 95.0) for i, r in enumerate(rows)], SCHEMA)


# a_start a_end a_len, b_strand, b_start b_end b_len
CLASSES = [
    ((500, 1000, 1000, 0, 0, 500, 900), "left"), ((0, 500, 1000, 0, 400, 900, 900), "right"), ((0, 1000, 1000, 0, 0, 1000, 1000), "equal"), ((100, 900, 1000, 0, 0, 800, 800), "containing"), ((0, 800, 800, 0, 100, 900, 1000), "contained"), ((100, 500, 1000, 0, 100, 500, 900), "abnormal"),
    ((0, 500, 1000, 1, 0, 500, 900), "left"), ((500, 1000, 1000, 1, 400, 900, 900), "right"), ((0, 1000, 1000, 1, 0, 1000, 1000), "equal"), ((100, 900, 1000, 1, 0, 800, 800), "containing"), ((0, 800, 800, 1, 100, 900, 1000), "contained"), ((500, 1000, 1000, 1, 0, 500, 900), "abnormal"),
]


def shifted(row, d):
    """Ends that touch a read end moved inwards by d."""
    a0, a1, al, s, b0, b1, bl = row
    return (d if a0 == 0 else a0, al - d if a1 == al else a1, al, s, d if b0 == 0 else b0, bl - d if b1 == bl else b1, bl)


def test_all_classes_at_zero_err_and_beyond(spark):
    err = 20
    rows = [r for r, _ in CLASSES] + [shifted(r, err) for r, _ in CLASSES] + [shifted(r, err + 1) for r, _ in CLASSES]
    got = {r["ol_id"]: r for r in frame(spark, rows).select("ol_id", ov.location(0).alias("l0"), ov.location(err).alias("le")).collect()}
    n = len(CLASSES)
    for i, (_, want) in enumerate(CLASSES):
        assert got[i]["l0"] == want and got[i]["le"] == want
        assert got[n + i]["le"] == want
        assert got[2 * n + i]["le"] == "abnormal"


def random_rows(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        al, bl = rnd.randrange(1, 300), rnd.randrange(1, 300)
        a, b = sorted((rnd.choice([0, rnd.randrange(al)]), rnd.choice([al, rnd.randrange(1, al + 1)]))), sorted((rnd.choice([0, rnd.randrange(bl)]), rnd.choice([bl, rnd.randrange(1, bl + 1)])))
        if a[0] < a[1] and b[0] < b[1]:
            out.append((*a, al, rnd.randrange(2), *b, bl))
    return out


def test_seen_from_the_other_read(spark):
    rows = random_rows(600, 3)
    df = frame(spark, rows)
    here = {r[0]: r[1] for r in df.select("ol_id", ov.reverse_location(ov.location(5), ov.same_direction())).collect()}
    # the mirrored row: sides swapped, and both turned where the strands differ, so that a stays the reference
    swapped = [(r[4], r[5], r[6], r[3], r[0], r[1], r[2]) for r in rows]
    there = {r[0]: r[1] for r in frame(spark, swapped).select("ol_id", ov.location(5)).collect()}
    assert here == there


def test_extension_makes_ends_meet(spark):
    df = frame(spark, random_rows(600, 4)).withColumn("e", ov.extended(30))
    got = df.where("e is not null").select("*", *[F.col(f"e.{n}").alias(f"n_{n}") for n in ("a_start", "a_end", "b_start", "b_end")])
    snapped = got.drop("a_start", "a_end", "b_start", "b_end").withColumnsRenamed({f"n_{n}": n for n in ("a_start", "a_end", "b_start", "b_end")})
    assert got.count() > 50
    # snapped ends lie on a read end or moved with the other side
    assert snapped.where((F.col("a_start") != 0) & (F.col("b_start") != 0) & ov.same_direction() & (ov.location(0) != "abnormal") & (F.least("a_start", "b_start") > 0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 50), st.integers(1, 60), st.integers(0, 50), st.integers(1, 60), st.integers(-30, 200), st.booleans())
def test_mapping_at_and_beyond_the_ends(spark, a0, an, b0, bn, pos, same):
    a1, b1 = a0 + an, b0 + bn
    got = frame(spark, [(a0, a1, 300, 0 if same else 1, b0, b1, 300)]).select(ov.mapping(F.lit(pos), "a", "b"), ov.mapping(F.lit(b0), "a", "b"), ov.mapping(F.lit(b1), "a", "b")).first()
    if same:
        want = a0 + pos - b0 if pos < b0 else a0 + (pos - b0) * an // bn if pos < b1 else a1 + pos - b1
    else:
        want = a0 - (pos - b1) if pos > b1 else a0 + (b1 - pos) * an // bn if pos > b0 else a1 - (pos - b0)
    assert got[0] == want
    assert (got[1], got[2]) == ((a0, a1) if same else (a1, a0))


def valid(f, r, both=True, rep=0):
    a0, a1, al, s, b0, b1, bl, ident = r
    if al < f.l or bl < f.l or ident < f.i:
        return False
    v = max((a1 - a0 + b1 - b0) // 2, rep)
    if f.alr >= 0 and v < f.al and v < al * f.alr and v < bl * f.alr:
        return False
    if f.aal >= 0 and v >= f.aal or f.aalr >= 0 and (v >= al * f.aalr or v >= bl * f.aalr):
        return True
    if f.oh < 0 and f.ohr < 0:
        return True
    ao, bo = (min(x for x in (f.oh if f.oh >= 0 else None, int(n * f.ohr) if f.ohr >= 0 else None) if x is not None) + rep for n in (al, bl))
    left = a0 > ao and (b0 if s == 0 else bl - b1) > bo
    right = al - a1 > ao and (bl - b1 if s == 0 else b0) > bo
    return not (left or right) if both else not (left and right)


@pytest.mark.parametrize("rules", ["", "l=50:i=90", "al=80:alr=0.5", "oh=10:ohr=0.1", "oh=-1:ohr=0.05", "oh=5:ohr=-1:aal=60:aalr=-1", "oh=-1:ohr=-1:alr=-1:al=5000", "oh=0:ohr=0:aalr=0.3:aal=-1"])
def test_filter_rules(spark, rules):
    f = ov.Filter.parse(rules)
    rows = [(*r, random.Random(i).choice([80.0, 90.0, 95.0])) for i, r in enumerate(random_rows(300, 5))]
    df = frame(spark, rows)
    for both, rep in ((True, 0), (False, 0), (True, 15)):
        got = {r[0] for r in df.where(f.valid(F.lit(rep) if rep else None, both)).select("ol_id").collect()}
        assert got == {i for i, r in enumerate(rows) if valid(f, r, both, rep)}


def test_filter_text():
    f = ov.Filter.parse("i=90:al=1000:aalr=0.99")
    assert f.i == 90 and f.al == 1000 and f.aalr == pytest.approx(0.99, abs=1e-7) and f.aalr != 0.99
    assert ov.Filter.parse(str(ov.Filter(l=5, oh=-1))) == ov.Filter(l=5, oh=-1)
    with pytest.raises(ValueError):
        ov.Filter.parse("nope=1")


def test_filter_is_pushed_into_the_scan(spark, tmp_path):
    frame(spark, random_rows(50, 6)).write.parquet(str(tmp_path / "o"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = spark.read.parquet(str(tmp_path / "o")).where(ov.Filter.parse("l=50").valid()).select("ol_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(a_len,50)" in plan and "BatchEvalPython" not in plan
