import random

import pytest
from pyspark.sql import functions as F

from strandframe.llm import mixture

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 5), ("absent", 0.1, 2)]


def frames(spark, seed=1):
    rnd = random.Random(seed)
    docs = [(i, rnd.choice("aaab"), rnd.randrange(0, 60)) for i in range(3000)] + [(5000 + i, "c", 40) for i in range(20)]
    docs += [(6000, None, 10), (6001, "untargeted", 10), (6002, "a", None), (6003, "b", 0)]
    return docs, spark.createDataFrame(docs, "doc_id long, source string, tokens int"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_caps_and_every_document(spark):
    docs, df, targets = frames(spark)
    drawn = mixture.draw(df, targets)
    got = {r["doc_id"]: r for r in drawn.collect()}
    assert set(got) == {d for d, _, _ in docs}
    cap = {s: m for s, _, m in TARGETS}
    for d, s, n in docs:
        r = got[d]
        assert 0 <= r["uses"] <= (cap.get(s, 0) if n else 0)
    shares = {r["source"]: r for r in mixture.shares(drawn, targets).collect()}
    for s, share, _ in TARGETS[:3]:
        assert abs(shares[s]["reached_share"] - share / 0.9) < 0.005
    assert shares["absent"]["used_tokens"] == shares[None]["used_tokens"] == shares["untargeted"]["used_tokens"] == 0
    # the mixture is as large as the scarcest source allows
    assert all(got[d]["uses"] == 5 for d, s, _ in docs if s == "c")


def test_total_larger_than_the_caps(spark):
    _, df, targets = frames(spark)
    shares = {r["source"]: r["reached_share"] for r in mixture.shares(mixture.draw(df, targets, total=10**9), targets).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9


def test_running_sums(spark):
    docs, df, _ = frames(spark)
    out = mixture.running(df.where("tokens is not null and source is not null"), "source", "doc_id", "tokens", slices=7).collect()
    for s in "ab":
        own = sorted((r["before"], r["before"] + r["tokens"]) for r in out if r["source"] == s)
        assert own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


def test_times_invert_the_integrated_weight(spark):
    for g in (-1.0, -0.5, 0.0, 0.3, 1.0):
        got = spark.range(0, 11).select((F.col("id") / 10).alias("y"), mixture.when(F.col("id") / 10, F.lit(g)).alias("t")).collect()
        for r in got:
            assert abs((1 - g) * r["t"] + g * r["t"] ** 2 - r["y"]) < 1e-9


def test_positions_follow_the_schedule(spark):
    docs, df, targets = frames(spark)
    wanted = {"a": -0.2, "b": 0.6}
    drawn = mixture.draw(df, targets, wanted=wanted)
    out = mixture.positions(drawn)
    rows = out.collect()
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    uses = {r["doc_id"]: r["uses"] for r in drawn.collect()}
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r["use_no"])
    assert {d: sorted(v) for d, v in seen.items()} == {d: list(range(1, u + 1)) for d, u in uses.items() if u}
    size = {d: n for d, _, n in docs}
    b = [(r["position"], size[r["doc_id"]]) for r in rows if r["source"] == "b"]
    early = sum(n for p, n in b if p <= 0.5) / sum(n for _, n in b)
    share = {"a": 0.5 / 0.9, "b": 0.3 / 0.9, "c": 0.1 / 0.9}
    g = mixture.tilts(share, wanted)["b"]
    assert abs(early - ((1 - g) * 0.5 + g * 0.25)) < 0.02


def test_shares_follow_the_schedule_over_time(spark):
    _, df, targets = frames(spark)
    got = mixture.shares_by_time(mixture.draw(df, targets, wanted={"a": -0.2, "b": 0.6}), parts=5).collect()
    assert len(got) == 15
    for r in got:
        assert abs(r["wanted_share"] - r["reached_share"]) < 0.02
    b = {r["part"]: r["reached_share"] for r in got if r["source"] == "b"}
    assert b[0] < b[2] < b[4]


def test_tilts_must_leave_weights_positive():
    with pytest.raises(ValueError):
        mixture.tilts({"a": 0.5, "b": 0.5}, {"a": 2.5})


def test_empty(spark):
    _, df, targets = frames(spark)
    none = df.where("false")
    assert mixture.draw(none, targets).count() == 0
    assert mixture.positions(mixture.draw(none, targets)).count() == 0
    assert mixture.draw(df, targets.where("false")).where("uses > 0").count() == 0
