"""Shared spans against sets of windows."""

import random

import pytest

from strandframe.llm import spans

K = 40


def brute(records, k):
    own = {}
    for r, s in records:
        if r is not None and s is not None:
            for i in range(len(s) - k + 1):
                own.setdefault(s[i : i + k], set()).add(r)
    cov = {}
    for r, s in records:
        if r is not None and s is not None:
            for i in range(len(s) - k + 1):
                if len(own[s[i : i + k]]) > 1:
                    cov.setdefault(r, set()).update(range(i, i + k))
    out = []
    for r, c in cov.items():
        xs = sorted(c)
        starts = [x for x in xs if x - 1 not in c]
        ends = [x + 1 for x in xs if x + 1 not in c]
        out += [(r, a, b) for a, b in zip(starts, ends, strict=True)]
    return sorted(out)


def make(seed):
    rnd = random.Random(seed)
    genome = "".join(rnd.choice("ACGT") for _ in range(1500))
    records = []
    for i in range(60):
        a = rnd.randrange(0, 1300)
        s = list(genome[a : a + rnd.randrange(10, 400)])
        for _ in range(rnd.randrange(0, 4)):
            if s:
                s[rnd.randrange(len(s))] = rnd.choice("ACGTNacgt")
        records.append((i, "".join(s)))
    records += [records[3], records[3], (100, None), (None, genome), (101, ""), (102, "A" * 300), (103, "A" * 500), (104, "ACGT" * 60), (105, "N" * K), (106, "N" * (K - 1)), (107, "N" * (K + 5))]
    return records


@pytest.mark.parametrize("hot", [spans.HOT_LETTERS, 400])
def test_against_sets(spark, rows, hot):
    records = make(4)
    got = spans.shared_spans(spark.createDataFrame(records, "rid long, seq string"), "rid", "seq", K, hot_letters=hot)
    assert rows(got) == sorted(brute(records, K), key=repr)


def test_one_id_twice_is_one_record(spark, rows):
    df = spark.createDataFrame([(1, "ACGTT" * 30), (1, "ACGTT" * 30)], "rid long, seq string")
    assert rows(spans.shared_spans(df, "rid", "seq", K)) == []


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_long_records_are_cut_in_stretches(spark, rows, monkeypatch, chunk):
    import numpy as np

    monkeypatch.setattr(spans, "CHUNK", chunk)
    ids, at, base, lens = spans._chunks(np.array([1, 2]), np.array([0, K, 3 * K]), K)
    assert lens.min() >= K and (lens <= chunk + K - 1).all() and (lens - K + 1).sum() == 1 + K + 1
    kept = [(i, s) for i, s in make(4) if i is not None and s and len(s) >= K]
    data = "".join(s for _, s in kept).encode()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in kept]), pa.array([s for _, s in kept])], names=["id", "seq"])
    parts = [b for b in spans._cut_runs(K)(iter([batch]))]
    assert sum(b.column(3).to_pandas().sum() for b in parts) == len(data) - (K - 1) * len(kept)
    got = spans._settle(pa.Table.from_batches(parts).sort_by("bucket"), K)
    cov = {}
    for r, s, e in zip(*got, strict=True):
        cov.setdefault(int(r), set()).update(range(int(s), int(e)))
    want = {}
    for r, s, e in brute(kept, K):
        want.setdefault(r, set()).update(range(s, e))
    assert cov == want


def test_small_steps_of_the_bucket_reader(spark, rows, monkeypatch):
    monkeypatch.setattr(spans, "AT_A_TIME", 50)
    records = make(9)
    got = spans.shared_spans(spark.createDataFrame(records, "rid long, seq string"), "rid", "seq", K)
    assert rows(got) == sorted(brute(records, K), key=repr)


def test_colliding_hashes_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    real = spans._hashes
    records = make(6)[:40]
    data = "".join(s for _, s in records if len(s) >= K)
    kept = [(i, s) for i, s in records if len(s) >= K]
    lens = np.array([len(s) for _, s in kept])
    runs = spans._runs(np.array([i for i, _ in kept]), np.frombuffer(data.encode(), np.uint8), np.cumsum(lens) - lens, lens, np.zeros(len(lens), int), K)
    monkeypatch.setattr(spans, "_hashes", lambda x, n: real(x, n) % np.uint64(5))
    got = spans._settle(pa.Table.from_batches([runs]), K)
    cov = {}
    for r, s, e in zip(*got, strict=True):
        cov.setdefault(int(r), set()).update(range(int(s), int(e)))
    want = {}
    for r, s, e in brute(kept, K):
        want.setdefault(r, set()).update(range(s, e))
    assert cov == want


def test_empty_and_bounds(spark, rows):
    assert rows(spans.shared_spans(spark.createDataFrame([], "rid long, seq string"), "rid", "seq", K)) == []
    with pytest.raises(ValueError):
        spans.shared_spans(spark.createDataFrame([], "rid long, seq string"), "rid", "seq", 20)
