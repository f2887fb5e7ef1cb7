"""Long exact spans shared between records, by super-k-mers.

Every window of ``k`` letters has a minimiser, the m-mer of least hash in it. Runs of windows with the same minimiser
travel as one packed string (two bits a letter where only A, C, G, T occur) to the minimiser's bucket. Equal windows have
equal minimisers, so each bucket can be settled alone: its windows are sorted by a 64-bit hash, equal neighbours are
compared letter by letter, and a window is shared if two record ids hold it. Buckets with more letters than one task
should hold are cut further: their windows go one by one through a distributed grouping instead, by hash first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import broadcast_if_small, cut, is_empty, skew_join

#: Letters of a minimiser.
M = 16
#: Letters of one minimiser's strings from which its bucket is settled by the distributed grouping.
HOT_LETTERS = 6_000_000
#: Letters of strings settled at a time within a task; whole buckets, so up to HOT_LETTERS more.
AT_A_TIME = 3_000_000
#: Windows of a record, and letters of records, cut at a time.
CHUNK = 1_000_000
#: Longest run of windows in one string.
LONGEST_RUN = 4_096

_MULT = 0x9E3779B97F4A7C15
_CODE = np.full(256, 255, np.uint8)
_CODE[[65, 67, 71, 84]] = np.arange(4)
_LETTER = np.frombuffer(b"ACGT", np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hashes(letters: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n letters from each position on (shorter array by n - 1), by doubling."""
    unit = _mix(letters.astype(np.uint64) + np.uint64(1))
    power = {1: _MULT}
    out, done, size = None, 0, 1
    while True:
        if n & size:
            if out is None:
                out = unit
            else:
                keep = len(letters) - (done + size) + 1
                out = out[:keep] * np.uint64(power[size]) + unit[done : done + keep]
            done += size
        if done == n:
            return _mix(out[: len(letters) - n + 1])
        unit = unit[: len(unit) - size] * np.uint64(power[size]) + unit[size:]
        power[size * 2] = power[size] ** 2 % (1 << 64)
        size *= 2


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All indexes starts[i] .. starts[i] + lens[i] - 1 one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


_RUN = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("raw", pa.bool_()), ("letters", pa.large_binary())])


def _runs(ids: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray, base: np.ndarray, k: int) -> pa.RecordBatch:
    """The super-k-mers of the stretches data[starts : starts + lens], each of k letters at least; they begin at ``base`` in
    their records."""
    least = _sliding_min(_hashes(data, M), k - M + 1)
    # the windows of all records, record by record
    per = lens - k + 1
    at = _ragged(starts, per)
    key = least[at]
    fresh = np.zeros(len(at), bool)
    fresh[np.cumsum(per) - per] = True
    fresh[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    fresh |= (np.arange(len(at)) - first[run]) % LONGEST_RUN == 0
    first = np.flatnonzero(fresh)
    windows = np.diff(np.append(first, len(at)))
    record = np.repeat(np.arange(len(ids)), per)[first]
    begin, size = at[first], windows + k - 1
    code = _CODE[data]
    bad = np.concatenate([[0], np.cumsum(code == 255)])
    raw = bad[begin + size] > bad[begin]
    quad = np.concatenate([code & 3, np.zeros(8, np.uint8)])
    packed = (quad[:-3] << 6) | (quad[1:-2] << 4) | (quad[2:-1] << 2) | quad[3:]
    # byte i of a packed string is packed[begin + 4 i]
    nbytes = np.where(raw, size, (size + 3) // 4)
    ends = np.cumsum(nbytes)
    step = np.where(raw, 1, 4)
    inner = np.arange(ends[-1]) - np.repeat(ends - nbytes, nbytes)
    where = np.repeat(begin, nbytes) + inner * np.repeat(step, nbytes)
    out = packed[where]
    if raw.any():
        mask = np.repeat(raw, nbytes)
        out[mask] = data[where[mask]]
    strings = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays(
        [pa.array(key[first].view(np.int64)), pa.array(ids[record]), pa.array((begin - starts[record] + base[record]).astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(raw), strings], schema=_RUN
    )


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a binary or string array without nulls."""
    col = col.cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def _chunks(ids: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, place in the data, place in the record, letters) of stretches of at most CHUNK windows of the records."""
    starts, lens = offsets[:-1], np.diff(offsets)
    n = -(-(lens - k + 1) // CHUNK)
    row = np.repeat(np.arange(len(ids)), n)
    base = _ragged(np.zeros(len(ids), np.int64), n) * CHUNK
    return ids[row], starts[row] + base, base, np.minimum(lens[row] - base, CHUNK + k - 1)


def _cut_runs(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _bytes_of(batch.column(1))
            ids, at, base, lens = _chunks(batch.column(0).to_numpy(zero_copy_only=False), offsets, k)
            # some MB at a time, as the arrays of hashes are eight times as large
            step = np.cumsum(lens) // (2 * CHUNK)
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(step)) + 1):
                a, n = at[part], lens[part]
                letters = data[_ragged(a, n)]
                yield _runs(ids[part], letters, np.cumsum(n) - n, n, base[part], k)

    return run


def _unpack(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all strings, start of each, its number of letters)."""
    data, offsets = _bytes_of(t.column("letters").combine_chunks())
    windows, raw = t.column("windows").to_numpy(), t.column("raw").to_numpy(zero_copy_only=False)
    size = windows.astype(np.int64) + k - 1
    ends = np.cumsum(size)
    out = np.empty(ends[-1], np.uint8)
    for kind in (False, True):
        rows = np.flatnonzero(raw == kind)
        if not len(rows):
            continue
        inner = _ragged(np.zeros(len(rows), np.int64), size[rows])
        base = np.repeat(offsets[rows], size[rows])
        to = _ragged((ends - size)[rows], size[rows])
        out[to] = data[base + inner] if kind else _LETTER[(data[base + inner // 4] >> (6 - 2 * (inner % 4)).astype(np.uint8)) & 3]
    return out, ends - size, size


def _reached_twice(t: pa.Table) -> pa.Table:
    """The rows of the buckets, which come one after the other, that several records reach; others share nothing."""
    key, who = t.column("bucket").to_numpy(), t.column("id").to_numpy()
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    several = np.minimum.reduceat(who, edge) != np.maximum.reduceat(who, edge)
    return t.filter(pa.array(np.repeat(several, np.diff(np.append(edge, len(key))))))


def _settle(t: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(id, span start, span end) of the runs of shared windows of whole buckets."""
    letters, starts, _ = _unpack(t, k)
    windows = t.column("windows").to_numpy().astype(np.int64)
    ids, begin = t.column("id").to_numpy(), t.column("start").to_numpy().astype(np.int64)
    at = _ragged(starts, windows)
    row = np.repeat(np.arange(len(windows)), windows)
    h = _hashes(letters, k)[at]
    order = np.argsort(h)
    hs = h[order]
    same = hs[1:] == hs[:-1]
    whole = np.ndarray((len(letters) - k + 1,), dtype=f"V{k}", buffer=letters, strides=(1,))
    pairs = np.flatnonzero(same)
    wrong = []
    for i in range(0, len(pairs), 100_000):
        p = pairs[i : i + 100_000]
        unequal = whole[at[order[p]]] != whole[at[order[p + 1]]]
        wrong.extend(p[unequal].tolist())
    group = np.concatenate([[0], np.cumsum(~same)])
    if wrong:  # different windows of one hash: number them by their letters
        extra = group[-1] + 1
        for g in np.unique(group[wrong]):
            seen: dict[bytes, int] = {}
            for i in np.flatnonzero(group == g):
                group[i] = seen.setdefault(whole[at[order[i]]].tobytes(), extra + len(seen))
            extra += len(seen)
        again = np.argsort(group, kind="stable")
        order, group = order[again], group[again]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    who = ids[row[order]]
    shared_group = np.minimum.reduceat(who, edge) != np.maximum.reduceat(who, edge)
    shared = np.zeros(len(at), bool)
    shared[order] = np.repeat(shared_group, np.diff(np.append(edge, len(order))))
    if not shared.any():
        return None
    new_row = np.concatenate([[True], row[1:] != row[:-1]])
    start = shared & (new_row | ~np.concatenate([[False], shared[:-1]]))
    stop = shared & np.concatenate([new_row[1:] | ~shared[1:], [True]])
    first, last = np.flatnonzero(start), np.flatnonzero(stop)
    r = row[first]
    offset = begin[r] - starts[r]
    return ids[r], at[first] + offset, at[last] + offset + k


_SPAN = pa.schema([("id", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def _settle_buckets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def out(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(rows)
            t = _reached_twice(t) if t.num_rows else t
            if t.num_rows and (r := _settle(t, k)):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in r], schema=_SPAN)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            count = np.cumsum(batch.column(3).to_numpy().astype(np.int64) + k - 1)
            borders = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != keys[0]:
                borders = np.concatenate([[0], borders])
            from_row = from_count = 0
            for b in borders:
                upto = int(count[b - 1]) if b else 0
                if n + upto - from_count >= AT_A_TIME:
                    held.append(batch.slice(from_row, b - from_row))
                    yield from out(held)
                    held, n, from_row, from_count = [], 0, int(b), upto
            held.append(batch.slice(from_row))
            n += int(count[-1]) - from_count
        if held:
            yield from out(held)

    return run


def _window_hashes(k: int):
    """(hash, id, run, place in the run) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for i in range(0, t.num_rows, 1024):
                part = t.slice(i, 1024)
                letters, starts, _ = _unpack(part, k)
                windows = part.column("windows").to_numpy().astype(np.int64)
                at = _ragged(starts, windows)
                row = np.repeat(np.arange(len(windows)), windows)
                hashes = _hashes(letters, k)[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(part.column("id").to_numpy()[row]), pa.array(part.column("run").to_numpy()[row]), pa.array((at - starts[row]).astype(np.int32))], names=["hash", "id", "run", "o"])

    return run


def _take_windows(k: int):
    """(id, start, letters) of the windows at the places ``at`` of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for i in range(0, t.num_rows, 256):
                part = t.slice(i, 256).combine_chunks()
                letters, starts, _ = _unpack(part, k)
                places = part.column("at").combine_chunks()
                count = np.diff(places.offsets.to_numpy())
                o, row = places.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(part.num_rows), count)
                ids, pos = part.column("id").to_numpy()[row], part.column("start").to_numpy().astype(np.int64)[row] + o
                for lo in range(0, len(o), 20_000):
                    cutout = letters[(starts[row] + o)[lo : lo + 20_000, None] + np.arange(k)]
                    text = pa.Array.from_buffers(pa.binary(), len(cutout), [None, pa.py_buffer((np.arange(len(cutout) + 1) * k).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(cutout))])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[lo : lo + 20_000]), pa.array(pos[lo : lo + 20_000]), text], names=["id", "s", "window"])

    return run


def _hot_windows(runs: DataFrame, k: int) -> DataFrame:
    """(id, s, window) of the windows of hot buckets that other ids may hold: hashes, ids and places are shuffled, and letters
    only of windows whose hash two ids have. Equal hashes are compared by their letters afterwards."""
    runs = cut(runs.distinct().withColumn("run", F.monotonically_increasing_id()))
    places = cut(runs.mapInArrow(_window_hashes(k), "hash long, id long, run long, o int"))
    several = cut(places.groupBy("hash").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("hash"))
    # a run has at most LONGEST_RUN windows
    wanted = skew_join(places, several, ["hash"]).groupBy("run").agg(F.collect_list("o").alias("at"))
    return cut(runs.join(wanted, "run").mapInArrow(_take_windows(k), "id long, s long, window binary").distinct())


def merge(spans: DataFrame) -> DataFrame:
    """Maximal runs (id, s, e) of the union of spans; touching spans make one run."""
    w = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.distinct().withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int")).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("id", "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def shared_spans(records: DataFrame, id_col: str, seq_col: str, k: int, hot_letters: int = HOT_LETTERS) -> DataFrame:
    """(id, s, e): maximal runs of letters that lie in k or more consecutive letters that another id holds as well.

    Letters are compared as stored (UTF-8 bytes; positions count bytes), on the given strand only. Rows with the same id
    are one record. Null ids, null sequences and sequences shorter than ``k`` share nothing. k must be at least 32."""
    if k < 2 * M:
        raise ValueError(f"k must be at least {2 * M}")
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(seq_col).alias("seq")).where(F.col("id").isNotNull() & (F.octet_length("seq") >= k))
    runs = cut(rows.mapInArrow(_cut_runs(k), "bucket long, id long, start int, windows int, raw boolean, letters binary"))
    hot = cut(runs.groupBy("bucket").agg(F.sum(F.col("windows") + k - 1).alias("n")).where(F.col("n") > hot_letters).select("bucket"))
    settle = "id long, s long, e long"
    if is_empty(hot):
        return merge(runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle_buckets(k), settle))
    marked = broadcast_if_small(hot)
    usual = runs.join(marked, "bucket", "left_anti").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_settle_buckets(k), settle)
    single = _hot_windows(runs.join(marked, "bucket", "left_semi"), k)
    held = cut(single.groupBy("window").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("window"))
    return merge(usual.unionByName(skew_join(single, held, ["window"]).select("id", "s", (F.col("s") + k).alias("e"))))
