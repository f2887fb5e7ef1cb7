"""Base calls of reads on the reads or contigs they are aligned to, from their sequences.

``walk`` follows a CIGAR; ``between_flanks`` needs none: a base is called where its two flanks stand once in either
stretch. Both run in Arrow batches, one alignment at a time and a few numpy passes over it; their calls are counted and
joined as tables. ``at_sites`` adds the misses: a site under an alignment that made no call there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes of a call: bases 0 to 3, an insertion before the position as 4 plus its first base, a deletion, no call.
INSERTION, DELETION, MISS = 4, 8, -1
#: Letters on either side of a base that have to match.
FLANK = 8
#: Positions in a bucket of the join of alignments with sites.
BUCKET = 1024

_CODE = np.full(256, 4, np.int64)
_CODE[[65, 67, 71, 84]] = _CODE[[97, 99, 103, 116]] = np.arange(4)
_OPS = re.compile(r"(\d+)([MIDNSHP=X])")
_CALLS = pa.schema([("ctg", pa.int64()), ("pos", pa.int64()), ("read", pa.int64()), ("base", pa.int32())])


def _codes(text: str) -> np.ndarray:
    """Bases as 0 to 3, any other letter as 4."""
    return _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def _merged(cigar: str) -> list[tuple[int, str]]:
    """The operations, equal and unequal letters put together as matches."""
    out: list[tuple[int, str]] = []
    for n, op in _OPS.findall(cigar):
        op = "M" if op in "=X" else op
        if out and out[-1][1] == op:
            out[-1] = (out[-1][0] + int(n), op)
        else:
            out.append((int(n), op))
    return out


def _walked(cigar: str, q: np.ndarray, t: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in t, call) of one alignment of the whole of q to the whole of t."""
    at_q = at_t = 0
    half = match // 2
    pos: list[np.ndarray] = []
    call: list[np.ndarray] = []
    for n, op in _merged(cigar):
        if op == "M":
            if n >= match:
                same = (q[at_q : at_q + n] == t[at_t : at_t + n]) & (t[at_t : at_t + n] < 4)
                upto = np.concatenate([[0], np.cumsum(same)])
                i = np.arange(half, n - half)
                around = upto[i + half + 1] - upto[i - half] - same[i]
                i = i[(around == 2 * half) & (q[at_q + i] < 4)]
                pos.append(at_t + i)
                call.append(q[at_q + i])
            at_q, at_t = at_q + n, at_t + n
        elif op in "DN":
            if op == "D":
                pos.append(np.arange(at_t, at_t + n))
                call.append(np.full(n, DELETION))
            at_t += n
        elif op == "I":
            if q[at_q] < 4:
                pos.append(np.array([at_t]))
                call.append(np.array([INSERTION + q[at_q]]))
            at_q += n
        # clips lie outside of the stretches
    return (np.concatenate(pos), np.concatenate(call)) if pos else (np.zeros(0, np.int64),) * 2


def _pairs(codes: np.ndarray, gap: int, flank: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, code of its two flanks with ``gap`` letters between them) of windows without other letters."""
    n = len(codes) - 2 * flank - gap + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    side = np.zeros(len(codes) - flank + 1, np.int64)
    for i in range(flank):
        side = side * 4 + (codes[i : i + len(side)] & 3)
    bad = np.concatenate([[0], np.cumsum(codes > 3)])
    at = np.arange(n)
    at = at[bad[at + 2 * flank + gap] == bad[at]]
    return at, (side[at] << (2 * flank)) + side[at + flank + gap]


def _once(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes that occur once, sorted, with their places."""
    if not len(code):
        return code, at
    order = np.argsort(code, kind="stable")
    code, at = code[order], at[order]
    edge = np.concatenate([[True], code[1:] != code[:-1], [True]])
    single = edge[:-1] & edge[1:]
    return code[single], at[single]


def _look_up(keys: np.ndarray, code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each key among sorted codes, -1 if it is not there."""
    if not len(code):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(code, keys), len(code) - 1)
    return np.where(code[i] == keys, at[i], -1)


def _flanked(q: np.ndarray, t: np.ndarray, flank: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in t, call) where the flanks stand once in t and once in q, around one letter or none."""
    key, place = _once(*_pairs(t, 1, flank)[::-1])
    one = _look_up(key, *_once(*_pairs(q, 1, flank)[::-1]))
    none = _look_up(key, *_once(*_pairs(q, 0, flank)[::-1]))
    call = np.where(none >= 0, DELETION, MISS)
    call[one >= 0] = q[one[one >= 0] + flank]
    return (place + flank)[call != MISS], call[call != MISS]


def _run(each):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctg, read, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for i, row in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3, batch.num_columns)), strict=True)):
                pos, call = each(*row)
                for held, x in zip(out, (np.full(len(pos), ctg[i]), pos + start[i], np.full(len(pos), read[i]), call), strict=True):
                    held.append(x)
            if out[0]:
                arrays = [np.concatenate(x) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, _CALLS, strict=True)], schema=_CALLS)

    return run


_DDL = "ctg long, pos long, read long, base int"


def walk(aligned: DataFrame, match: int = 7) -> DataFrame:
    """(ctg, pos, read, base) of alignments (ctg, read, start, q, t, cigar).

    ``t`` is the target from ``start`` on and ``q`` the query on the target's strand, both as far as the CIGAR goes. A
    matched base counts within ``match`` letters that are equal but for itself, in an operation at least so long; a
    deletion counts at each base, an insertion once, at the base after it, with its first letter. Letters other than A,
    C, G, T call nothing. Rows with a null give no call."""
    rows = aligned.select(F.col("ctg").cast("long"), F.col("read").cast("long"), F.col("start").cast("long"), "cigar", "q", "t").dropna()
    return rows.mapInArrow(_run(lambda cigar, q, t: _walked(cigar, _codes(q), _codes(t), match)), _DDL)


def between_flanks(aligned: DataFrame, flank: int = FLANK) -> DataFrame:
    """(ctg, pos, read, base) of stretches (ctg, read, start, q, t) that overlap, without a CIGAR.

    The base between two flanks of ``flank`` letters (1 to 15) is called if the pair of flanks stands once in ``t`` and
    once in ``q`` with one letter between, or as a deletion if it stands once in ``q`` with none between. Rows with a null
    and stretches shorter than the flanks give no call."""
    if not 1 <= flank <= 15:
        raise ValueError("flanks have 1 to 15 letters")
    rows = aligned.select(F.col("ctg").cast("long"), F.col("read").cast("long"), F.col("start").cast("long"), "q", "t").dropna()
    return rows.mapInArrow(_run(lambda q, t: _flanked(_codes(q), _codes(t), flank)), _DDL)


def counts(calls: DataFrame) -> DataFrame:
    """(ctg, pos, n_a, n_c, n_g, n_t, n_ins, n_del): calls of each kind; counted before the shuffle by position."""
    kinds = {"n_a": "= 0", "n_c": "= 1", "n_g": "= 2", "n_t": "= 3", "n_ins": "between 4 and 7", "n_del": "= 8"}
    return calls.groupBy("ctg", "pos").agg(*[F.count_if(F.expr(f"base {k}")).alias(n) for n, k in kinds.items()])


def at_sites(calls: DataFrame, placed: DataFrame, sites: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(ctg, pos, read, base) of every site under an alignment: its call, or MISS where it made none.

    ``placed`` has (ctg, read, start, end). Alignments meet the sites of their contig bucket by bucket, so a contig with
    very many of both is no single task's work."""
    where = F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))
    parts = placed.where("start < end").select("ctg", "read", "start", "end", F.explode(where).alias("_b"))
    near = sites.select("ctg", "pos", F.floor(F.col("pos") / bucket).alias("_b"))
    under = parts.join(near, ["ctg", "_b"]).where("start <= pos and pos < end").select("ctg", "pos", "read").distinct()
    return under.join(calls, ["ctg", "pos", "read"], "left").select("ctg", "pos", "read", F.coalesce("base", F.lit(MISS)).alias("base"))
