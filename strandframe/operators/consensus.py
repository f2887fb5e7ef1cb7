"""Consensus of reads over a target: aligned columns, links, best path."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.align import edit_path, identities, rows_of, shift_gaps, trimmed
from strandframe.functions.dna import slice_of

_FLIP = str.maketrans("ACGTacgt", "TGCAtgca")


def tags(x: str, y: str, offset: int = 0) -> list[tuple[int, int, str]]:
    """(column, row, base) of a query row over a target row: row 0 stands on the target, further rows are insertions."""
    out, col, row = [], offset - 1, 0
    for q, t in zip(x, y, strict=True):
        if t == "-":
            row += 1
        else:
            col, row = col + 1, 0
        out.append((col, row, q))
    return out


def links(tagged: dict[int, list[tuple[int, int, str]]]) -> dict[tuple[tuple[int, int, str], tuple[int, int, str]], set[int]]:
    """Steps between consecutive tags with the queries that take them."""
    got: dict[tuple[tuple[int, int, str], tuple[int, int, str]], set[int]] = defaultdict(set)
    for q, ts in tagged.items():
        for a, b in zip(ts, ts[1:], strict=False):
            got[a, b].add(q)
    return got


def best_path(steps: dict, weight: dict[int, float] | None = None, penalty: float = 0.5) -> list[tuple[int, int, str]]:
    """The path of nodes with the largest sum of support less ``penalty`` times the column's coverage; ties by node order."""
    into: dict[tuple[int, int, str], list[tuple[tuple[int, int, str], float]]] = defaultdict(list)
    cover: dict[int, float] = defaultdict(float)
    nodes = set()
    for (a, b), qs in steps.items():
        w = sum((weight or {}).get(q, 1.0) for q in qs)
        into[b].append((a, w))
        cover[b[0]] += w if b[1] == 0 else 0.0
        nodes |= {a, b}
    score: dict[tuple[int, int, str], float] = {}
    back: dict[tuple[int, int, str], tuple[int, int, str] | None] = {}
    for n in sorted(nodes):
        options = [(score[a] + w - penalty * cover[n[0]], a) for a, w in into.get(n, []) if a in score]
        top = max(options, default=(0.0, None), key=lambda o: (o[0], o[1] or ()))
        score[n], back[n] = (0.0, None) if not into.get(n) else top
    if not score:
        return []
    end = max(score, key=lambda n: (score[n], n))
    path = [end]
    while back[path[-1]] is not None:
        path.append(back[path[-1]])
    return path[::-1]


def spell(path: list[tuple[int, int, str]]) -> str:
    return "".join(b for _, _, b in path if b != "-")


def correct(target: str, queries: list[tuple[int, str, int, int]], least: int = 2, identity: float = 70.0, deep: int | None = None) -> tuple[str, int, int, list[tuple[int, float, int]]]:
    """(consensus, start, end, scores) of a target from queries (id, bases on the target's strand, start, end on it).

    Queries are aligned to their stretch, gaps are placed alike, ends without a firm match are cut off, and those below the
    identity are left out. With ``deep``, a query is not tried if each of its bases has as many that took part already. The consensus covers the longest stretch with ``least`` queries; scores tell each query's
    identity and whether it took part."""
    tagged: dict[int, list[tuple[int, int, str]]] = {}
    scores = []
    depth = [0] * (len(target) + 1)
    cover = np.zeros(len(target), int)
    for q, bases, s, e in queries:
        if deep is not None and s < e and cover[s:e].min() >= deep:
            continue
        ops = edit_path(bases, target[s:e], max(10, (e - s) * 4 // 10))
        got = (0.0, 0)
        if ops is not None:
            x, y = shift_gaps(*rows_of(bases, target[s:e], ops))
            a, b = trimmed(x, y)
            whole, _ = identities(x[a:b], y[a:b])
            got = (whole, 0)
            if b > a and whole >= identity:
                at = s + sum(c != "-" for c in y[:a])
                tagged[q] = tags(x[a:b], y[a:b], at)
                to = at + sum(c != "-" for c in y[a:b])
                depth[at] += 1
                depth[to] -= 1
                cover[at:to] += 1
                got = (whole, 1)
        scores.append((q, *got))
    best, run, level = (0, 0), None, 0
    for i, d in enumerate(depth):
        level += d
        if level >= least and run is None:
            run = i
        if (level < least or i == len(target)) and run is not None:
            if i - run > best[1] - best[0]:
                best = (run, i)
            run = None
    start, end = best
    if start == end:
        return "", 0, 0, scores
    own = [t for t in tags(target, target)]
    tagged[-1] = own
    inside = {q: [t for t in ts if start <= t[0] < end] for q, ts in tagged.items()}
    weight = {q: (0.5 if q == -1 else 1.0) for q in inside}
    return spell(best_path(links(inside), weight)), start, end, scores


def correct_reads(overlaps: DataFrame, reads: DataFrame, most: int = 60, least: int = 2) -> DataFrame:
    """(read, seq, range_start, range_end, used): consensus of every target read (side b) from its query reads (side a).

    ``overlaps`` has one row per query and target at most. The queries of a target are tried from the longest on until every
    base has ``most`` of them, so the alignments are bounded by the depth of a base; a target's queries are read in one task.
    ``reads`` has (read_id, seq)."""
    top = overlaps.where("a_id != b_id").withColumn("_n", F.expr("(a_end - a_start + b_end - b_start) div 2"))
    q = reads.select(F.col("read_id").alias("a_id"), F.upper("seq").alias("_q"))
    rows = top.join(q, "a_id").where("_q is not null")
    rows = rows.select("b_id", "a_id", F.col("b_start").alias("s"), F.col("b_end").alias("e"), slice_of(F.col("_q"), F.col("a_start"), F.col("a_end"), (F.col("a_strand") != F.col("b_strand")).cast("int")).alias("bases"), "_n")
    targets = reads.select(F.col("read_id").alias("b_id"), F.upper("seq").alias("_t")).where("_t is not null")

    def run(t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if t.empty or p.empty:
            return pd.DataFrame({"read": [0], "seq": [""], "range_start": [0], "range_end": [0], "used": [0]}).iloc[:0]
        p = p.sort_values(["_n", "a_id"], ascending=[False, True], kind="stable")
        seq, a, b, scores = correct(t["_t"].iloc[0], list(zip(p["a_id"], p["bases"], p["s"], p["e"], strict=True)), least, deep=most)
        return pd.DataFrame({"read": [p["b_id"].iloc[0]], "seq": [seq], "range_start": [a], "range_end": [b], "used": [sum(s[2] for s in scores)]})

    # a target's bases meet its queries once; a group costs far more than its bytes tell, so partitions are not merged by size
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = (x.repartition(parts, "b_id").groupBy("b_id") for x in (targets, rows))
    return left.cogroup(right).applyInPandas(run, "read long, seq string, range_start int, range_end int, used int")


def candidate_weights(sides: DataFrame, overhang_weight: float = 0.5) -> DataFrame:
    """(read, other, weight): aligned bases less a share of the overhang, the order in which candidates are tried."""
    aligned = F.col("r_end") - F.col("r_start")
    hang = F.least("r_start", "o_start") + F.least(F.col("r_len") - F.col("r_end"), F.col("o_len") - F.col("o_end"))
    return sides.select("read", "other", (aligned - F.lit(overhang_weight) * hang).alias("weight")).groupBy("read", "other").agg(F.max("weight").alias("weight"))


def score_threshold(scores: list[float], bins: int = 201) -> float:
    """The lowest point between the two highest peaks of the scores' histogram over [0, 1]; 0 if there is one peak."""
    h = [0] * bins
    for s in scores:
        h[min(bins - 1, max(0, int(s * (bins - 1))))] += 1
    smooth = [sum(h[max(0, i - 3) : i + 4]) for i in range(bins)]
    peaks = [i for i in range(bins) if smooth[i] and smooth[i] >= max(smooth[max(0, i - 5) : i + 6]) and (i == 0 or smooth[i - 1] < smooth[i])]
    peaks = sorted(sorted(peaks, key=lambda i: (-smooth[i], i))[:2])
    if len(peaks) < 2:
        return 0.0
    a, b = peaks
    return min(range(a, b + 1), key=lambda i: (smooth[i], i)) / (bins - 1)


def select_reads(scores: dict[int, float], least: int, threshold: float | None = None) -> set[int]:
    """Reads at or above the threshold (found from the scores where not given), filled up to ``least`` by score."""
    th = score_threshold(list(scores.values())) if threshold is None else threshold
    order = sorted(scores, key=lambda r: (-scores[r], r))
    return {r for r in order if scores[r] >= th} | set(order[:least])
