"""Phasing: reads around a target are split by their alleles, and placements of other haplotypes are reported.

A read's alleles relative to the target are -1 (other), 0 (unknown) and 1 (same). One group is a target with the reads
that share enough sites with it, bounded by the reads kept per target; groups run in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import cut, is_empty


@dataclass(frozen=True)
class Options:
    """Rules: a query disagrees if at least ``count`` sites and a share of ``rate`` differ, and agrees if at least ``same``
    sites and a share of ``same_rate`` are equal. ``rounds`` limits k-means, ``depth`` the division, ``iterations`` the
    correction of target alleles."""

    count: int = 3
    rate: float = 0.5
    same: int = 3
    same_rate: float = 0.7
    rounds: int = 10
    depth: int = 4
    iterations: int = 2

    @classmethod
    def parse(cls, text: str) -> Options:
        """icc, icr: count and rate to disagree; sc, sr: to agree; it: iterations."""
        names = {"icc": ("count", int), "icr": ("rate", float), "sc": ("same", int), "sr": ("same_rate", float), "it": ("iterations", int)}
        got = {}
        for part in filter(None, (text or "").split(":")):
            key, eq, value = part.partition("=")
            if key not in names or not eq:
                raise ValueError(f"not a phasing rule: {part!r}")
            got[names[key][0]] = names[key][1](value)
        return cls(**got)


def counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(same, different) over places known in both."""
    p = a * b
    return int((p > 0).sum()), int((p < 0).sum())


def disagrees(a: np.ndarray, b: np.ndarray, o: Options) -> bool:
    s, d = counts(a, b)
    return d >= o.count and d >= (s + d) * o.rate


def agrees(a: np.ndarray, b: np.ndarray, o: Options) -> bool:
    s, d = counts(a, b)
    return s >= o.same and s >= (s + d) * o.same_rate


def centre(m: np.ndarray) -> np.ndarray:
    """Sign of the column sums."""
    return np.sign(m.sum(axis=0)).astype(int)


def spread(m: np.ndarray) -> float:
    """Sum of squared distances to the mean over known places."""
    known = m != 0
    n = known.sum(axis=0)
    mean = np.divide(m.sum(axis=0), n, out=np.zeros(m.shape[1]), where=n > 0)
    return float((((m - mean) ** 2) * known).sum())


def two_means(m: np.ndarray, o: Options) -> np.ndarray:
    """0 or 1 per row: seeds are the row with most conflicts to the others and the row farthest from it."""
    p = m @ m.T
    both = (np.abs(m) @ np.abs(m).T)
    diff = (both - p) // 2
    first = int(np.argmax(diff.sum(axis=1)))
    second = int(np.argmax(diff[first]))
    label = (diff[second] < diff[first]).astype(int)
    label[second], label[first] = 1, 0
    for _ in range(o.rounds):
        if label.min() == label.max():
            break
        c = [centre(m[label == k]) for k in (0, 1)]
        d = np.stack([np.maximum(-(m * x), 0).sum(axis=1) - np.maximum(m * x, 0).sum(axis=1) for x in c])
        new = (d[1] < d[0]).astype(int)
        if (new == label).all():
            break
        label = new
    return label


def divide(m: np.ndarray, o: Options, depth: int = 0) -> list[np.ndarray]:
    """Rows split as long as the two parts disagree and the spread falls."""
    rows = np.arange(len(m))
    if len(m) < 2 or depth >= o.depth:
        return [rows]
    label = two_means(m, o)
    if label.min() == label.max():
        return [rows]
    a, b = rows[label == 0], rows[label == 1]
    if not disagrees(centre(m[a]), centre(m[b]), o) or spread(m[a]) + spread(m[b]) >= spread(m):
        return [rows]
    return [x[part] for x in (a, b) for part in divide(m[x], o, depth + 1)]


def split_at_gaps(m: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows in groups whose stretches of known places touch one another."""
    spans = sorted((int(k[0]), int(k[-1]), int(r)) for r in rows if len(k := np.flatnonzero(m[r])))
    out: list[list[int]] = []
    reach = -1
    for s, e, r in spans:
        if s > reach or not out:
            out.append([])
        out[-1].append(r)
        reach = max(reach, e)
    return [np.array(g) for g in out]


def combine(m: np.ndarray, groups: list[np.ndarray], o: Options) -> list[np.ndarray]:
    """Groups joined while their centres agree, largest first."""
    out: list[np.ndarray] = []
    for g in sorted(groups, key=lambda x: (-len(x), int(x[0]))):
        for i, h in enumerate(out):
            if agrees(centre(m[h]), centre(m[g]), o) and not disagrees(centre(m[h]), centre(m[g]), o):
                out[i] = np.concatenate([h, g])
                break
        else:
            out.append(g)
    return out


def classify(m: np.ndarray, target: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """(class per row, corrected target): 1 same haplotype, -1 other, 0 unknown."""
    cls, target, _ = classify_groups(m, target, o)
    return cls, target


def classify_groups(m: np.ndarray, target: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``classify`` with the centres of the groups, each compared with the target that the classes were found with.

    The target's group decides; target alleles that most of its group contradict are turned before the next round."""
    target = used = target.copy()
    cls = np.zeros(len(m), int)
    for _ in range(max(1, o.iterations)):
        groups = combine(m, [part for g in divide(m, o) for part in split_at_gaps(m, g)], o)
        used = target
        own = [g for g in groups if agrees(centre(m[g]), target, o)]
        cls[:] = 0
        for g in groups:
            c = centre(m[g])
            if disagrees(c, target, o):
                cls[g] = [-1 if disagrees(m[r], target, o) else 0 for r in g]
            elif agrees(c, target, o):
                cls[g] = [1 if not disagrees(m[r], target, o) else 0 for r in g]
        if not own:
            break
        votes = m[np.concatenate(own)].sum(axis=0)
        turned = np.where((np.abs(votes) >= o.same) & (np.sign(votes) == -target), -target, target)
        if (turned == target).all():
            break
        target = turned
    return cls, target, np.array([used, *(centre(m[g]) for g in groups)])


def classify_row(row: np.ndarray, target: np.ndarray, centres: np.ndarray, o: Options) -> int:
    """The class of a read that was in no group: that of the nearest centre, under the rule of its members."""
    c = centres[int(np.argmax((centres * row).sum(axis=1)))]
    if disagrees(c, target, o):
        return -1 if disagrees(row, target, o) else 0
    return int(agrees(c, target, o) and not disagrees(row, target, o))


def phase(alleles: DataFrame, least_shared: int = 3, most: int = 200, options: Options | None = None) -> DataFrame:
    """(ctg, t, q, cls): for each target read the reads of the same (1) and the other (-1) haplotype on a contig.

    ``alleles`` has (ctg, read, pos, choice). Reads meet over sites they share, ``least_shared`` at least; the groups of each
    target are found from the ``most`` with most shared sites, the others get their class row by row from the centres of
    these groups. A site's reads are as many as the coverage, which bounds the pairs."""
    o = options or Options()
    ok = alleles.where("choice != -1").select("ctg", "read", "pos", "choice").distinct()
    x = ok.select("ctg", "pos", F.col("read").alias("t"), F.col("choice").alias("_c"))
    y = ok.select("ctg", "pos", F.col("read").alias("q"), F.col("choice").alias("_d"))
    shared = cut(x.join(y, ["ctg", "pos"]).where("t != q").select("ctg", "t", "q", "pos", F.when(F.col("_c") == F.col("_d"), 1).otherwise(-1).alias("v")))
    n = shared.groupBy("ctg", "t", "q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_shared)
    w = Window.partitionBy("ctg", "t")
    near = cut(n.withColumn("_r", F.row_number().over(w.orderBy(F.col("n").desc(), "q"))).withColumn("_more", F.count(F.lit(1)).over(w) > most).select("ctg", "t", "q", (F.col("_r") <= most).alias("_in"), "_more"))
    rows = shared.join(near.where("_in").drop("_in"), ["ctg", "t", "q"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        qs, sites = np.unique(p["q"]), np.unique(p["pos"])
        m = np.zeros((len(qs), len(sites)), int)
        m[np.searchsorted(qs, p["q"]), np.searchsorted(sites, p["pos"])] = p["v"]
        cls, _, found = classify_groups(m, np.ones(len(sites), int), o)
        keep = cls != 0
        out = pd.DataFrame({"ctg": p["ctg"].iloc[0], "t": p["t"].iloc[0], "q": qs[keep], "cls": cls[keep], "sites": None, "found": None})
        if p["_more"].iloc[0]:
            # the centres stand in a row of the target's own
            own = pd.DataFrame({"ctg": [p["ctg"].iloc[0]], "t": [p["t"].iloc[0]], "q": [p["t"].iloc[0]], "cls": [0], "sites": [sites.tolist()], "found": [found.ravel().tolist()]})
            out = pd.concat([out.astype(object), own.astype(object)], ignore_index=True) if len(out) else own
        return out

    kinds = {f.name: f.dataType.simpleString() for f in alleles.schema}
    shape = f"ctg {kinds['ctg']}, t {kinds['read']}, q {kinds['read']}, cls int"
    grouped = rows.groupBy("ctg", "t").applyInPandas(run, f"{shape}, sites array<{kinds['pos']}>, found array<int>")
    if is_empty(near.where("not _in")):
        return grouped.select("ctg", "t", "q", "cls")
    grouped = cut(grouped)

    def run_rest(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for p in parts:
            cls = []
            for sites, found, pos, v in zip(p["sites"], p["found"], p["pos"], p["v"], strict=True):
                places = np.asarray(sites)
                pos, v = np.asarray(pos), np.asarray(v)
                at = np.minimum(np.searchsorted(places, pos), len(places) - 1)
                known = places[at] == pos
                row = np.zeros(len(places), int)
                row[at[known]] = v[known]
                target, centres = np.split(np.asarray(found).reshape(-1, len(places)), [1])
                # a site that no read of the groups has stands as it is in the target
                beyond = v[~known]
                whole = np.concatenate([row, beyond])
                pad = [(0, 0), (0, len(beyond))]
                cls.append(classify_row(whole, np.pad(target, pad, constant_values=1)[0], np.pad(centres, pad), o))
            out = p[["ctg", "t", "q"]].assign(cls=cls)
            yield out[out["cls"] != 0]

    rest = shared.join(near.where("not _in").select("ctg", "t", "q"), ["ctg", "t", "q"]).groupBy("ctg", "t", "q").agg(F.collect_list("pos").alias("pos"), F.collect_list("v").alias("v"))
    centres = grouped.where("found is not null").select("ctg", "t", "sites", "found")
    return grouped.where("found is null").select("ctg", "t", "q", "cls").unionByName(rest.join(centres, ["ctg", "t"]).mapInPandas(run_rest, shape))


def placements(phased: DataFrame, reads: DataFrame) -> DataFrame:
    """(t, q, strand, offset) of reads of other haplotypes: where q starts on t by their places on the contig.

    ``reads`` has (ctg, read, direction, offset), one placement each."""
    t = reads.select("ctg", F.col("read").alias("t"), F.col("direction").alias("_td"), F.col("offset").alias("_to"))
    q = reads.select("ctg", F.col("read").alias("q"), F.col("direction").alias("_qd"), F.col("offset").alias("_qo"))
    rows = phased.where("cls = -1").join(t, ["ctg", "t"]).join(q, ["ctg", "q"])
    same = F.col("_td") == F.col("_qd")
    off = F.when(F.col("_td") == 0, F.col("_qo") - F.col("_to")).otherwise(F.col("_to") - F.col("_qo"))
    return rows.select("t", "q", F.when(same, 0).otherwise(1).alias("strand"), off.alias("offset")).distinct()


def low_complexity(seq: str, k: int = 5, window: int = 100, share: float = 0.66) -> list[tuple[int, int]]:
    """Stretches of windows, at any base, in which the three commonest k-mers make up a share of all.

    A step of one base changes the three's sum by one at most, so the windows between are known from how far it is off."""
    out: list[tuple[int, int]] = []
    last, s = max(0, len(seq) - window), 0
    while s <= last:
        part = seq[s : s + window]
        n: dict[str, int] = {}
        for i in range(len(part) - k + 1):
            n[part[i : i + k]] = n.get(part[i : i + k], 0) + 1
        over = sum(sorted(n.values())[-3:]) - share * sum(n.values())
        if n and over >= 0:
            to = min(last, s + int(over))
            if out and s <= out[-1][1]:
                out[-1] = (out[-1][0], to + len(part))
            else:
                out.append((s, to + len(part)))
            s = to + 1
        else:
            s += max(1, math.ceil(-over - 1e-9))
    return out


def masked_regions(seqs: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, start, end) of the low-complexity stretches of every sequence."""
    kind = seqs.schema[key].dataType.simpleString()

    def run(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for p in parts:
            rows = [(k, a, b) for k, s in zip(p[key], p[seq], strict=True) if s for a, b in low_complexity(s)]
            yield pd.DataFrame(rows, columns=[key, "start", "end"])

    return seqs.select(key, seq).mapInPandas(run, f"`{key}` {kind}, start int, end int")


def flip_bubbles(links: dict[tuple[str, str], float], limit: int = 1000) -> dict[str, int]:
    """Sides (1 or -1) of bubbles such that no bubble's links speak against it: the worst one is turned again and again.

    ``links`` sums agreeing less disagreeing mates of two bubbles. For one contig's bubbles, on the driver or in a task."""
    names = sorted({n for pair in links for n in pair})
    side = dict.fromkeys(names, 1)
    for _ in range(limit):
        pull = dict.fromkeys(names, 0.0)
        for (a, b), w in links.items():
            if a != b:
                pull[a] += w * side[a] * side[b]
                pull[b] += w * side[a] * side[b]
        worst = min(names, key=lambda n: (pull[n], n), default=None)
        if worst is None or pull[worst] >= 0:
            break
        side[worst] = -side[worst]
    return side
