"""Alignment kernels for Arrow-batched UDFs: edit distance, alignments, gap placement, trimming, seeds."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: str, b: str) -> int:
    """Bit-parallel edit distance: one step per letter of the longer string on integers of the shorter one's length."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    m = len(a)
    mask, last = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, ch in enumerate(a):
        eq[ch] = eq.get(ch, 0) | 1 << i
    vp, vn, score = mask, 0, m
    for ch in b:
        x = eq.get(ch, 0)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
        hp = hp << 1 | 1
        vp = (hn << 1 | ~(d0 | hp)) & mask
        vn = d0 & hp & mask
    return score


def edit_path(a: str, b: str, limit: int | None = None) -> list[tuple[int, str]] | None:
    """An alignment with the fewest edits as [(length, op)] with = X I (a only) D (b only); None beyond ``limit`` edits.

    Furthest-reaching points per diagonal for each number of edits; memory is the square of the edits."""
    n, m = len(a), len(b)
    limit = n + m if limit is None else limit
    rounds: list[dict[int, tuple[int, int]]] = []

    def slide(i: int, k: int) -> int:
        while i < n and i - k < m and a[i] == b[i - k]:
            i += 1
        return i

    frontier = {0: (slide(0, 0), 0)}
    rounds.append(frontier)
    while frontier.get(n - m, (-1,))[0] < n:
        if len(rounds) > limit:
            return None
        nxt: dict[int, tuple[int, int]] = {}
        for k in range(min(frontier) - 1, max(frontier) + 2):
            # 1 substitution on the same diagonal, 2 a letter of a, 3 a letter of b
            options = [(frontier[k][0] + 1, 1)] if k in frontier else []
            if k - 1 in frontier:
                options.append((frontier[k - 1][0] + 1, 2))
            if k + 1 in frontier:
                options.append((frontier[k + 1][0], 3))
            options = [(i, how) for i, how in options if i <= n and 0 <= i - k <= m]
            if options:
                i, how = max(options, key=lambda o: (o[0], -o[1]))
                nxt[k] = (slide(i, k), how)
        frontier = nxt
        rounds.append(frontier)
    ops: list[tuple[int, str]] = []
    k, i = n - m, n
    for d in range(len(rounds) - 1, -1, -1):
        how = rounds[d][k][1]
        if d == 0:
            ops.append((i, "="))
            break
        pk = k if how == 1 else k - 1 if how == 2 else k + 1
        start = rounds[d - 1][pk][0] + (1 if how in (1, 2) else 0)
        ops.append((i - start, "="))
        ops.append((1, "XID"[how - 1]))
        i, k = rounds[d - 1][pk][0], pk
    return _joined([o for o in reversed(ops) if o[0]])


def _steps(eq: dict[str, int], letters: str, vp: int, vn: int, mask: int) -> Iterator[tuple[int, int]]:
    """Rows one above and one below their upper neighbour (as bits), column by column."""
    for ch in letters:
        x = eq.get(ch, 0)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        hp = hp << 1 | 1
        vp = (hn << 1 | ~(d0 | hp)) & mask
        vn = d0 & hp & mask
        yield vp, vn


def least_path(a: str, b: str) -> list[tuple[int, str]]:
    """An alignment with the fewest edits as ``edit_path`` has it, whatever the lengths and the number of edits.

    Bit-parallel columns of the letters of b; one in the square root of them is kept, and those between are computed again on
    the way back, so memory is the length of a times that root in bits."""
    n, m = len(a), len(b)
    mask = (1 << n) - 1
    eq: dict[str, int] = {}
    for i, ch in enumerate(a):
        eq[ch] = eq.get(ch, 0) | 1 << i
    width = max(1, math.isqrt(m))
    kept = [(mask, 0)]
    for j, column in enumerate(_steps(eq, b, mask, 0, mask), 1):
        if j % width == 0:
            kept.append(column)
    ops: list[tuple[int, str]] = []
    i, j, low = n, m, m + 1
    block: list[tuple[int, int]] = []
    while i and j:
        if j - 1 < low:
            # columns low to j, the one before j among them
            low = (j - 1) // width * width
            block = [kept[low // width], *_steps(eq, b[low:j], *kept[low // width], mask)]
        if block[j - low][0] >> i - 1 & 1:
            ops.append((1, "I"))
            i -= 1
        elif block[j - 1 - low][1] >> i - 1 & 1:
            ops.append((1, "D"))
            j -= 1
        else:
            ops.append((1, "=" if a[i - 1] == b[j - 1] else "X"))
            i, j = i - 1, j - 1
    ops += [(i, "I")] if i else [(j, "D")] if j else []
    return _joined(ops[::-1])


def _joined(ops: list[tuple[int, str]]) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    for n, op in ops:
        if out and out[-1][1] == op:
            out[-1] = (out[-1][0] + n, op)
        else:
            out.append((n, op))
    return out


def affine_path(a: str, b: str, match: int = 2, mismatch: int = -4, gap_open: int = 4, gap_extend: int = 2, band: int | None = None) -> tuple[int, list[tuple[int, str]]]:
    """(score, ops) of a global alignment with affine gaps, within a band around the diagonal where given."""
    n, m = len(a), len(b)
    if band is None:
        band = max(n, m)
    band = max(band, abs(n - m) + 1)
    low = -(10**9)
    h, e, f = (np.full((n + 1, m + 1), low, np.int64) for _ in range(3))
    h[0, 0] = 0
    for i in range(n + 1):
        for j in range(max(0, i - band), min(m, i + band) + 1):
            if i:
                e[i, j] = max(h[i - 1, j] - gap_open - gap_extend, e[i - 1, j] - gap_extend)
            if j:
                f[i, j] = max(h[i, j - 1] - gap_open - gap_extend, f[i, j - 1] - gap_extend)
            if i or j:
                diag = h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch) if i and j else low
                h[i, j] = max(diag, e[i, j], f[i, j])
    ops: list[tuple[int, str]] = []
    i, j, state = n, m, "h"
    while i or j:
        if state == "h":
            if i and j and h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                ops.append((1, "=" if a[i - 1] == b[j - 1] else "X"))
                i, j = i - 1, j - 1
            else:
                state = "e" if h[i, j] == e[i, j] else "f"
        elif state == "e":
            ops.append((1, "I"))
            state = "h" if e[i, j] == h[i - 1, j] - gap_open - gap_extend else "e"
            i -= 1
        else:
            ops.append((1, "D"))
            state = "h" if f[i, j] == h[i, j - 1] - gap_open - gap_extend else "f"
            j -= 1
    return int(h[n, m]), _joined(ops[::-1])


def rows_of(a: str, b: str, ops: list[tuple[int, str]]) -> tuple[str, str]:
    """Both strings with - for gaps."""
    x, y, i, j = [], [], 0, 0
    for n, op in ops:
        x.append("-" * n if op == "D" else a[i : i + n])
        y.append("-" * n if op == "I" else b[j : j + n])
        i += n if op != "D" else 0
        j += n if op != "I" else 0
    return "".join(x), "".join(y)


def shift_gaps(x: str, y: str) -> tuple[str, str]:
    """Gaps as far right as equal letters allow, so that equal alignments are written alike; no gap meets a gap."""

    def right(s: str, o: str) -> str:
        c = list(s)
        for i in range(len(c) - 1, -1, -1):
            if c[i] != "-":
                continue
            k = i
            while k + 1 < len(c) and c[k + 1] != "-" and o[k] == c[k + 1] and o[k + 1] != "-":
                c[k], c[k + 1] = c[k + 1], "-"
                k += 1
        return "".join(c)

    x = right(x, y)
    y = right(y, x)
    keep = [k for k in range(len(x)) if not (x[k] == "-" and y[k] == "-")]
    return "".join(x[k] for k in keep), "".join(y[k] for k in keep)


def trimmed(x: str, y: str, run: int = 8, stub: int = 0) -> tuple[int, int]:
    """(start, end) of the columns from the first to the last run of equal letters; an empty range if there is none.

    Ends within ``stub`` columns of the alignment's ends count as reached."""
    same = "".join("1" if p == q and p != "-" else "0" for p, q in zip(x, y, strict=True))
    first, last = same.find("1" * run), same.rfind("1" * run)
    if first < 0:
        return 0, 0
    return (0 if first <= stub else first), (len(same) if len(same) - (last + run) <= stub else last + run)


def identities(x: str, y: str, window: int = 1000) -> tuple[float, float]:
    """(overall, least in any window) share of equal columns in percent."""
    same = np.fromiter((p == q and p != "-" for p, q in zip(x, y, strict=True)), bool, len(x))
    if not len(same):
        return 0.0, 0.0
    whole = float(same.mean() * 100)
    if len(same) <= window:
        return whole, whole
    run = np.concatenate([[0], np.cumsum(same)])
    return whole, float((run[window:] - run[:-window]).min() / window * 100)


def seed(a: str, b: str, k: int = 12, span: int = 100) -> tuple[int, int] | None:
    """(i, j) of the first exact match of k letters whose places differ by at most ``span``."""
    at: dict[str, list[int]] = {}
    for j in range(len(b) - k + 1):
        at.setdefault(b[j : j + k], []).append(j)
    for i in range(len(a) - k + 1):
        near = [j for j in at.get(a[i : i + k], ()) if abs(i - j) <= span]
        if near:
            return i, min(near, key=lambda j: (abs(i - j), j))
    return None


def aligner(options: str) -> Callable[[str, str], list[tuple[int, str]] | None]:
    """An aligner by ``name:key=value:...``: edit (limit) or affine (match, mismatch, open, extend, band)."""
    name, *rest = options.split(":")
    p = {k: int(v) for k, v in (x.split("=", 1) for x in rest)}
    if name == "edit":
        return lambda a, b: edit_path(a, b, p["limit"]) if "limit" in p else least_path(a, b)
    if name == "affine":
        return lambda a, b: affine_path(a, b, p.get("match", 2), p.get("mismatch", -4), p.get("open", 4), p.get("extend", 2), p.get("band"))[1]
    raise ValueError(f"unknown aligner: {options}")


def cigar_text(ops: list[tuple[int, str]]) -> str:
    return "".join(f"{n}{op}" for n, op in ops)


def distance_udf(a: Column, b: Column) -> Column:
    """Edit distance in Arrow batches; null for a null side."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else edit_distance(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return run(a, b)


def quality_of(a: Column, b: Column) -> Column:
    """100 less the edit distance in percent of the longer string; strings without letters in common length give 0."""
    return quality_from(distance_udf(a, b), F.length(a), F.length(b))


def quality_from(distance: Column, a: Column, b: Column) -> Column:
    """The quality of strings of the lengths a and b at a known distance."""
    return F.lit(100.0) - distance * 100.0 / F.nullif(F.greatest(a, b), F.lit(0))


def align_udf(a: Column, b: Column, options: str = "edit") -> Column:
    """CIGAR (= X I D) in Arrow batches; null for a null side or beyond the aligner's limit."""

    @F.pandas_udf("string")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        go = aligner(options)
        out = []
        for p, q in zip(x, y, strict=True):
            ops = None if p is None or q is None else go(p, q)
            out.append(None if ops is None else cigar_text(ops))
        return pd.Series(out, dtype="object")

    return run(a, b)


def parse_ops(text: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in re.findall(r"(\d+)([=XIDM])", text)]
