"""Bin completion over a histogram of sizes.

Items of equal size are interchangeable, so a packing is a list of patterns (how often, which sizes) over at most
``capacity`` distinct sizes, whatever the number of items. Around the largest size left, all fillings are enumerated lazily
from the least waste on, each as often as it fits and then less often; a filling that packs into a kept one is dominated and
left out. The search is depth first; a branch ends when its waste passes what the best packing so far allows. The first
incumbent is best fit decreasing. The number of nodes is the only limit: a search that ends within it has found the fewest bins.
"""

from __future__ import annotations

from collections.abc import Iterator

Filling = tuple[tuple[int, int], ...]
Pattern = tuple[int, Filling]

#: Nodes of the search; the best packing found by then is returned.
NODES = 6_000
#: Items of a filling up to which it is tested for dominance, and kept fillings it is tested against; searching a dominated
#: filling all the same costs nodes and loses no packing.
TESTED, AGAINST = 12, 50


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best fit decreasing, with equal open bins as one class."""
    bins: dict[tuple[tuple[int, int], ...], int] = {}
    by_room: dict[int, list[tuple[tuple[int, int], ...]]] = {}

    def add(pattern: tuple[tuple[int, int], ...], times: int) -> None:
        if pattern not in bins:
            by_room.setdefault(capacity - sum(s * m for s, m in pattern), []).append(pattern)
        bins[pattern] = bins.get(pattern, 0) + times

    for size in sorted(counts, reverse=True):
        left = counts[size]
        for room in sorted(r for r in by_room if r >= size):
            while left and by_room.get(room):
                pattern = by_room[room].pop()
                times, fit = bins.pop(pattern), room // size
                full = min(times, left // fit)
                if full:
                    add((*pattern, (size, fit)), full)
                    left -= full * fit
                if full < times and left:
                    add((*pattern, (size, left)), 1)
                    left, full = 0, full + 1
                if full < times:
                    add(pattern, times - full)
                    break
            if not left:
                break
        fit = capacity // size
        if left // fit:
            add(((size, fit),), left // fit)
        if left % fit:
            add(((size, left % fit),), 1)
    return [(n, p) for p, n in bins.items()]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of total size over capacity and the bound by items that exclude each other (for every threshold)."""
    total = sum(s * n for s, n in counts.items())
    bound = -(-total // capacity)
    sizes = sorted(counts)
    for a in sizes:
        if a * 2 > capacity:
            break
        big = sum(counts[s] for s in sizes if s > capacity - a)
        mid = [(s, counts[s]) for s in sizes if capacity - a >= s > capacity / 2]
        low = sum(s * counts[s] for s in sizes if a <= s <= capacity / 2)
        free = sum((capacity - s) * n for s, n in mid)
        bound = max(bound, big + sum(n for _, n in mid) + max(0, -(-(low - free) // capacity)))
    return bound


def _reach(counts: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """reach[i]: bit set of the sums up to ``room`` that the i smallest sizes can give."""
    mask = (1 << (room + 1)) - 1
    out, bits = [1], 1
    for s in sizes:
        n, take = min(counts[s], room // s), 1
        while n > 0:
            take = min(take, n)
            bits |= (bits << (s * take)) & mask
            n -= take
            take *= 2
        out.append(bits)
    return out


def _exact(counts: dict[int, int], sizes: list[int], reach: list[int], target: int, top: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Every filling of exactly ``target`` from sizes[:top], the largest sizes first."""
    if not target:
        yield ()
        return
    for i in range(top, 0, -1):
        if not reach[i] >> target & 1:  # nor with fewer sizes
            return
        s = sizes[i - 1]
        for m in range(min(counts[s], target // s), 0, -1):
            if reach[i - 1] >> (target - s * m) & 1:
                for rest in _exact(counts, sizes, reach, target - s * m, i - 1):
                    yield ((s, m), *rest)


def _fits(items: list[int], bins: list[int]) -> bool:
    """Whether the items (descending) can be packed into bins of these sizes."""
    if not items:
        return True
    seen = set()
    for i, b in enumerate(bins):
        if b >= items[0] and b not in seen:
            seen.add(b)
            if _fits(items[1:], [*bins[:i], b - items[0], *bins[i + 1 :]]):
                return True
    return False


def _flat(f: tuple[tuple[int, int], ...]) -> list[int]:
    return sorted((s for s, m in f for _ in range(m)), reverse=True)


def fillings(counts: dict[int, int], room: int) -> Iterator[tuple[int, Filling] | None]:
    """Undominated (waste, filling) of ``room``, from the least waste on; None for a dominated one, as it took a look too."""
    if counts.get(room, 0):
        yield 0, ((room, 1),)  # dominates every other filling
        return
    sizes = sorted(s for s, n in counts.items() if n and s <= room)
    if not sizes:
        yield room, ()
        return
    reach = _reach(counts, sizes, room)
    kept: list[list[int]] = []
    for target in range(reach[-1].bit_length() - 1, 0, -1):
        if reach[-1] >> target & 1:
            for f in _exact(counts, sizes, reach, target, len(sizes)):
                flat = _flat(f)
                if len(flat) <= TESTED:
                    if any(_fits(flat, k) for k in kept):
                        yield None
                        continue
                    if len(kept) < AGAINST:
                        kept.append(flat)
                yield room - target, f


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """Patterns that hold every item once, with as few bins as the search finds; the fewest possible if it ends in time."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return []
    if min(counts) < 1 or max(counts) > capacity:
        raise ValueError("sizes must lie between 1 and the capacity")
    total = sum(s * n for s, n in counts.items())
    least = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    bins = sum(n for n, _ in best)
    left = dict(counts)
    path: list[Pattern] = []
    used = wasted = spent = 0

    def options() -> Iterator[tuple[int, Filling, int]]:
        """(waste, filling, how often) around the largest size left; 0 times for a dominated filling."""
        s = max(left)
        rest = dict(left)
        rest[s] -= 1
        for found in fillings(rest, capacity - s):
            if found is None:
                yield 0, (), 0
                continue
            waste, f = found
            need = dict(f)
            need[s] = need.get(s, 0) + 1
            f = tuple(sorted(need.items(), reverse=True))
            for times in range(min(left[x] // m for x, m in f), 0, -1):
                yield waste, f, times

    def apply(f: tuple[tuple[int, int], ...], times: int) -> None:
        for s, m in f:
            n = left.get(s, 0) - m * times
            if n:
                left[s] = n
            else:
                left.pop(s, None)

    stack = [options()]
    steps: list[tuple[int, int, tuple[tuple[int, int], ...]]] = []
    while stack and bins > least and spent < nodes:
        choice = next(stack[-1], None)
        allowed = (bins - 1) * capacity - total
        if choice is None or wasted > allowed:
            stack.pop()
            if steps:
                times, waste, f = steps.pop()
                apply(f, -times)
                path.pop()
                used -= times
                wasted -= times * waste
            continue
        spent += 1
        waste, f, times = choice
        if not times or wasted + waste * times > allowed:  # the waste stays, so the branch can't beat the best
            continue
        apply(f, times)
        path.append((times, f))
        steps.append((times, waste, f))
        used += times
        wasted += times * waste
        if left:
            stack.append(options())
            continue
        if used < bins:
            best, bins = list(path), used
        stack.append(iter(()))
    return best
