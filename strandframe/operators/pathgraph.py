"""The condensed graph on the driver: bubbles, crossings, bridges, flows and contig paths.

After unitig compaction a graph has few edges per contig; its structures are found here on plain adjacency. Edges are
(in, out, len, score) with an id; a mirror function, where given, keeps reductions skew symmetric.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator

Edge = tuple[str, str]


class PathGraph:
    """Directed edges between named nodes, at most one per pair (the better score); reductions only mark."""

    def __init__(self, edges: Iterable[tuple[str, str, int, float]], mirror: Callable[[str], str] | None = None):
        self.length: dict[Edge, int] = {}
        self.score: dict[Edge, float] = {}
        self.reason: dict[Edge, str] = {}
        self.mirror = mirror
        for u, v, n, s in sorted(edges):
            if (u, v) not in self.score or s > self.score[u, v]:
                self.length[u, v], self.score[u, v] = n, s
        self._index()

    def _index(self) -> None:
        self.outs: dict[str, list[str]] = defaultdict(list)
        self.ins: dict[str, list[str]] = defaultdict(list)
        for u, v in sorted(self.length):
            if (u, v) not in self.reason:
                self.outs[u].append(v)
                self.ins[v].append(u)

    @property
    def nodes(self) -> list[str]:
        return sorted({n for e in self.length for n in e})

    def reduce(self, edges: Iterable[Edge], reason: str) -> int:
        """Mark edges and their mirrors; the number newly marked."""
        n = 0
        for u, v in list(edges):
            both = [(u, v)] + ([(self.mirror(v), self.mirror(u))] if self.mirror else [])
            for e in both:
                if e in self.length and e not in self.reason:
                    self.reason[e] = reason
                    n += 1
        self._index()
        return n

    def reactivate(self, edges: Iterable[Edge]) -> None:
        for e in list(edges):
            self.reason.pop(e, None)
            if self.mirror:
                self.reason.pop((self.mirror(e[1]), self.mirror(e[0])), None)
        self._index()

    # -- searches

    def ego(self, start: str, depth: int, bases: int | None = None, most: int | None = None) -> list[str]:
        """Nodes reached within a number of steps, bases and nodes, nearest first."""
        seen, queue, out = {start}, deque([(start, 0, 0)]), []
        while queue and (most is None or len(out) < most):
            n, d, b = queue.popleft()
            out.append(n)
            for w in self.outs[n]:
                k = b + self.length[n, w]
                if w not in seen and d < depth and (bases is None or k <= bases):
                    seen.add(w)
                    queue.append((w, d + 1, k))
        return out

    def shortest(self, src: str, dst: str, cost: Callable[[Edge], float] | None = None, within: set[str] | None = None) -> list[str] | None:
        """Nodes of the cheapest path (bases unless a cost is given, which must not be negative)."""
        cost = cost or (lambda e: self.length[e])
        best, back, heap = {src: 0.0}, {}, [(0.0, src)]
        while heap:
            d, n = heapq.heappop(heap)
            if n == dst:
                path = [n]
                while path[-1] != src:
                    path.append(back[path[-1]])
                return path[::-1]
            if d > best[n]:
                continue
            for w in self.outs[n]:
                if within is not None and w not in within and w != dst:
                    continue
                k = d + cost((n, w))
                if k < best.get(w, float("inf")):
                    best[w], back[w] = k, n
                    heapq.heappush(heap, (k, w))
        return None

    def all_paths(self, src: str, dst: str, within: set[str], most: int = 10) -> list[list[str]]:
        """Simple paths inside a set of nodes, at most ``most`` per first edge."""
        out = []
        for first in self.outs[src]:
            n = 0
            stack = [[src, first]]
            while stack and n < most:
                p = stack.pop()
                if p[-1] == dst:
                    out.append(p)
                    n += 1
                    continue
                stack.extend([*p, w] for w in reversed(self.outs[p[-1]]) if w not in p and (w in within or w == dst))
        return out

    def disjoint_paths(self, src: str, dst: str, allowed: set[Edge] | None = None) -> list[list[str]]:
        """A largest set of edge-disjoint paths, by augmenting a unit flow."""
        flow: set[Edge] = set()
        usable = [e for e in self.length if e not in self.reason and (allowed is None or e in allowed)]
        adj: dict[str, list[tuple[str, Edge, bool]]] = defaultdict(list)
        for u, v in sorted(usable):
            adj[u].append((v, (u, v), True))
            adj[v].append((u, (u, v), False))
        while True:
            back: dict[str, tuple[str, Edge, bool] | None] = {src: None}
            queue = deque([src])
            while queue and dst not in back:
                n = queue.popleft()
                for w, e, ahead in adj[n]:
                    if w not in back and ((e not in flow) if ahead else (e in flow)):
                        back[w] = (n, e, ahead)
                        queue.append(w)
            if dst not in back or src == dst:
                break
            n = dst
            while back[n] is not None:
                n, e, ahead = back[n]
                flow.add(e) if ahead else flow.discard(e)
        nxt: dict[str, list[str]] = defaultdict(list)
        for u, v in sorted(flow):
            nxt[u].append(v)
        paths = []
        while nxt[src]:
            p = [src]
            while p[-1] != dst:
                p.append(nxt[p[-1]].pop(0))
            paths.append(p)
        return paths

    def extends(self, e: Edge, least_len: int, least_nodes: int) -> bool:
        """The unbranched way out of an edge goes on for so many bases or nodes, or ends at a branching."""
        n, bases, k, seen = e[1], self.length[e], 1, {e[0]}
        while bases < least_len and k < least_nodes:
            if n in seen or len(self.outs[n]) == 0:
                return False
            if len(self.outs[n]) > 1 or len(self.ins[n]) > 1:
                return True
            seen.add(n)
            w = self.outs[n][0]
            bases, k, n = bases + self.length[n, w], k + 1, w
        return True

    # -- structures

    def bubble(self, start: str, depth: int = 50, width: int = 10) -> tuple[str, set[str]] | None:
        """(end, inner nodes) of the superbubble that opens at a fork: every way in comes from inside, all ways meet."""
        if len(self.outs[start]) < 2:
            return None
        seen: set[str] = set()
        ready = [start]
        open_: set[str] = set()
        for _ in range(depth * width):
            if not ready:
                return None
            n = ready.pop()
            seen.add(n)
            open_.discard(n)
            if not self.outs[n]:
                return None
            for w in self.outs[n]:
                if w == start:
                    return None
                open_.add(w)
                if all(p in seen for p in self.ins[w]):
                    ready.append(w)
            if len(open_) > width:
                return None
            if len(ready) == 1 and open_ == {ready[0]}:
                end = ready[0]
                return None if start in self.outs[end] else (end, seen - {start})
        return None

    def bubbles(self) -> list[tuple[str, str, set[str]]]:
        out = []
        for n in self.nodes:
            if (b := self.bubble(n)) is not None:
                out.append((n, *b))
        return out

    def bubble_ways(self, clear: bool = False) -> list[tuple[str, str, list[Edge]]]:
        """(start, end, edges that fall) of every bubble, see ``pop_bubbles``."""
        out = []
        for s, t, inner in self.bubbles():
            paths = self.all_paths(s, t, inner)
            if len(paths) < 2 or clear and any(len(self.ins[n]) > 1 or len(self.outs[n]) > 1 for n in inner):
                continue
            keep = max(paths, key=lambda p: (sum(self.score[e] for e in zip(p, p[1:], strict=False)), sum(self.length[e] for e in zip(p, p[1:], strict=False)), p))
            kept = set(zip(keep, keep[1:], strict=False))
            out.append((s, t, [(u, v) for u in {s, *inner} for v in self.outs[u] if (v in inner or v == t) and (u, v) not in kept]))
        return out

    def pop_bubbles(self, clear: bool = False) -> int:
        """Of every bubble only the path with the best score, then the longest, stays. ``clear`` leaves bubbles alone whose ways
        through share an edge."""
        return self.reduce([e for *_, gone in self.bubble_ways(clear) for e in gone], "bubble")

    def semi_bubbles(self, ratio: float = 2.0) -> int:
        """At a fork with a dead end that is shorter by a ratio than another branch the dead end falls."""
        gone: list[Edge] = []
        for n in self.nodes:
            if len(self.outs[n]) < 2:
                continue
            ends = [(self.length[n, w], w) for w in self.outs[n] if not self.outs[w] and len(self.ins[w]) == 1]
            rest = [self.length[n, w] + max([self.length[w, x] for x in self.outs[w]], default=0) for w in self.outs[n]]
            gone += [(n, w) for k, w in ends if k * ratio <= max(rest)]
        return self.reduce(gone, "semi")

    def tips(self, ratio: float = 2.0) -> int:
        """Edges from nodes without a way in that are shorter by a ratio than another way into the same node."""
        gone = []
        for n in self.nodes:
            ways = [(self.length[p, n], p) for p in self.ins[n]]
            if len(ways) > 1:
                longest = max(k for k, _ in ways)
                gone += [(p, n) for k, p in ways if not self.ins[p] and len(self.outs[p]) == 1 and k * ratio <= longest]
        return self.reduce(gone, "spur")

    def small_loops(self) -> int:
        """Edges back from a node to the one before it."""
        return self.reduce([(v, u) for u, v in list(self.length) if (v, u) in self.length and (u, v) not in self.reason and (v, u) not in self.reason and self.score[u, v] >= self.score[v, u] and u < v], "loop")

    def covered_branches(self, rounds: int = 5) -> int:
        """Branches whose ends are all ends of a sibling as well, repeated while any falls."""
        total = 0
        for _ in range(rounds):
            gone = []
            for n in self.nodes:
                ends = {w: set(self.outs[w]) for w in self.outs[n]}
                for w in ends:
                    better = [x for x in ends if x != w and ends[w] and ends[w] <= ends[x] and (self.score[n, x], x) > (self.score[n, w], w)]
                    if better:
                        gone.append((n, w))
            k = self.reduce(gone, "transitive")
            total += k
            if not k:
                break
        return total

    def cross(self, n: str) -> tuple[tuple[str, str], tuple[str, str]] | None:
        """((in0, in1), (out0, out1)) of a 2 x 2 crossing that a node is the first way into."""
        if len(self.outs[n]) != 2:
            return None
        outs = tuple(self.outs[n])
        ins = {p for w in outs for p in self.ins[w]}
        if len(ins) != 2 or any(len(self.ins[w]) != 2 for w in outs) or any(set(self.outs[p]) != set(outs) for p in ins):
            return None
        return tuple(sorted(ins)), outs

    def resolve_crosses(self, factor: float = 2.0) -> int:
        """Crossings keep the pair of ways whose score is larger by a factor."""
        gone: list[Edge] = []
        for n in self.nodes:
            if (c := self.cross(n)) is None or c[0][0] != n:
                continue
            (a, b), (x, y) = c
            straight, crossed = self.score[a, x] + self.score[b, y], self.score[a, y] + self.score[b, x]
            if straight >= factor * crossed:
                gone += [(a, y), (b, x)]
            elif crossed >= factor * straight:
                gone += [(a, x), (b, y)]
        return self.reduce(gone, "cross")

    def bridges(self, factor: float = 2.0, rounds: int = 3) -> int:
        """Edges between a fork and a join that are both better served by other edges, by a factor of the score."""
        total = 0
        for _ in range(rounds):
            gone = []
            for (u, v), s in self.score.items():
                if (u, v) in self.reason or len(self.outs[u]) < 2 or len(self.ins[v]) < 2:
                    continue
                if max(self.score[u, w] for w in self.outs[u] if w != v) >= factor * s and max(self.score[p, v] for p in self.ins[v] if p != u) >= factor * s:
                    gone.append((u, v))
            k = self.reduce(gone, "bridge")
            total += k
            if not k:
                break
        return total

    def phase_crosses(self, links: dict[Edge, tuple[int, int]], least: int = 2) -> int:
        """Ways through repeats with ``least`` more different than same alleles fall where another way agrees."""
        gone = []
        for n in self.nodes:
            signs = {w: links.get((n, w), (0, 0)) for w in self.outs[n]}
            if any(s > d for s, d in signs.values()):
                gone += [(n, w) for w, (s, d) in signs.items() if d - s >= least]
        return self.reduce(gone, "phase")

    def extend_ends(self, spare: Iterable[tuple[str, str, int, float]], rounds: int = 3) -> int:
        """Spare edges are added where they lead on from a dead end, best score first."""
        added = 0
        pool = sorted(spare, key=lambda e: (-e[3], e))
        for _ in range(rounds):
            new = 0
            for u, v, n, s in pool:
                if (u, v) not in self.length and (self.ins[u] or u in self.outs) and not self.outs[u]:
                    for a, b in [(u, v)] + ([(self.mirror(v), self.mirror(u))] if self.mirror else []):
                        self.length[a, b], self.score[a, b] = n, s
                    new += 1
                    self._index()
            added += new
            if not new:
                break
        return added

    def clusters(self) -> list[set[str]]:
        """Weakly connected parts, larger first."""
        left, out = set(self.nodes), []
        while left:
            queue, part = [min(left)], set()
            while queue:
                n = queue.pop()
                if n in part:
                    continue
                part.add(n)
                queue += self.outs[n] + self.ins[n]
            left -= part
            out.append(part)
        return sorted(out, key=lambda p: (-len(p), min(p)))

    def paths(self, method: str = "best") -> Iterator[list[str]]:
        """Contig paths: unbranched ones (``no``), or extended by the best edge both ways agree on (``best``); each node
        once, longest first."""
        used: set[str] = set()

        def step(n: str) -> str | None:
            if not self.outs[n]:
                return None
            w = max(self.outs[n], key=lambda x: (self.score[n, x], x))
            if method == "no" and (len(self.outs[n]) > 1 or len(self.ins[w]) > 1):
                return None
            return w if max(self.ins[w], key=lambda p: (self.score[p, w], p)) == n else None

        nxt = {n: step(n) for n in self.nodes}
        prev = {w: n for n, w in nxt.items() if w is not None}
        out = []
        for n in [x for x in self.nodes if x not in prev] + self.nodes:
            if n in used:
                continue
            p = [n]
            used.add(n)
            while (w := nxt[p[-1]]) is not None and w not in used:
                p.append(w)
                used.add(w)
            if len(p) > 1:
                out.append(p)
        yield from sorted(out, key=lambda p: (-sum(self.length[e] for e in zip(p, p[1:], strict=False)), p))

    def duplicates(self) -> int:
        """Of paths of one or two edges between the same nodes, with inner nodes on no other path, the best one stays."""
        gone: list[Edge] = []
        for n in self.nodes:
            ways: dict[str, list[tuple[float, int, str, list[Edge]]]] = defaultdict(list)
            for w in self.outs[n]:
                ways[w].append((self.score[n, w], self.length[n, w], "", [(n, w)]))
                if len(self.ins[w]) == 1 and len(self.outs[w]) == 1 and (x := self.outs[w][0]) != n:
                    ways[x].append((min(self.score[n, w], self.score[w, x]), self.length[n, w] + self.length[w, x], w, [(n, w), (w, x)]))
            for paths in ways.values():
                for *_, edges in sorted(paths, key=lambda p: (-p[0], -p[1], p[2]))[1:]:
                    gone += edges
        return self.reduce(gone, "duplicate")

    def simplify(self, strategy: str) -> dict[str, int]:
        """Steps of ``bubble:s=1|semi|spur|loop|transitive|cross|bridge|duplicate`` in order, with the edges each reduced."""
        known = {
            "bubble": lambda p: self.pop_bubbles(p.get("s", "0") == "1"), "semi": lambda p: self.semi_bubbles(float(p.get("r", 2))), "spur": lambda p: self.tips(float(p.get("r", 2))), "loop": lambda p: self.small_loops(),
            "transitive": lambda p: self.covered_branches(), "cross": lambda p: self.resolve_crosses(float(p.get("f", 2))), "bridge": lambda p: self.bridges(float(p.get("f", 2))), "duplicate": lambda p: self.duplicates(),
        }
        done: dict[str, int] = {}
        for i, part in enumerate(filter(None, strategy.split("|"))):
            name, *params = part.split(":")
            done[f"{name}-{i}"] = known[name](dict(x.split("=", 1) for x in params))
        return done


def most_different(paths: list[list[str]], alleles: dict[str, set[str]]) -> tuple[list[str], list[str]] | None:
    """The pair of paths whose allele sets differ most, then have most in common, then are longest."""
    sets = [set().union(*(alleles.get(n, set()) for n in p)) for p in paths]
    pairs = [(len(sets[i] ^ sets[j]), len(sets[i] & sets[j]), len(paths[i]) + len(paths[j]), -i, -j) for i in range(len(paths)) for j in range(i)]
    if not pairs:
        return None
    best = max(pairs)
    return paths[-best[4]], paths[-best[3]]


def is_diploid(a: list[str], b: list[str], inconsistent: set[tuple[str, str]], share: float = 0.3) -> bool:
    """More than a share of the reads of the shorter path have a partner on the other that they are inconsistent with."""
    short, long = sorted((a, b), key=len)
    hit = sum(any((x, y) in inconsistent or (y, x) in inconsistent for y in long) for x in short)
    return bool(short) and hit > share * len(short)
