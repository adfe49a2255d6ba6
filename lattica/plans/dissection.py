"""Patterns as index arrays, and their multilevel nested dissection.

A pattern is halved by a separator that is found on a small image of it, in which heavily linked nodes are one, and bettered
on each larger image on the way back.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

COARSEST = 64  # nodes of the smallest image
SLACK = 0.2  # a side may hold this share more than half of all weight
IDLE_MOVES = 50  # moves without a gain before a pass ends
PIECE = 1 << 16  # parts of at most so many nodes may be ordered elsewhere
SENT = 1 << 24  # larger parts of at most so many nodes and links may be separated elsewhere: 64 MB
LISTED = 1 << 15  # nodes of a graph whose neighbours are held as lists, which are read faster and take ten times the space
SIDES = 0, 1
SEPARATOR = 2


@dataclass
class Graph:
    """A symmetric pattern without its diagonal: the neighbours of a, ascending, are near[start[a]:start[a + 1]]."""

    start: np.ndarray
    near: np.ndarray
    weight: np.ndarray  # nodes of the original pattern that a node stands for
    cost: np.ndarray  # links that an entry of near stands for
    listed: list[list[int]] | None = None

    def __len__(self) -> int:
        return len(self.weight)

    def __getitem__(self, a: int) -> np.ndarray:
        return self.near[self.start[a] : self.start[a + 1]]

    @property
    def source(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def lists(self) -> list[list[int]]:
        """The neighbours of each node, made once."""
        if self.listed is None:
            near, ends = self.near.tolist(), self.start.tolist()
            self.listed = [near[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return self.listed

    @classmethod
    def of(cls, n: int, a: np.ndarray, b: np.ndarray, cost: np.ndarray | None = None, weight: np.ndarray | None = None) -> Graph:
        """From links a, b that stand both ways; repeated ones are one, with the sum of their costs."""
        keep = a != b
        key, place = np.unique(a[keep].astype(np.int64) * n + b[keep], return_inverse=True)
        total = np.bincount(place, None if cost is None else cost[keep], minlength=len(key)).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(np.bincount(key // max(n, 1), minlength=n))]).astype(np.int64)
        return cls(start, key % max(n, 1), np.ones(n, dtype=np.int64) if weight is None else weight, total)

    def packed(self) -> bytes:
        """Four bytes an item; weights and costs that are all 1 take none."""
        return pickle.dumps([x.astype(np.int32) for x in (self.start, self.near)] + [None if (x == 1).all() else x.astype(np.int32) for x in (self.weight, self.cost)])

    @classmethod
    def unpacked(cls, data: bytes) -> Graph:
        start, near, weight, cost = pickle.loads(data)
        many = lambda x, n: np.ones(n, dtype=np.int64) if x is None else x.astype(np.int64)
        return cls(start.astype(np.int64), near.astype(np.int64), many(weight, len(start) - 1), many(cost, len(near)))

    def part(self, nodes: np.ndarray) -> Graph:
        """What stands among nodes, ascending, which get the numbers 0, 1, ... in their order; so links stay in order."""
        number = np.full(len(self), -1)
        number[nodes] = np.arange(len(nodes))
        a, b = number[self.source], number[self.near]
        keep = (a >= 0) & (b >= 0)
        start = np.concatenate([[0], np.cumsum(np.bincount(a[keep], minlength=len(nodes)))]).astype(np.int64)
        return Graph(start, b[keep], self.weight[nodes], self.cost[keep])

    def components(self) -> np.ndarray:
        """The least node that each node is linked to, in any number of steps."""
        label, a = np.arange(len(self)), self.source
        while True:
            before = label.copy()
            np.minimum.at(label, before[a], before[self.near])
            while (label != label[label]).any():
                label = label[label]
            if (label == before).all():
                return label


def adjacency(n: int, i: np.ndarray, j: np.ndarray) -> Graph:
    """The pattern of a matrix of which one triangle will do; 0-based."""
    i, j = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)
    g = Graph.of(n, np.concatenate([i, j]), np.concatenate([j, i]))
    g.cost[:] = 1
    return g


def minimum_degree(graph: Graph, nodes: Sequence[int] | None = None) -> list[int]:
    """Eliminates a node of least degree, ties by number, and makes its neighbours a clique, until none is left."""
    own = set(range(len(graph)) if nodes is None else nodes)
    near = {a: own.intersection(graph[a].tolist()) for a in own}
    heap = [(len(near[a]), a) for a in own]
    heapq.heapify(heap)
    order = []
    while heap:
        d, a = heapq.heappop(heap)
        if a not in near or d != len(near[a]):
            continue
        around = near.pop(a)
        order.append(a)
        for b in around:
            near[b] |= around
            near[b] -= {a, b}
            heapq.heappush(heap, (len(near[b]), b))
    return order


def coarser(g: Graph, heaviest: int) -> tuple[Graph, np.ndarray]:
    """The image in which matched nodes are one, and each node's number there.

    A node asks the neighbour to which its costliest link leads; two that ask each other are matched. Equal costs are told apart
    by a hash of the link, the same from both ends. Four rounds; no pair may weigh more than heaviest.
    """
    n, source, taken = len(g), g.source, np.arange(len(g))
    low, high = np.minimum(source, g.near).astype(np.uint64), np.maximum(source, g.near).astype(np.uint64)
    tie = (low * np.uint64(0x9E3779B97F4A7C15) + high) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(16)
    light = g.weight[source] + g.weight[g.near] <= heaviest
    for _ in range(4):
        free = taken == np.arange(n)
        able = np.flatnonzero(light & free[source] & free[g.near])
        if not len(able):
            break
        for worth in (g.cost, tie):  # what is left is the costliest of each node, then the largest hash of these
            first = np.flatnonzero(np.diff(source[able], prepend=-1))
            most = np.maximum.reduceat(worth[able], first)
            able = able[worth[able] == np.repeat(most, np.diff(first, append=len(able)))]
        last = np.flatnonzero(np.diff(source[able], append=n))
        asked = np.full(n, -1)
        asked[source[able[last]]] = g.near[able[last]]
        a = np.flatnonzero(asked >= 0)
        a = a[asked[asked[a]] == a]
        taken[a] = asked[a]
    _, number = np.unique(np.minimum(np.arange(n), taken), return_inverse=True)
    size = int(number.max()) + 1
    return Graph.of(size, number[source], number[g.near], g.cost, np.bincount(number, g.weight).astype(np.int64)), number


class Separation:
    """Each node of a graph is on side 0, on side 1 or in the separator; no link leads from side to side."""

    def __init__(self, g: Graph, where: Sequence[int]) -> None:
        self.g, self.near = g, g.lists() if len(g) <= LISTED else None
        self.weight, self.where = g.weight.tolist(), list(where)
        self.load = np.bincount(self.where, g.weight, minlength=3).astype(np.int64).tolist()
        self.most = (1 + SLACK) / 2 * sum(self.load)

    def around(self, a: int) -> list[int]:
        return self.g[a].tolist() if self.near is None else self.near[a]

    @property
    def score(self) -> tuple[float, int, int]:
        """To be small: what a side holds beyond its limit, then the separator, then the difference of the sides."""
        one, two, between = self.load
        over = (one if one > two else two) - self.most
        return over if over > 0 else 0.0, between, one - two if one > two else two - one

    def better(self) -> bool:
        """One pass: best moves first, each node leaves the separator once; what comes after the best state is undone.

        The gain of a move to a side is by how much the separator gets lighter, which calls in neighbours from the other side.
        """
        weight, where, load, most, around, push = self.weight, self.where, self.load, self.most, self.around, heapq.heappush
        offers: list[tuple[int, int, int, int]] = []
        gains: dict[int, tuple[int, int]] = {}  # as last offered, and so as they are: nodes whose neighbours move are offered again

        def offer(a: int) -> None:
            to_0 = to_1 = weight[a]
            for b in around(a):
                place = where[b]
                if place == 1:
                    to_0 -= weight[b]
                elif place == 0:
                    to_1 -= weight[b]
            gains[a] = to_0, to_1
            push(offers, (-to_0, load[0], a, 0))
            push(offers, (-to_1, load[1], a, 1))

        for a in np.flatnonzero(np.array(where) == SEPARATOR).tolist():
            offer(a)
        done: list[tuple[int, int, list[int]]] = []
        moved: set[int] = set()
        best, kept = self.score, 0
        while offers and len(done) - kept < IDLE_MOVES:
            value, _, a, s = heapq.heappop(offers)
            if a in moved or where[a] != SEPARATOR or gains[a][s] != -value or load[s] + weight[a] > most:
                continue
            other = 1 - s
            called = [b for b in around(a) if where[b] == other]
            where[a] = s
            load[s] += weight[a]
            moved.add(a)
            freed = -weight[a]
            for b in called:
                where[b] = SEPARATOR
                load[other] -= weight[b]
                freed += weight[b]
            load[SEPARATOR] += freed
            done.append((a, s, called))
            changed = set(called)
            for b in (a, *called):
                for c in around(b):
                    if where[c] == SEPARATOR:
                        changed.add(c)
            for c in changed:
                if c not in moved:
                    offer(c)
            if (now := self.score) < best:
                best, kept = now, len(done)
        for a, s, called in reversed(done[kept:]):
            where[a] = SEPARATOR
            load[s] -= weight[a]
            load[SEPARATOR] += weight[a]
            for b in called:
                where[b] = 1 - s
                load[1 - s] += weight[b]
                load[SEPARATOR] -= weight[b]
        return kept > 0

    def settled(self, passes: int = 6) -> Separation:
        while passes and self.better():
            passes -= 1
        return self


def grown(g: Graph, start: int) -> list[int]:
    """Side 0 grows around a node to half of all weight; those of it that touch the rest are the separator."""
    where, held, ahead, half = np.ones(len(g), dtype=np.int64), 0, [start], g.weight.sum() / 2
    seen = {start}
    for a in ahead:
        if held + g.weight[a] > half and held:
            break
        where[a] = 0
        held += g.weight[a]
        for b in g.lists()[a]:
            if b not in seen:
                seen.add(b)
                ahead.append(b)
    source = g.source
    where[source[(where[source] == 0) & (where[g.near] == 1)]] = SEPARATOR
    return where.tolist()


def separate(g: Graph) -> np.ndarray:
    """0, 1 or SEPARATOR of each node of a connected graph."""
    images: list[tuple[Graph, np.ndarray]] = []
    heaviest, small = max(2, int(1.5 * g.weight.sum() / COARSEST)), g
    while len(small) > COARSEST:
        image, number = coarser(small, heaviest)
        if len(image) > 0.95 * len(small):
            break
        images.append((small, number))
        small = image
    starts = np.unique(np.linspace(0, len(small) - 1, 8).astype(int)).tolist()
    found = min((Separation(small, grown(small, a)).settled() for a in starts), key=lambda x: x.score)
    for graph, number in reversed(images):
        found = Separation(graph, np.array(found.where)[number].tolist()).settled()
    return np.array(found.where)


#: Orders, or separates, each of some graphs, wherever it does so.
Dealer = Callable[[list[Graph]], list[np.ndarray]]


def nested_dissection(graph: Graph, leaf: int = 96, deal: Dealer | None = None, piece: int = PIECE, halve: Dealer | None = None, sent: int = SENT) -> list[int]:
    """Both sides of a separator first, each in the same way, then the separator; parts of at most leaf nodes by minimum degree.

    deal: orders parts of at most `piece` nodes of a larger graph. halve: separates larger parts of at most `sent` nodes and links,
    all that are known at a time. Each part is ordered and separated by itself, so the order is the same without.
    """
    order = np.empty(len(graph), dtype=np.int64)
    given: list[tuple[int, np.ndarray, Graph]] = []  # parts for deal to order, and where they stand in the order
    ahead: list[tuple[int, np.ndarray, Graph]] = [(0, np.arange(len(graph)), graph)]
    while ahead:
        whole: list[tuple[int, np.ndarray, Graph]] = []
        while ahead:
            at, nodes, g = ahead.pop()
            if deal and leaf < len(nodes) <= piece < len(graph):
                given.append((at, nodes, g))
                continue
            if len(nodes) <= leaf:
                order[at : at + len(nodes)] = nodes[minimum_degree(g)]
                continue
            label = g.components()
            sizes = np.bincount(label, minlength=len(nodes))
            few = np.flatnonzero(sizes[label] <= leaf)
            if len(few):  # small components go together
                order[at : at + len(few)] = nodes[few[minimum_degree(g.part(few))]]
                at += len(few)
            large = np.flatnonzero(sizes > leaf)
            if len(large) > 1 or len(few):
                members = np.argsort(label, kind="stable")
                ends = np.searchsorted(label[members], large, side="right")
                for k, end in zip(reversed(large.tolist()), reversed(ends.tolist()), strict=True):
                    own = members[end - sizes[k] : end]
                    ahead.append((at, nodes[own], g.part(own)))
                    at += len(own)
                continue
            whole.append((at, nodes, g))
        far = [halve is not None and piece < len(g) < len(graph) and len(g) + len(g.near) <= sent for _, _, g in whole]
        told = iter(halve([g for (_, _, g), f in zip(whole, far, strict=True) if f]) if halve and any(far) else [])
        for (at, nodes, g), f in zip(whole, far, strict=True):
            where = next(told) if f else separate(g)
            sides = [np.flatnonzero(where == s) for s in SIDES]
            if not len(sides[0]) or not len(sides[1]):
                order[at : at + len(nodes)] = nodes[minimum_degree(g)]
                continue
            for own in reversed(sides):  # as they are taken from a stack
                ahead.append((at, nodes[own], g.part(own)))
                at += len(own)
            order[at : at + int((where == SEPARATOR).sum())] = nodes[where == SEPARATOR]
    if given and deal:
        for (at, nodes, _), own in zip(given, deal([g for _, _, g in given]), strict=True):
            order[at : at + len(nodes)] = nodes[own]
    return order.tolist()
