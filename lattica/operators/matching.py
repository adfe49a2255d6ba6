"""Matching kernels on one block of a matrix, in plain Python: exact assignment and auction."""

from __future__ import annotations

import heapq
from collections import deque
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Assignment:
    row_of: np.ndarray  # for each column its row, -1 if unmatched
    u: np.ndarray  # row duals
    v: np.ndarray  # column duals: u + v <= cost, equal where matched


def assign(m: int, n: int, rows: list[np.ndarray], costs: list[np.ndarray]) -> Assignment:
    """Least-cost assignment of the most columns, by shortest augmenting paths. rows, costs: those of each column, 0-based."""
    u, v = np.zeros(m), np.zeros(n)
    for j in range(n):
        v[j] = costs[j].min() if len(costs[j]) else 0.0
    row_of, owner = np.full(n, -1), np.full(m, -1)
    tight = [rows[j][costs[j] <= v[j]].tolist() for j in range(n)]
    for j in range(n):  # what is tight at the start is matched at once
        for i in tight[j]:
            if owner[i] < 0:
                row_of[j], owner[i] = i, j
                break
    for j in range(n):  # then by a column that gives up its row for another, free one
        for i in tight[j] if row_of[j] < 0 else []:
            held = int(owner[i])
            free = next((x for x in tight[held] if owner[x] < 0), -1)
            if free >= 0:
                row_of[held], owner[free] = free, held
                row_of[j], owner[i] = i, j
                break
    for start in range(n):
        if row_of[start] >= 0 or not len(rows[start]):
            continue
        dist: dict[int, float] = {}
        via: dict[int, int] = {}  # row -> the column it is reached from
        final: set[int] = set()
        seen_cols, heap, column, base, end = {start: 0.0}, [], start, 0.0, -1
        while True:
            for i, c in zip(rows[column].tolist(), costs[column].tolist(), strict=True):
                d = base + c - u[i] - v[column]
                if i not in final and d < dist.get(i, np.inf):
                    dist[i], via[i] = d, column
                    heapq.heappush(heap, (d, i))
            while heap and (heap[0][1] in final or heap[0][0] > dist[heap[0][1]]):
                heapq.heappop(heap)
            if not heap:
                break
            base, i = heapq.heappop(heap)
            final.add(i)
            if owner[i] < 0:
                end = i
                break
            column = int(owner[i])
            seen_cols[column] = base
        if end < 0:
            continue  # no augmenting path: the column stays unmatched
        for c, d in seen_cols.items():
            v[c] += base - d
        for i in final:
            u[i] -= base - dist[i]
        i = end
        while True:
            c = via[i]
            owner[i] = c
            row_of[c], i = i, row_of[c]
            if c == start:
                break
    return Assignment(row_of, u, v)


@dataclass(frozen=True)
class AuctionOptions:
    # Default limits of the auction.
    max_iterations: int = 30000
    max_unchanged: tuple[int, int, int] = (10, 100, 100)
    min_proportion: tuple[float, float, float] = (0.90, 0.0, 0.0)
    eps_initial: float = 0.01


@dataclass
class Auction:
    row_of: np.ndarray
    u: np.ndarray
    v: np.ndarray
    iterations: int = 0
    unmatchable: int = 0
    idle: set[int] = field(default_factory=set)


class Patience:
    """How long the number of open columns has stood still; it ends once that is long enough for the share that is matched."""

    def __init__(self, total: int, options: AuctionOptions) -> None:
        self.total, self.rules = total, list(zip(options.max_unchanged, options.min_proportion, strict=True))
        self.last, self.rounds = -1, 0

    def ended(self, open_: int) -> bool:
        self.rounds = self.rounds + 1 if open_ == self.last else 1
        self.last = open_
        matched = (self.total - open_) / self.total
        return any(self.rounds >= rounds and matched >= share for rounds, share in self.rules)


class Market:
    """Rows for sale at rising prices to columns, each of which gains by some of them."""

    def __init__(self, m: int, rows: list[np.ndarray], gains: list[np.ndarray]) -> None:
        self.rows, self.gains, self.price = rows, gains, np.zeros(m)
        self.holder: dict[int, int] = {}  # row -> column
        self.worth = np.array([g.max() if len(g) else 0.0 for g in gains])  # of columns, to themselves

    def bid(self, column: int, eps: float) -> tuple[bool, int | None]:
        """The column buys the row that it gains most by, if it gains at all, for what makes the next best as good, and eps more.

        Whether it bought, and the column that lost the row.
        """
        offer = self.gains[column] - self.price[self.rows[column]]
        at = int(offer.argmax())
        if offer[at] <= 0:
            return False, None
        others = np.concatenate([offer[:at], offer[at + 1 :]])
        next_best = float(others.max()) if len(others) else 0.0
        row = int(self.rows[column][at])
        self.price[row] += offer[at] - next_best + eps
        self.worth[column] = next_best - eps
        loser = self.holder.get(row)
        self.holder[row] = column
        return True, loser

    def settled(self, n: int) -> np.ndarray:
        """Row of each column; the worth of columns without one becomes the least that no entry of theirs exceeds."""
        row_of = np.full(n, -1)
        for row, column in self.holder.items():
            row_of[column] = row
        for column in np.flatnonzero(row_of < 0).tolist():
            if len(self.rows[column]):
                self.worth[column] = (self.gains[column] - self.price[self.rows[column]]).max()
        return row_of


def auction(m: int, n: int, rows: list[np.ndarray], gains: list[np.ndarray], options: AuctionOptions = AuctionOptions()) -> Auction:
    """Columns bid for rows of largest gain minus price, each raising its row's price by its margin plus eps.

    Bidders queue; who loses a row bids again in the next round, whose eps is larger by 1 / (n + 1), up to 1. A column
    without a positive offer drops out. It ends when no column is open, or when patience does.
    """
    market, patience = Market(m, rows, gains), Patience(max(min(m, n), 1), options)
    queue, dropped = deque(column for column in range(n) if len(rows[column])), set()
    number = 0
    while number < options.max_iterations:
        open_ = min(m, n) - len(market.holder) - len(dropped)
        if open_ == 0 or patience.ended(open_):
            break
        eps = min(1.0, options.eps_initial + (number + 1) / (n + 1))
        for _ in range(len(queue)):
            column = queue.popleft()
            bought, loser = market.bid(column, eps)
            if not bought:
                dropped.add(column)
            elif loser is not None:
                queue.append(loser)
        number += 1
    return Auction(market.settled(n), market.price, market.worth, min(number, options.max_iterations - 1), len(dropped), dropped)
