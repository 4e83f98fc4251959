"""The configuration linear program of packing: few sequences for a histogram of lengths.

A variable stands for a filling of a sequence (how many pieces of each length), and every length must be covered. The
program is solved by multiplicative weights: lengths have prices, a knapsack dynamic program finds the dearest fillings,
their variables grow, and the weights in the prices of what they cover shrink exponentially. Bounds from below come from
dual solutions. Variables are rounded down; of what that leaves, fillings are taken once more in order of their fractions
as far as their pieces are there, or not, whichever needs fewer sequences, and the last pieces are packed best-fit
decreasing. All sizes of input go the same way."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

Filling = tuple[tuple[int, int], ...]


class Knapsack:
    """The fillings of greatest price for every capacity up to ``capacity``, with at most counts[s] pieces of length s."""

    def __init__(self, price: np.ndarray, counts: np.ndarray, capacity: int):
        self.takes = []
        for s in np.flatnonzero(counts[: capacity + 1]).tolist():
            most, k = min(int(counts[s]), capacity // s), 1
            while most > 0:  # doubling parts make up every number of pieces
                k = min(k, most)
                self.takes.append((s, k))
                most, k = most - k, 2 * k
        self.value, self.chosen = np.zeros(capacity + 1), np.zeros((capacity + 1, len(self.takes)), bool)
        for row, (s, k) in enumerate(self.takes):
            size = s * k
            better = self.value[: capacity + 1 - size] + price[s] * k
            self.chosen[size:, row] = better > self.value[size:] + 1e-12
            self.value[size:] = np.maximum(self.value[size:], better)

    def filling(self, capacity: int) -> dict[int, int]:
        found: dict[int, int] = defaultdict(int)
        row = len(self.takes)
        while row and (at := np.flatnonzero(self.chosen[capacity, :row])).size:
            row = int(at[-1])
            s, k = self.takes[row]
            found[s] += k
            capacity -= s * k
        return found


def solve(counts: np.ndarray, capacity: int, step: float, rate: float) -> dict[Filling, float]:
    """How often each filling is used, in fractions that cover all counts.

    The price of a length is its size, times an exponential weight in how much of it is still to be covered beside the rest.
    In a round the lengths that lag offer themselves, each with the dearest filling of what it leaves of a sequence; that
    filling's variable grows until it has covered the share ``step`` of one of its lengths, or one is covered whole. Rounds
    go on until all is covered; each covers a share of some length, so there are at most lengths / step of them."""
    need, size = counts.astype(float), np.arange(len(counts)) / capacity
    used: dict[Filling, float] = defaultdict(float)
    while (open_ := need > 1e-9).any():
        share = need / np.maximum(counts, 1)
        mean = float(need.sum() / counts.sum())
        dear = Knapsack(size * np.exp(rate * (share - mean)), np.where(open_, np.ceil(need), 0).astype(np.int64), capacity)
        lagging = np.flatnonzero(open_ & (share >= mean - step))
        for s in lagging[np.argsort(-share[lagging], kind="stable")].tolist():
            if need[s] <= 1e-9:
                continue
            filling = dear.filling(capacity - s)
            filling[s] += 1
            grow = min(min(step * counts[t], need[t]) / a for t, a in filling.items())
            if grow > 1e-12:
                used[tuple(sorted(filling.items()))] += grow
                for t, a in filling.items():
                    need[t] -= a * grow
        need[need <= 1e-9] = 0.0
    return used


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """A number of sequences that no packing goes below: the greatest of dual solutions. Prices are the sizes, and steps of
    them, floor((k + 1) size) / k, each over its dearest filling."""
    size = np.arange(len(counts))
    there = counts > 0
    found = 0.0
    for price in (size / capacity, *(((k + 1) * size // capacity) / k for k in range(1, 8))):
        dearest = Knapsack(price, np.where(there, capacity, 0), capacity).value[capacity]
        if dearest > 0:
            found = max(found, float(counts @ price) / dearest)
    return found


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings for all pieces of ``left``, longest first, each into the fullest sequence that takes it."""
    rooms: list[list] = []
    by_room: dict[int, list] = defaultdict(list)
    for s in np.flatnonzero(left)[::-1].tolist():
        n = int(left[s])
        while n:
            room = next((r for r in range(s, capacity + 1) if by_room[r]), None)
            if room is None:
                whole, n = divmod(n, capacity // s)
                if whole:
                    rooms.append([{s: capacity // s}, capacity - s * (capacity // s), whole])
                    by_room[rooms[-1][1]] += [rooms[-1]]
                if n:
                    rooms.append([{s: n}, capacity - s * n, 1])
                    by_room[rooms[-1][1]].append(rooms[-1])
                break
            found = by_room[room][-1]
            k = min(room // s, n) if found[2] == 1 else room // s
            times = min(found[2], n // k) if k and n >= k else 0
            if not times:  # fewer pieces than one sequence takes
                times, k = 1, n
            by_room[room].pop()
            if times < found[2]:
                rest = [dict(found[0]), room, found[2] - times]
                rooms.append(rest)
                by_room[room].append(rest)
                found[2] = times
            found[0][s] = found[0].get(s, 0) + k
            found[1] -= s * k
            by_room[found[1]].append(found)
            n -= k * times
    return [(dict(x[0]), x[2]) for x in rooms]


def rounded(used: dict[Filling, float], counts: np.ndarray, capacity: int, again: bool) -> list[tuple[dict[int, int], int]]:
    """Whole numbers of fillings that hold exactly the counts: fractions rounded down, with ``again`` each filling once more
    in order of its fraction as far as its pieces are there, and the rest best-fit decreasing."""
    left, out = counts.astype(np.int64).copy(), []

    def take(filling: Filling, times: int) -> None:
        if times > 0:
            out.append((dict(filling), times))
            for s, a in filling:
                left[s] -= a * times

    for filling, x in used.items():
        take(filling, min(int(x + 1e-9), *(int(left[s]) // a for s, a in filling)))
    for filling, x in sorted(used.items(), key=lambda f: (-(f[1] % 1), f[0])) if again else ():
        take(filling, min(1, *(int(left[s]) // a for s, a in filling)))
    return out + best_fit(left, capacity)


#: Steps and rates of the weights, from coarse to fine.
PACES = ((0.5, 2.0), (0.06, 2.0), (0.015, 6.0))


def configurations(counts: np.ndarray, capacity: int, gap: float = 0.005) -> tuple[list[tuple[dict[int, int], int]], float]:
    """(filling, how many sequences) that hold exactly the counts of pieces by length, and the lower bound on sequences.

    The program is solved at finer and finer paces until a plan is within ``gap`` of the bound or the finest is done; of all
    plans, each solution rounded in two ways and best-fit decreasing by itself, the one of fewest sequences is taken."""
    total = lambda plan: sum(m for _, m in plan)
    bound, plan = lower_bound(counts, capacity), None
    for step, rate in PACES if counts.any() else ():
        used = solve(counts, capacity, step, rate)
        plan = min([rounded(used, counts, capacity, True), rounded(used, counts, capacity, False), *([plan] if plan else [])], key=total)
        if total(plan) <= np.ceil(bound - 1e-6) * (1 + gap):
            break
    return min([best_fit(counts, capacity), *([plan] if plan else [])], key=lambda x: (total(x), plan is not None and x is not plan)), bound
