"""The configuration linear program of packing (operator 13), over a histogram of lengths.

A configuration is a set of lengths that fit one sequence together.  The program asks for amounts of configurations, as few as
can be, that hold every length as often as it occurs.  It has more configurations than anyone could write down; multiplicative
weights solve it without: every length has a price, which falls exponentially with how much of it is covered, and a knapsack by
dynamic programming finds the configurations of the highest price among all (``price``).  Prices that no configuration exceeds
by more than 1 prove a lower bound on the number of sequences, which is kept.

The amounts are then rounded: the largest first, up to a whole number as long as pieces are left.  What remains is packed
longest first, each time with the longest pieces that still fit, as often as all of these are there.

Everything depends on the histogram alone: its size is bounded by the capacity, the number of configurations by ``ROUNDS`` x
``WIDTH`` and two for each length, however many pieces there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

ROUNDS, WIDTH = 160, 256
#: At most this share of a length is covered in a round; prices fall by this factor in the exponent; lengths whose best
#: configuration is worth so much less than the best of all wait.
STEP, RATE, SLACK = 0.25, 1.5, 0.02
#: Rounding leaves out configurations that are worth so much less than 1 at the proving prices.
ROUND_SLACK = 0.005
#: The program is solved when its amounts are within this of the lower bound.
CLOSE = 0.001

#: Pairs (length, times), the longest first.
Configuration = tuple[tuple[int, int], ...]


def price(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each capacity 0 to n the highest price of lengths that fit, and the longest of them that leads there (0: a place
    stays empty).  prices[l] is the price of length l, minus infinity where there is none."""
    n = len(prices) - 1
    best, pick = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    down = prices[::-1].copy()
    for c in range(1, n + 1):
        worth = down[n - c : n] + best[:c]  # lengths c to 1
        k = int(worth.argmax())
        if worth[k] >= best[c - 1]:
            best[c], pick[c] = worth[k], c - k
        else:
            best[c] = best[c - 1]
    return best, pick


def _configurations(first: np.ndarray, pick: np.ndarray, most: np.ndarray) -> list[Configuration]:
    """For each length, it with the best that fits beside it, as pairs (length, times), no length more often than it occurs."""
    capacity, out = len(pick) - 1, []
    for length in first.tolist():
        found, c = {length: 1}, capacity - length
        while c > 0:
            got = int(pick[c])
            if got:
                found[got] = found.get(got, 0) + 1
            c -= got or 1
        out.append(tuple((size, min(times, int(most[size]))) for size, times in sorted(found.items(), reverse=True)))
    return out


def solve(counts: np.ndarray) -> tuple[dict[Configuration, float], np.ndarray, float]:
    """Amounts of configurations that cover counts[l] pieces of each length l, the prices that proved the highest lower bound on
    their sum (no configuration is worth more than 1), and that bound."""
    capacity = len(counts) - 1
    lengths = np.flatnonzero(counts)
    amounts: dict[Configuration, float] = {}
    covered, bound, proof = np.zeros(capacity + 1), 0.0, np.zeros(capacity + 1)
    start = np.where(counts > 0, np.arange(capacity + 1) / capacity, -np.inf)
    for _ in range(ROUNDS if len(lengths) else 0):
        prices = start.copy()
        prices[lengths] *= np.exp(-RATE * (covered[lengths] - covered[lengths].min()))
        best, pick = price(prices)
        value = float((counts[lengths] * prices[lengths]).sum() / best[-1])
        if value > bound:
            bound, proof[lengths] = value, prices[lengths] / best[-1]
        worth = prices[lengths] + best[capacity - lengths]
        good = lengths[worth >= (1 - SLACK) * best[-1]]
        good = good[np.argsort(-prices[good] * counts[good], kind="stable")[:WIDTH]]
        chosen = list(dict.fromkeys(_configurations(good, pick, counts)))
        load = np.zeros(capacity + 1)
        for c in chosen:
            for size, times in c:
                load[size] += times
        for c in chosen:
            amount = STEP * min(counts[size] / load[size] for size, _ in c)
            amounts[c] = amounts.get(c, 0.0) + amount
            for size, times in c:
                covered[size] += amount * times / counts[size]
        least = covered[lengths].min()
        if least > 0 and sum(amounts.values()) / least <= bound * (1 + CLOSE):
            break
    least = covered[lengths].min() if len(lengths) else 1.0
    return {c: a / max(least, STEP / 2) for c, a in amounts.items()}, proof, bound


class Plan(NamedTuple):
    """Which sequence and place the pieces of each length get, in order of their numbers: entry i serves the pieces ``first[i]``
    to the next entry's first of its ``length``, ``times`` to a sequence, from sequence ``sequence`` and place ``offset`` on."""

    length: np.ndarray
    first: np.ndarray
    times: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    bound: float

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and number within the length."""
        wide = int(max(self.first.max(initial=0), number.max(initial=0))) + 1
        if wide * (int(self.length.max(initial=0)) + 1) >= 1 << 63:
            raise ValueError("too many pieces of one length")
        at = np.searchsorted(self.length * wide + self.first, length * wide + number, "right") - 1
        k = number - self.first[at]
        return self.sequence[at] + k // self.times[at], self.offset[at] + k % self.times[at] * length


def _longest_first(left: np.ndarray) -> Configuration:
    capacity, out = len(left) - 1, []
    room = capacity
    sizes = np.flatnonzero(left)
    while len(sizes) and sizes[0] <= room:
        size = int(sizes[np.searchsorted(sizes, room, "right") - 1])
        times = min(int(left[size]), room // size)
        out.append((size, times))
        room -= times * size
        sizes = sizes[: np.searchsorted(sizes, size)]
    return tuple(out)


def plan(counts: np.ndarray) -> Plan:
    """counts[l] pieces of each length l up to the capacity, in whole configurations."""
    counts = np.asarray(counts, np.int64)
    left = counts.copy()
    amounts, prices, bound = solve(counts)
    amounts = {c: a for c, a in amounts.items() if sum(prices[size] * times for size, times in c) >= 1 - ROUND_SLACK}
    used: list[tuple[Configuration, int]] = []
    for c, amount in sorted(amounts.items(), key=lambda x: (-x[1], x[0])):
        n = min(int(np.ceil(amount - 1e-9)), *(int(left[size]) // times for size, times in c))
        if n > 0:
            used.append((c, n))
            for size, times in c:
                left[size] -= n * times
    while left.any():
        c = _longest_first(left)
        n = min(int(left[size]) // times for size, times in c)
        used.append((c, n))
        for size, times in c:
            left[size] -= n * times
    taken, sequence, rows = np.zeros(len(counts), np.int64), 0, []
    for c, n in used:
        offset = 0
        for size, times in c:
            rows.append((size, int(taken[size]), times, sequence, offset))
            taken[size] += n * times
            offset += size * times
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return Plan(*table, sequence, bound)
