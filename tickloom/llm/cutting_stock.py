"""The cutting-stock problem over a histogram of lengths, by column generation.

A pattern says how many pieces of each length share one sequence.  The linear program
asks for the fewest sequences, in fractions of patterns, that hold all pieces.  It
starts from patterns that a first-fit walk down the histogram makes, each of which uses
up one length; then the dual price of every length goes into a knapsack, solved by
dynamic programming over the capacity, whose best filling is the next pattern to enter.
It ends when no filling is worth more than a sequence, when the bound of the prices
shows that fewer sequences by `gap` are impossible, or when PATIENCE columns together
save less than that.  Demands are raised by a hair, each by its own, so that no two
patterns run out at once and every column makes progress.

Everything here has the size of the capacity (at most one row for each length), whatever
the number of pieces."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GAP = 0.00005
PATIENCE = 50
#: Share of a piece by which demands are raised at most.
HAIR = 1e-3
#: Below this a number of the solver counts as zero.
TINY = 1e-9


@dataclass
class Solution:
    """`patterns`: {length: pieces} of each pattern; `amounts`: how many sequences of
    each, in fractions; `bound`: no filling needs fewer; `rounds`: columns generated."""

    patterns: list[dict[int, int]]
    amounts: np.ndarray
    bound: float
    rounds: int


def walk(capacity: int, sizes: np.ndarray, left: np.ndarray) -> dict[int, int]:
    """The longest piece left, then the longest that still fit, as {index: pieces}."""
    live = np.flatnonzero(left > 0)
    room, pattern, i = capacity, {}, len(live) - 1
    while room and i >= 0:
        k = live[i]
        times = int(min(room // sizes[k], np.ceil(left[k])))
        if times:
            pattern[int(k)] = times
            room -= times * int(sizes[k])
        i = min(i - 1, int(np.searchsorted(sizes[live], room, side="right")) - 1)
    return pattern


def first_patterns(capacity: int, sizes: np.ndarray, demand: np.ndarray) -> list[tuple[int, dict[int, int], float]]:
    """(length used up, pattern, amount) for every length, a basis of the program: each
    walk is repeated until one length is used up, which no later pattern has.  Lengths
    used up at the same time get a pattern of their own, taken 0 times."""
    left = demand.astype(float).copy()
    out = []
    while (left > 0).any():
        pattern = walk(capacity, sizes, left)
        used = np.array(list(pattern))
        per = np.array(list(pattern.values()), float)
        amount = float((left[used] / per).min())
        left[used] -= amount * per
        gone = [int(k) for k in used if left[k] <= TINY * max(1.0, demand[k])]
        out.append((gone[0], pattern, amount))
        out += [(k, {k: max(1, capacity // int(sizes[k]))}, 0.0) for k in gone[1:]]
        left[gone] = 0
    return out


class Basis:
    """The inverse of the matrix whose column r is the pattern that row r stands for.  It
    grows from the identity by exchanging one column at a time, which touches only the
    rows that the new pattern reaches."""

    def __init__(self, m: int):
        self.inverse = np.eye(m)
        self.price = np.zeros(m)

    def step(self, pattern: dict[int, int]) -> np.ndarray:
        """The pattern in terms of those of the basis."""
        return (self.inverse[:, list(pattern)] * np.array(list(pattern.values()), float)).sum(axis=1)

    def enter(self, r: int, pattern: dict[int, int], step: np.ndarray) -> None:
        row = self.inverse[r] / step[r]
        worth = sum(self.price[k] * n for k, n in pattern.items())
        self.price = self.price + (1 - worth) * row
        step = step.copy()
        step[r] -= 1
        moved = np.flatnonzero(np.abs(step) > TINY)
        self.inverse[moved] -= np.outer(step[moved], row)


def best_filling(capacity: int, sizes: np.ndarray, price: np.ndarray) -> tuple[float, dict[int, int]]:
    """The most valuable pieces, any number of each, that fit the capacity: its value and
    {index of the length: pieces}."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fit = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        n = fit[room]
        best = value[room - 1]
        if n:
            got = value[room - sizes[:n]] + price[:n]
            k = int(got.argmax())
            if got[k] > best + TINY:
                best, choice[room] = got[k], k
        value[room] = best
    room, pattern = capacity, {}
    while room > 0:
        k = int(choice[room])
        if k < 0:
            room -= 1
            continue
        pattern[k] = pattern.get(k, 0) + 1
        room -= int(sizes[k])
    return float(value[capacity]), pattern


def solve(capacity: int, counts: dict[int, int], gap: float = GAP) -> Solution:
    """Patterns and amounts for {length: pieces}, lengths from 1 to the capacity."""
    sizes = np.array(sorted(s for s, n in counts.items() if n), np.int64)
    m = len(sizes)
    if not m:
        return Solution([], np.zeros(0), 0.0, 0)
    demand = np.array([counts[int(s)] for s in sizes], float) + HAIR * (1 + np.arange(m) * 0.6180339887498949 % 1) / 2
    patterns: list[dict[int, int]] = [{}] * m
    amount, basis = np.zeros(m), Basis(m)
    # the last ones first: each has no length that an earlier one used up
    for r, pattern, x in reversed(first_patterns(capacity, sizes, demand)):
        basis.enter(r, pattern, basis.step(pattern))
        patterns[r], amount[r] = pattern, x
    bound, rounds = float((sizes * demand).sum()) / capacity, 0
    seen = [amount.sum()]
    while amount.sum() > bound * (1 + gap):
        if rounds % PATIENCE == 0 and rounds:
            if seen[-1] - amount.sum() < gap * amount.sum():
                break
            seen.append(amount.sum())
        price = np.maximum(basis.price, 0)
        worth, pattern = best_filling(capacity, sizes, price)
        bound = max(bound, float((price * demand).sum()) / max(worth, 1.0))
        if worth <= 1 + 1e-7:
            break
        rounds += 1
        step = basis.step(pattern)
        ratio = np.full(m, np.inf)
        able = step > TINY
        ratio[able] = amount[able] / step[able]
        r = int(ratio.argmin())
        amount = np.maximum(amount - ratio[r] * step, 0)
        amount[r] = ratio[r]
        patterns[r] = pattern
        basis.enter(r, pattern, step)
    return Solution([{int(sizes[k]): n for k, n in p.items()} for p in patterns], amount, bound, rounds)


def whole(solution: Solution, counts: dict[int, int], capacity: int, room: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, sequences): amounts rounded down, never more pieces than there are.  Of
    the pieces left over, fewer than the basis has room for, further walks are taken
    where they leave less than `room` of a sequence."""
    left, out = dict(counts), []
    for pattern, x in zip(solution.patterns, solution.amounts):
        times = min([int(np.floor(x + 1e-6)), *[left[s] // n for s, n in pattern.items()]])
        if times > 0:
            for s, n in pattern.items():
                left[s] -= times * n
            out.append((pattern, times))
    sizes = np.array(sorted(s for s, n in left.items() if n), np.int64)
    more = np.array([left[int(s)] for s in sizes], np.int64)
    while (more > 0).any():
        found = walk(capacity, sizes, more)
        used, per = np.array(list(found)), np.array(list(found.values()))
        times = int((more[used] // per).min())
        more[used] -= times * per
        if capacity - int((sizes[used] * per).sum()) < room:
            out.append(({int(sizes[k]): n for k, n in found.items()}, times))
    return out
