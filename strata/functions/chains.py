"""Heaviest order-keeping chains over scored pairs: both score tables, one best chain, and what else could be in one.

A chain takes pairs (i, j) that grow on both sides.  Only given pairs are visited, in the order of i, with a Fenwick tree of the
best sum so far over j, so a group costs n log n in its pairs, however long its sides.
"""

from __future__ import annotations

from itertools import groupby

Pair = tuple[int, int, int]  # (i, j, score); scores are whole numbers, so that sums compare exactly


class _Most:
    """The largest value put in at places before one asked for."""

    def __init__(self, size: int):
        self.tree = [0] * (size + 1)

    def put(self, place: int, value: int) -> None:
        place += 1
        while place < len(self.tree):
            self.tree[place] = max(self.tree[place], value)
            place += place & -place

    def before(self, place: int) -> int:
        most = 0
        while place:
            most = max(most, self.tree[place])
            place &= place - 1
        return most


def _ending(pairs: list[Pair]) -> list[int]:
    """For each pair, sorted by i, the best sum of a chain that ends with it."""
    places = {j: k for k, j in enumerate(sorted({j for _, j, _ in pairs}))}
    most, out = _Most(len(places)), []
    for _, row in groupby(pairs, key=lambda p: p[0]):
        row = [(places[j], s) for _, j, s in row]
        sums = [s + most.before(j) for j, s in row]  # all of a row before any of it counts
        for (j, _), total in zip(row, sums, strict=True):
            most.put(j, total)
        out += sums
    return out


def tables(pairs: list[Pair]) -> tuple[list[int], list[int]]:
    """For each pair, sorted by (i, j), the best sum of a chain that ends with it and of one that begins with it."""
    turned = [(-i, -j, s) for i, j, s in reversed(pairs)]
    return _ending(pairs), _ending(turned)[::-1]


def best_chain(pairs: list[Pair], begins: list[int]) -> list[int]:
    """Places in ``pairs`` of one heaviest chain.

    Of several, the one that a walk finds which passes over items of the left side first while that loses nothing: at each step the
    first pair at the very next place of the right side if it is one, else the last left item that a heaviest rest can begin with.
    """
    by_worth: dict[int, list[int]] = {}
    for k, worth in enumerate(begins):
        by_worth.setdefault(worth, []).append(k)
    left, i, j, out = max(begins, default=0), -1, -1, []
    while left > 0:
        open_ = [k for k in by_worth.get(left, ()) if pairs[k][0] > i and pairs[k][1] > j]
        here = min((k for k in open_ if pairs[k][1] == j + 1), default=None)
        if here is None:
            row = max(pairs[k][0] for k in open_)
            here = min(k for k in open_ if pairs[k][0] == row)
        i, j, worth = pairs[here]
        left -= worth
        out.append(here)
    return out


def aligned(pairs: list[Pair], near: int) -> list[tuple[int, int, int, bool]]:
    """A heaviest chain as (i, j, score, whether another i could stand in for it).

    Another could if it scores with j at most ``near`` less, or if a chain through it is at most ``near`` lighter than the heaviest.
    """
    pairs = sorted(p for p in pairs if p[2] > 0)
    ends, begins = tables(pairs)
    best = max(begins, default=0)
    by_j: dict[int, list[int]] = {}
    for k, (_, j, _) in enumerate(pairs):
        by_j.setdefault(j, []).append(k)
    out = []
    for k in best_chain(pairs, begins):
        i, j, s = pairs[k]
        others = [o for o in by_j[j] if o != k]
        tie = any(pairs[o][2] >= s - near or best - (ends[o] + begins[o] - pairs[o][2]) <= near for o in others)
        out.append((i, j, s, tie))
    return out
