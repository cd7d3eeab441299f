"""Bin configurations for a histogram of lengths: the configuration linear program by multiplicative weights, then rounded.

Everything here works on the histogram, at most capacity numbers, so it costs the same for any number of pieces.

* Lengths over capacity / SMALL are dealt into groups of at most ITEMS lengths that spread over the whole range; a length with more
  than an ITEMS-th of the pieces is in every group with a share of its pieces. Shorter lengths only fill what is left.
* The linear program of a group covers each of its lengths by patterns (multisets that fit) with as few bins as possible. Its dual
  weights start at length / capacity; each step prices the best pattern by knapsack dynamic programming, takes it until one of its
  lengths is covered once more and lowers the weights of what it covers, until every length is covered TIMES times.
* Amounts of patterns are rounded down to whole bins, the fullest first, and none is taken beyond the pieces there are. What the
  rounding leaves is dealt into groups again, once for each of CYCLES. The rest and the short lengths go where they fit best, longest first, a
  whole group of equal bins at a time; new bins are opened last. This is done after every cycle, and the fewest bins count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np

SMALL, ITEMS, TIMES, EPSILON = 8, 64, 4, 0.1
CYCLES = (512, 128)  # a cycle takes patterns with at most this part of the capacity left as room


@dataclass
class Bins:
    """count equal bins: how many pieces of which length each holds, and the room left in each."""

    count: int
    room: int
    holds: Counter = field(default_factory=Counter)


def best_pattern(lengths: list[int], weights: np.ndarray, counts: list[int], capacity: int) -> dict[int, int]:
    """Places and multiplicities of a heaviest multiset of at most counts pieces: a knapsack by dynamic programming."""
    value = np.zeros(capacity + 1)
    took = np.zeros((len(lengths), capacity + 1), np.int16)
    for i, n in enumerate(lengths):
        for _ in range(min(counts[i], capacity // n)):
            with_one = value[:-n] + weights[i]
            better = with_one > value[n:]
            if not better.any():
                break
            # one piece more than the best choice at the room left by it
            more = np.where(better, took[i, :-n] + 1, took[i, n:])
            value[n:] = np.where(better, with_one, value[n:])
            took[i, n:] = more
    out, room = {}, capacity
    for i in range(len(lengths) - 1, -1, -1):
        k = int(took[i, room])
        if k:
            out[i] = k
            room -= k * lengths[i]
    return out


def linear_program(lengths: list[int], counts: list[int], capacity: int) -> dict[tuple, float]:
    """Patterns ((place, multiplicity), ...) and how many bins of each; together they cover every length about once."""
    number = np.array(counts, float)
    weights, covered, amounts = np.array(lengths) / capacity, np.zeros(len(lengths)), defaultdict(float)
    while (covered < TIMES).any():
        found = best_pattern(lengths, np.where(covered < TIMES, weights, 0.0), counts, capacity)
        at, times = np.array(list(found)), np.array(list(found.values()))
        step = float((number[at] / times).min())
        amounts[tuple(found.items())] += step
        covered[at] += step * times / number[at]
        weights[at] *= np.exp(-EPSILON * step * times / number[at])
    return {p: amount / TIMES for p, amount in amounts.items()}


def _dealt(left: Counter, least: int):
    """Groups of lengths over `least` with the counts to pack of each, as left shrinks."""
    lengths = sorted(n for n in left if n > least)
    share = sum(left[n] for n in lengths) / ITEMS
    heavy, light = [n for n in lengths if left[n] > share], [n for n in lengths if left[n] <= share]
    groups = max(1, -(-len(light) // max(1, ITEMS - len(heavy))))
    for g in range(groups):
        counts = {n: left[n] // (groups - g) for n in heavy} | {n: left[n] for n in light[g::groups]}
        if counts := {n: c for n, c in sorted(counts.items()) if c}:
            yield list(counts), list(counts.values())


def _best_fit(bins: list[Bins], left: Counter, capacity: int) -> list[Bins]:
    """Puts what is left where it fits best, longest first, into groups of equal bins; opens bins for the rest."""
    by_room: list[list[Bins]] = [[] for _ in range(capacity + 1)]
    for b in bins:
        by_room[b.room].append(b)
    some = np.array([bool(x) for x in by_room])

    def put(b: Bins) -> None:
        by_room[b.room].append(b)
        some[b.room] = True

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            room = n + int(np.argmax(some[n:]))
            if some[room]:
                b = by_room[room].pop()
                some[room] = bool(by_room[room])
            else:
                b = Bins(-(-count // (capacity // n)), capacity)
            each = min(b.room // n, count)
            full = min(b.count, count // each)
            if full < b.count:
                put(Bins(b.count - full, b.room, b.holds))
            put(Bins(full, b.room - each * n, b.holds + Counter({n: each})))
            count -= full * each
    return [b for group in by_room for b in group]


def configurations(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Groups of equal bins that together hold exactly the pieces of a histogram {length: count}; lengths from 1 to capacity."""
    left = Counter({n: c for n, c in histogram.items() if c})
    whole = left.pop(capacity, 0)
    bins = [Bins(whole, 0, Counter({capacity: 1}))] if whole else []
    found = [_best_fit(bins, left, capacity)] if not any(n > capacity // SMALL for n in left) else []
    for part in () if found else CYCLES:
        for lengths, counts in _dealt(left, capacity // SMALL):
            program = linear_program(lengths, counts, capacity)
            for pattern, amount in sorted(program.items(), key=lambda x: (-sum(lengths[i] * k for i, k in x[0]), -x[1], x[0])):
                if capacity - sum(lengths[i] * k for i, k in pattern) > capacity // part:
                    break
                copies = min(int(amount + 1e-9), *(left[lengths[i]] // k for i, k in pattern))
                if copies:
                    holds = Counter({lengths[i]: k for i, k in pattern})
                    left -= Counter({n: k * copies for n, k in holds.items()})
                    bins.append(Bins(copies, capacity - sum(n * k for n, k in holds.items()), holds))
        found.append(_best_fit(bins, left, capacity))
    return min(found, key=lambda x: sum(b.count for b in x))
