"""Names of equal windows over sequences of symbols, in NumPy: the step inside a task of the two repeat operators.

A symbol is a 64-bit number (of a byte or of a word). Equal windows have equal names; a name of length h is made from
names of half that length, so the names of all positions cost O(log h) passes over an array.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_A, _B, _C = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
BYTE_SYMBOLS = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=U)
WORDS_KEPT = 200_000


class WordSymbols(dict):
    """Number of a word given as bytes; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Name of two neighbours; the order counts."""
    x = left * _A
    x += (right ^ (right >> U(31))) * _B
    x ^= x >> U(29)
    x *= _C
    x ^= x >> U(32)
    return x


def names(symbols: np.ndarray, length: int) -> np.ndarray:
    """Names of all windows of one length, by doubling; a rest that is no power of two overlaps."""
    cur, have = symbols, 1
    while have < length:
        step = min(have, length - have)
        cur = pair(cur[: len(cur) - step], cur[step:]) if len(cur) > step else cur[:0]
        have += step
    return cur


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least value in every window of width values."""
    at, low, have = np.arange(len(values), dtype=np.int32), values, 1
    while have < width:
        step = min(have, width - have)
        left, right = low[: len(low) - step], low[step:]
        smaller = right < left
        low = np.where(smaller, right, left)
        at = np.where(smaller, at[step:], at[: len(at) - step])
        have += step
    return at


def anchored_runs(symbols: np.ndarray, lengths: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows that share one anchor, over sequences laid end to end.

    Returns for each run the number of its sequence, the start in that sequence, the count of windows, the anchor's name
    and the place of the run's first symbol in symbols. No window crosses sequences.
    The anchor of a window is its leftmost part of length seed with the least name. It depends on the window's content
    alone, so equal windows have anchors of equal name at equal offsets; and two equal windows at different places are
    never in one run.
    """
    ends = np.cumsum(lengths)
    of = np.flatnonzero(lengths >= window)
    none = np.empty(0, np.int64)
    if not len(of):
        return none, none, none, none.astype(U), none
    parts = names(symbols, seed)
    at = window_argmin(parts, window - seed + 1)
    edge = np.zeros(len(at) + 1, np.int8)
    edge[ends[of] - lengths[of]] += 1
    edge[ends[of] - window + 1] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    last = np.empty(len(at), bool)
    last[-1] = True
    last[:-1] = (at[1:] != at[:-1]) | ~inside[1:]
    starts, stops = np.flatnonzero(new & inside), np.flatnonzero(last & inside)
    sequence = np.searchsorted(ends, starts, side="right")
    return sequence, starts - (ends - lengths)[sequence], stops - starts + 1, parts[at[starts]], starts


def covered(starts: np.ndarray, counts: np.ndarray, window: int, length: int) -> np.ndarray:
    """Which of length symbols lie in a window that starts in one of the runs."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0
