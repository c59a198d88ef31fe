"""An FM-index over one shard of word numbers, searched for many phrases at once."""

from __future__ import annotations

import numpy as np

#: Every so many positions the suffix array is kept; walks to one of them take fewer steps than this.
SAMPLE = 32


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order; 0 is a separator, all of them different and smaller than the rest.

    Doubles the compared length each round; a suffix is settled at its first separator at the latest,
    so the longest run of words bounds the rounds, not the repeats in the shard.
    """
    n = len(symbols)
    breaks = symbols == 0
    n_breaks = int(breaks.sum())
    rank = symbols.astype(np.int64) + n_breaks
    rank[breaks] = np.arange(1, n_breaks + 1)
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        ordered = rank[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], ordered[1:] != ordered[:-1])))
        if n == 0 or rank[order[-1]] == n:
            return order
        after = np.zeros(n, dtype=np.int64)
        after[: n - width] = rank[width:] if width < n else 0
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        width *= 2


class FMIndex:
    """``symbols``: word numbers from 1, 0 between runs; it starts and ends with 0.

    The Burrows-Wheeler transform is held in a wavelet matrix, a level per bit of a symbol; a rank is
    one lookup a level. Suffix positions are kept for every SAMPLE-th place and for the first word of
    each run, so that a walk back never crosses a separator.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        order = suffix_array(symbols)
        transform = symbols[order - 1]
        top = int(symbols.max()) if len(symbols) else 0
        self.size = len(symbols)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=top + 1))))
        self.levels = []
        rest = transform
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            zeros = np.concatenate(([0], np.cumsum(1 - ones))).astype(np.int32)
            self.levels.append((bit, zeros))
            rest = np.concatenate((rest[ones == 0], rest[ones == 1]))
        self.transform = transform
        marked = (order % SAMPLE == 0) | (transform == 0)
        self.marked = marked
        self.marks_before = np.concatenate(([0], np.cumsum(marked)))
        self.sampled = order[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place of the transform."""
        low = np.zeros_like(at)
        high = at.copy()
        for bit, zeros in self.levels:
            total = int(zeros[-1])
            one = (symbol >> bit) & 1 == 1
            low = np.where(one, low - zeros[low] + total, zeros[low])
            high = np.where(one, high - zeros[high] + total, zeros[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffix array that start with each phrase (one a row, all equally long)."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        alive = np.arange(len(phrases))
        known = len(self.below) - 1
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            fits = symbol < known
            high[alive[~fits]] = low[alive[~fits]]
            alive, symbol = alive[fits], symbol[fits]
            low[alive] = self.below[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.below[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in the shard the suffixes of these rows start."""
        place = np.zeros(len(rows), dtype=np.int64)
        waiting, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(waiting):
            done = self.marked[at]
            place[waiting[done]] = self.sampled[self.marks_before[at[done]]] + steps
            waiting, at = waiting[~done], at[~done]
            symbol = self.transform[at]
            at = self.below[symbol] + self.rank(symbol, at)
            steps += 1
        return place
