"""An FM-index over a sequence of small integers: wavelet-matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, by rank doubling. Symbol 0 ends a run: no two of them compare equal.

    The rounds grow with the logarithm of the longest repeat inside a run.
    """
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends), symbols.astype(np.int64) + np.count_nonzero(ends))
    reach = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - reach)] = rank[reach:]
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        step = np.ones(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        reach *= 2
        if not n or rank.max() == n:
            return order


class WaveletMatrix:
    """Ranks in a sequence of integers below `size`, one bit vector with running counts per binary digit."""

    def __init__(self, values: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, at = np.zeros_like(at), at.copy()
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            one = ((symbol >> level) & 1).astype(bool)
            low = np.where(one, zeros + ones[low], low - ones[low])
            at = np.where(one, zeros + ones[at], at - ones[at])
        return at - low


class FMIndex:
    """Search runs of integers in [1, size), each run ended by a 0, for patterns without 0.

    Every `sample`-th position and every start of a run is sampled, so a walk back never leaves its run.
    """

    def __init__(self, symbols: np.ndarray, size: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        self.n, self.last = len(symbols), symbols[order - 1]  # the symbol before each suffix; at the start an end
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))]).astype(np.int64)
        self.tree = WaveletMatrix(self.last.astype(np.int64), size)
        kept = (order % sample == 0) | (self.last == 0)
        self.kept, self.places = kept, np.concatenate([[0], np.cumsum(kept)])
        self.sampled = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last row of each pattern; patterns are the rows of a matrix, padded at the end."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            symbol = patterns[live, lengths[live] - step].astype(np.int64)
            ends = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live] = self.before[symbol] + ends[: len(live)]
            high[live] = self.before[symbol] + ends[len(live):]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: walk back until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.kept[rows])
        while len(todo):
            symbol = self.last[rows[todo]].astype(np.int64)
            rows[todo] = self.before[symbol] + self.tree.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.kept[rows[todo]]]
        return self.sampled[self.places[rows]] + steps
