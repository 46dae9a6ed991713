"""An FM-index over a sequence of symbols, with numpy.

Symbols are 1..V; 0 separates passages. The Burrows-Wheeler transform is kept
in a wavelet matrix (one bit vector with ranks per bit of a symbol), so the
count of a symbol before any row takes one step per bit. Suffix positions are
kept for every ``SAMPLE``-th place and for the first place of a passage; other
rows walk back to one of these. All queries run on whole arrays of patterns.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; separators are unique, in order of place."""
    n = len(symbols)
    gap = symbols == 0
    rank = symbols.astype(np.int64) + int(gap.sum()) - 1
    rank[gap] = np.arange(int(gap.sum()))
    width, order = 1, np.argsort(rank, kind="stable")
    while True:
        top = int(rank.max()) + 2
        second = np.zeros(n, dtype=np.int64)
        second[: max(n - width, 0)] = rank[width:] + 1
        key = rank * top + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, width = fresh, width * 2
        if int(rank.max()) == n - 1 or width >= n:
            return order


class FMIndex:
    """Backward search and location over ``symbols`` (the last one must be 0)."""

    def __init__(self, symbols: np.ndarray, vocabulary: int):
        n = len(symbols)
        order = suffix_array(symbols)
        last = symbols[order - 1].astype(np.int64)  # place 0 follows the closing separator
        self.levels = max(1, int(vocabulary).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = last
        for level in reversed(range(self.levels)):
            bits = (current >> level) & 1
            ranks = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(bits, out=ranks[1:])
            self.ones.append(ranks)
            self.zeros.append(n - int(ranks[-1]))
            current = np.concatenate([current[bits == 0], current[bits == 1]])
        counts = np.bincount(symbols, minlength=vocabulary + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])[: vocabulary + 1].astype(np.int64)
        self.n = n
        kept = np.arange(n) % SAMPLE == 0
        kept[0] = True
        kept[1:] |= symbols[:-1] == 0
        marked = kept[order]
        self.marks = marked
        self.mark_rank = np.cumsum(marked) - 1
        self.positions = order[marked]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each row of the transform."""
        at, start = row.astype(np.int64), np.zeros(len(row), dtype=np.int64)
        for i, level in enumerate(reversed(range(self.levels))):
            bit = ((symbol >> level) & 1).astype(bool)
            ones = self.ones[i]
            one_at, one_start = ones[at].astype(np.int64), ones[start].astype(np.int64)
            at = np.where(bit, self.zeros[i] + one_at, at - one_at)
            start = np.where(bit, self.zeros[i] + one_start, start - one_start)
        return at - start

    def symbol(self, row: np.ndarray) -> np.ndarray:
        """The symbol before each row's suffix."""
        at, out = row.astype(np.int64), np.zeros(len(row), dtype=np.int64)
        for i in range(self.levels):
            ones = self.ones[i]
            here = ones[at].astype(np.int64)
            bit = ones[at + 1] - here
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[i] + here, at - here)
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns (one per line, all of one length)."""
        lo = np.zeros(len(patterns), dtype=np.int64)
        hi = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            c = patterns[live, column].astype(np.int64)
            lo[live] = self.before[c] + self.rank(c, lo[live])
            hi[live] = self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(lo, hi)
        dead = np.ones(len(patterns), dtype=bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes of some rows, by walking back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.marks[at])
        while len(live):
            c = self.symbol(at[live])
            at[live] = self.before[c] + self.rank(c, at[live])
            steps[live] += 1
            live = live[~self.marks[at[live]]]
        return self.positions[self.mark_rank[at]] + steps
