"""An FM-index over a sequence of small integers, with NumPy arrays for all queries at once."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start of each suffix in sorted order. Zeros are separators: each is unlike the others, in order of place."""
    n = len(symbols)
    zeros = symbols == 0
    rank = symbols.astype(np.int64) + int(zeros.sum())
    rank[zeros] = np.arange(int(zeros.sum()))
    k = 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:-k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, k = new, 2 * k
        if int(rank.max()) == n - 1 or k >= n:
            return order


class Wavelet:
    """Wavelet matrix: for each bit of a symbol, highest first, the bits in the order of the level above."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels: list[tuple[np.ndarray, int, int]] = []
        for bit in reversed(range(max(1, int(most).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((before, int(len(symbols) - before[-1]), bit))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] comes up before place i[k]."""
        start = np.zeros_like(i)
        for before, zeros, bit in self.levels:
            one = (c >> bit & 1).astype(bool)
            a, b = before[start], before[i]
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start


class FMIndex:
    """symbols: 0 separates and is never searched for. rate: every rate-th suffix position is kept."""

    def __init__(self, symbols: np.ndarray, rate: int = 16):
        symbols = np.append(symbols, 0)
        order = suffix_order(symbols)
        self.n, self.most = len(symbols), int(symbols.max())
        self.bwt = symbols[order - 1]  # before the first comes the last, which is a separator
        self.tree = Wavelet(self.bwt, self.most)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.most + 1))])
        kept = (order % rate == 0) | (self.bwt == 0)
        self.kept, self.number, self.place = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase, flat[start : start + size], by backward search."""
        rows = np.arange(len(start))
        lo, hi = np.zeros(len(start), dtype=np.int64), np.full(len(start), self.n, dtype=np.int64)
        hi[sizes == 0] = 0
        for back in range(1, int(sizes.max(initial=0)) + 1):
            live = rows[(sizes >= back) & (lo < hi)]
            c = flat[start[live] + sizes[live] - back]
            known = (c > 0) & (c <= self.most)
            lo[live[~known]] = hi[live[~known]] = 0
            live, c = live[known], c[known]
            if not len(live):
                break
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position of each suffix: steps to the left until one whose position is kept."""
        at, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        open_ = np.flatnonzero(~self.kept[at])
        while len(open_):
            c = self.bwt[at[open_]]
            at[open_] = self.below[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.kept[at[open_]]]
        return self.place[self.number[at]] + steps
