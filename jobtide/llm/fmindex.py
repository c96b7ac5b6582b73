"""An FM-index over the words of one shard: backward search, wavelet ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of ``symbols`` in order, by prefix doubling; each 0 (a separator) differs from every other 0."""
    n = len(symbols)
    gaps = symbols == 0
    rank = symbols.astype(np.int64) + int(gaps.sum())
    rank[gaps] = np.arange(int(gaps.sum()))
    order, step = np.argsort(rank, kind="stable"), 1
    while True:
        rank_of = rank[order]
        fresh = np.ones(n, bool)
        fresh[1:] = rank_of[1:] != rank_of[:-1]
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        rank = rank * (n + 1) + ahead
        order, step = np.argsort(rank, kind="stable"), step * 2


class WaveletMatrix:
    """Ranks of a symbol sequence, one bit plane for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, width: int):
        self.planes: list[tuple[int, int, np.ndarray]] = []
        for bit in range(width - 1, -1, -1):
            ones = (symbols >> bit) & 1 == 1
            sums = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=sums[1:])
            zeros = len(symbols) - int(sums[-1])
            self.planes.append((bit, zeros, sums))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        first = np.zeros_like(upto)
        for bit, zeros, sums in self.planes:
            one = (symbol >> bit) & 1 == 1
            first = np.where(one, zeros + sums[first], first - sums[first])
            upto = np.where(one, zeros + sums[upto], upto - sums[upto])
        return upto - first

    def at(self, position: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        symbol = np.zeros_like(position)
        for _, zeros, sums in self.planes:
            one = sums[position + 1] > sums[position]
            symbol = symbol * 2 + one
            position = np.where(one, zeros + sums[position], position - sums[position])
        return symbol


class FMIndex:
    """Of a sequence of symbols 1..top, in which 0 separates runs; the sequence ends with a 0."""

    def __init__(self, symbols: np.ndarray, top: int, every: int = 16):
        order = suffix_order(symbols)
        before = symbols[order - 1]  # the symbol before the first position is the final separator
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=top + 1), out=self.first[1:])
        self.matrix = WaveletMatrix(before, max(1, int(top).bit_length()))
        # Every position after a separator is sampled, so no walk has to pass one.
        sampled = (order % every == 0) | (before == 0)
        self.sample_at = np.zeros(len(order) + 1, np.int64)
        np.cumsum(sampled, out=self.sample_at[1:])
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases (rows of symbols, all of one length)."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.first[-1], np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            low = self.first[symbol] + self.matrix.rank(symbol, low)
            high = self.first[symbol] + self.matrix.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: step back until a sampled one is met."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while True:
            open_ = open_[self.sample_at[rows[open_] + 1] == self.sample_at[rows[open_]]]
            if not len(open_):
                return self.samples[self.sample_at[rows]] + steps
            symbol = self.matrix.at(rows[open_])
            rows[open_] = self.first[symbol] + self.matrix.rank(symbol, rows[open_])
            steps[open_] += 1
