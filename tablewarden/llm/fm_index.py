"""An FM-index over a sequence of small integers, with numpy.

The sequence's Burrows-Wheeler transform is kept in a wavelet matrix, whose levels answer how often a
symbol occurs before a place. Backward search narrows the rows of many phrases at once; the places
behind the rows come from a sample of the suffix array and steps back through the sequence.
"""

from __future__ import annotations

import numpy as np

SAMPLED = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix that is the beginning of another comes first."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        behind = np.zeros(n, dtype=np.int64)
        behind[: n - step] = rank[step:]
        key = rank * (n + 2) + behind
        order = np.argsort(key, kind="stable")
        changed = np.empty(n, dtype=np.int64)
        changed[0] = 1
        changed[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(changed)
        step *= 2
        if rank[order[-1]] == n or step >= n:
            return order


class WaveletMatrix:
    """Level by level from the highest bit: zeros of that bit first, ones behind them, each in order."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.zeros_before, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = (symbols >> bit) & 1
            counted = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(1 - one, out=counted[1:])
            self.zeros_before.append(counted)
            self.zeros.append(int(counted[-1]))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin = np.zeros_like(place)
        for level in range(self.bits):
            counted, zeros = self.zeros_before[level], self.zeros[level]
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            place = np.where(one, zeros + place - counted[place], counted[place])
            begin = np.where(one, zeros + begin - counted[begin], counted[begin])
        return place - begin

    def at(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(place), dtype=np.int64)
        for level in range(self.bits):
            counted, zeros = self.zeros_before[level], self.zeros[level]
            one = counted[place + 1] == counted[place]
            symbol = symbol * 2 + one
            place = np.where(one, zeros + place - counted[place], counted[place])
        return symbol


class FMIndex:
    """Of symbols from 1; 0 is put at the end."""

    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols, 0).astype(np.int64)
        order = suffix_array(symbols)
        self.transform = WaveletMatrix(symbols[order - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.sampled = order % SAMPLED == 0
        self.samples_before = np.cumsum(self.sampled) - self.sampled
        self.samples = order[self.sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) whose suffixes begin with each phrase; phrases end at the right edge of their line."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.first[-1], dtype=np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, -back]
            known = symbol < len(self.first) - 1
            low[live[~known]] = high[live[~known]] = 0
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self.transform.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.transform.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in these rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            symbol = self.transform.at(rows[going])
            rows[going] = self.first[symbol] + self.transform.rank(symbol, rows[going])
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        return self.samples[self.samples_before[rows]] + steps
