"""FM-index over a sequence of integer symbols: suffix array, wavelet ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by prefix doubling; the last symbol must be 0.

    A 0 ends a suffix: zeros count as smaller than every symbol and as different from each other, earlier ones first,
    so every run of symbols between zeros is sorted on its own and no two suffixes tie.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    width = max(1, 62 // bits)
    zeros, at = np.flatnonzero(symbols == 0), np.flatnonzero(symbols)
    padded = np.concatenate([symbols, np.zeros(width, symbols.dtype)]).astype(np.int64)
    key, alive = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for k in range(width):
        symbol = padded[at + k] * alive
        alive &= symbol > 0
        key = key << bits | symbol
    order = np.argsort(key, kind="stable")  # suffixes that end early and tie stay in order of position, as their zeros are
    sorted_at, sorted_key, open_end = at[order], key[order], alive[order]
    # rank of each position: its place in the order, for ties the first place of those that tie
    place = len(zeros) + np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ~open_end[1:]
    group = np.maximum.accumulate(np.where(new, place, 0))
    rank = np.empty(n, np.int64)
    rank[zeros] = np.arange(len(zeros))
    rank[sorted_at] = group
    tied = ~new
    tied[:-1] |= ~new[1:]
    members, depth = sorted_at[tied], width
    while len(members):
        first, then = rank[members], rank[members + depth]
        order = np.lexsort((then, first))
        members, first, then = members[order], first[order], then[order]
        head = np.ones(len(members), bool)
        head[1:] = first[1:] != first[:-1]
        index = np.arange(len(members))
        inside = index - np.maximum.accumulate(np.where(head, index, 0))
        new = head.copy()
        new[1:] |= then[1:] != then[:-1]
        rank[members] = np.maximum.accumulate(np.where(new, first + inside, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        members, depth = members[tied], depth * 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Wavelet:
    """Wavelet matrix: for every bit of the symbols, the number of ones before each place."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        current = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.zeros(len(current) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(current) - int(ones[-1]))
            high = bit.astype(bool)
            current = np.concatenate([current[~high], current[high]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before each ``place``."""
        low = np.zeros_like(place)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            high = ((symbol >> level) & 1).astype(bool)
            place = np.where(high, zeros + ones[place], place - ones[place])
            low = np.where(high, zeros + ones[low], low - ones[low])
        return place - low

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[place + 1] - ones[place]
            symbol = symbol << 1 | bit
            place = np.where(bit > 0, zeros + ones[place], place - ones[place])
        return symbol


class FMIndex:
    """Search of phrases (sequences of symbols from 1 on) in ``symbols``, where 0 separates."""

    def __init__(self, symbols: np.ndarray, every: int = 16):
        symbols = np.concatenate([symbols, [0]]).astype(np.int64)
        self.order = len(symbols)
        suffixes = suffix_array(symbols)
        before = np.where(suffixes > 0, symbols[suffixes - 1], 0)
        self.wavelet = Wavelet(before)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1))])
        # a walk to the left meets a sampled suffix after ``every`` steps, and before it would cross a separator
        sampled = (suffixes % every == 0) | (before == 0)
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.samples = suffixes[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes that start with each phrase (one phrase a row, filled up with zeros on the right)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.order, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            active = np.flatnonzero((lengths > k) & (low < high))
            symbol = phrases[active, k]
            known = symbol < len(self.first) - 1
            high[active[~known]] = low[active[~known]] = 0
            active, symbol = active[known], symbol[known]
            base = self.first[symbol]
            low[active], high[active] = base + self.wavelet.rank(symbol, low[active]), base + self.wavelet.rank(symbol, high[active])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Position in the sequence of each suffix row."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            found = self.sample_rank[at + 1] > self.sample_rank[at]
            out[todo[found]] = self.samples[self.sample_rank[at[found]]] + steps[todo[found]]
            todo, at = todo[~found], at[~found]
            symbol = self.wavelet.access(at)
            rows[todo] = self.first[symbol] + self.wavelet.rank(symbol, at)
            steps[todo] += 1
        return out
