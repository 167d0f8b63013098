"""An FM-index over integer symbols as numpy arrays; every search step runs for all patterns at once."""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes. The last symbol has to be 0 and unique. Prefix doubling, on tied suffixes only."""
    n = len(seq)
    width = max(1, int(seq.max()).bit_length())
    depth = max(1, 62 // width)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= width
        key[: max(n - k, 0)] |= seq[k:]
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    alone = first & np.concatenate((first[1:], [True]))
    tied = np.flatnonzero(~alone)
    while len(tied):
        s = order[tied]
        group, next_ = head[tied], rank[np.minimum(s + depth, n - 1)]
        by = np.lexsort((next_, group))
        s, group, next_ = s[by], group[by], next_[by]
        order[tied] = s
        first = np.concatenate(([True], (group[1:] != group[:-1]) | (next_[1:] != next_[:-1])))
        new = np.maximum.accumulate(np.where(first, tied, 0))
        head[tied] = new
        rank[s] = new
        alone = first & np.concatenate((first[1:], [True]))
        tied = tied[~alone]
        depth *= 2
    return order


class Bits:
    """A bit vector with rank: counts per 64-bit word, population count for the rest."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view(U64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))
        self.ones = int(self.before[-1])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(U64)) & U64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        low = self.words[i >> 6] & ((U64(1) << (i & 63).astype(U64)) - U64(1))
        return self.before[i >> 6] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank and access for a sequence of small integers, one bit vector a level."""

    def __init__(self, seq: np.ndarray):
        self.levels, self.zeros = [], []
        rest = seq
        for level in reversed(range(max(1, int(seq.max()).bit_length()))):
            bit = ((rest >> level) & 1).astype(bool)
            self.levels.append((level, Bits(bit)))
            self.zeros.append(len(rest) - int(bit.sum()))
            rest = np.concatenate((rest[~bit], rest[bit]))
        self.begin = self._down(np.zeros(int(seq.max()) + 1, np.int64), np.arange(int(seq.max()) + 1))

    def _down(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``i``."""
        return self._down(i, symbol) - self.begin[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for (level, bits), zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = bits.get(i), bits.rank(i)
            symbol |= one.astype(np.int64) << level
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i - self.begin[symbol]


class FMIndex:
    def __init__(self, seq: np.ndarray, every: int = 16):
        """``seq``: symbols from 1; each ``every``-th text position is kept for locating."""
        seq = np.append(np.asarray(seq, np.int64), 0)
        order = suffix_array(seq)
        self.size = len(seq)
        self.wavelet = WaveletMatrix(seq[order - 1])
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(seq))))
        kept = order % every == 0
        self.sampled, self.places = Bits(kept), order[kept]
        self.symbols = len(self.smaller) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns, read from their ends; -1 before a pattern's start fills a shorter one."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        high[(patterns >= self.symbols).any(axis=1)] = 0
        for k in reversed(range(patterns.shape[1])):
            on = np.flatnonzero((low < high) & (patterns[:, k] >= 0))
            c = patterns[on, k]
            low[on] = self.smaller[c] + self.wavelet.rank(c, low[on])
            high[on] = self.smaller[c] + self.wavelet.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: steps back through the text until a sampled position."""
        place, row, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled.get(row)
            place[left[done]] = self.places[self.sampled.rank(row[done])] + steps
            left, row = left[~done], row[~done]
            symbol, before = self.wavelet.access(row)
            row = self.smaller[symbol] + before
            steps += 1
        return place
