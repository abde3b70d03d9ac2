"""A full-text index over whole numbers: sorted suffixes, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the sorted length; the last number must be unique and least."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        held = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


class Bits:
    """A bit string with constant-time rank: a count before each 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, dtype=bool)]), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))])[:-1].astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits are set."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


class Wavelet:
    """Wavelet matrix: the numbers' bits from the highest down, zeros before ones at every level."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.depth = max(1, (symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bits = (values >> level) & 1 == 1
            self.levels.append(Bits(bits))
            self.zeros.append(len(values) - int(bits.sum()))
            values = np.concatenate([values[~bits], values[bits]])
        self.first = self._down(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbols >> (self.depth - 1 - level)) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``at`` numbers."""
        return self._down(symbols, at) - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at some places, and how often each occurs before its place."""
        symbols = np.zeros(len(at), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            ones, here = bits.rank(at), bits.get(at)
            symbols = symbols << 1 | here
            at = np.where(here, zeros + ones, at - ones)
        return symbols, at - self.first[symbols]


class FMIndex:
    """Index of a text of numbers from 1 up; 0 is put behind it as its end."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.concatenate([text, [0]]).astype(np.int64)
        order = suffix_array(text)
        self.size = len(text)
        self.wavelet = Wavelet(text[order - 1], symbols)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:-1]
        sampled = order % SAMPLE == 0
        self.sampled, self.positions = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each pattern; patterns are padded behind."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((step < lengths) & (low < high))
            symbols = patterns[live, lengths[live] - 1 - step].astype(np.int64)
            low[live] = self.smaller[symbols] + self.wavelet.rank(symbols, low[live])
            high[live] = self.smaller[symbols] + self.wavelet.rank(symbols, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the text, by stepping back from each suffix to a sampled one."""
        found = np.empty(len(rows), dtype=np.int64)
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        for steps in range(SAMPLE):
            known = self.sampled.get(at)
            found[left[known]] = self.positions[self.sampled.rank(at[known])] + steps
            left, at = left[~known], at[~known]
            symbols, before = self.wavelet.access(at)
            at = self.smaller[symbols] + before
        return found
