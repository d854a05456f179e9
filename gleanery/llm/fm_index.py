"""A compressed full-text index over word ids: Burrows-Wheeler transform in a wavelet matrix, searched backward."""

from __future__ import annotations

import numpy as np

_U = np.uint64


class Bits:
    """A packed bit vector with a count per 64 bits, for constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // 64) * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(_U)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (_U(1) << (at & 63).astype(_U)) - _U(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol before any place, one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.levels = []
        for bit in range(depth - 1, -1, -1):
            ones = symbols >> bit & 1
            self.levels.append((bit, Bits(ones)))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        """Where each of ``places`` falls on the lowest level, where a symbol's places are one run."""
        held = list(places)
        for bit, bits in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            ranks = [bits.rank(x) for x in held]
            held = [np.where(one, bits.zeros + r, x - r) for x, r in zip(held, ranks, strict=True)]
        return held


class FMIndex:
    """Index of a sequence of word ids from 1 on, where 0 ends each text. ``order`` is the suffix array."""

    def __init__(self, symbols: np.ndarray, longest: int):
        n = len(symbols)
        rank = symbols.astype(np.int64)
        step = 1
        # suffixes need ordering only as far as a text reaches
        while step <= longest:
            second = np.zeros(n, np.int64)
            second[: n - step] = rank[step:] + 1
            key = rank * (n + 2 + int(symbols.max(initial=0))) + second
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            step *= 2
        else:
            # equal suffixes stand in the order of the sequence, as those one word longer do
            order = np.argsort(rank, kind="stable")
        self.order = order
        depth = max(1, int(symbols.max(initial=0)).bit_length())
        self.matrix = WaveletMatrix(symbols[order - 1].astype(np.int64), depth)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1))])
        # where each symbol's run starts on the lowest level
        self.base = self.matrix.rank(np.arange(len(self.starts) - 1), np.zeros(len(self.starts) - 1, np.int64))[0]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (rows) that occur: the interval of ``order`` that begins with each.

        A search stops once one place is left: then the interval is that of the pattern's end, in the only text
        that can hold the pattern.
        """
        # one word alone begins a run of the order
        last = patterns[:, -1]
        low, high = self.starts[last], self.starts[last + 1]
        going = np.flatnonzero(high - low > 1)
        for j in range(patterns.shape[1] - 2, -1, -1):
            if not len(going):
                break
            symbol = patterns[going, j]
            a, b = self.matrix.rank(symbol, low[going], high[going])
            shift = self.starts[symbol] - self.base[symbol]
            low[going], high[going] = a + shift, b + shift
            going = going[b - a > 1]
        return low, high
