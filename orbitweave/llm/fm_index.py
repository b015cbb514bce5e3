"""FM-index over a sequence of integer symbols: suffix array, Burrows-Wheeler transform, wavelet
matrix for ranks, backward search and location by sampled suffix positions. All searches work on
arrays of patterns or rows at once."""

from __future__ import annotations

import numpy as np


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of t in order, by prefix doubling; t must end in a symbol that is
    smaller than all others."""
    n = len(t)
    order = np.argsort(t, kind="stable")
    s = t[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
    k = 1
    while n > 1 and rank[order[-1]] < n - 1:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        k *= 2
    return order


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Rank and access of symbols in logarithmic time: one bit vector per bit of the alphabet."""

    def __init__(self, s: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for b in range(self.depth - 1, -1, -1):
            one = (s >> b) & 1 == 1
            self.levels.append(Bits(one))
            self.zeros.append(int(len(s) - one.sum()))
            s = np.concatenate((s[~one], s[one]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands before position i[k]."""
        start = np.zeros_like(i)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (c >> (self.depth - 1 - level)) & 1 == 1
            ri, rs = bits.rank(i), bits.rank(start)
            i = np.where(one, zeros + ri, i - ri)
            start = np.where(one, zeros + rs, start - rs)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it stands before it."""
        c, start = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(i) == 1
            ri, rs = bits.rank(i), bits.rank(start)
            i = np.where(one, zeros + ri, i - ri)
            start = np.where(one, zeros + rs, start - rs)
            c = c * 2 + one
        return c, i - start


class FMIndex:
    """Symbols are 1..n_symbols-1; 0 is the end mark, which the index appends itself."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 8):
        t = np.concatenate((symbols.astype(np.int64), [0]))
        sa = suffix_array(t)
        self.n = len(t)
        self.wavelet = WaveletMatrix(t[sa - 1], n_symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=n_symbols))))
        sampled = sa % sample == 0
        self.sampled, self.samples = Bits(sampled), sa[sampled]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: one per row, padded on the right. The rows [low, high) of the suffixes that
        begin with each; low = high where there is none."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > j) & (low < high))
            if not len(live):
                continue
            c = patterns[live, j].astype(np.int64)
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = self.first[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the text until a sampled row."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, todo = rows.astype(np.int64), np.arange(len(rows))
        while len(todo):
            done = self.sampled.get(at) == 1
            out[todo[done]] = self.samples[self.sampled.rank(at[done])] + steps
            todo, at = todo[~done], at[~done]
            if len(todo):
                c, r = self.wavelet.access_rank(at)
                at = self.first[c] + r
            steps += 1
        return out
