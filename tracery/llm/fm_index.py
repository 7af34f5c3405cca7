"""A compressed full-text index over word ids: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class WaveletMatrix:
    """Rank over a sequence of small numbers; a bit a level and symbol, with a count for each 64."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.levels, self.n = levels, len(seq)
        self.words, self.counts, self.zeros = [], [], []
        s = seq
        for level in range(levels - 1, -1, -1):
            bit = (s >> level) & 1
            padded = np.zeros((len(s) // 64 + 1) * 64, np.uint8)
            padded[: len(s)] = bit
            w = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(w)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(w).astype(np.int64))[:-1]]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i falls, at the last level, among the symbols c."""
        for level in range(self.levels):
            ones = self._ones(level, i)
            i = np.where((c >> (self.levels - 1 - level)) & 1 == 1, self.zeros[level] + ones, i - ones)
        return i


class FMIndex:
    """Backward search over a text of numbers 1.. with 0 between its parts; matches of up to ``depth`` symbols.

    What stays is the wavelet matrix of the transformed text, and of the suffix order one sample
    for each interval of suffixes that agree on ``depth`` symbols: where it begins, and the
    smallest of ``places`` in it. The text, the suffix order and the ranks go once it is built.
    """

    def __init__(self, text: np.ndarray, depth: int, places: np.ndarray):
        self.depth, n = depth, len(text)
        self.n, sigma = n, int(text.max(initial=0)) + 1
        rank, span = text.astype(np.int64), 1
        at_half, half = rank, 1
        order = np.argsort(rank, kind="stable")
        while span <= depth:  # ranks by the first ``span`` symbols
            if span <= depth < 2 * span:
                at_half, half = rank, span
            ahead = np.zeros(n, np.int64)
            ahead[: n - span] = rank[span:] + 1 if span < n else 0
            key = rank * (int(rank.max(initial=0)) + 2) + ahead
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])) if n else 0
            span *= 2
        other = np.full(n, -1, np.int64)
        back = depth - half
        other[: n - back] = at_half[back:] if back < n else 0
        a, b = at_half[order], other[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if n else np.zeros(0, bool)
        self.start = np.flatnonzero(new).astype(np.int32)
        self.least = np.minimum.reduceat(places[order], self.start) if n else places
        bwt = text[order - 1]
        self.matrix = WaveletMatrix(bwt, max(1, int(sigma - 1).bit_length()))
        symbols = np.arange(sigma)
        self.base = self.matrix.descend(symbols, np.zeros(sigma, np.int64))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma))])[:sigma]

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c followed by what low..high match."""
        got = self.matrix.descend(np.concatenate([c, c]), np.concatenate([low, high]))
        k = len(c)
        shift = self.less[c] - self.base[c]
        return got[:k] + shift, got[k:] + shift

    def statistics(self, streams: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Reads parts of ``streams``, of any documents, each from its end, side by side; yields (part, place in streams, interval) wherever ``depth`` symbols from place on match.

        ``start`` and ``least`` tell where an interval begins and its smallest place. Symbols that the text lacks are 0 in
        streams. A match that has grown past depth symbols goes back to the interval of its first
        depth; one that can't go on gives up its last symbol and is read anew.
        """
        at, stop = ends - 1, ends - lengths
        low, high, matched = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64), np.zeros(len(ends), np.int64)
        upto = np.append(self.start[1:], np.int32(self.n))
        live = np.flatnonzero(at >= stop)
        while len(live):
            c = streams[at[live]]
            lo, hi = self.extend(c, low[live], high[live])
            lost = (hi <= lo) | (c == 0)
            if lost.any():
                fail = live[lost]
                again = (c[lost] != 0) & (matched[fail] > 0)
                at[fail] += np.where(again, matched[fail] - 1, -1)
                low[fail], high[fail], matched[fail] = 0, self.n, 0
                own, lo, hi = live[~lost], lo[~lost], hi[~lost]
            else:
                own = live
            matched[own] += 1
            whole = np.flatnonzero(matched[own] >= self.depth)
            if len(whole):
                block = np.searchsorted(self.start, lo[whole], "right") - 1
                lo[whole], hi[whole] = self.start[block], upto[block]
                matched[own[whole]] = self.depth
                yield own[whole], at[own[whole]], block
            low[own], high[own] = lo, hi
            at[own] -= 1
            live = live[at[live] >= stop[live]]
