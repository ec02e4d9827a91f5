"""FM-index over word numbers: suffix order, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions in suffix order, by prefix doubling. Each 0 counts as a symbol of its own, ordered by position."""
    n = len(text)
    rank = np.empty(n, np.int64)
    ends = np.flatnonzero(text == 0)
    rank[ends] = np.arange(len(ends))
    words = text != 0
    rank[words] = np.unique(text[words], return_inverse=True)[1] + len(ends)
    step = 1
    while True:
        key = rank * (n + len(ends) + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        rank[order] = fresh
        if fresh[-1] == n - 1 or step * 2 >= n:
            return order
        step *= 2


class WaveletMatrix:
    """Counts of a symbol before a position, one bit of the symbol per level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits, self.ones, self.zeros = max(1, int(top).bit_length()), [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


class FMIndex:
    """text: word numbers from 1, every run closed by a 0. starts: the runs' first positions; these are sampled, too,
    so that no walk back leaves its run."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, top: int):
        order = suffix_order(text)
        self.size, self.last = len(text), text[order - 1]
        self.tree = WaveletMatrix(self.last, top)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        chosen = np.zeros(len(text), bool)
        chosen[::SAMPLE] = True
        chosen[starts] = True
        marked = chosen[order]
        self.place = np.concatenate(([0], np.cumsum(marked))).astype(np.int32)
        self.marked, self.positions = marked, order[marked]

    def search(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with words[start : start + length], for every phrase; empty if low == high."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.size, np.int64)
        live = np.arange(len(start))
        for back in range(1, int(length.max(initial=0)) + 1):
            live = live[(length[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            word = words[start[live] + length[live] - back]
            low[live] = self.before[word] + self.tree.rank(word, low[live])
            high[live] = self.before[word] + self.tree.rank(word, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one, counting steps."""
        rows, out, steps = rows.copy(), np.zeros(len(rows), np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            here = rows[open_]
            done = self.marked[here]
            out[open_[done]] = self.positions[self.place[here[done]]] + steps
            open_, here = open_[~done], here[~done]
            word = self.last[here]
            rows[open_] = self.before[word] + self.tree.rank(word, here)
            steps += 1
        return out
