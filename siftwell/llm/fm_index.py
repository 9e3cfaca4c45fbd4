"""A compressed full-text index over word numbers: suffix order, Burrows-Wheeler transform, wavelet matrix.

The indexed sequence holds symbols from 1 up; 0 ends a run. Every 0 counts as a letter of its own in the suffix
order, so no suffix comparison crosses a run's end, and a pattern never holds 0.
"""

from __future__ import annotations

import numpy as np

_FIELD = 21  # two ranks and a position pack into 63 bits up to this many bits each


def _sorted_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The order of the pairs (a, b)."""
    n = len(a)
    if n < 1 << _FIELD and (not n or max(int(a.max()), int(b.max())) < 1 << _FIELD):
        key = (a.astype(np.uint64) << np.uint64(2 * _FIELD)) | (b.astype(np.uint64) << np.uint64(_FIELD)) | np.arange(n, dtype=np.uint64)
        key.sort()
        return (key & np.uint64((1 << _FIELD) - 1)).astype(np.int64)
    return np.lexsort((b, a))


def suffix_order(symbols: np.ndarray, keep_depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array by prefix doubling, later rounds over unresolved suffixes only; and the ranks by the first
    keep_depth symbols (equal ranks: equal first symbols)."""
    n = len(symbols)
    ends = symbols == 0
    count = int(ends.sum())
    rank = symbols.astype(np.int64) + count - 1
    rank[ends] = np.arange(count)
    pad = np.append(rank[1:], 0) if n else rank
    order = _sorted_pairs(rank, pad)
    depth, kept = 2, None
    slots = np.arange(n)
    held, second, first = order, pad[order], rank[order]
    rank = np.empty(n, np.int64)
    while True:
        new = np.ones(len(held), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        start = np.maximum.accumulate(np.where(new, slots, 0))
        rank[held] = start
        if depth >= keep_depth and kept is None:
            kept = rank.copy()
        single = new.copy()
        single[:-1] &= new[1:]
        open_ = ~single
        if not open_.any():
            break
        slots, held = slots[open_], held[open_]
        after = held + depth
        first, second = rank[held], np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        by = _sorted_pairs(first, second)
        held, first, second = held[by], first[by], second[by]
        order[slots] = held
        depth *= 2
    return order, rank.copy() if kept is None else kept


class WaveletMatrix:
    """Rank of any symbol in a sequence, one packed bit vector with block counts for each bit of the alphabet."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        n, self.bits, self.counts, self.zeros = len(values), [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            ones = bit.astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(ones, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.bits.append(words)
            self.counts.append(counts)
            self.zeros.append(n - int(counts[-1]))
            values = np.concatenate([values[~ones], values[ones]])
        self.base = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][block] + np.bitwise_count(self.bits[k][block] & mask)
            at = np.where((symbols >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self._down(symbols, at) - self.base[symbols]

    def access(self, at: np.ndarray) -> np.ndarray:
        symbols = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            block, place = at >> 6, (at & 63).astype(np.uint64)
            word = self.bits[k][block]
            bit = ((word >> place) & np.uint64(1)).astype(np.int64)
            ones = self.counts[k][block] + np.bitwise_count(word & ((np.uint64(1) << place) - np.uint64(1)))
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            symbols = symbols << 1 | bit
        return symbols


class FMIndex:
    """symbols: see above; top: the largest symbol; sample: every how many places a suffix position is kept."""

    def __init__(self, symbols: np.ndarray, top: int, sample: int = 8, keep_order: bool = False):
        order, self.ranks = suffix_order(symbols)
        self.n, self.top = len(symbols), top
        last = symbols[order - 1] if self.n else symbols
        if self.n:
            last[order == 0] = 0
        self.wavelet = WaveletMatrix(last.astype(np.int64), top)
        self.less = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=top + 1), out=self.less[1:])
        self.order = order
        if not keep_order:
            self.compress(last, sample)
        else:
            self._last = last

    def compress(self, last: np.ndarray | None = None, sample: int = 8) -> None:
        """Keeps sampled suffix positions in place of the whole suffix order and the ranks. The first place of each run
        is kept: there the walk back would leave the run."""
        last = self._last if last is None else last
        kept = (self.order % sample == 0) | (last == 0)
        packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
        raw = np.packbits(kept, bitorder="little")
        packed[: len(raw)] = raw
        self.marks = packed.view(np.uint64)
        self.mark_counts = np.zeros(len(self.marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.marks), out=self.mark_counts[1:])
        self.samples = self.order[kept].astype(np.int32 if self.n < 2**31 else np.int64)
        self.order = self.ranks = self._last = None

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: from the rows that begin with P to those that begin with symbol + P."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high])) + np.tile(self.less[symbols], 2)
        return both[: len(low)], both[len(low) :]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns, one a row of the matrix; symbol 0 in a pattern: no match."""
        m, width = patterns.shape
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.flatnonzero((patterns > 0).all(axis=1)) if self.n else np.zeros(0, np.int64)
        high[np.setdiff1d(np.arange(m), live)] = 0
        for j in range(width - 1, -1, -1):
            a, b = self.extend(patterns[live, j], low[live], high[live])
            low[live], high[live] = a, b
            live = live[b > a]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: walk back by the last-to-first mapping to a row with a kept place."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, live = rows.astype(np.int64), np.arange(len(rows))
        while len(live):
            block, place = at >> 6, (at & 63).astype(np.uint64)
            word = self.marks[block]
            kept = ((word >> place) & np.uint64(1)).astype(bool)
            index = self.mark_counts[block] + np.bitwise_count(word & ((np.uint64(1) << place) - np.uint64(1)))
            out[live[kept]] = self.samples[index[kept]] + steps[live[kept]]
            live, at = live[~kept], at[~kept]
            steps[live] += 1
            symbols = self.wavelet.access(at)
            at = self.less[symbols] + self.wavelet.rank(symbols, at)
        return out
