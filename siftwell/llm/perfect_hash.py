"""A minimal perfect hash: n distinct keys to the slots 0 to n - 1, in about four bits a key.

A key is placed at a bit of the first level. Bits that one key alone has are set, and the others' keys go on to the
next, smaller level. A key's slot is the number of set bits before its own. A key that was not put in gets any slot or
none: what stands in the slot has to tell.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import mix64

LEVELS = 40
#: Bits of a level for each key that reaches it.
ROOM = 2
_STEP = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(keys + np.uint64((level + 1) * _STEP % 2**64)) % np.uint64(bits)).astype(np.int64)


@dataclass
class PerfectHash:
    sizes: np.ndarray  # words of each level
    words: np.ndarray  # all levels' bits, 64 a word
    rest: np.ndarray  # keys of the last slots, sorted: those that never had a bit of their own (equal ones, as a rule)

    def __post_init__(self):
        ones = np.bitwise_count(self.words).astype(np.int64)
        self._before = np.cumsum(ones) - ones
        self._n = int(ones.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash of uint64 keys, and the slot of each."""
        slots = np.full(len(keys), -1, np.int64)
        left, sizes, words, done = np.arange(len(keys)), [], [], 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(1, -(-ROOM * len(left) // 64))
            place = _place(keys[left], level, size * 64)
            alone = np.bincount(place, minlength=size * 64) == 1
            rank = np.cumsum(alone) - 1
            own = alone[place]
            slots[left[own]] = done + rank[place[own]]
            done += int(alone.sum())
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~own]
        left = left[np.argsort(keys[left], kind="stable")]
        slots[left] = done + np.arange(len(left))
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64), keys[left]), slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot that each key may have, -1 for none; of equal keys in `rest` the first one's, the others' follow."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                return out
            place = _place(keys[left], level, int(size) * 64)
            word, bit = base + (place >> 6), (place & 63).astype(np.uint64)
            held = self.words[word]
            hit = (held >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self._before[word] + below)[hit]
            left, base = left[~hit], base + int(size)
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self._n + at[same]
        return out
