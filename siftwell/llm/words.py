"""Vectorised word splitting over Arrow text columns.

Texts are handled as UTF-8 bytes. Both word definitions used in this subpackage are byte classes (every byte of
a non-ASCII character is 0x80 or above), so a 256-entry table finds the words without decoding.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BYTES = np.arange(256)
#: Words are runs of anything but space and \t \n \v \f \r.
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words are runs of 0-9, a-z and every character from U+0080 up, after A-Z was lower-cased.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_MIX_A, _MIX_B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_A
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX_B
    return h ^ (h >> np.uint64(33))


def column_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts in them (one more entry than texts; null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.array([], texts.type)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    buffers = texts.buffers()
    at = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[at[0] : at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


@dataclass
class Words:
    """Words of a block of texts, in order. Word w has the bytes data[starts[w]:ends[w]] and belongs to text doc[w]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the count of all words
    ids: np.ndarray  # of the distinct word
    distinct: pa.Array  # the distinct words, as binary

    @property
    def n(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """For each word, how many words of its text start there or later."""
        return np.repeat(self.first[1:], self.counts) - np.arange(self.n)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word, the same in every task: the sum of a mixed value of each byte with its
        place (tabulation hashing), mixed with the length."""
        n = len(self.distinct)
        if not n:
            return np.zeros(0, np.uint64)
        at = np.frombuffer(self.distinct.buffers()[1], np.int64)[self.distinct.offset : self.distinct.offset + n + 1]
        data = np.frombuffer(self.distinct.buffers()[2], np.uint8)[at[0] : at[-1]].astype(np.uint64)
        starts, sizes = at[:-1] - at[0], np.diff(at)
        place = (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.uint64)
        mixed = mix64((place << np.uint64(8) | data) + np.uint64(0x9E3779B97F4A7C15))
        return mix64(np.add.reduceat(mixed, starts) + sizes.astype(np.uint64))


def split_words(texts, table: np.ndarray, lower: bool = False, encode: bool = True) -> Words:
    data, at = column_bytes(texts)
    if lower:
        data = _LOWER[data]
    mask = table[data]
    n = len(mask)
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    before[edges] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    first = np.searchsorted(starts, at)
    if not encode:
        return Words(data, starts, ends, first, np.zeros(0, np.int32), pa.array([], pa.binary()))
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    joined = np.ascontiguousarray(data[mask])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    return Words(data, starts, ends, first, ids, coded.dictionary)


def run_hash(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k neighbours; values are hashes already. Shorter than values by k - 1."""
    n = max(0, len(values) - k + 1)
    out = np.full(n, np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64), np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(k):
        factor = factor * 0xD1342543DE82EF95 % 2**64 | 1
        out += values[j : j + n] * np.uint64(factor)
    return mix64(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w neighbours; shorter than values by w - 1."""
    n, out, have = len(values) - w + 1, values, 1
    if n <= 0:
        return values[:0]
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def blocks(batch: pa.RecordBatch, column: str, most: int):
    """Slices of a batch with about `most` bytes of text each; a longer text comes alone."""
    data, at = column_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, "right")) - 1)
        yield batch.slice(begin, min(end, batch.num_rows) - begin)
        begin = end


def covered(n: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Which of n places lie in any of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.subtract.at(step, starts + lengths, 1)
    return np.cumsum(step[:n]) > 0


def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many flags are set among the words of each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def release() -> None:
    """Gives freed memory back to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def rows_of(batches):
    """Batches that have rows."""
    for k, batch in enumerate(batches):
        if k:
            release()
        if batch.num_rows:
            yield batch
    release()
