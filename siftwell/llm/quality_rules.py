"""Quality rules: base text counts and compression bands.

Whole documents and fixed chunks are compressed with zstandard. A ratio (compressed over plain bytes) under its band
means repetitive text, one over it incompressible text. Limits depend on the length of what was compressed, as a
frame's fixed cost weighs more on short input and a longer window finds more repeats. The base counts reject what is
too short to judge or repeats itself word by word; the bands decide everything else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import NON_SPACE, Words, blocks, column_bytes, covered, per_doc, rows_of, split_words

BLOCK_BYTES = 2 << 20
_ADDED = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("ratio", T.DoubleType()), ("chunk_low", T.DoubleType()), ("chunk_high", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Bands:
    """Allowed zstandard ratios: knots (bytes, least, most). Between two knots the limits run straight over the
    logarithm of the length, as ratios fall with it; input shorter than the first knot has none, and beyond the last
    knot its limits hold.

    The limits come from prose in use, not from the tables that the queries read: licences, manuals, release notes and
    guides in English (503 texts of 1.5 to 600 KB, whole and cut to the knots' lengths). The least document ratios
    lie about a tenth under the lowest of those, legal texts included; the least chunk ratios under what a long text's
    tables and lists of names fall to, so that one such chunk does not reject it. The most ratios lie a fifth above the
    highest and let everything but encoded or random data through.
    """

    document: tuple[tuple[int, float, float], ...] = ((256, 0.42, 0.95), (512, 0.38, 0.88), (1024, 0.35, 0.80), (2048, 0.33, 0.76), (4096, 0.31, 0.72), (8192, 0.285, 0.70), (16384, 0.28, 0.68), (65536, 0.27, 0.68), (262144, 0.255, 0.68))
    chunk: tuple[tuple[int, float, float], ...] = ((1024, 0.20, 0.80), (2048, 0.20, 0.76), (4096, 0.20, 0.72))
    chunk_bytes: int = 4096
    level: int = 3


def _outside(limits, sizes: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    knots, low, high = (np.array(x, np.float64) for x in zip(*limits, strict=True))
    at, knots = np.log2(np.maximum(sizes, 1)), np.log2(knots)
    return (at >= knots[0]) & ((ratios < np.interp(at, knots, low)) | (ratios > np.interp(at, knots, high)))


def compression(texts, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: whole ratio, least and largest chunk ratio (NaN without bytes), and whether all are in their bands."""
    data, at = column_bytes(texts)
    view, squeeze = memoryview(data), zstandard.ZstdCompressor(level=bands.level).compress
    n, step = len(at) - 1, bands.chunk_bytes
    sizes = np.diff(at)
    ratio = np.array([len(squeeze(view[a:b])) / (b - a) if b > a else np.nan for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
    counts = -(-sizes // step)
    owner = np.repeat(np.arange(n), counts)
    begin = np.repeat(at[:-1], counts) + step * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    length = np.minimum(step, at[1:][owner] - begin)
    alone = counts[owner] == 1  # the chunk is the document
    chunk = np.array([ratio[d] if one else len(squeeze(view[a : a + m])) / m for d, one, a, m in zip(owner.tolist(), alone.tolist(), begin.tolist(), length.tolist(), strict=True)])
    low, high, ok = np.full(n, np.nan), np.full(n, np.nan), ~_outside(bands.document, sizes, np.nan_to_num(ratio, nan=0.5))
    has = np.flatnonzero(counts)
    if len(has):
        heads = (np.cumsum(counts) - counts)[has]
        low[has], high[has] = np.minimum.reduceat(chunk, heads), np.maximum.reduceat(chunk, heads)
        ok[owner[_outside(bands.chunk, length, chunk)]] = False
    return ratio, low, high, ok


def _repeat_words(words: Words) -> np.ndarray:
    """For each text, its words inside any 3-word window that the text has twice or more."""
    starts = np.flatnonzero(words.room() >= 3)
    if not len(starts):
        return np.zeros(len(words.first) - 1, np.int64)
    a, b, c = words.ids[starts], words.ids[starts + 1], words.ids[starts + 2]
    if len(words.distinct) < 1 << 21:
        key = a << 42 | b << 21 | c
    else:
        _, key = np.unique(a * len(words.distinct) + b, return_inverse=True)
        key = key * len(words.distinct) + c
    by = np.argsort(key)
    doc = words.doc[starts][by]
    by2 = np.argsort(doc, kind="stable")
    by, doc = by[by2], doc[by2]
    key = key[by]
    same = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    twice = np.zeros(len(starts), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return per_doc(covered(words.n, starts[by[twice]], 3), words.first)


def _dup_lines(words: Words, at: np.ndarray) -> np.ndarray:
    """For each text, its \\n-split lines with a word that equal an earlier line of it."""
    data, n = words.data, len(at) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([at[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(at, breaks, "right") - 1])
    by = np.lexsort((begin, doc))  # an empty text begins where the next one does
    begin, doc = begin[by], doc[by]
    end = np.minimum(np.append(begin[1:] - 1, len(data)), at[1:][doc])
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = at[1:][doc[last]]
    has = np.searchsorted(words.starts, end) > np.searchsorted(words.starts, begin)
    begin, end, doc = begin[has], end[has], doc[has]
    if not len(begin):
        return np.zeros(n, np.int64)
    plain = np.cumsum(data != 10)
    offsets = np.append(0, np.cumsum(end - begin))
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, begin, 1)
    np.subtract.at(keep, end, 1)
    raw = np.ascontiguousarray(data[np.cumsum(keep[: len(data)]) > 0]) if len(plain) else data
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(doc * (int(ids.max()) + 1) + ids) // (int(ids.max()) + 1)
    return np.bincount(doc, minlength=n) - np.bincount(pairs, minlength=n)


def _counts(texts) -> dict[str, np.ndarray]:
    words = split_words(texts, NON_SPACE)
    _, at = column_bytes(texts)
    in_word = NON_SPACE[words.data] & ((words.data & 0xC0) != 0x80)
    return {"n_words": words.counts, "word_chars": per_doc(in_word, at), "n_symbols": per_doc(_SYMBOLS[words.data], at), "n_dup_lines": _dup_lines(words, at), "n_repeat_words": _repeat_words(words)}


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs (column text) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratio,
    chunk_low, chunk_high, base_failed and kept; earlier columns of these names are replaced.

    Null and empty texts have no words: base_failed, not kept, null ratios. Whole texts count, whatever their length,
    and each row is judged by itself, repeated ones too. Columns beside text pass through.
    """
    names = [n for n, _ in _ADDED]
    columns = [c for c in docs.columns if c not in names]
    chosen = docs.select(*(F.col(f"`{c}`") for c in columns))

    def run(batches):
        for batch in rows_of(batches):
            for part in blocks(batch, "text", BLOCK_BYTES):
                texts = part.column("text")
                made = _counts(texts)
                ratio, low, high, ok = compression(texts, bands)
                failed = (made["n_words"] < 50) | (100 * made["n_repeat_words"] > 50 * made["n_words"])
                values = [*(pa.array(made[n].astype(np.int64)) for n in names[:5]), *(pa.array(x, from_pandas=True) for x in (ratio, low, high)), pa.array(failed), pa.array(~failed & ok)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *values], names=[*columns, *names])

    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields, *(T.StructField(n, t) for n, t in _ADDED)]))


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns only."""
    held = [f"c{k}" if c != "text" else c for k, c in enumerate(docs.columns)]
    good = judge(docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held, strict=True))), bands).filter("kept")
    return good.select(*(F.col(h).alias(c) for c, h in zip(docs.columns, held, strict=True)))
