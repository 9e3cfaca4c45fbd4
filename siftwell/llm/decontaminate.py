"""Benchmark decontamination: each training shard gets an FM-index, and benchmark phrases are searched in it.

A shard is a block of documents as a task reads them, so no text is shuffled. Its index is built over the words
that the benchmark also uses; any other word ends a run, as no phrase can cross it. All phrases are searched
backwards at once through wavelet-matrix ranks, their occurrences are located by sampled suffix positions, and the
spans found are merged.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .frames import own, text_bytes
from .words import ALNUM, blocks, covered, per_doc, rows_of, split_words

WINDOW = 13
#: UTF-8 bytes of benchmark text sent to the executors at once; a larger benchmark is searched in several passes.
BENCHMARK_BLOCK = 16 << 20
#: UTF-8 bytes of text in a shard.
SHARD_BYTES = 6 << 20
_SPANS, _ITEMS, _COUNT = own("spans"), own("items"), own("n_words")
_LOCATE_ROWS = 500_000


@dataclass
class Phrases:
    """The distinct windows of some items: numbers from 1 of all words of the items, one after the other, and by length
    where each window starts among them, where its items start, and the items."""

    vocabulary: pa.Array
    numbers: np.ndarray
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    item_ids: list[str]  # sorted as strings


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """size whole numbers from each begin on."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)


def phrases(rows: list[tuple], window: int) -> Phrases:
    """rows: (item id or None, text or None). Items without a word give nothing; those without an id have windows
    that count as hits, but are not listed. Equal windows are found by sorted numbers, a word at a time, so that a row of
    whole windows is never held."""
    names = sorted({str(i) for i, _ in rows if i is not None})
    place = {name: k for k, name in enumerate(names)}
    owner = np.array([-1 if i is None else place[str(i)] for i, _ in rows], np.int64)
    words = split_words(pa.array([t or "" for _, t in rows], pa.string()), ALNUM, lower=True)
    numbers, counts = words.ids.astype(np.int32) + 1, np.diff(words.first)
    lengths, by_length = np.minimum(window, counts), {}
    for m in sorted({int(m) for m in lengths if m}):
        some = np.flatnonzero(lengths == m)
        size = counts[some] - m + 1
        starts, owners = _ranges(words.first[:-1][some], size), np.repeat(owner[some], size)
        group = np.zeros(len(starts), np.int64)
        for j in range(m):
            _, at, group = np.unique(group * (len(words.distinct) + 1) + numbers[starts + j], return_index=True, return_inverse=True)
        pairs = np.unique(group * (len(names) + 1) + owners + 1)
        pairs = pairs[pairs % (len(names) + 1) > 0]
        item_at = np.searchsorted(pairs // (len(names) + 1), np.arange(len(at) + 1))
        by_length[m] = starts[at], item_at, pairs % (len(names) + 1) - 1
    return Phrases(words.distinct, numbers, by_length, names)


def _found(index: FMIndex, phrase: Phrases, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The row ranges of all windows of a length, so many written out at once."""
    starts = phrase.by_length[m][0]
    parts = [index.search(phrase.numbers[starts[k : k + _LOCATE_ROWS, None] + np.arange(m)].astype(np.int64)) for k in range(0, len(starts), _LOCATE_ROWS)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _runs(symbols: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least `least` symbols over 0 inside one text, each followed by a 0; and the word index of
    each place."""
    n = len(symbols)
    known = symbols > 0
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    heads = first[:-1][(np.diff(first) > 0)]
    begin[heads] = known[heads]
    end = known.copy()
    end[:-1] &= ~known[1:]
    tails = first[1:][(np.diff(first) > 0)] - 1
    end[tails] = known[tails]
    starts, lengths = np.flatnonzero(begin), np.flatnonzero(end) + 1
    lengths = lengths - starts
    starts, lengths = starts[lengths >= least], lengths[lengths >= least]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out_at = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1] + 1, out=out_at[1:])
    place = np.arange(out_at[-1] + lengths[-1] + 1) - np.repeat(out_at, lengths + 1) + np.repeat(starts, lengths + 1)
    text = symbols[np.minimum(place, n - 1)]
    text[out_at + lengths] = 0
    return text, place


def _occurrences(phrase: Phrases, symbols: np.ndarray, first: np.ndarray):
    """(length, phrase numbers, word starts) of all occurrences in a shard, some at a time."""
    text, place = _runs(symbols, first, min(phrase.by_length))
    if not len(text):
        return
    index = FMIndex(text, len(phrase.vocabulary))
    for m in phrase.by_length:
        low, high = _found(index, phrase, m)
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        until = np.cumsum(counts)
        begin = 0
        while begin < len(hit):  # a phrase with more rows than the limit comes alone, in parts
            done = until[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(until, done + _LOCATE_ROWS, "right")))
            some = hit[begin:end]
            numbers = np.repeat(some, counts[begin:end])
            rows = np.arange(len(numbers)) - np.repeat(until[begin:end] - counts[begin:end] - done, counts[begin:end]) + np.repeat(low[some], counts[begin:end])
            for part in range(0, len(rows), _LOCATE_ROWS):
                yield m, numbers[part : part + _LOCATE_ROWS], place[index.locate(rows[part : part + _LOCATE_ROWS])]
            begin = end


def _search_shard(texts, phrase: Phrases, old_spans, old_items) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, merged spans and item ids of each text, what an earlier pass found included."""
    words = split_words(texts, ALNUM, lower=True)
    known = pc.fill_null(pc.index_in(words.distinct.cast(pa.binary()), value_set=phrase.vocabulary.cast(pa.binary())), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    symbols = known[words.ids] if words.n else words.ids
    doc, step = words.doc, np.zeros(words.n + 1, np.int64)
    pairs: list[np.ndarray] = []
    n_items = max(1, len(phrase.item_ids))
    if phrase.by_length:
        for m, numbers, starts in _occurrences(phrase, symbols, words.first):
            np.add.at(step, starts, 1)
            np.subtract.at(step, starts + m, 1)
            _, item_at, items = phrase.by_length[m]
            both = np.unique(doc[starts] * len(item_at) + numbers)
            docs, numbers = both // len(item_at), both % len(item_at)
            size = np.diff(item_at)[numbers]
            flat = _ranges(item_at[:-1][numbers], size)
            pairs.append(np.unique(np.repeat(docs, size) * n_items + items[flat]))
    if old_spans is not None:
        flat = old_spans.flatten()
        base = np.repeat(words.first[:-1], pc.list_value_length(old_spans).to_numpy(zero_copy_only=False))
        np.add.at(step, base + flat.field(0).to_numpy(), 1)
        np.subtract.at(step, base + flat.field(1).to_numpy(), 1)
    hit = np.cumsum(step[: words.n]) > 0
    before = np.zeros(words.n + 1, bool)
    before[1:] = hit
    before[words.first[:-1]] = False
    begin = np.flatnonzero(hit & ~before[: words.n])
    after = np.zeros(words.n + 1, bool)
    after[: words.n] = hit
    after[words.first[1:]] = False
    end = np.flatnonzero(hit & ~after[1:]) + 1
    base = words.first[:-1][doc[begin]]
    offsets = np.searchsorted(doc[begin], np.arange(len(texts) + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "end"]))
    both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    offsets = np.searchsorted(both // n_items, np.arange(len(texts) + 1)).astype(np.int32)
    names = pa.array(phrase.item_ids, pa.string()).take(pa.array(both % n_items)) if len(both) else pa.array([], pa.string())
    items = pa.ListArray.from_arrays(pa.array(offsets), names)
    if old_items is not None:
        items = pa.array([sorted({*a, *b}) for a, b in zip(items.to_pylist(), old_items.to_pylist(), strict=True)], pa.list_(pa.string()))
    return pa.array(words.counts), spans, items


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BENCHMARK_BLOCK, shard_bytes: int = SHARD_BYTES, remove: bool = False) -> DataFrame:
    """The rows of docs (column text) with n_words, spans (merged word intervals inside any benchmark window; end
    exclusive), item_ids (strings, sorted: items of which a window occurs) and n_hit (words in spans).

    Null and empty texts have no words; items without words are never found. Repeated rows are judged each by
    itself. Earlier columns of the new names are replaced. benchmark has item_id and text; it is read by the driver in
    blocks of a checked size. remove: the texts come without their spans; all else is as judged on the input.
    """
    docs = docs.drop("n_words", "spans", "item_ids", "n_hit")
    spark = docs.sparkSession
    chosen = benchmark.select("item_id", "text")
    n_blocks = max(1, -(-text_bytes(chosen) // block_bytes))
    columns, out = docs.columns, docs
    added = [T.StructField(_COUNT, T.LongType(), False), T.StructField(_SPANS, T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField(_ITEMS, T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *added])
    for k in range(n_blocks):
        rows = chosen if n_blocks == 1 else chosen.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        held = spark.sparkContext.broadcast(phrases([(r[0], r[1]) for r in rows.collect()], window))

        def search(batches, held=held, cut=remove and k == n_blocks - 1):
            phrase = held.value
            for batch in rows_of(batches):
                for part in blocks(batch, "text", shard_bytes):
                    old = [part.column(c) if c in part.schema.names else None for c in (_SPANS, _ITEMS)]
                    new = _search_shard(part.column("text"), phrase, *old)
                    kept = {"text": _without(part.column("text"), new[1])} if cut else {}
                    yield pa.RecordBatch.from_arrays([*(kept.get(c, part.column(c)) for c in columns), *new], names=[*columns, _COUNT, _SPANS, _ITEMS])

        out = out.mapInArrow(search, schema)
    n_hit = F.aggregate(F.col(_SPANS), F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))
    return out.select(*columns, F.col(_COUNT).alias("n_words"), F.col(_SPANS).alias("spans"), F.col(_ITEMS).alias("item_ids"), n_hit.alias("n_hit"))


def is_contaminated(n_hit="n_hit", n_words="n_words"):
    """A twentieth of the words, at least one, lies in benchmark windows."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def cut_spans(text: str | None, spans: list) -> str | None:
    """text without the words of the spans, from each span's first word to its last; what stands between stays."""
    if not text or not spans:
        return text
    words = split_words(pa.array([text], pa.string()), ALNUM, lower=True, encode=False)
    raw, out, at = text.encode(), [], 0
    for s in spans:
        out.append(raw[at : words.starts[s["start"]]])
        at = words.ends[s["end"] - 1]
    return b"".join([*out, raw[at:]]).decode()


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without their spans; few have any."""
    has = pc.greater(pc.list_value_length(spans), 0)
    if not pc.any(has).as_py():
        return texts
    cut = [cut_spans(t, s) for t, s in zip(texts.filter(has).to_pylist(), spans.filter(has).to_pylist(), strict=True)]
    return pc.replace_with_mask(texts, has, pa.array(cut, texts.type))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, their texts without the benchmark windows that they still hold
    (n_chars, where there is one, follows). Texts without any stay as they are."""
    columns = docs.columns
    plain = docs.select([F.col(f"`{c}`").alias(own(f"in_{k}")) if c != "text" else F.col(c) for k, c in enumerate(columns)])
    found = find_benchmark(plain, benchmark, window, remove=True).filter(~is_contaminated())
    size = lambda old: F.when(F.col("n_hit") > 0, F.length("text")).otherwise(old)
    old = [F.col(own(f"in_{k}")) if c != "text" else F.col(c) for k, c in enumerate(columns)]
    return found.select([(size(x) if c == "n_chars" else x).alias(c) for c, x in zip(columns, old, strict=True)])
