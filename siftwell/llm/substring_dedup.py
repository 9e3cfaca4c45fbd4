"""Substring deduplication over documents by FM-indexes of shards that share an anchor.

A window is 13 consecutive words (runs of anything but white space) of one document. Its anchor is the least hash
among its nine runs of five words, so equal windows have equal anchors. Neighbouring windows with one anchor form a
segment. The work goes in four steps:

1. Documents are dealt over text shards of bounded size by doc_id. Each shard names its anchors once, with the
   number of its documents that have them.
2. Anchors that two documents share are kept. One row an anchor and shard makes this safe for an anchor that a third
   of all documents have.
3. Each text shard sends the segments of its shared anchors, equal ones once, to the index shard of the anchor. For
   an anchor in very many documents it sends single windows, dealt by their own hash, as the segments around a
   common passage all differ. So an index shard gets a window once from each text shard, about 100 bytes: of 100 TB
   in text shards of 128 MB, 80 MB for a window that all of them have.
4. An index shard builds a compressed FM-index (wavelet matrix of the Burrows-Wheeler transform, sampled suffix
   positions; the suffix order goes once it is built) over its segments and streams the segments through it from right to left. Backward search gives the matching
   statistics, cut at 13 words; for each match of 13 the least doc_id of its suffix rows goes back to the shards
   that sent it.

Anchors only choose what is compared where; every match is found by exact backward search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fm_index import FMIndex
from .frames import own, pieces, text_bytes
from .words import NON_SPACE, Words, covered, per_doc, release, run_hash, sliding_min, split_words

WINDOW, ANCHOR = 13, 5
#: UTF-8 bytes of text in a text shard, on average.
SHARD_BYTES = 4 << 20
#: An anchor of more documents sends single windows.
COMMON = 512
_LAST = np.iinfo(np.int64).max  # order of a null doc_id: after all others
_SHARD, _TEXT, _ID = own("shard"), own("text"), own("doc_id")
_PACK = "shard long, home int, rows binary, starts binary, lengths binary, least binary, more binary, words binary"
_BACK = "shard long, rows binary, starts binary, least binary"


def _window_starts(words: Words, window: int) -> np.ndarray:
    return np.flatnonzero(words.room() >= window)


def _segments(words: Words, ids: np.ndarray, window: int, anchor: int):
    """Of a shard: the anchor of each segment, its first word and its number of windows; ids: word hashes."""
    starts = _window_starts(words, window)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    least = sliding_min(run_hash(ids, anchor), window - anchor + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    return least[heads], starts[heads], np.diff(np.append(heads, len(starts)))


def _order_ids(table: pa.Table) -> np.ndarray:
    ids = table.column(_ID).combine_chunks()
    return ids.fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64) if len(table) else np.zeros(0, np.int64)


def _freeing(step, *args) -> pa.Table:
    out = step(*args)
    release()
    return out


def _settled(table: pa.Table) -> pa.Table:
    """The rows of a text shard by doc_id and text: a shuffle brings them in another order each time, and places
    found by one task are read by another."""
    ids = _order_ids(table)
    by = np.argsort(ids, kind="stable")
    if len(ids) and (np.diff(ids[by]) == 0).any():
        by = pc.sort_indices(table.select([_ID, _TEXT]), sort_keys=[(_ID, "ascending"), (_TEXT, "ascending")])
    return table.take(pa.array(by)).combine_chunks()


def _anchors(table: pa.Table, window: int, anchor: int) -> pa.Table:
    words = split_words(table.column(_TEXT), NON_SPACE)
    values, starts, _ = _segments(words, words.hashes()[words.ids] if words.n else np.zeros(0, np.uint64), window, anchor)
    docs = _order_ids(table)[words.doc[starts]] if len(starts) else starts
    by = np.lexsort((docs, values))
    values, docs = values[by], docs[by]
    new_value = np.ones(len(values), bool)
    new_value[1:] = values[1:] != values[:-1]
    new_doc = new_value.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    heads = np.flatnonzero(new_value)
    counts = np.add.reduceat(new_doc.astype(np.int64), heads) if len(heads) else heads
    shard = table.column(_SHARD)[0].as_py() if len(table) else 0
    return pa.table({_SHARD: np.full(len(heads), shard, np.int64), "anchor": values[heads].view(np.int64), "docs": counts.astype(np.int32)})


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the spans' places, one span after the other."""
    at = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(at - starts, lengths)


def _distinct(keys: np.ndarray, docs: np.ndarray):
    """Of spans with equal keys: one of them, and the least and largest doc_id."""
    by = np.lexsort((docs, keys))
    keys, docs = keys[by], docs[by]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(keys)) - 1
    return by[heads], docs[heads], docs[tails]


def _span_keys(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each span's words; ids: word hashes. Two sums over different multiples of the place, mixed."""
    flat = _gather(starts, lengths)
    place = (flat - np.repeat(starts, lengths)).astype(np.uint64)
    factor = run_hash(place, 1, 7) | np.uint64(1)
    heads = np.cumsum(lengths) - lengths
    return run_hash(np.add.reduceat(ids[flat] * factor, heads) + lengths.astype(np.uint64), 1) if len(starts) else np.zeros(0, np.uint64)


def _packs(left: pa.Table, shared: pa.Table, homes: int, window: int, anchor: int, common: int) -> pa.Table:
    """What a text shard sends: for each index shard, distinct spans with their place here, their least doc_id, how
    much larger the largest one is, and their words, a space after each. In order of place, so that all of it packs
    well."""
    empty = pa.table({n: pa.array([], t) for n, t in (("shard", pa.int64()), ("home", pa.int32()), *((c, pa.binary()) for c in ("rows", "starts", "lengths", "least", "more", "words")))})
    if not len(left) or not len(shared):
        return empty
    left = _settled(left)
    words = split_words(left.column(_TEXT), NON_SPACE)
    ids = words.hashes()[words.ids] if words.n else np.zeros(0, np.uint64)
    values, starts, windows = _segments(words, ids, window, anchor)
    wanted = shared.column("anchor").to_numpy().view(np.uint64)
    counts = shared.column("docs").to_numpy()
    by = np.argsort(wanted)
    wanted, counts = wanted[by], counts[by]
    at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    hit = wanted[at] == values
    many = hit & (counts[at] > common)
    few = hit & ~many
    single = _gather(starts[many], windows[many])
    begin = np.concatenate([starts[few], single])
    length = np.concatenate([windows[few] + window - 1, np.full(len(single), window)])
    docs = _order_ids(left)[words.doc[begin]]
    keys = _span_keys(ids, begin, length)
    is_single = np.arange(len(begin)) >= int(few.sum())
    keys = keys ^ is_single.astype(np.uint64)  # a segment of one window stays apart from a single window
    pick, least, most = _distinct(keys, docs)
    begin, length = begin[pick], length[pick]
    route = np.where(is_single[pick], run_hash(keys[pick], 1, 3), run_hash(np.concatenate([values[few], np.zeros(len(single), np.uint64)])[pick], 1, 5))
    home = (route % np.uint64(homes)).astype(np.int64)
    by = np.lexsort((begin, home))
    begin, length, least, most, home = begin[by], length[by], least[by], most[by], home[by]
    flat = _gather(begin, length)
    sizes = (words.ends - words.starts)[flat]
    word_ends = np.cumsum(sizes + 1)
    raw = np.full(int(word_ends[-1]) if len(flat) else 0, 0x20, np.uint8)
    raw[_gather(word_ends - sizes - 1, sizes)] = words.data[_gather(words.starts[flat], sizes)]
    cuts = np.append(np.flatnonzero(np.append(True, home[1:] != home[:-1])), len(home)) if len(home) else np.zeros(1, np.int64)
    rows = words.doc[begin]
    places = begin - words.first[:-1][rows]
    in_words = np.append(0, np.cumsum(length))
    out: dict[str, list] = {c: [] for c in empty.column_names}
    shard = left.column(_SHARD)[0].as_py()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w0, w1 = in_words[a], in_words[b]
        text = raw[word_ends[w0 - 1] if w0 else 0 : word_ends[w1 - 1]]
        for c, v in (("shard", shard), ("home", int(home[a])), ("rows", rows[a:b].astype(np.int32).tobytes()), ("starts", places[a:b].astype(np.int32).tobytes()), ("lengths", length[a:b].astype(np.int32).tobytes()), ("least", least[a:b].tobytes()), ("more", (most - least)[a:b].tobytes()), ("words", text.tobytes())):
            out[c].append(v)
    return pa.table(out, schema=empty.schema)


def _group_starts(index: FMIndex, depth: int) -> np.ndarray:
    """Where the suffix rows with equal first `depth` symbols (8 to 16) begin, as flags."""
    order, ranks, n = index.order, index.ranks, index.n
    new = np.ones(n, bool)
    more = ranks[np.minimum(order + depth - 8, n - 1)]
    here = ranks[order]
    new[1:] = (here[1:] != here[:-1]) | (more[1:] != more[:-1])
    return new


def matching_statistics(index: FMIndex, shorter: np.ndarray, spans: tuple[np.ndarray, np.ndarray], symbols: np.ndarray, window: int):
    """Streams spans of the symbols through the index, all spans in step, from right to left.

    Yields (span numbers, word places in the symbols, low rows) of the matches of `window` symbols. A match is kept
    at window - 1 symbols before each further step, by the suffix rows' groups of that depth; shorter: where they begin.
    """
    starts, lengths = spans
    parent = np.flatnonzero(shorter)
    group = np.zeros(index.n, np.int64)
    group[parent] = 1
    group = np.cumsum(group) - 1
    parent = np.append(parent, index.n)
    live = np.argsort(-lengths, kind="stable")
    low, high = np.zeros(len(live), np.int64), np.full(len(live), index.n, np.int64)
    for step in range(int(lengths.max()) if len(lengths) else 0):
        keep = int(np.searchsorted(-lengths[live], -step, "left"))
        live, low, high = live[:keep], low[:keep], high[:keep]
        if step >= window - 1 and step > window - 1:
            of = group[low]
            low, high = parent[of], parent[of + 1]
        place = starts[live] + lengths[live] - 1 - step
        low, high = index.extend(symbols[place], low, high)
        if step >= window - 1:
            yield live, place, low


def _match(table: pa.Table, window: int) -> pa.Table:
    """What an index shard answers: for each sending shard, the windows with a smaller doc_id than its largest."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names if c != "home"}
    ints = lambda c, kind: [np.frombuffer(x, kind) for x in columns[c]]
    lengths, rows, starts = (np.concatenate(ints(c, np.int32)).astype(np.int64) for c in ("lengths", "rows", "starts"))
    least, more = (np.concatenate(ints(c, np.int64)) for c in ("least", "more"))
    most = least + more
    sender = np.repeat(np.arange(len(table)), [len(x) // 4 for x in columns["rows"]])
    raw = np.frombuffer(b"".join(columns["words"]), np.uint8)
    space = raw == 0x20
    offsets = np.append(0, np.flatnonzero(space) - np.arange(int(space.sum())))
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[~space]))]).dictionary_encode()
    ids = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    head = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
    symbols[_gather(head, lengths)] = ids
    index = FMIndex(symbols, int(ids.max()), keep_order=True)
    span = np.repeat(np.arange(len(lengths)), lengths + 1)
    flags, shorter = _group_starts(index, window), _group_starts(index, window - 1)
    heads = np.flatnonzero(flags)
    lowest = np.minimum.reduceat(least[span[index.order]], heads)
    index.compress()  # searches need the wavelet matrix and the groups' borders only
    group = np.cumsum(flags, dtype=np.int32) - 1
    found = []
    for spans, place, low in matching_statistics(index, shorter, (head, lengths), symbols, window):
        value = lowest[group[low]]
        smaller = value < most[spans]
        found.append((spans[smaller], place[smaller], value[smaller]))
    spans, place, value = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    by = np.argsort(sender[spans], kind="stable")
    spans, place, value = spans[by], place[by], value[by]
    at = starts[spans] + place - head[spans]
    cuts = np.searchsorted(sender[spans], np.arange(len(table) + 1))
    out: dict[str, list] = {"shard": [], "rows": [], "starts": [], "least": []}
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            for c, v in (("shard", columns["shard"][k]), ("rows", rows[spans[a:b]].astype(np.int32).tobytes()), ("starts", at[a:b].astype(np.int32).tobytes()), ("least", value[a:b].tobytes())):
                out[c].append(v)
    return pa.table(out, schema=pa.schema([("shard", pa.int64()), ("rows", pa.binary()), ("starts", pa.binary()), ("least", pa.binary())]))


def _removed(left: pa.Table, answers: pa.Table, words: Words, window: int) -> np.ndarray:
    """Which words of a text shard go: those in a window that some smaller doc_id has."""
    gone = np.zeros(words.n, bool)
    if not len(answers) or not words.n:
        return gone
    rows, starts = (np.concatenate([np.frombuffer(x, np.int32) for x in answers.column(c).to_pylist()]).astype(np.int64) for c in ("rows", "starts"))
    least = np.concatenate([np.frombuffer(x, np.int64) for x in answers.column("least").to_pylist()])
    told = words.first[:-1][rows] + starts
    keys = run_hash(run_hash(words.ids.astype(np.uint64), 1), window)
    by = np.lexsort((least, keys[told]))
    told, least = told[by], least[by]
    known = keys[told]
    every = _window_starts(words, window)
    at = np.minimum(np.searchsorted(known, keys[every]), len(known) - 1)
    hit = np.flatnonzero((known[at] == keys[every]) & (least[at] < _order_ids(left)[words.doc[every]]))
    same = np.ones(len(hit), bool)
    for j in range(window):  # equal hashes are not enough
        same &= words.ids[told[at[hit]] + j] == words.ids[every[hit] + j]
    return covered(words.n, every[hit[same]], window)


def find_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, common: int = COMMON) -> DataFrame:
    """The rows of docs (doc_id long, text string) with n_words, n_removed, kept_text (the kept words, joined by one
    space) and spans (merged word intervals to remove, end exclusive).

    A word goes if a window over it also starts in a document with a smaller doc_id; all windows are judged on the
    input. Rows with one doc_id never remove from each other; a null doc_id comes after all others. Null texts have
    no words; texts of fewer words than a window lose none. Other columns pass through; earlier ones of the new names
    are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text", "spans")
    if not anchor <= window or not 8 < window <= 17:
        raise ValueError("windows of 9 to 17 words are supported, anchors of at most a window")
    columns = [f"c{k}" for k in range(len(docs.columns))]
    shards = pieces(text_bytes(docs), shard_bytes)
    plain = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias(_SHARD),
        F.col("doc_id").cast("long").alias(_ID),
        F.col("text").alias(_TEXT),
        *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, columns, strict=True) if c not in ("doc_id", "text")),
    )
    dealt = plain.repartition(_SHARD)
    asked = dealt.groupBy(_SHARD).applyInArrow(lambda t: _freeing(_anchors, t, window, anchor), f"{_SHARD} long, anchor long, docs int")
    total = F.sum("docs").over(Window.partitionBy("anchor"))
    shared = asked.withColumn("docs", total).filter("docs > 1")
    packs = dealt.groupBy(_SHARD).cogroup(shared.groupBy(_SHARD)).applyInArrow(lambda a, b: _freeing(_packs, a, b, shards, window, anchor, common), _PACK)
    answers = packs.groupBy("home").applyInArrow(lambda t: _freeing(_match, t, window), _BACK)
    kept = [f for f in plain.schema.fields if f.name != _SHARD]
    schema = T.StructType([*kept, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])

    def finish(left: pa.Table, back: pa.Table) -> pa.Table:
        left = _settled(left)
        words = split_words(left.column(_TEXT), NON_SPACE)
        gone = _removed(left, back, words, window)
        stay = np.flatnonzero(~gone)
        text, at = _joined(words, stay)
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) if words.n else np.zeros(1, np.int8)
        inner = words.first[1:-1]
        inner = inner[(inner > 0) & (inner < words.n)]
        both = np.unique(inner[gone[inner - 1] & gone[inner]]) if len(inner) else inner
        begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), both]))
        end = np.sort(np.concatenate([np.flatnonzero(edge == -1), both]))
        doc = words.doc
        base = words.first[:-1][doc[begin]] if len(begin) else begin
        offsets = np.searchsorted(begin, words.first).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array((begin - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], ["start", "end"]))
        data = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(text)).cast(pa.string())
        arrays = [*(left.column(f.name) for f in kept), pa.array(words.counts), pa.array(per_doc(gone, words.first)), data, spans]
        return pa.table(arrays, names=[*(f.name for f in kept), "n_words", "n_removed", "kept_text", "spans"])

    out = dealt.groupBy(_SHARD).cogroup(answers.groupBy("shard")).applyInArrow(lambda a, b: _freeing(finish, a, b), schema)
    back = [F.col({"doc_id": _ID, "text": _TEXT}.get(c, n)).alias(c) for c, n in zip(docs.columns, columns, strict=True)]
    return out.select(*back, "n_words", "n_removed", "kept_text", "spans")


def _joined(words: Words, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words that stay, those of one text joined by spaces, and where each text starts."""
    sizes = (words.ends - words.starts)[stay] + 1
    doc = words.doc[stay]
    ends = np.cumsum(sizes)
    text = np.full(int(sizes.sum()), 0x20, np.uint8)
    text[_gather(ends - sizes, sizes - 1)] = words.data[_gather(words.starts[stay], sizes - 1)]
    last = np.ones(len(stay), bool)
    last[:-1] = doc[1:] != doc[:-1]
    keep = np.ones(len(text), bool)
    keep[ends[last] - 1] = False
    at = np.zeros(len(words.first), np.int64)
    np.cumsum(np.bincount(doc, weights=sizes - last, minlength=len(words.first) - 1), out=at[1:])
    return text[keep], at.astype(np.int64)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated windows cut from text (n_chars, where there is one, follows it). A text that loses nothing stays as it is; one
    that loses all its words goes."""
    held = [c if c in ("doc_id", "text", "n_chars") else f"in_{k}" for k, c in enumerate(docs.columns)]
    found = find_repeats(docs.select(*(F.col(f"`{c}`").alias(h) for c, h in zip(docs.columns, held, strict=True)))).filter("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    made = {"text": text, "n_chars": F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text")) if "n_chars" in docs.columns else None}
    return found.select(*(made[c].alias(c) if c in made else F.col(h).alias(c) for c, h in zip(docs.columns, held, strict=True)))
