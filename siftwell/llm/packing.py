"""Best-fit packing of tokenised documents by pattern packing with non-negative least squares.

The histogram of piece lengths (at most one entry a length) is all that the driver sees. Patterns of up to three
lengths that fill a sequence are enumerated; a non-negative least-squares fit finds how often to repeat each, the
counts are rounded to what the histogram holds, and the residual pieces are packed best-fit, longest first. The plan
is a list of runs: the pieces number a to b of one length go to sequences s, s + 1, ... at one offset.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import gapless, own, settle
from .words import blocks, column_bytes, rows_of

LENGTH, END_ID = 1024, 2
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_LATIN_LEAD = 0xC9  # first bytes up to here: characters below U+0240, on which both libraries are known to agree


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary: the tokenizers file, and optionally the same one as ranks for tiktoken with its
    split pattern, which is faster, and the file's added tokens. Texts with characters past U+023F, and those in which
    an added token's string occurs, always go through tokenizers."""

    path: str
    ranks: str | None = None
    pattern: str | None = None
    added: tuple[str, ...] = ()


def added_tokens(path: str) -> tuple[str, ...]:
    """The strings that a tokenizers file takes as tokens of their own wherever they occur in a text."""
    with open(path, encoding="utf-8") as file:
        return tuple(sorted(t["content"] for t in json.load(file).get("added_tokens") or () if t["content"]))


def public_vocabulary() -> Vocabulary:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return Vocabulary(path, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added_tokens(path))


class Encoder:
    """Token ids of texts, those that the tokenizers file gives by itself, without the tokens of its post-processor:
    the string of an added token in a text has that token's id."""

    _made: dict = {}

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.slow, self.fast = vocabulary, None, None
        self.added = re.compile("|".join(map(re.escape, vocabulary.added))) if vocabulary.added else None
        if vocabulary.ranks:
            import base64

            import tiktoken

            with open(vocabulary.ranks, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(f"siftwell {vocabulary.ranks}", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})

    def _exact(self, text: str) -> list[int]:
        if self.slow is None:  # large, and most workers never need it
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.vocabulary.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Encoder:
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def encode(self, texts: pa.Array):
        """The ids of each text, one after the other."""
        data, at = column_bytes(texts)
        top = np.zeros(len(texts), np.uint8)
        full = np.flatnonzero(np.diff(at))
        if len(full):
            top[full] = np.maximum.reduceat(data, at[:-1][full])
        for text, high in zip(texts.to_pylist(), top, strict=True):
            if not text:
                yield np.zeros(0, np.uint32)
            elif self.fast is not None and high <= _LATIN_LEAD and not (self.added and self.added.search(text)):
                yield np.array(self.fast.encode_ordinary(text), np.uint32)
            else:
                yield np.array(self._exact(text), np.uint32)


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: full ones, but for a shorter first one."""
    head = n % most or most
    return [(0, head), *((s, most) for s in range(head, n, most))] if n else []


def token_pieces(docs: DataFrame, vocabulary: Vocabulary, most: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece. A null text counts as an empty one and, like
    it, gives one piece of the end id alone. Each repeated row gives pieces of its own."""

    def run(batches):
        encoder = Encoder.of(vocabulary)
        for batch in rows_of(batches):
            for part in blocks(batch, "text", 2 << 20):
                out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), most)):
                        piece = ids[start : start + length]
                        for c, v in (("doc_id", doc_id), ("piece", k), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(piece.tobytes()))):
                            out[c].append(v)
                        if with_ids:
                            out["ids"].append(piece.astype(np.int32))
                fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * with_ids]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(fields))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES + ", ids array<int>" * with_ids)


def patterns(lengths: np.ndarray, most: int) -> np.ndarray:
    """Rows of up to three of the lengths, descending and padded by 0, that fill a sequence exactly or, with any one
    more length, would not; of two lengths the best partner below the gap stands in where no exact one exists."""
    there = np.zeros(most + 1, bool)
    there[lengths] = True
    below = np.maximum.accumulate(np.where(there, np.arange(most + 1), 0))  # the largest length up to each size
    a = lengths.astype(np.int64)
    one = np.stack([a, np.zeros_like(a), np.zeros_like(a)], 1)
    two = np.stack([a, below[most - a], np.zeros_like(a)], 1)
    x, y = np.meshgrid(a, a, indexing="ij")
    ok = (y <= x) & (x + y < most)
    x, y = x[ok], y[ok]
    z = below[most - x - y]
    three = np.stack([x, y, z], 1)[(z > 0) & (z <= y)]
    return np.unique(-np.sort(-np.concatenate([one, two, three]), axis=1), axis=0)


def fit_repeats(rows: np.ndarray, histogram: np.ndarray, most: int, steps: int = 300) -> np.ndarray:
    """How often to use each pattern: minimises the weighted squared difference between what the patterns use and the
    histogram, over non-negative counts, by accelerated projected gradient. Leftover long pieces weigh more, and so
    does the room that a pattern leaves free."""
    target = histogram.astype(np.float64)
    scale = max(target.max(), 1.0)
    weight = (0.1 + np.arange(most + 1) / most) ** 2
    waste = (most - rows.sum(axis=1)) / most
    valid = rows > 0

    def used(x):
        return np.bincount(rows.ravel(), weights=(valid * x[:, None]).ravel(), minlength=most + 1)

    def gradient(x):
        miss = weight * (used(x) - target / scale)
        return (miss[rows] * valid).sum(axis=1) + 0.05 * waste

    probe = np.ones(len(rows))
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = (weight * used(probe))[rows]
        probe = (probe * valid).sum(axis=1)
        size = np.linalg.norm(probe)
        probe /= size
    step = 1.0 / max(size, 1e-12)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * gradient(y))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x * scale


def round_to(rows: np.ndarray, wanted: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole counts of at most what the histogram allows, and the residual histogram. Fuller patterns, then those
    wanted most, go first."""
    left, counts = histogram.copy(), np.zeros(len(rows), np.int64)
    for k in np.lexsort((-wanted, -rows.sum(axis=1))):
        n = int(np.floor(wanted[k] + 0.5))
        if n < 1:
            continue
        lengths, need = np.unique(rows[k][rows[k] > 0], return_counts=True)
        counts[k] = n = min(n, int((left[lengths] // need).min()))
        left[lengths] -= n * need
    return counts, left


def best_fit(left: np.ndarray, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs the residual histogram longest first, each piece into the open sequences with the least room that holds
    it; equal sequences are handled by their count. Returns (lengths, count)."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    sizes: list[int] = []

    def put(room, row, n):
        if room not in rooms:
            rooms[room] = {}
            bisect.insort(sizes, room)
        rooms[room][row] = rooms[room].get(row, 0) + n

    for length in range(most, 0, -1):
        rest = int(left[length])
        while rest:
            at = bisect.bisect_left(sizes, length)
            if at == len(sizes):  # new sequences, with as many equal pieces as fit in each
                each = most // length
                if full := rest // each:
                    put(most - each * length, (length,) * each, full)
                if over := rest % each:
                    put(most - over * length, (length,) * over, 1)
                break
            room = sizes[at]
            row, have = next(iter(rooms[room].items()))
            n = min(have, rest)
            if have == n:
                del rooms[room][row]
                if not rooms[room]:
                    del rooms[room]
                    sizes.pop(at)
            else:
                rooms[room][row] = have - n
            put(room - length, (*row, length), n)
            rest -= n
    return [(row, n) for found in rooms.values() for row, n in found.items()]


def plan(histogram: np.ndarray, most: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """Runs (length, first number, first sequence, offset), by length and number; each goes on to the next one of its
    length. histogram[n]: pieces of length n. Its size depends on `most` alone."""
    histogram = histogram.astype(np.int64).copy()
    histogram[0] = 0
    lengths = np.flatnonzero(histogram[:most])
    packed: list[tuple[tuple[int, ...], int]] = [((most,), int(histogram[most]))] if histogram[most] else []
    left = histogram.copy()
    left[most] = 0
    if len(lengths):
        rows = patterns(lengths, most)
        counts, left = round_to(rows, fit_repeats(rows, left, most), left)
        packed += [(tuple(int(v) for v in rows[k] if v), int(counts[k])) for k in np.flatnonzero(counts)]
    packed += best_fit(left, most)
    used, sequence, runs = np.zeros(most + 1, np.int64), 0, []
    for row, n in packed:
        offset = 0
        for length in row:
            runs.append((length, int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    assert (used == histogram).all()
    return sorted(runs)


def place(pieces: DataFrame, runs: list[tuple[int, int, int, int]], rows: int) -> DataFrame:
    """pieces with sequence_id and offset."""
    rank = own("rank")
    numbered = gapless(pieces, "length", ["doc_id", "piece", "ids_crc32", "start"], rank, rows)
    length, first, sequence, offset = (np.array([r[k] for r in runs], np.int64) for k in range(4))
    held = pieces.sparkSession.sparkContext.broadcast((length << 44 | first, first, sequence, offset))
    columns = pieces.columns
    schema = numbered.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches):
        key, first, sequence, offset = held.value
        for batch in rows_of(batches):
            ranks = batch.column(rank).to_numpy()
            at = np.searchsorted(key, batch.column("length").to_numpy() << 44 | ranks, "right") - 1
            new = [pa.array(sequence[at] + ranks - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], names=[*columns, "sequence_id", "offset"])

    return numbered.select(*columns, rank).mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, most: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset (see token_pieces). Texts are tokenised once,
    and only the table of pieces is kept and shuffled."""
    pieces = settle(token_pieces(docs, vocabulary or public_vocabulary(), most, end_id))
    histogram = np.zeros(most + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most one row a length
        histogram[length] = n
    return place(pieces, plan(histogram, most), int(histogram.sum()))
