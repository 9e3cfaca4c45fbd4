"""Line dedup: a sharded minimal perfect hash over distinct line hashes, probed by the documents.

Lines are hashed to 128 bits and counted by document. Those found often enough are put into shards; a shard holds a
perfect hash over the first 64 bits and, in the order of its slots, arrays of fingerprints (the other 64 bits), counts
and keepers (the document that keeps the line). Documents are read once more and look their lines up in the arrays, so
neither lines nor texts are shuffled for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import own, pieces, written
from .perfect_hash import PerfectHash
from .words import blocks, rows_of

LEAST_CHARS, LEAST_DOCS = 40, 5
_WHITE = b" \t\n\x0b\x0c\r"
#: Lines in a shard of the index, and lines whose arrays are sent to the executors at once (about 25 bytes each).
SHARD_LINES, PASS_LINES = 1 << 18, 1 << 21
#: UTF-8 bytes of text worked on at once.
_BLOCK = 4 << 20
_HASH, _MARK, _GONE = own("hash"), own("mark"), own("gone")
_INDEX = "sizes binary, words binary, rest binary, fingerprints binary, counts binary, keepers binary"


def key(line: bytes, least_chars: int) -> bytes | None:
    """A line's key: without white space at both ends, A-Z lower-cased. None if it has too few code points."""
    if len(line) < least_chars:
        return None
    line = line.strip(_WHITE)
    n = len(line)
    if n >= least_chars and not line.isascii():
        n -= sum(np.bincount(np.frombuffer(line, np.uint8) >> 6, minlength=4)[2:3])
    return line.lower() if n >= least_chars else None


def hashes(text: bytes, least_chars: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines of a text, the places of those long enough to count, and their hashes (rows of two uint64)."""
    lines = text.split(b"\n")
    keys = [(k, found) for k, line in enumerate(lines) if (found := key(line, least_chars)) is not None]
    raw = b"".join([xxhash.xxh3_128_digest(found) for _, found in keys])
    return lines, np.array([k for k, _ in keys], np.int64), np.frombuffer(raw, "<u8").reshape(-1, 2)


@dataclass
class LineIndex:
    """One shard: a perfect hash and its arrays by slot."""

    slots: PerfectHash
    fingerprints: np.ndarray
    counts: np.ndarray
    keepers: np.ndarray

    @classmethod
    def build(cls, hashed: np.ndarray, counts: np.ndarray, keepers: np.ndarray) -> LineIndex:
        """hashed: distinct rows of two uint64. Counts are cut at what 32 bits hold."""
        table, slots = PerfectHash.build(hashed[:, 0])
        order = np.argsort(slots)
        return cls(table, hashed[order, 1], np.minimum(counts[order], 2**32 - 1).astype(np.uint32), keepers[order])

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The slot of each row, -1 for those that are not in the index."""
        slot = self.slots.slots(hashed[:, 0])
        maybe = np.flatnonzero(slot >= 0)
        wrong = maybe[self.fingerprints[slot[maybe]] != hashed[maybe, 1]]
        n = len(self.fingerprints) - len(self.slots.rest)
        for k in wrong:  # only keys in the rest can have others beside them
            at = slot[k]
            while at >= n and at + 1 < len(self.fingerprints) and self.slots.rest[at + 1 - n] == hashed[k, 0] and self.fingerprints[at] != hashed[k, 1]:
                at += 1
            slot[k] = at if self.fingerprints[at] == hashed[k, 1] else -1
        return slot

    def pack(self) -> list[bytes]:
        return [v.tobytes() for v in (self.slots.sizes, self.slots.words, self.slots.rest, self.fingerprints, self.counts, self.keepers)]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> LineIndex:
        sizes, words, rest, fingerprints, counts, keepers = (np.frombuffer(b, kind) for b, kind in zip(parts, ("<i8", "<u8", "<u8", "<u8", "<u4", "<i8"), strict=True))
        return cls(PerfectHash(sizes, words, rest), fingerprints, counts, keepers)


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % n


def count_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """high, low (a line's hash), documents and keeper (the largest doc_id) of lines in at least so many documents. A
    line of very many documents is counted in every task before its counts meet."""

    def run(batches):
        for batch in rows_of(batches):
            for part in blocks(batch, "text", _BLOCK):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                each = [np.unique(hashes(t.as_buffer().to_pybytes(), least_chars)[2], axis=0) for t in part.column("text").cast(pa.binary())]
                rows = np.concatenate(each).view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(np.repeat(ids, [len(e) for e in each]).astype(np.int64))], names=["high", "low", "doc_id"])

    chosen = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= least_chars)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = chosen.mapInArrow(run, "high long, low long, doc_id long").distinct()
    counted = lines.groupBy("high", "low").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper"))
    return counted.filter(F.col("documents") >= least_docs)


def build_index(counted: DataFrame, shards: int) -> DataFrame:
    """A row for each shard that has lines: shard, and the arrays as binary columns."""

    def build(table: pa.Table) -> pa.Table:
        hashed = np.column_stack([table.column(c).to_numpy().view("<u8") for c in ("high", "low")])
        index = LineIndex.build(hashed, table.column("documents").to_numpy(), table.column("keeper").to_numpy())
        names = [f.split()[0] for f in _INDEX.split(", ")]
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), **{n: pa.array([b], pa.binary()) for n, b in zip(names, index.pack(), strict=True)}})

    number = F.pmod(F.shiftrightunsigned("high", 40), F.lit(shards)).cast("int")
    return counted.withColumn("shard", number).groupBy("shard").applyInArrow(build, f"shard int, {_INDEX}")


def _probe(index: dict[int, LineIndex], shards: int, hashed: np.ndarray, doc_id: int | None, least_docs: int) -> np.ndarray:
    """Which of a document's lines another document keeps."""
    gone = np.zeros(len(hashed), bool)
    if doc_id is None or not len(hashed):
        return gone
    shard = _shard(hashed[:, 0], shards)
    for s in np.unique(shard):
        if (found := index.get(int(s))) is not None:
            at = np.flatnonzero(shard == s)
            slot = found.find(hashed[at])
            at, slot = at[slot >= 0], slot[slot >= 0]
            gone[at] = (found.counts[slot] >= least_docs) & (found.keepers[slot] != doc_id)
    return gone


def _send(index: DataFrame):
    """A block of shards for the executors."""
    rows = index.collect()
    return index.sparkSession.sparkContext.broadcast({r["shard"]: [bytes(b) for b in r[1:]] for r in rows})


def _open(held) -> dict[int, LineIndex]:
    return {s: LineIndex.unpack(parts) for s, parts in held.value.items()}


def _marks(docs: DataFrame, held, shards: int, least_chars: int, least_docs: int) -> DataFrame:
    """doc_id and hash of the lines that go, by a block of shards."""

    def run(batches):
        index = _open(held)
        for batch in rows_of(batches):
            for part in blocks(batch, "text", _BLOCK):
                ids, out = part.column("doc_id").to_pylist(), []
                for i, t in zip(ids, part.column("text").cast(pa.binary()), strict=True):
                    hashed = np.unique(hashes(t.as_buffer().to_pybytes(), least_chars)[2], axis=0)
                    out += [(i, h.tobytes()) for h in hashed[_probe(index, shards, hashed, i, least_docs)]]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([h for _, h in out], pa.binary())], names=["doc_id", _HASH])

    return docs.filter(F.col("doc_id").isNotNull() & (F.length("text") >= least_chars)).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {_HASH} binary")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, shard_lines: int = SHARD_LINES, pass_lines: int = PASS_LINES) -> DataFrame:
    """The rows of docs (doc_id, text) with n_lines, n_dropped and kept_text: without the lines whose key has at least
    `least_chars` code points, is found in at least `least_docs` documents, and that a document with a larger doc_id
    holds too.

    Null and empty texts have one empty line. Rows of one doc_id are one document, each judged by itself; a row without
    doc_id counts for no line and loses none. A document's repeated lines stay or go together. Texts of any length are
    read whole, one at a time. Earlier columns of the new names are replaced, all others pass through.

    An index of up to `pass_lines` lines is sent to all executors at once. A larger one goes block by block, each in a
    job that writes down which lines of which documents go; these meet the texts in a join at the end.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    columns, spark = docs.columns, docs.sparkSession
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(rows: DataFrame, mark) -> DataFrame:
        """mark(): a function of hashes, doc_id and the row's own marks, if any, to the lines that go."""

        def run(batches):
            goes = mark()
            for batch in rows_of(batches):
                for part in blocks(batch, "text", _BLOCK):
                    ids = part.column("doc_id").to_pylist()
                    marks = part.column(_GONE) if _GONE in part.schema.names else [None] * len(ids)
                    total, dropped, kept = [], [], []
                    for i, t, own_marks in zip(ids, part.column("text").cast(pa.binary()), marks, strict=True):
                        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                        lines, at, hashed = hashes(raw, least_chars)
                        gone = at[goes(hashed, i, own_marks)]
                        total.append(len(lines))
                        dropped.append(len(gone))
                        out = set(gone.tolist())
                        kept.append(b"\n".join([line for k, line in enumerate(lines) if k not in out]) if out else raw)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[*columns, "n_lines", "n_dropped", "kept_text"])

        return rows.mapInArrow(run, schema)

    with written(count_lines(docs, least_chars, least_docs), "lines") as counted:
        n = counted.count()
        shards = pieces(n, shard_lines)
        with written(build_index(counted, shards), "line-index") as index:
            n_blocks = pieces(n, pass_lines)
            if n_blocks == 1:
                held = _send(index)

                def lookup():
                    opened = _open(held)
                    return lambda hashed, i, _: _probe(opened, shards, hashed, i, least_docs)

                return cut(docs, lookup)
            found = []
            for k in range(n_blocks):
                held = _send(index.filter(F.pmod("shard", F.lit(n_blocks)) == k))
                found.append(_marks(docs, held, shards, least_chars, least_docs).distinct().checkpoint())
                held.unpersist()
    marks = reduce(DataFrame.unionByName, found).groupBy(F.col("doc_id").alias(_MARK)).agg(F.collect_list(_HASH).alias(_GONE))
    joined = docs.join(marks, F.col("doc_id").cast("long") == F.col(_MARK), "left").drop(_MARK)

    def listed():
        def goes(hashed, _, own_marks):
            marked = set(own_marks.as_py() or ())
            return np.array([h.tobytes() in marked for h in hashed], bool)

        return goes

    return cut(joined, listed)
