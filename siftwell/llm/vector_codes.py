"""Vector code compression: product codes, learned by Lloyd's rounds over weighted distinct parts.

Vectors become integers and are cut into parts. Equal parts of a position are one row with a weight, so a round reads
each distinct part once, and a vector that a third of all rows share weighs as much as any other. A round's sums are
integers: the result does not depend on the order in which tasks finish. In the end codes and errors of the distinct
parts are joined back to the vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import own, settle, written
from .vectors import common_length, magnitude, matrix, whole
from .words import rows_of

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components from here on give squares that are far beyond a long.
LARGEST = 2.0**40
#: Labels up to this many are sent to all executors, with a sum each; more are joined by a shuffle.
FEW_LABELS = 1 << 16
_X, _ROW, _ID, _LABEL = own("x"), own("row"), own("id"), own("label")
_CHUNK = 4096
#: Widths of a key's numbers; the least that fits is taken, so equal parts have equal keys.
_WIDTHS = ("<i2", "<i4", "<i8")


def cuts(dimension: int, parts: int) -> list[int]:
    """Where the parts begin and end; they are equal if their number divides the dimension."""
    return [k * dimension // parts for k in range(parts + 1)]


def _keys(x: np.ndarray) -> pa.Array:
    """Each row as bytes, in the least width that holds all its numbers."""
    if not x.shape[1]:
        return pa.array([b""] * len(x), pa.binary())
    least, most = x.min(axis=1), x.max(axis=1)
    fits = [(least >= np.iinfo(w).min) & (most <= np.iinfo(w).max) for w in _WIDTHS]
    if fits[0].all():
        step = 2 * x.shape[1]
        at = pa.py_buffer(np.arange(0, step * (len(x) + 1), step, dtype=np.int32))
        return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, at, pa.py_buffer(np.ascontiguousarray(x.astype("<i2")))])
    width = np.where(fits[0], 0, np.where(fits[1], 1, 2))
    return pa.array([row.astype(_WIDTHS[w]).tobytes() for row, w in zip(x, width, strict=True)], pa.binary())


def _numbers(keys: list[bytes], length: int) -> np.ndarray:
    """Rows of int64 from keys of `length` numbers."""
    out = np.zeros((len(keys), length), np.int64)
    sizes = np.array([len(k) for k in keys])
    for w in _WIDTHS if length else ():
        some = np.flatnonzero(sizes == np.dtype(w).itemsize * length)
        out[some] = np.frombuffer(b"".join(keys[k] for k in some), w).reshape(-1, length)
    return out


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of the codebook for each row of x, the first of several, and the squared distance; all exact.
    Distances are whole numbers, so as long as they stay below 2**52 a product of float matrices gives them exactly;
    beyond that they are summed as int64, and from 2**62 on as Python's integers."""
    most = max(1, x.shape[1]) * (2 * magnitude(x, codebook)) ** 2
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64 if most < 2**62 else object)
    kind = np.float64 if most < 2**52 else np.int64 if most < 2**62 else object
    book = codebook.astype(kind)
    norms = (book * book).sum(axis=1)
    for at in range(0, len(x), _CHUNK if kind is np.float64 else 64):
        some = x[at : at + (_CHUNK if kind is np.float64 else 64)].astype(kind)
        if kind is np.float64:
            far = norms - 2 * (some @ book.T) + (some * some).sum(axis=1)[:, None]
        else:
            far = ((some[:, None, :] - book[None]) ** 2).sum(axis=2)
        code[at : at + len(some)] = best = far.argmin(axis=1)
        error[at : at + len(some)] = far[np.arange(len(some)), best]
    return code, error


def _by_position(batches, lengths: list[int]):
    """(batch, its row numbers, position, parts as numbers) of a table of distinct parts."""
    for batch in rows_of(batches):
        position = batch.column("position").to_numpy()
        for p in np.unique(position):
            at = np.flatnonzero(position == p)
            yield batch, at, int(p), _numbers(batch.column("key").take(pa.array(at)).to_pylist(), lengths[p])


def _round(distinct: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One assignment and the codebooks that follow from it. A task sends a row at most for each entry and component,
    and so does the sum over all tasks."""
    lengths = [b.shape[1] for b in codebooks]

    def run(batches):
        sums = [np.zeros((len(b), b.shape[1] + 1), object) for b in codebooks]
        for batch, at, p, x in _by_position(batches, lengths):
            weight = batch.column("weight").to_numpy()[at]
            order = np.argsort(code := nearest(x, codebooks[p])[0], kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(code[order]) > 0))
            wide = np.int64 if int(weight.sum()) * (magnitude(x) + 1) < 2**62 else object
            rows = np.column_stack([x.astype(wide) * weight[:, None].astype(wide), weight])[order]
            sums[p][code[order][heads]] += np.add.reduceat(rows, heads, axis=0).astype(object)
        for p, total in enumerate(sums):
            entry, place = np.nonzero(total[:, -1:] + np.zeros(total.shape[1], object))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(entry), p), pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array([str(v) for v in total[entry, place]], pa.string())], names=["position", "entry", "place", "total"])

    sent = distinct.mapInArrow(run, "position int, entry int, place int, total string")
    found = sent.groupBy("position", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals = {(p, e, c): int(t) for p, e, c, t in found}
    out = [b.copy() for b in codebooks]
    for (p, e, c), total in totals.items():
        if c < lengths[p]:
            out[p][e, c] = total // totals[p, e, lengths[p]]
    return out


def train(distinct: DataFrame, codebooks: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Lloyd's rounds over distinct parts (position, key, weight). An entry without parts stays as it is."""
    for _ in range(rounds if sum(len(b) for b in codebooks) else 0):
        codebooks = _round(distinct, codebooks)
    return codebooks


def codebooks_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in codebooks for v in b.ravel()).encode()).hexdigest()


def compress(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all rows with a whole vector, and the codebooks (one for each part, entries as rows).

    The frame has the id and label columns, codes (an index into each part's codebook), code (these with two hex digits
    each, more where codebooks need them), error (squared distances summed over parts) and label_error (error summed
    over equal labels, nulls together). Sums that have no place in a long are null.

    Left out are null vectors, those with null or non-finite components or with components from 2**40 up, and those of
    another length than most have. Where the number of parts does not divide the length, parts differ by one. Codebooks
    start from the rows with the least ids (nulls last, equal ids by vector), fewer where there are fewer rows. Repeated
    ids, rows and vectors are answered each by itself; null ids and labels are kept. Other columns do not matter. No
    rows give none. The driver holds the codebooks and their sums.
    """
    label_column = F.col(f"`{label}`") if label in rows.columns else F.lit(None).cast("int")
    ready = rows.filter(whole(vector, LARGEST)).select(F.col(f"`{id}`").alias(_ID), label_column.alias(_LABEL), F.transform(vector, lambda c: F.floor(c.cast("double") * scale)).alias(_X))
    d = common_length(ready, _X)
    ready, at = ready.filter(F.size(_X) == d), cuts(d, parts)
    kinds = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    least = [r[0] for r in ready.orderBy(F.col(_ID).asc_nulls_last(), _X).limit(entries).select(_X).collect()]
    first = np.array(least, np.int64).reshape(len(least), d)
    codebooks = [first[:, a:b] for a, b in zip(at, at[1:], strict=False)]

    def cut(batches):
        for batch in rows_of(batches):
            for begin in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(begin, _CHUNK)
                x, carried = matrix(part.column(_X), d), [c for c in (_ROW, _ID, _LABEL) if c in part.schema.names]
                for p in range(parts):
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(np.full(part.num_rows, p), pa.int32()), _keys(x[:, at[p] : at[p + 1]])], names=[*carried, "position", "key"])

    pieces = ready.select(_X).mapInArrow(cut, "position int, key binary")
    with written(pieces.groupBy("position", "key").agg(F.count("*").alias("weight")), "codes") as distinct:
        codebooks = train(distinct, codebooks, rounds)
        lengths = [b.shape[1] for b in codebooks]

        def assign(batches):
            for batch, some, p, x in _by_position(batches, lengths):
                code, error = nearest(x, codebooks[p])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in ("position", "key")), pa.array(code, pa.int32()), pa.array([str(v) for v in error], pa.string())], names=["position", "key", "entry", "far"])

        assigned = distinct.mapInArrow(assign, "position int, key binary, entry int, far string")
        numbered = ready.withColumn(_ROW, F.monotonically_increasing_id())
        whole_rows = numbered.mapInArrow(cut, f"{_ROW} long, {_ID} {kinds[_ID]}, {_LABEL} {kinds[_LABEL]}, position int, key binary")
        joined = whole_rows.join(assigned, ["position", "key"])
        entry = [F.max(F.when(F.col("position") == p, F.col("entry"))) for p in range(parts)]
        coded = settle(joined.groupBy(_ROW).agg(F.first(_ID).alias(_ID), F.first(_LABEL).alias(_LABEL), F.array(*entry).alias("codes"), F.sum(F.col("far").cast("decimal(38,0)")).alias("far")))
    totals = settle(coded.groupBy(_LABEL).agg(F.sum("far").alias("all")))
    sums = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    digits = max(2, len(f"{max(0, entries - 1):x}"))
    hexes = F.concat(*(F.lpad(F.lower(F.hex(F.col("codes")[p])), digits, "0") for p in range(parts)))
    found = coded.alias("a").join(sums.alias("b"), F.col(f"a.{_LABEL}").eqNullSafe(F.col(f"b.{_LABEL}")))
    fits = lambda c: F.when(F.col(c) < F.lit(2**63 - 1), F.col(c)).cast("long")
    return found.select(F.col(f"a.{_ID}").alias(id), F.col(f"a.{_LABEL}").alias(label), "codes", hexes.alias("code"), fits("far").alias("error"), fits("all").alias("label_error")), codebooks
