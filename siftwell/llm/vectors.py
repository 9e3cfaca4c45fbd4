"""Columns of vectors, and sums of long vectors over all rows in bounded memory on every executor and on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import rows_of

_SLICES = 32


def whole(vector: str, below: float) -> Column:
    """Whether a vector is there and holds finite numbers only, all of them less than `below` from 0."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= below))


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most rows' vectors have, the larger of two; 0 without rows."""
    found = df.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return found["size"] if found else 0


def matrix(lists, length: int) -> np.ndarray:
    """An Arrow column of lists of one length as rows of int64."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), length)


def int_sum(values: np.ndarray, most: int) -> list[int]:
    """Exact sums over axis 0. most: a bound of the absolute values."""
    if most * max(1, len(values)) < 2**62:
        return [int(x) for x in values.sum(axis=0)]
    return [int(x) for x in values.astype(object).sum(axis=0)] if len(values) else [0] * values.shape[1]


def magnitude(*values: np.ndarray) -> int:
    return max((max(int(v.max()), -int(v.min())) for v in values if v.size), default=0)


def summed(df: DataFrame, totals: Callable[[Iterable[pa.RecordBatch]], np.ndarray], length: int) -> np.ndarray:
    """The sum over all partitions of totals(batches), a float64 vector of the given length.

    Each task sends its vector in slices; a slice's sums are taken in a stream, so no task holds more than one
    vector, however many there are. The driver gets one vector.
    """
    size = -(-length // _SLICES)

    def parts(batches):
        vector = np.zeros(size * _SLICES, np.float64)
        vector[:length] = totals(rows_of(batches))
        for k in range(_SLICES):
            if (part := vector[k * size : (k + 1) * size]).any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in rows_of(batches):
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("part"), strict=True):
                part = np.frombuffer(raw.as_buffer(), np.float64)
                held[k] = held[k] + part if k in held else part.copy()
        for k, part in held.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

    schema = "slice int, part binary"
    out = np.zeros(size * _SLICES, np.float64)
    for k, raw in df.mapInArrow(parts, schema).repartition(_SLICES, "slice").mapInArrow(add, schema).collect():
        out[k * size : (k + 1) * size] = np.frombuffer(raw, np.float64)
    return out[:length]
