"""Embedding whitening: centred distinct vectors as a distributed row matrix, whose singular value decomposition gives
the components.

Entries are scaled to integers first, so sums and deviations are exact whatever order tasks add them in. The matrix
is decomposed by Spark MLlib; its singular values become eigenvalues of the covariance by the divisor n. The total
variance does not come from them, but from the exact deviations of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import own, written
from .vectors import common_length, int_sum, magnitude, matrix, summed, whole
from .words import rows_of

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries from here on have no place in a long once scaled.
LARGEST = 2.0**55
_X, _LIMB = own("x"), 10**18
#: Rows that are worked on at once.
_ROWS = 4096


@dataclass
class Whitening:
    """What is learned from the fit list; its size depends on the dimension only."""

    n: int
    sums: list[int]
    axes: np.ndarray  # dimension x components, unit columns
    eigenvalues: np.ndarray
    total: float  # the trace of the covariance
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.total for e in self.eigenvalues]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less its mean. The mean's whole part is taken off as integers, so little is rounded."""
        return (x - self._whole).astype(np.float64) - self._part

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Sums within a row, not a matrix product, whose last bits would depend on the rows beside it."""
        moved, out = self.centred(x), np.zeros((len(x), len(self.eigenvalues)))
        for k, e in enumerate(self.eigenvalues):
            out[:, k] = (moved * self.axes[:, k]).sum(axis=1) / np.sqrt(e)
        return out

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sums over dimensions of (n * x - sum) ** 2."""
        moved, rest = x - self._whole, [s % self.n for s in self.sums]
        most = self.n * (magnitude(moved) + 1)
        if most * most * max(1, x.shape[1]) < 2**63:
            return [int(v) for v in ((self.n * moved - np.array(rest, np.int64)) ** 2).sum(axis=1)]
        wide = moved.astype(object) * self.n - np.array(rest, object)
        return [sum(v * v for v in row) for row in wide]

    @property
    def _whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def _part(self) -> np.ndarray:
        return np.array([s % self.n / self.n for s in self.sums])


def integers(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows with whole vectors, and these as longs floor(scale * entry) + shift in a column of the operator's own."""
    return rows.filter(whole(vector, LARGEST)).withColumn(_X, F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")))


def _parts(batches, dimension: int):
    for batch in rows_of(batches):
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, matrix(part.column(_X), dimension)


def _column_sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """How many rows there are, and the sum of each dimension. A task sends one row a dimension."""

    def run(batches):
        rows, sums = 0, [0] * dimension
        for part, x in _parts(batches, dimension):
            rows += part.num_rows
            sums = [a + b for a, b in zip(sums, int_sum(x, magnitude(x)), strict=True)]
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, dimension), pa.int32()), "total": pa.array([str(v) for v in [rows, *sums]], pa.string())})

    found = fit.mapInArrow(run, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    totals = {d: int(t) for d, t in found.collect()}
    return totals.get(-1, 0), [totals.get(k, 0) for k in range(dimension)]


def _decompose(fit: DataFrame, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the covariance, falling, and its axes, without those that are 0 but for rounding."""
    d = len(model.sums)

    def run(batches):
        for _, x in _parts(batches, d):
            flat = model.centred(x).ravel()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, d), pa.int32()), pa.array(flat))], names=["row"])

    rows = fit.mapInArrow(run, "row array<double>").select(array_to_vector("row").alias("row"))
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "row"), model.n, d).computeSVD(d)
    if found.s is None or not len(found.s):
        return np.zeros(0), np.zeros((d, 0))
    e = found.s.toArray() ** 2 / model.n
    kept = e > e[0] * d * 8 * np.finfo(float).eps
    return e[kept], found.V.toArray()[:, : len(e)][:, kept]


def _total_deviation(fit: DataFrame, model: Whitening) -> int:
    """The sum of all rows' deviations, in two limbs, as it can have more than 38 digits."""

    def run(batches):
        total = sum(sum(model.deviations(x)) for _, x in _parts(batches, len(model.sums)))
        yield pa.RecordBatch.from_pydict({"high": pa.array([str(total // _LIMB)], pa.string()), "low": pa.array([total % _LIMB], pa.int64())})

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    high, low = fit.mapInArrow(run, "high string, low long").agg(*wide).first()
    return int(high or 0) * _LIMB + int(low or 0)


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.eigenvalues)

    def totals(batches):
        out = np.zeros(k * k)
        for _, x in _parts(batches, len(model.sums)):
            w = model.whiten(x)
            out += (w.T @ w).ravel()
        return out

    return float(np.abs(summed(fit, totals, k * k).reshape(k, k) / model.n - np.eye(k)).max())


def fit_whitening(distinct: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening:
    """Learns from a table of distinct integer vectors (column of `integers`), read once for each of four sums."""
    n, sums = _column_sums(distinct, dimension)
    model = Whitening(n, sums, np.zeros((dimension, 0)), np.zeros(0), 0.0)
    if n and dimension:
        e, axes = _decompose(distinct, model)
        model.eigenvalues, model.axes = e[:components], axes[:, :components]
        model.total = float(Fraction(_total_deviation(distinct, model), n**3))
        if len(model.eigenvalues):
            model.identity_error = _identity_error(distinct, model)
    return model


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The rows with a whole vector, with n (distinct integer vectors), deviation (long; null if it has no place in
    one), deviation_exact (decimal), whitened (an entry for each component, falling eigenvalues), explained (of each
    component) and identity_error.

    Left out are null vectors, those with null or non-finite entries or with entries from 2**55 up, and those of
    another length than most distinct vectors have. Repeated rows and vectors count once in the fit and are answered
    each by itself; a null id or label does not matter. There are fewer components than asked for where the covariance
    has a smaller rank, none for one distinct vector. No rows give none. Earlier columns of the new names are replaced,
    all others pass through. The driver holds the dimension's square, not the rows.
    """
    rows = rows.drop("n", "deviation", "deviation_exact", "whitened", "explained", "identity_error")
    columns = rows.columns
    ready = integers(rows, vector, scale, shift)
    with written(ready.select(_X).distinct(), "whitening") as distinct:
        d = common_length(distinct, _X)
        model = fit_whitening(distinct.filter(F.size(_X) == d), d, components)

    def run(batches):
        for part, x in _parts(batches, d):
            exact = model.deviations(x)
            flat = model.whiten(x).ravel()
            at = np.arange(0, part.num_rows + 1) * len(model.eigenvalues)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in columns), pa.array([v if v < 2**63 else None for v in exact], pa.int64()), pa.array([str(v) for v in exact], pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.float64()))],
                names=[*columns, "deviation", "deviation_exact", "whitened"],
            )

    added = [T.StructField("deviation", T.LongType()), T.StructField("deviation_exact", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    found = ready.filter(F.size(_X) == d).mapInArrow(run, T.StructType([*rows.schema.fields, *added]))
    explained = F.array(*map(F.lit, model.explained)).cast("array<double>")
    return found.select(*(F.col(f"`{c}`") for c in columns), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("deviation_exact").cast("decimal(38,0)").alias("deviation_exact"), "whitened", explained.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
