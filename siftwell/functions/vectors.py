"""Vector arithmetic over arrays, in double precision, without Python but for the hash embedding."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the common prefix of both."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(_double(a), F.lit(1), n), F.slice(_double(b), F.lit(1), n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_double(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is empty or all zeros."""
    n = F.least(F.size(a), F.size(b))
    size = norm(F.slice(a, F.lit(1), n)) * norm(F.slice(b, F.lit(1), n))
    return F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))


def normalize(v: Column) -> Column:
    """To unit length; zeros stay zeros."""
    size = norm(v)
    factor = F.when((size > 0) & ~F.isnan(size), 1 / size).otherwise(F.lit(0.0))
    return F.zip_with(_double(v), F.array_repeat(factor, F.size(v)), lambda x, f: x * f)  # in a lambda, the norm would be taken for each place


#: Distinct tokens of which a Python worker remembers the hash.
_REMEMBERED = 100_000
_TOKEN = re.compile("[a-z0-9_]+")


@lru_cache(_REMEMBERED)
def _hashed(token: str) -> tuple[int, int]:
    """The number that gives a token's place, and its sign."""
    sha = hashlib.sha256(token.encode()).digest()
    return int.from_bytes(sha[:4], "big"), 1 - 2 * (sha[4] % 2)


def hash_embedding(df: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """key and a unit vector of each row's text: each token of [a-z0-9_]+ adds 1 or -1 at a place, both from its SHA-256.
    Nothing is shuffled: a text's tokens are counted where the text is read. Texts without tokens have zeros."""

    def run(batches):
        for batch in batches:
            sums = np.zeros((batch.num_rows, dimensions))
            for row, value in enumerate(batch.column(1)):
                made = [0] * dimensions
                for token, n in Counter(_TOKEN.findall(value.as_py() or "")).items():
                    place, sign = _hashed(token)
                    made[place % dimensions] += sign * n
                sums[row] = made
            size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            sums *= np.divide(1, size, out=np.zeros_like(size), where=size > 0)
            ends = pa.array(np.arange(batch.num_rows + 1) * dimensions, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], names=batch.schema.names)

    lower = df.select(F.col(key).alias(key), F.lower(F.col(text)).alias("embedding"))
    return lower.mapInArrow(run, StructType([lower.schema[0], StructField("embedding", ArrayType(DoubleType()))]))
