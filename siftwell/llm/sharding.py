"""Sharding by jump consistent hashing: no ring table, and growing from n to n + 1 shards moves a row only into
the new shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import gapless, own

_STEP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach, 2014)."""
    keys = keys.astype(np.uint64)
    at, nxt = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        at[live] = nxt[live]
        keys[live] = keys[live] * _STEP + np.uint64(1)
        nxt[live] = ((at[live] + 1) * (float(1 << 31) / ((keys[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[nxt[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """key: a non-null long column with evenly spread bits."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().view(np.uint64).copy(), shards))

    return jump(key)


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """Rows of docs with shard, grown_shard (with one shard more), size (UTF-8 bytes of text, 0 for null, plus 1) and
    text_crc32 (null: of no bytes). Earlier columns of these names are replaced, others pass through. Only the key and
    the number of shards decide, for repeated rows as for any; a null key counts as a key of its own."""
    hashed = F.coalesce(F.xxhash64(F.col(key).cast("string")), F.lit(0).cast("long"))
    sized = docs.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "text_crc32": F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long"), own("key"): hashed})
    return sized.withColumns({"shard": shard_of(F.col(own("key")), shards), "grown_shard": shard_of(F.col(own("key")), shards + 1)}).drop(own("key"))


def shard_table(docs: DataFrame, shards: int = 16, key: str = "doc_id") -> DataFrame:
    """The key of each row with its size, text_crc32, shard, grown_shard and slot (gapless from 0 in each shard, in
    an order that is the same in each run; equal rows get neighbouring slots). Texts are not shuffled."""
    rows = docs.count()
    placed = assign_shards(docs.select(key, "text"), shards, key).select(key, "size", "text_crc32", "shard", "grown_shard")
    return gapless(placed, "shard", [key, "text_crc32", "size"], "slot", rows)
