"""Counts over the tables of an index. Sums are null on empty tables, as SQL has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(test: Column) -> Column:
    return F.sum(F.when(test, 1).otherwise(0))


def file_stats(files: DataFrame) -> DataFrame:
    gone = F.col("deleted_at").isNotNull()
    return files.agg(F.count("*").alias("total"), _n(~gone).alias("active"), _n(gone).alias("deleted"), _n(~gone & F.col("is_generated")).alias("generated"), F.max("last_indexed_at").alias("last_indexed_at"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("path").alias("files"), F.max("updated_at").alias("updated_at"))


def embedding_stats(chunks: DataFrame, embeddings: DataFrame, files: DataFrame) -> DataFrame:
    """Over chunks of active files: embedded, stale, missing, total, last."""
    live = chunks.join(files.filter("deleted_at IS NULL").select("path"), "path", "left_semi")
    e = embeddings.select("chunk_id", "stale", F.col("updated_at").alias("__at"))
    there = F.col("stale").isNotNull()
    return live.join(e, "chunk_id", "left").agg(_n(there & ~F.col("stale")).alias("embedded"), _n(there & F.col("stale")).alias("stale"), _n(~there).alias("missing"), F.count("*").alias("total"), F.max("__at").alias("last"))


def by_kind(rows: DataFrame, kind: str = "kind") -> DataFrame:
    """Count of each kind, and of all under `total`."""
    return rows.rollup(kind).agg(F.count("*").alias("n")).select(F.coalesce(kind, F.lit("total")).alias("kind"), "n")


def rule_stats(rules: DataFrame) -> DataFrame:
    return rules.agg(F.count("*").alias("total"), _n(F.col("status") == "active").alias("active"), _n(F.col("status") == "disabled").alias("disabled"))


def scan_counters(scanned: DataFrame) -> DataFrame:
    """Files kept, and files skipped by reason (a null reason: kept)."""
    reason = lambda r: _n(F.col("skip_reason") == r)
    return scanned.agg(_n(F.col("skip_reason").isNull()).alias("files"), _n(F.col("skip_reason").isNotNull()).alias("skipped"), reason("ignored").alias("skipped_ignored"), reason("binary").alias("skipped_binary"), reason("too_large").alias("skipped_too_large"))


def throughput(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """Items a second, and seconds until the end; null where nothing is known."""
    rate = F.when((done > 0) & (seconds > 0), done / seconds)
    return rate, F.when(rate > 0, F.greatest(total - done, F.lit(0)) / rate)
