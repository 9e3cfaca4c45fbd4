"""The work queue of an index: requests drawn together, progress and repeats held back, and what to resume."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of work.
FULL, CHANGED, DELETED, BACKFILL = "fullRepoIndex", "changedFilesIndex", "deletedFileCleanup", "embeddingBackfill"


def pending(requests: DataFrame, queue: str = "queue", seq: str = "seq") -> DataFrame:
    """The jobs of each queue after its requests (queue, seq, kind, path), none having run: queue, kind, seq (its place),
    paths. One job of a kind is pending at most; further paths of changed and deleted files join it, each once, in order
    of their first request; a backfill is not taken while it or a full run waits. Requests of paths without any are
    dropped."""
    with_paths = F.col("kind").isin(CHANGED, DELETED)
    asked = requests.filter(~with_paths | F.col("path").isNotNull())
    first = asked.groupBy(queue, "kind", F.when(with_paths, F.col("path")).alias("path")).agg(F.min(seq).alias("s"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("s", "path")))), lambda x: x["path"])
    jobs = first.groupBy(queue, "kind").agg(F.min("s").alias(seq), listed.alias("paths"))
    full = F.min(F.when(F.col("kind") == FULL, F.col(seq))).over(Window.partitionBy(queue))
    kept = jobs.withColumn("__full", full).filter((F.col("kind") != BACKFILL) | F.col("__full").isNull() | (F.col(seq) < F.col("__full")))
    return kept.select(queue, "kind", seq, "paths")


def throttled(events: DataFrame, key: str, at: str, seconds: float, count: str | None = None, every: int = 0) -> DataFrame:
    """Of each key's events, by time and count, the first and then each that comes `seconds` or more after the last one
    shown, or whose count is at least `every` more. Of events at one time that with the largest count stands for all.

    What is shown depends on what was shown before, but an event `seconds` after the one before it is shown whatever
    came earlier. So a key's log falls into runs, which are dealt over tasks and gone through in order: a task holds the
    last event shown, and no run is gathered."""
    gap = int(seconds * 1_000_000)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    number = F.col(count).cast("long") if count else F.lit(0).cast("long")
    first = events.groupBy(key, micros.alias("t")).agg(F.max(number).alias("n"))
    w = Window.partitionBy(key).orderBy("t")
    begins = F.coalesce(F.col("t") - F.lag("t").over(w) >= gap, F.lit(True)).cast("int")
    runs = first.withColumn("b", begins).withColumn("run", F.sum("b").over(w))
    ordered = runs.repartition(key, "run").sortWithinPartitions(key, "run", "t").select(key, "t", "n", "b")
    step = every if count else 0

    def show(batches):
        last_t = last_n = 0
        for batch in batches:
            due = []
            for t, n, new in zip(*(batch.column(k).to_numpy().tolist() for k in (1, 2, 3)), strict=True):
                shown = new or t - last_t >= gap or (step and n - last_n >= step)
                if shown:
                    last_t, last_n = t, n
                due.append(bool(shown))
            yield batch.filter(pa.array(due, pa.bool_())).select([0, 1, 2])

    found = ordered.mapInArrow(show, T.StructType(ordered.schema.fields[:3]))
    return found.select(key, F.timestamp_micros("t").alias(at), *([F.col("n").alias(count)] if count else []))


def recovery(queued: Column, running: Column, worker: Column, completed_at: Column, missing: Column, status: Column, chunks: Column, embedded: Column, since_last: Column | None = None, retry_seconds: float = 8.0) -> Column:
    """What an interrupted index does next: kick (work waits and nothing runs), wait (something runs, or the last
    attempt was less than retry_seconds ago), full (never completed), backfill (vectors missing), or none."""
    busy = running | worker.isNotNull()
    early = F.lit(False) if since_last is None else F.coalesce(since_last < retry_seconds, F.lit(False))
    lacks = (missing > 0) | (F.coalesce(status == "not_started", F.lit(False)) & (chunks > 0) & (embedded == 0))
    return F.when((queued > 0) & ~busy, "kick").when(busy | early, "wait").when(completed_at.isNull(), "full").when(lacks, "backfill").otherwise("none")


def batch_size(device: Column, sizes: dict[str, int], fallback: int) -> Column:
    """Texts that are embedded at once on a device."""
    table = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)) if sizes else F.create_map().cast("map<string,int>")
    return F.greatest(F.lit(1), F.coalesce(F.try_element_at(table, device), F.lit(fallback)))


def seeded(known: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """known with those default rows whose key it lacks."""
    return known.unionByName(defaults.join(known.select(key), key, "left_anti").select(*known.columns))
