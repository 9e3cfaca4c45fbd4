"""Change feeds: debounced batches, last event for each path, turns, and suppressed repeats.

Each has a batch form over a bounded table, and those that keep state a streaming form with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import jobs, ordering


def sessions(events: DataFrame, at: str, seconds: float, *keys: str) -> DataFrame:
    """events with session: consecutive numbers of runs in which each event follows the one before within `seconds`,
    for each value of keys (name one: a run is found by ordering its key's events)."""
    w = Window.partitionBy(*keys).orderBy(at, *(c for c in ("event_id",) if c in events.columns))
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    new = F.when(gap.isNull() | (gap > int(seconds * 1_000_000)), 1).otherwise(0)
    return events.withColumn("session", F.sum(new).over(w))


def debounced(events: DataFrame, at: str, seconds: float, *keys: str) -> DataFrame:
    """One row a run: first and last time, and events. Works on streams too, with one key at least: session windows end `seconds` after their
    last event, and a watermark lets their state go."""
    window = F.session_window(at, f"{seconds} seconds")
    return events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).select(*keys, "first_at", "last_at", "events")


def last_event(events: DataFrame, path: str, kind: str, *order: str) -> DataFrame:
    """The last kind of event of each path: a later change undoes a pending delete, and the other way round."""
    return events.groupBy(path).agg(F.max_by(kind, F.struct(*order)).alias(kind))


def split_batch(events: DataFrame, path: str, kind: str, *order: str) -> tuple[DataFrame, DataFrame]:
    """Changed and deleted paths of a batch."""
    last = last_event(events, path, kind, *order)
    return last.filter(F.col(kind) != "unlink").select(path), last.filter(F.col(kind) == "unlink").select(path)


def turns(messages: DataFrame, key: str, seq: str, role: str = "role") -> DataFrame:
    """Pairs each user message with the first later reply of its key before the next user message; open turns have no
    reply. Rows: key, start_seq, reply_seq, open."""
    w = Window.partitionBy(key).orderBy(seq)
    turn = F.sum(F.when(F.col(role) == "user", 1).otherwise(0)).over(w)
    numbered = messages.withColumn("__turn", turn).filter("__turn > 0")
    out = numbered.groupBy(key, "__turn").agg(F.min(F.when(F.col(role) == "user", F.col(seq))).alias("start_seq"), F.min(F.when(F.col(role) == "assistant", F.col(seq))).alias("reply_seq"))
    return out.select(key, "start_seq", "reply_seq", F.col("reply_seq").isNull().alias("open"))


def active_turns(events: DataFrame, key: str, at: str, action: str = "action") -> DataFrame:
    """events with active: how many keys are started and not finished after each event (a second start of a key counts
    once). Keys are tracked by themselves; the count over all of them goes by parts of the ordered log."""
    w = Window.partitionBy(key).orderBy(at)
    state = F.when(F.col(action) == "start", 1).otherwise(0)
    delta = state - F.coalesce(F.lag(state).over(w), F.lit(0))
    return ordering.running_sum(events.withColumn("__d", delta), [at, key], "__d", "active").drop("__d")


def unrepeated(events: DataFrame, at: str, seconds: float, *keys: str) -> DataFrame:
    """Events whose key was not shown in the last `seconds`: the first of each key, then each that comes so long after
    the last one shown. Of events of a key at one time the first by event_id, where there is one, stands for all."""
    key, micros, n = "__key", "__micros", "__n"
    keyed = events.withColumn(key, F.struct(*keys)).withColumn(micros, F.unix_micros(F.col(at).cast("timestamp")))
    order = [c for c in ("event_id",) if c in events.columns] or [micros]
    first = keyed.withColumn(n, F.row_number().over(Window.partitionBy(key, micros).orderBy(*order))).filter(F.col(n) == 1)
    shown = jobs.throttled(keyed, key, at, seconds).select(key, F.unix_micros(at).alias(micros))
    return first.join(shown, [key, micros], "left_semi").select(*events.columns)


def unrepeated_stream(events: DataFrame, at: str, seconds: float, *keys: str) -> DataFrame:
    """The streaming form, with the same result where events come in order: a key's state lasts `seconds` from the event
    that was shown."""
    return events.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark(list(keys))


def run_incremental(changes: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, path: str = "path", kind: str = "kind", order: tuple[str, ...] = ("ts",), once: bool = True):
    """Starts a query that gives each micro-batch's changed and deleted paths to apply(changed, deleted, batch_id).
    apply must be safe to repeat for one batch id, as a restart repeats the last one."""

    def batch(df: DataFrame, batch_id: int) -> None:
        changed, deleted = split_batch(df, path, kind, *order)
        apply(changed, deleted, batch_id)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def turn_tracker(events: DataFrame, timeout_minutes: int = 60) -> DataFrame:
    """A stream of (key, action start or finish, ts) to one row for each finished turn: key, started_at, finished_at.
    State is one time for each open key; it goes once the watermark is past its timeout."""
    import pandas as pd

    def step(key, frames, state):
        started = state.get[0] if state.exists and not state.hasTimedOut else None
        out = []
        for frame in frames:
            for row in frame.sort_values("ts").itertuples():
                if row.action == "start":
                    started = started if started is not None else row.ts
                elif started is not None:
                    out.append((key[0], started, row.ts))
                    started = None
        if started is None:
            if state.exists:
                state.remove()
        else:
            state.update((started,))
            ends = int(pd.Timestamp(started).timestamp() * 1000) + timeout_minutes * 60_000
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "started_at", "finished_at"])

    timed = events.withWatermark("ts", f"{timeout_minutes} minutes")
    return timed.groupBy("key").applyInPandasWithState(step, "key string, started_at timestamp, finished_at timestamp", "started_at timestamp", "append", "EventTimeTimeout")
