"""Batches of changed files that wait longer while many changes are pending: a stateful operator with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds without an event after which a batch goes out, those from MANY pending paths on, and that number.
QUIET_MS, BUSY_QUIET_MS, MANY = 750, 5_000, 100
OUTPUT = "root string, path string, change string, flushed_at timestamp"
#: Rows of a batch that are handed over at once.
_ROWS = 10_000


class Debounce(StatefulProcessor):
    """For each root the last change of each pending path, and one timer. An event puts the timer off: by quiet_ms, or by
    busy_quiet_ms while `many` or more paths are pending. When it fires, all pending paths go out, and none stays. A
    path that is deleted and then there again is changed, and the other way round; it counts once."""

    def __init__(self, quiet_ms: int = QUIET_MS, busy_quiet_ms: int = BUSY_QUIET_MS, many: int = MANY):
        self.quiet_ms, self.busy_quiet_ms, self.many = quiet_ms, busy_quiet_ms, many

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "path string", "change string")
        self.waiting = handle.getValueState("waiting", "paths long, due_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        paths, due = self.waiting.get() if self.waiting.exists() else (0, 0)
        last: dict[str, str] = {}
        for frame in rows:
            frame = frame.dropna(subset=["path"])
            if "seq" in frame.columns:
                frame = frame.sort_values("seq", kind="stable")
            last |= {p: "deleted" if k == "unlink" else "changed" for p, k in zip(frame["path"], frame["kind"], strict=True)}
        if last:
            for path, change in last.items():
                paths += not self.pending.containsKey((path,))
                self.pending.updateValue((path,), (change,))
            if due:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + (self.busy_quiet_ms if paths >= self.many else self.quiet_ms)
            self.handle.registerTimer(due)
            self.waiting.update((paths, due))
        yield pd.DataFrame(columns=["root", "path", "change", "flushed_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = pd.Timestamp(timerValues.getCurrentProcessingTimeInMs(), unit="ms")
        rows: list[tuple] = []
        for (path,), (change,) in self.pending.iterator():
            rows.append((key[0], path, change, at))
            if len(rows) >= _ROWS:
                yield pd.DataFrame(rows, columns=["root", "path", "change", "flushed_at"])
                rows = []
        self.pending.clear()
        self.waiting.clear()
        yield pd.DataFrame(rows, columns=["root", "path", "change", "flushed_at"])

    def close(self) -> None:
        pass


def state_store(spark: SparkSession) -> None:
    """Operators with timers need the state store that keeps columns apart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def adaptive_batches(events: DataFrame, root: str = "root", quiet_ms: int = QUIET_MS, busy_quiet_ms: int = BUSY_QUIET_MS, many: int = MANY) -> DataFrame:
    """A stream of events (root, path, kind, and seq if their order within a micro-batch matters) to rows of batches: root,
    path, change (changed or deleted) and flushed_at. Events without path are left out. State grows with the paths pending
    of a root, and a root's events are handled by one task."""
    state_store(events.sparkSession)
    chosen = events.select(events[root].alias("root"), "path", "kind", *(c for c in ("seq",) if c in events.columns))
    return chosen.groupBy("root").transformWithStateInPandas(Debounce(quiet_ms, busy_quiet_ms, many), OUTPUT, "Append", "ProcessingTime")
