"""Batches that wait longer while many changes are pending."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftwell.operators import jobs
from siftwell.streaming import debounce


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    containsKey = dict.__contains__
    updateValue = dict.__setitem__

    def iterator(self):
        return iter(self.items())


class Clock:
    """The handle, its timers and the time, for one key."""

    def __init__(self, processor):
        self.now, self.timers, self.processor, self.flushed = 1_000, [], processor, []
        processor.init(self)

    getMapState = staticmethod(lambda *_: Map())
    getValueState = staticmethod(lambda *_: Value())

    def registerTimer(self, ms):
        self.timers.append(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    def send(self, *events):
        list(self.processor.handleInputRows(("r",), iter([pd.DataFrame(events, columns=["path", "kind"])]), self))

    def wait(self, ms):
        self.now += ms
        for due in [t for t in self.timers if t <= self.now]:
            self.timers.remove(due)
            out = pd.concat(list(self.processor.handleExpiredTimer(("r",), self, None)))
            self.flushed.append(sorted(zip(out["path"], out["change"], strict=True)))


def test_both_delays_and_an_unlink_undone():
    clock = Clock(debounce.Debounce())
    clock.send(("a", "change"), ("b", "unlink"), (None, "change"))
    clock.wait(700)
    clock.send(("b", "add"), ("a", "unlink"), ("c", "unlink"))  # puts the batch off, and turns both round
    clock.wait(700)
    assert not clock.flushed and len(clock.timers) == 1
    clock.wait(50)
    assert clock.flushed == [[("a", "deleted"), ("b", "changed"), ("c", "deleted")]] and not clock.timers
    clock.wait(10_000)
    assert len(clock.flushed) == 1
    clock.send(*[(f"p{k}", "change") for k in range(99)], *[(f"p{k}", "unlink") for k in range(99)])
    assert clock.timers == [clock.now + 750]  # 99 paths, each once
    clock.send(("p99", "add"))
    assert clock.timers == [clock.now + 5_000]
    clock.wait(4_999)
    assert len(clock.flushed) == 1
    clock.wait(1)
    assert len(clock.flushed[1]) == 100 and clock.flushed[1].count(("p99", "changed")) == 1
    clock.send(("z", "change"))
    assert clock.timers == [clock.now + 750]


def test_stream(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        put = lambda k, *rows: spark.createDataFrame([("r", *r) for r in rows], "root string, path string, kind string, seq int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        put(0, ("a", "change", 1), ("b", "unlink", 2), ("b", "add", 3), ("c", "add", 1), ("c", "unlink", 2))
        source = spark.readStream.schema("root string, path string, kind string, seq int").parquet(f"{tmp_path}/in")
        query = debounce.adaptive_batches(source, quiet_ms=300, busy_quiet_ms=600).writeStream.format("memory").queryName("debounce_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
        until = time.time() + 90
        while time.time() < until and spark.table("debounce_out").count() < 3 and query.isActive:
            time.sleep(1)
        query.stop()
        assert query.exception() is None
        assert sorted((r["path"], r["change"]) for r in spark.table("debounce_out").collect()) == [("a", "changed"), ("b", "changed"), ("c", "deleted")]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


@pytest.mark.parametrize("every", [0, 7])
def test_throttle_of_one_hot_key(spark, every):
    n, gap = 200_000, 5
    events = spark.range(n).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id")).alias("at"), (F.col("id") * 3 % 11 + F.col("id")).alias("c"))
    others = spark.createDataFrame([("x", 1, 1), ("x", 2, 1), ("x", 9, 2), (None, 3, 1)], "k string, s int, c long").select("k", F.timestamp_seconds("s").alias("at"), "c")
    got = jobs.throttled(events.union(others), "k", "at", gap, "c", every) if every else jobs.throttled(events.union(others), "k", "at", gap)
    shown, last = [], None
    for t in range(n):
        c = t * 3 % 11 + t
        if last is None or t - last[0] >= gap or (every and c - last[1] >= every):
            last = (t, c)
            shown.append(t)
    rows = got.select("k", F.unix_seconds("at").alias("t")).collect()
    assert sorted(r["t"] for r in rows if r["k"] == "hot") == shown
    assert sorted((r["k"] or "", r["t"]) for r in rows if r["k"] != "hot") == [("", 3), ("x", 1), ("x", 9)]
    assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
