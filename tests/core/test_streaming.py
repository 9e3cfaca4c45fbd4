from pyspark.sql import functions as F

from siftwell.streaming import changes

SCHEMA = "path string, kind string, ts timestamp, key string, action string"


def stream(spark, folder, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame([(p, kind, F.to_timestamp, None, None)[:2] + (ts, p, a) for p, kind, ts, a in rows], "path string, kind string, t string, key string, action string").select("path", "kind", F.to_timestamp("t").alias("ts"), "key", "action").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_incremental_batches(spark, tmp_path):
    seen = []
    source = stream(spark, str(tmp_path), [("a", "change", "2024-01-01 00:00:01", None), ("a", "unlink", "2024-01-01 00:00:02", None), ("b", "unlink", "2024-01-01 00:00:01", None), ("b", "add", "2024-01-01 00:00:03", None)], [("c", "add", "2024-01-01 00:00:09", None)])
    changes.run_incremental(source, lambda c, d, k: seen.append((sorted(r[0] for r in c.collect()), sorted(r[0] for r in d.collect()))), str(tmp_path / "state")).awaitTermination()
    assert sorted(seen) == [(["b"], ["a"]), (["c"], [])]


def test_debounced_stream(spark, tmp_path):
    source = stream(spark, str(tmp_path), [("a", "change", "2024-01-01 00:00:00", None), ("b", "change", "2024-01-01 00:00:04", None), ("c", "change", "2024-01-01 00:01:00", None)], [("d", "change", "2024-01-01 01:00:00", None)], [("e", "change", "2024-01-01 02:00:00", None)])
    out = changes.debounced(source.withWatermark("ts", "5 seconds"), "ts", 5, "kind")
    query = out.writeStream.format("memory").queryName("sessions_out").outputMode("append").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(r["events"] for r in spark.table("sessions_out").collect())
    assert got[-1] == 2 and len(got) >= 2


def test_unrepeated_stream(spark, tmp_path):
    source = stream(spark, str(tmp_path), [("a", "x", "2024-01-01 00:00:00", None), ("a", "x", "2024-01-01 00:00:10", None), ("b", "x", "2024-01-01 00:00:10", None)])
    query = changes.unrepeated_stream(source, "ts", 30, "path").writeStream.format("memory").queryName("unrepeated_out").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["path"] for r in spark.table("unrepeated_out").collect()) == ["a", "b"]


def test_turn_tracker(spark, tmp_path):
    source = stream(spark, str(tmp_path), [("k", "", "2024-01-01 00:00:00", "start"), ("m", "", "2024-01-01 00:00:01", "finish")], [("k", "", "2024-01-01 00:00:05", "start"), ("k", "", "2024-01-01 00:00:09", "finish")])
    query = changes.turn_tracker(source.select("key", "action", "ts")).writeStream.format("memory").queryName("turns_out").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["key"], str(r["started_at"])[-8:], str(r["finished_at"])[-8:]) for r in spark.table("turns_out").collect()] == [("k", "00:00:00", "00:00:09")]


def test_active_turns(spark):
    events = spark.createDataFrame([("a", "start", 1), ("b", "start", 2), ("a", "start", 3), ("a", "finish", 4), ("c", "finish", 5), ("b", "finish", 6)], "key string, action string, at int")
    assert [r["active"] for r in changes.active_turns(events, "key", "at").orderBy("at").collect()] == [1, 2, 2, 1, 1, 0]
