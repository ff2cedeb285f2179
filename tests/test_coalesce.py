"""Coalescing: priorities, times to live, repeated keys, intervals; batch and stream alike."""

import time

from tracewell.streaming import coalesce

SCHEMA = "session string, now_ms long, key string, priority int, occurred_ms long"
ROWS = [
    ("a", 0, "k1", 1, 0), ("a", 50, "k2", 0, 50), ("a", 60, "k3", 2, 60), ("a", 70, "k3", 9, 70), ("a", 5000, "late", 5, 2900), ("a", 5100, "ahead", 5, 9000), ("a", 5200, "k4", 1, 5200),
    ("a", 5210, "k5", 1, 5210), ("a", 5400, "k6", 3, 5400), ("b", 10, "k1", 1, 10), ("b", None, "x", 1, 1),
]
WANT = {("a", "k3", 2, 150), ("a", "k5", 1, 5350), ("a", "k6", 3, 6350), ("b", "k1", 1, 160)}


def test_batch(spark):
    assert {tuple(r) for r in coalesce.coalesced_batch(spark.createDataFrame(ROWS, SCHEMA)).collect()} == WANT
    assert coalesce.coalesced_batch(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(source)
    stream = coalesce.coalesced(spark.readStream.schema(SCHEMA).parquet(source))
    run = stream.writeStream.format("memory").queryName("notified").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    end = time.time() + 60
    while time.time() < end and run.isActive and spark.table("notified").count() < len(WANT):
        time.sleep(0.5)
    run.stop()
    assert {tuple(r) for r in spark.table("notified").collect()} == WANT
