"""Session logs, the batching stream, and work operators on small rows."""

import json
import random
import time

from tracewell.operators import work
from tracewell.sources import sessions
from tracewell.streaming import monitor


def test_session_usage(spark, tmp_path):
    head = {"type": "session", "id": "s1", "cwd": "/w"}
    said = lambda usage, ts="2026-01-02T03:04:05Z", **m: json.dumps({"type": "message", "timestamp": ts, "message": {"role": "assistant", "usage": usage, **m}})
    folder = tmp_path / "p"
    (folder / "deeper").mkdir(parents=True)
    good = [" ", json.dumps(head), "{not json", said({"input": 5, "output": "7", "cacheRead": -1, "cacheWrite": 2.5, "cost": {"total": 0.5}}, model="m"), said({"totalTokens": 9, "input": 1}), said({"input": 1}, ts="never"), json.dumps({"type": "message", "message": {"role": "assistant"}})]
    (folder / "a.jsonl").write_text("\n".join(good))
    (folder / "b.jsonl").write_text("\n".join(good[2:]))
    (folder / "deeper" / "c.jsonl").write_text("\n".join(good))
    rows = sessions.session_usage(sessions.session_lines(spark, str(tmp_path))).orderBy("total").collect()
    assert [(r.session, r.model, r.provider, r.input, r.output, r.cache_read, r.cache_write, r.total, r.cost) for r in rows] == [
        ("s1", "m", "unknown", 5.0, 0.0, 0.0, 2.5, 7.5, 0.5),
        ("s1", "unknown", "unknown", 1.0, 0.0, 0.0, 0.0, 9.0, 0.0),
    ]
    (folder / "b.jsonl").write_text('{"text": "x", "ts": 4}\n{"text": " "}\n{"text": 3}\n{"torn')
    stored = sessions.prompts(sessions.session_lines(spark, str(tmp_path)).where("file like '%b.jsonl'")).collect()
    assert [(r.v, r.text, r.ts) for r in stored] == [(1, "x", 4)]


def test_line_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((f"j{rng.randrange(2)}", rng.randrange(3000), rng.choice(["", "x", "y"])) for _ in range(300))
    spark.createDataFrame(rows, "job string, ms long, line string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job string, ms long, line string").parquet(str(tmp_path / "in"))
    run = monitor.line_batches(stream, most=4).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    want, at = {}, {}
    for job, ms, line in rows:
        if line:
            if job not in at or ms >= at[job] + 200:
                at[job] = ms
            want.setdefault((job, at[job]), []).append(line)
    end = time.time() + 60
    while time.time() < end and run.isActive and spark.table("batches").count() < len(want):
        time.sleep(0.5)
    run.stop()
    got = {(r.job, r.opened_ms): (len(r.lines), r.omitted) for r in spark.table("batches").collect()}
    assert got == {k: (min(4, len(v)), max(0, len(v) - 4)) for k, v in want.items()}


def test_work_edges(spark):
    nodes = spark.createDataFrame([(1, "A", "t", ["x", " "]), (2, " a", "T", None), (3, None, "t", ["X"]), (4, "b", "t", [""]), (5, None, None, None)], "node long, area string, topic string, tags array<string>")
    assert {r.node: r.reasons for r in work.related(nodes, 1).collect()} == {2: "area,topic", 3: "tag"}
    assert work.related(nodes, 9).count() == 0
    prices = spark.createDataFrame([(1, 2.0, 3.0, 1.0, 1.0), (2, None, 3.0, 1.0, 1.0), (3, 1.0, 1.0, 0.0, 1.0)], "id long, input double, output double, base_input double, base_output double")
    assert [r.blended for r in work.price_ratio(prices).orderBy("id").collect()] == [3.0, None, None]
