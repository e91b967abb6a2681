"""Streams against their batch twins."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gridleaf.streaming import feeds


def plain_throttle(events, interval):
    last, kept = {}, set()
    for task, at, seq, forced in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if forced or task not in last or at - last[task] >= interval:
            last[task] = at
            kept.add((task, seq))
    return kept


def event_rows(seed, n=1500):
    rng = random.Random(seed)
    at, out = 0, []
    for seq in range(n):
        at += rng.choice([1, 5, 30, 90, 700])
        out.append((rng.choice(["hot", "hot", "cold"]), at, seq, rng.random() < 0.05))
    return out


def test_throttle(spark, monkeypatch):
    monkeypatch.setattr(feeds, "BUCKET_MS", 500)
    events = event_rows(3)
    got = feeds.throttle(spark.createDataFrame(events, "task_id string, ts_ms long, seq long, forced boolean")).collect()
    assert {(r.task_id, r.seq) for r in got} == plain_throttle(events, 80)


@pytest.mark.parametrize("interval", [1, 80, 1300])
def test_throttle_over_cells(spark, monkeypatch, interval):
    """Close runs over many cells, equal times, an interval wider than a cell, nulls, columns of any name."""
    monkeypatch.setattr(feeds, "BUCKET_MS", 200)
    rng, at, events = random.Random(interval), -3000, []
    for seq in range(3000):
        at += rng.choice([0, 0, 1, 3, 20])
        events.append((rng.choice(["hot", "hot", "warm", ""]), at, seq, rng.random() < 0.01, f"x{seq}"))
    events += [("far", t, 9000 + i, False, None) for i, t in enumerate([0, 5000, 5010, 90_000])]
    odd = [(None, 5, 1, None, "null task"), (None, 6, 2, None, "drop" if interval > 1 else "stay"), ("hot", None, 8003, None, "no time")]
    frame = spark.createDataFrame(events + odd, "task_id string, ts_ms long, seq long, forced boolean, __last string").repartition(4)
    got = feeds.throttle(frame, interval)
    assert got.columns == frame.columns
    rows = got.collect()
    assert {(r.task_id, r.seq) for r in rows if r.task_id and r.ts_ms is not None} | {("", r.seq) for r in rows if r.task_id == ""} == plain_throttle([e[:4] for e in events], interval)
    assert {r["__last"] for r in rows if r.task_id is None or r.ts_ms is None} == {"null task", "no time"} | ({"stay"} if interval == 1 else set())
    assert len(rows) == len({(r.task_id, r.seq) for r in rows})
    assert feeds.throttle(frame.limit(0), interval).count() == 0 and feeds.throttle(frame, 0).count() == len(events + odd)


def test_throttle_stream(spark, folder):
    events = event_rows(4, 300)
    frame = spark.createDataFrame(events, "task_id string, ts_ms long, seq long, forced boolean").withColumn("ts", F.timestamp_millis("ts_ms"))
    for part in range(3):
        frame.where(F.floor(F.col("seq") / 100) == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in")
    query = feeds.throttle_stream(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert {(r.task_id, r.seq) for r in spark.table("kept").collect()} == plain_throttle(events, 80)


def test_latest_state_stream(spark, folder):
    data = [("a", 1, 0, "queued"), ("a", 2, 1, "running"), ("b", 1, 2, "queued"), ("a", 2, 3, "succeeded")]
    frame = spark.createDataFrame(data, "task_id string, ts long, seq long, status string")
    frame.write.parquet(f"{folder}/in")
    stream = feeds.latest_task_state(spark.readStream.schema(frame.schema).parquet(f"{folder}/in"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination(180)
    rows = lambda f: {(r.task_id, r.seq, r.status) for r in f.collect()}
    assert rows(spark.table("latest")) == rows(feeds.latest_task_state(frame)) == {("a", 3, "succeeded"), ("b", 2, "queued")}


def put(folder, name, body):
    full = os.path.join(folder, name)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as handle:
        handle.write(body)


def test_watch_sees_new_and_rewritten_files_once(spark, folder):
    root, out, seen, batches = f"{folder}/in", f"{folder}/in/done", f"{folder}/state/seen", []
    work = lambda batch, tick: batches.append(sorted(os.path.basename(r.path) for r in batch.collect()))
    look = lambda tick: feeds.watch_tick(spark, root, out, seen, ["pdf"], work, tick)
    put(root, "a.pdf", "1")
    put(root, "b.txt", "1")
    put(out, "r.pdf", "1")
    assert look(0) == 1 and look(1) == 0
    put(root, "a.pdf", "longer")
    put(root, "c.pdf", "1")
    assert look(2) == 2 and look(3) == 0
    assert batches == [["a.pdf"], ["a.pdf", "c.pdf"]]


def test_watch_folder_runs_as_a_query(spark, folder):
    put(f"{folder}/in", "a.pdf", "1")
    batches = []
    query = feeds.watch_folder(spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", ["pdf"], lambda b, n: batches.append(b.count()), 0.5)
    try:
        for _ in range(60):
            if batches:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert batches == [1]


def test_tail_and_merge_streams(spark, folder):
    docs = spark.createDataFrame([(1, 0, 2, False), (2, 1, 3, False)], "doc_id int, ord int, page_count int, encrypted boolean")
    docs.write.parquet(f"{folder}/docs")
    got = []
    feeds.batch_merges(
        spark.readStream.schema(docs.schema).parquet(f"{folder}/docs"), lambda b, n: got.append({r.doc_id: r.first_page for r in b.collect()}), f"{folder}/ck1"
    ).awaitTermination(120)
    assert got == [{1: 1, 2: 3}]
    log = spark.createDataFrame([(i, f"l{i}") for i in range(30)], "seq int, line string")
    log.repartition(3).write.parquet(f"{folder}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")
    feeds.tail_stream(stream, f"{folder}/tail", f"{folder}/ck2", 7).awaitTermination(120)
    newest = max((d for d in os.listdir(f"{folder}/tail")), key=int)
    assert sorted(r.seq for r in spark.read.parquet(f"{folder}/tail/{newest}").collect()) == list(range(23, 30))
