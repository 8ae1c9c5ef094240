"""Heartbeats, retention and guards by a clock of the test's own, and as streams; files that grow between triggers."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from scrivener.operators import jobs
from scrivener.sources import growing
from scrivener.streaming import subscriptions as S


def started(df, tmp_path, name, mode="append", every=None, function=None):
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name))
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return (writer.foreachBatch(function) if function else writer.format("memory").queryName(name)).start()


# Heartbeats


def test_subscription_by_the_clock():
    held = S.Subscription()
    assert held.events([(1, "job", "running", 0), (2, "log", None, 3)], 1000) == [(1, "job", "running", 0, 1000), (2, "log", "running", 3, 1000)]
    assert held.silence(20_999, 20_000) == []
    assert held.silence(21_000, 20_000) == [(None, "heartbeat", "running", 3, 21_000)]
    assert held.silence(30_000, 20_000) == [] and len(held.silence(41_000, 20_000)) == 1
    assert [x[1] for x in held.events([(3, "done", "completed", 3), (4, "log", None, 9)], 42_000)] == ["done"]
    assert held.silence(900_000, 20_000) == [] and held.events([(5, "log", None, 0)], 43_000) == []


def test_subscription_stream_beats_until_done(spark, tmp_path):
    """Real time: a second of silence gives a heartbeat without any new event, and none comes after done."""
    (tmp_path / "in").mkdir()
    write = lambda n, rows: (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(dict(zip(("job", "sequence", "kind", "status", "dropped"), r, strict=True))) for r in rows))
    write(0, [("a", 1, "log", "running", 0), ("b", 1, "done", "completed", 2), ("b", 2, "log", None, 0)])
    events = spark.readStream.schema("job string, sequence long, kind string, status string, dropped long").json(str(tmp_path / "in"))
    q = started(S.subscriptions(events, idle_seconds=1), tmp_path, "beats", every="200 milliseconds")
    rows = lambda: [tuple(r)[:5] for r in spark.table("beats").collect()]

    def until(test, seconds=60):
        end = time.time() + seconds
        while not test() and time.time() < end:
            time.sleep(0.2)
        assert test()

    until(lambda: sum(r[2] == "heartbeat" for r in rows()) >= 2)
    assert {r for r in rows() if r[2] == "heartbeat"} == {("a", None, "heartbeat", "running", 0)}
    write(1, [("a", 2, "done", "completed", 1)])
    until(lambda: ("a", 2, "done", "completed", 1) in rows())
    beats = len(rows())
    time.sleep(3)
    q.stop()
    assert len(rows()) == beats and ("b", 2, "log", "completed", 2) not in rows() and ("b", 1, "done", "completed", 2) in rows()


def test_heartbeats_of_a_log(spark):
    at = lambda s: f"2024-01-01 00:00:{s:06.3f}"
    rows = [("a", 1, at(0), "log"), ("a", 2, at(20), "log"), ("a", 3, at(50.5), "done"), ("a", 4, at(59), "log"), ("b", 1, at(10), "log")]
    df = spark.createDataFrame(rows, "job string, sequence long, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = jobs.heartbeats(df, "job", "sequence", "ts", "kind", "20 SECONDS", F.lit(at(50)).cast("timestamp"))
    beats = sorted((r["job"], r["at"].strftime("%S")) for r in got.filter("kind = 'heartbeat'").collect())
    assert beats == [("a", "40"), ("b", "30"), ("b", "50")]
    assert got.filter("kind <> 'heartbeat'").count() == 4


# Retention


def test_retained_by_the_clock():
    held = S.Retained()
    for i in range(5):
        held.take(f"t{i}", "finished", i * 10)
    held.take("t0", "subscribed", 0)
    assert held.evict(100, 1000, 3) == [("t1", "overflow")] and held.next_expiry(1000) == 1020
    assert held.evict(1030, 1000, 3) == [("t2", "expired"), ("t3", "expired")]
    held.take("t0", "unsubscribed", 0)
    assert held.evict(1030, 1000, 3) == [("t0", "expired")] and held.state() == (["t4"], [40], [], [])
    held.take("t9", "subscribed", 0)
    held.take("t9", "subscribed", 0)
    held.take("t9", "unsubscribed", 0)
    assert S.Retained(*held.state()).watchers == {"t9": 1}


def test_retention_stream_evicts_by_age_without_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("g", f"t{i}", "finished", i) for i in range(4)] + [("g", "t1", "subscribed", 9)]
    (tmp_path / "in/0.json").write_text("\n".join(json.dumps(dict(zip(("group", "task", "kind", "sequence"), r, strict=True))) for r in rows))
    events = spark.readStream.schema("group string, task string, kind string, sequence long").json(str(tmp_path / "in"))
    q = started(S.retention(events, ttl_seconds=2, most=2), tmp_path, "gone", every="200 milliseconds")
    end = time.time() + 60
    while spark.table("gone").count() < 3 and time.time() < end:
        time.sleep(0.2)
    time.sleep(1)
    q.stop()
    assert [(r["task"], r["reason"]) for r in spark.table("gone").orderBy("at_ms", "task").collect()] == [("t0", "overflow"), ("t2", "expired"), ("t3", "expired")]


def test_retention_of_a_table_equals_the_state(spark):
    rng = random.Random(4)
    rows = [(f"g{rng.randint(0, 3)}", f"t{i:03d}", rng.choice(["completed", "failed", "running"]), rng.randint(0, 3000), int(rng.random() < 0.2)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, task string, status string, at int, watchers int").withColumn("done", F.timestamp_seconds("at"))
    now = F.timestamp_seconds(F.lit(3000))
    got = jobs.retention(df, "task", "g", F.col("status"), F.col("done"), F.col("done"), F.col("watchers"), now, "1500 SECONDS", 10).collect()
    want = set()
    for g in range(4):
        held = S.Retained()
        for name, task, status, at, watchers in rows:
            if name == f"g{g}" and status != "running":
                held.take(task, "finished", at)
                if watchers:
                    held.take(task, "subscribed", at)
        want |= set(held.evict(3000, 1500, 10))
    assert {(r["task"], r["reason"]) for r in got} == want and len(got) == len(want)


# Budgets and the circuit breaker

LIMITS = dict(window=6, least=4, rate=0.5, fatal=2)


@pytest.mark.parametrize("limits", [dict(), dict(requests=12), dict(tokens=300)])
def test_guard_of_a_table_and_of_a_stream_equal_the_fold(spark, tmp_path, limits):
    rng = random.Random(len(limits))
    kinds = ["", "timeout", "authentication", "not_found"]
    calls = [{"job": f"j{j}", "sequence": i, "tokens": rng.randint(-5, 40), "ok": (ok := rng.random() < 0.3 + j / 30), "category": "" if ok else rng.choice(kinds[1:])} for j in range(20) for i in range(30)]
    want = {}
    for j in range(20):
        guard = jobs.CallGuard(**limits, **LIMITS)
        for c in (c for c in calls if c["job"] == f"j{j}"):
            want[c["job"], c["sequence"]] = guard.call(c["tokens"], c["ok"], c["category"])
    df = spark.createDataFrame(calls, "job string, sequence long, tokens long, ok boolean, category string")
    kwargs = {("most_tokens" if k == "tokens" else k): v for k, v in limits.items()}
    got = jobs.guarded(df, "job", "sequence", F.col("tokens"), F.col("ok"), F.col("category"), **kwargs, **LIMITS).collect()
    assert {(r["job"], r["sequence"]): r["reason"] for r in got} == want and all(r["refused"] == bool(r["reason"]) for r in got)
    assert len(set(want.values())) > 2
    if limits:
        return
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps(c) for c in calls if c["sequence"] // 10 == n))
        time.sleep(0.02)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    started(S.guarded_calls(stream, **LIMITS), tmp_path, "guarded").awaitTermination(120)
    assert {(r["job"], r["sequence"]): r["reason"] for r in spark.table("guarded").collect()} == want


# Growing files


def test_half_a_line_waits_for_the_rest(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    file = folder / "a.ndjson"
    take = lambda final=False: started(growing.growing_ndjson(spark, str(folder), "job string, n int", final), tmp_path, "grown", function=lambda df, _: seen.extend(tuple(r) for r in df.select("job", "n", "position").collect())).awaitTermination(120)
    seen: list[tuple] = []
    file.write_bytes('{"job":"ä","n":1}\n\n  \n{"job":"b",'.encode())
    take()
    assert seen == [("ä", 1, 0)]
    with file.open("ab") as f:
        f.write(b'"n":2}\n{"job":"c","n":3}\nnot json\n{"job":"d"')
    (folder / "b.ndjson").write_bytes(b'{"job":"e","n":5}\n')
    take()
    assert sorted(seen[1:], key=repr) == [("b", 2, 23), ("c", 3, 41), ("e", 5, 0), (None, None, 59)]
    take()
    assert len(seen) == 5
    with file.open("ab") as f:
        f.write(b',"n":4}')
    take()
    assert len(seen) == 5
    take(final=True)
    assert seen[5:] == [("d", 4, 68)]


@pytest.mark.parametrize("split", [1, 7, 100, 10_000])
def test_ranges_read_each_line_once(tmp_path, split, monkeypatch):
    monkeypatch.setattr(growing, "BLOCK", 13)
    rng = random.Random(split)
    lines = [bytes(rng.choice(b"ab ") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    data = b"\n".join(lines) + b"\nopen"
    (tmp_path / "x").write_bytes(data)
    reader = growing.GrowingLines({"path": str(tmp_path), "split_bytes": str(split)})
    end = reader.latestOffset()
    assert list(end.values()) == [len(data) - 4]
    for start in ({}, {next(iter(end)): sum(len(x) + 1 for x in lines[:20])}):
        got = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        want = [(sum(len(x) + 1 for x in lines[:i]), x.decode().strip()) for i, x in enumerate(lines) if x.strip() and i >= (20 if start else 0)]
        assert [(r["position"], r["value"]) for r in got] == want
    assert reader.partitions({next(iter(end)): 10**9}, end)[0].begin == 0
