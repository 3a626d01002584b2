"""Window forms against plain loops, and batch against stream."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import flow, ordering, rates
from cadenza.sources import commit
from cadenza.sources import frames as source
from cadenza.streaming import flows


def traces(seed: int, sessions: int = 20, n: int = 60):
    rng = random.Random(seed)
    out = []
    for s in range(sessions):
        t = 0
        for i in range(rng.randrange(1, n)):
            t += rng.choice([0, 1, 3, 7, 20, 90])
            out.append((f"s{s}", i, t, rng.choice(["push", "pop"]), rng.randrange(0, 12)))
    return out


def test_throttle_is_the_loop(spark):
    rows = traces(1)
    df = spark.createDataFrame(rows, "session_id string, seq bigint, ts_us bigint, op string, s bigint")
    got = {(r["session_id"], r["seq"]): r["accepted"] for r in flow.throttle(df, 10, ["session_id"], ["ts_us", "seq"]).collect()}
    slot: dict = {}
    for s, i, t, _, _ in rows:
        at = slot.setdefault(s, t)
        assert got[s, i] == (t >= at)
        slot[s] = at + (10 if t >= at else 0)


def test_completion_is_the_loop(spark):
    rows = traces(2)
    df = spark.createDataFrame(rows, "session_id string, seq bigint, ts_us bigint, op string, s bigint")
    got = {(r["session_id"], r["seq"]): r["done"] for r in flow.completion_times(df, "ts_us", "s", ["session_id"], ["ts_us", "seq"]).collect()}
    free: dict = {}
    for s, i, t, _, cost in rows:
        free[s] = max(t, free.get(s, t)) + cost
        assert got[s, i] == free[s]


def brute_queue(ops: list[tuple], held: int) -> dict:
    """Operation by operation; sessions start empty."""
    out, n = {}, {}
    for s, i, what in ops:
        before = n.get(s, 0)
        ok = {"push": before < held, "pop": before > 0, "clear": True, "attach": True}.get(what, False)
        n[s] = 0 if what in ("clear", "attach") else before + ({"push": 1, "pop": -1}.get(what, 0) if ok else 0)
        out[s, i] = (ok, n[s])
    return out


def test_queue_is_the_loop(spark):
    """Also with batches that end inside sessions."""
    rng = random.Random(3)
    ops = [(f"s{s}", i, rng.choice(["push", "push", "pop", "clear", "attach", "odd", None])) for s in range(12) for i in range(rng.randrange(1, 120))]
    df = spark.createDataFrame(ops, "session_id string, seq bigint, op string").withColumn("wide", F.lit("not asked for"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (before, "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = flow.bounded_queue(df, 5, ["session_id"], ["seq"])
        assert {(r["session_id"], r["seq"]): (r["ok"], r["occupancy"]) for r in got.collect()} == brute_queue(ops, 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_scans_are_the_loops():
    rng = np.random.default_rng(7)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        add, low = rng.integers(-3, 4, n), rng.integers(-2, 3, n)
        high = low + rng.integers(0, 5, n)
        low[0] = high[0]
        x, want = 0, []
        for a, b, c in zip(add, low, high, strict=True):
            x = min(max(x + a, b), c)
            want.append(x)
        assert flow.clamped_sums(add, low, high).tolist() == want


def test_windows_and_wakeups_are_the_loops(spark):
    rows = traces(8, 8, 200)
    df = spark.createDataFrame(rows, "session_id string, seq bigint, ts_us bigint, op string, s bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (before, "5"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        windows = {(r["session_id"], r["seq"]): (r["window_no"], r["start_us"], r["closes"]) for r in rates.restarted_windows(df, 40, ["session_id"], ["ts_us", "seq"], []).collect()}
        waked = {(r["session_id"], r["seq"]): (r["wakeup_no"], r["wakeup_us"], r["timeouts"]) for r in flow.coalesced_wakeups(df, 15, 10, ["session_id"], ["ts_us", "seq"]).collect()}
        at, state = {}, {}
        for s, i, t, _, _ in rows:
            if s not in at:
                at[s], state[s] = (t, 0), (0, t, 0)
                assert windows[s, i] == (None, t, False)
            else:
                start, no = at[s]
                assert windows[s, i] == (no, start, t - start >= 40)
                if t - start >= 40:
                    at[s] = (t, no + 1)
                no, now, _ = state[s]
                if t > now:
                    state[s] = (no + 1, max(t, now + 15), max(0, (t - now - 15) // 10))
            assert waked[s, i] == state[s]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_wrong_clock_is_an_error(spark):
    df = spark.createDataFrame([("s", 0, 5, 1), ("s", 1, 10**15, 2)], "session_id string, seq bigint, ts_us bigint, v int")
    with pytest.raises(Exception, match="ticks between two rows"):
        flow.repeat_last(df, 10, ["session_id"], ["seq"], "v").collect()


def test_global_order_in_many_ranges(spark):
    rows = traces(9, 1, 400)
    df = spark.createDataFrame([(i, t, t) for _, i, t, _, _ in rows], "seq bigint, ts_us bigint, ts_ms bigint")
    got = ordering.with_global_intervals(df, ["ts_us", "seq"], bucket_us=10, rows=7).orderBy("seq").collect()
    times = [t for _, _, t, _, _ in rows]
    assert [(r["frame_index"], r["interval_ms"]) for r in got] == [(i, t - times[i - 1] if i else 0) for i, t in enumerate(times)]


def test_hot_sessions_in_many_ranges(spark):
    rows = [r for r in traces(10, 3, 200)]
    df = spark.createDataFrame([(s, i, t, t) for s, i, t, _, _ in rows], "session_id string, seq bigint, ts_us bigint, ts_ms bigint")
    order = ["ts_us", "seq"]
    got = ordering.with_global_intervals(df, order, bucket_us=10, rows=7, keys=["session_id"]).select(*df.columns, "frame_index", "interval_ms")
    want = ordering.with_intervals(df, ["session_id"], order).select(*df.columns, "frame_index", "interval_ms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_replacing_a_table(spark, tmp_path):
    path = str(tmp_path / "table")
    commit.replace_parquet(spark.range(5), path)
    commit.replace_parquet(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4]
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        commit.replace_parquet(broken, path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [3, 4]
    assert not [p for p in tmp_path.iterdir() if ".old-" in p.name]


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame(traces(4), "session_id string, seq bigint, ts_us bigint, op string, s bigint")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    taken = flows.drained(flows.throttle_stream(stream(), 10, ident="seq"), "taken", str(tmp_path / "c1"))
    want = flow.throttle(df, 10, ["session_id"], ["ts_us", "seq"]).filter("accepted").select("session_id", "seq", "ts_us")
    assert sorted(map(tuple, taken.collect())) == sorted(map(tuple, want.collect()))
    closed = flows.drained(flows.restarted_rate_stream(stream(), 40, ident="seq"), "closed", str(tmp_path / "c6"))
    want = rates.live_rate_greedy(df, 40, ["session_id"], ["ts_us", "seq"]).select("session_id", "window_no", "start_us", "end_us", "n")
    assert sorted(map(tuple, closed.collect())) == sorted(map(tuple, want.collect()))
    queue = flows.drained(flows.queue_stream(stream(), 5), "queue", str(tmp_path / "c2"))
    want = flow.bounded_queue(df, 5, ["session_id"], ["seq"]).select("session_id", "seq", "op", "ok", "occupancy")
    assert sorted(map(tuple, queue.collect())) == sorted(map(tuple, want.collect()))


def test_frame_source(spark, tmp_path):
    source.register(spark)
    batch = spark.read.format("cadenza_frames").option("sessions", 2).option("frames", 30).load()
    assert batch.count() == 60
    stream = spark.readStream.format("cadenza_frames").option("frames", 50).load().withColumn("ts", F.timestamp_micros("ts_us"))
    rate = flows.live_rate_stream(stream, "1 second")
    query = rate.writeStream.format("memory").queryName("rate").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).start()
    query.processAllAvailable()
    query.stop()
    assert sum(r["n"] for r in spark.table("rate").collect()) == 50


def test_drain_latest_stream(spark, tmp_path):
    df = spark.createDataFrame([(i, i * 300_000) for i in range(10)], "frame_id bigint, ts_us bigint").withColumn("ts", F.timestamp_micros("ts_us"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = flows.drained(flows.drain_latest_stream(stream, "1 second", ["frame_id"]), "latest", str(tmp_path / "c4"), "complete")
    assert sorted((r["frame_id"], r["drained"]) for r in got.collect()) == [(3, 4), (6, 3), (9, 3)]


def test_log_lines(spark, tmp_path):
    df = spark.createDataFrame([(i,) for i in range(5)], "frame_id bigint")
    df.write.parquet(str(tmp_path / "in"))
    query = flows.log_lines(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c5"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.json(str(tmp_path / "log")).count() == 5
