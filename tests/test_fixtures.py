"""Hand-made fixtures with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.functions import binary
from cadenza.functions import scalars as S
from cadenza.operators import flow, joins, ordering, pacing, rates, sync
from cadenza.sources import timing_log, wav


def frames(spark, times):
    return spark.createDataFrame([("s", i, t, t * 1000) for i, t in enumerate(times)], "session_id string, frame_id bigint, ts_ms bigint, ts_us bigint")


def summary(spark, times):
    return pacing.pacing_summary(ordering.with_intervals(frames(spark, times), ["session_id"], ["ts_us", "frame_id"]), ["session_id"]).collect()


@pytest.mark.parametrize(
    ("times", "mean", "stddev", "rate", "target", "cov", "severity"),
    [
        ([0, 16, 33, 50, 66, 83, 100, 116, 133, 150], 16.666667, 0.471405, 60.0, 16.666667, 0.028284, "good"),
        ([0, 16, 33, 60, 66, 83, 104, 116, 133, 155], 17.222222, 5.652488, 58.064516, 17.241379, 0.328209, "warn"),
        ([0, 16, 33, 50, 66, 166, 183, 200, 216, 233], 25.888889, 26.20621, 38.626609, 25.641026, 1.012257, "crit"),
        ([0, 3000, 6000, 9000], 3000, 0, 0.333333, None, 0, "good"),
        ([5, 5, 5, 5], 0, 0, None, None, None, "crit"),
    ],
)
def test_pacing(spark, times, mean, stddev, rate, target, cov, severity):
    (row,) = summary(spark, times)
    close = lambda x: None if x is None else pytest.approx(x, abs=1e-5)
    assert (row["mean_ms"], row["stddev_ms"]) == (close(mean), close(stddev))
    assert row["rate"] == close(rate)
    assert row["target_ms"] == close(target)
    assert row["cov"] == close(cov)
    assert row["severity"] == severity
    assert row["frames"] == len(times)


def test_too_short_and_empty(spark):
    assert summary(spark, [0, 16]) == []
    assert summary(spark, []) == []


def test_throttle(spark):
    times = [0, 5, 10, 16, 17, 30, 34, 50, 51, 120, 121, 122, 123, 124, 125, 140]
    rows = flow.throttle(frames(spark, times), 16_000, ["session_id"], ["ts_us", "frame_id"]).orderBy("frame_id").collect()
    assert [int(r["accepted"]) for r in rows] == [1, 0, 0, 1, 0, 0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 1]


def test_bounded_queue(spark):
    ops = ["pop", *["push"] * 5, "pop", "push", *["pop"] * 4]
    df = spark.createDataFrame([("s", i, o) for i, o in enumerate(ops)], "session_id string, seq bigint, op string")
    rows = flow.bounded_queue(df, 4, ["session_id"], ["seq"]).orderBy("seq").collect()
    assert [r["ok"] for r in rows] == [False, True, True, True, False, False, True, True, True, True, True, False]


def test_greedy_windows(spark):
    rows = rates.live_rate_greedy(frames(spark, [0, 300, 700, 1100, 1500, 2050, 2200, 3300, 3400]), 1_000_000, ["session_id"], ["ts_us", "frame_id"]).orderBy("window_no").collect()
    assert [(r["start_us"], r["end_us"], r["n"]) for r in rows] == [(0, 1_100_000, 3), (1_100_000, 2_200_000, 3), (2_200_000, 3_300_000, 1)]


def test_repeat_last(spark):
    df = spark.createDataFrame([("s", 0, 0, None), ("s", 1, 5, "a"), ("s", 2, 47, "b"), ("s", 3, 100, None)], "session_id string, frame_id bigint, ts_us bigint, v string")
    rows = flow.repeat_last(df.filter("v IS NOT NULL OR frame_id IN (0, 3)"), 20, ["session_id"], ["frame_id"], "v").orderBy("tick_us").collect()
    assert [(r["tick_us"], r["last"]) for r in rows] == [(0, None), (20, "a"), (40, "a"), (60, "b"), (80, "b"), (100, None)]


@pytest.mark.parametrize(("raw", "video", "tracks"), [([0.25, 0.5], 0, [0.25, 0.5]), ([-0.25, 0.5], 0.25, [0, 0.75]), ([-0.75, -0.25], 0.75, [0, 0.5])])
def test_sync_offsets(spark, raw, video, tracks):
    v = spark.createDataFrame([("s", 1_000_000)], "session_id string, anchor_us bigint")
    t = spark.createDataFrame([("s", f"t{i}", int(1_000_000 + x * 1e6)) for i, x in enumerate(raw)], "session_id string, stream string, anchor_us bigint")
    rows = sync.sync_offsets(v, t, ["session_id"]).orderBy("stream").collect()
    assert [r["track_s"] for r in rows] == tracks
    assert {r["video_s"] for r in rows} == {video}


def test_parameters(spark):
    df = spark.createDataFrame([(x,) for x in (None, "abc", "-5", "0", "60", "999")], "a string")
    assert [r[0] for r in df.select(S.effective_fps(F.col("a"))).collect()] == [30, 30, 30, 30, 60, 240]
    assert [r[0] for r in spark.createDataFrame([(3,), (4,), (5,)], "x int").select(S.even(F.col("x"))).collect()] == [2, 4, 4]
    paths = spark.createDataFrame([("C:\\rec\\a.mp4",), ("/x/b.wav",)], "p string")
    assert [tuple(r) for r in paths.select(S.directory_of(F.col("p")), S.without_suffix(F.col("p"))).collect()] == [("C:\\rec\\", "C:\\rec\\a"), ("/x/", "/x/b")]


def test_candidate_processes(spark):
    p = spark.createDataFrame([(0, "idle"), (1, "a"), (2, "b")], "pid bigint, name string")
    w = spark.createDataFrame([(1, True, "t"), (1, True, "u"), (2, True, ""), (2, False, "x"), (0, True, "t")], "pid bigint, visible boolean, title string")
    assert [r["pid"] for r in joins.candidate_processes(p, w).collect()] == [1]


def test_pixels_and_wav(spark):
    padded = bytes(range(1, 9)) + b"zz" + bytes(range(11, 19)) + b"zz"
    df = spark.createDataFrame([(padded, 2, 2, 10, True), (padded, 2, 2, 10, False), (None, 2, 2, 10, False), (b"x", 2, 2, 10, False)], "d binary, w int, h int, p int, s boolean")
    rows = [r[0] and bytes(r[0]) for r in df.select(binary.normalize_pixels(F.col("d"), F.col("w"), F.col("h"), F.col("p"), F.col("s"))).collect()]
    assert rows == [bytes([3, 2, 1, 4, 7, 6, 5, 8, 13, 12, 11, 14, 17, 16, 15, 18]), bytes([*range(1, 9), *range(11, 19)]), None, None]
    head = binary.wav_header(False, 2, 48_000, 16, 1000) + b"\0" * 1000
    row = spark.createDataFrame([(head,), (b"short",)], "d binary").select(binary.decoded_wav_header(F.col("d")).alias("w")).collect()
    assert row[0]["w"].asDict() == {"riff": "RIFF", "riff_size": 1036, "format": 1, "channels": 2, "rate": 48_000, "byte_rate": 192_000, "block_align": 4, "bits": 16, "data_size": 1000}
    assert row[1]["w"] is None


def test_timing_log_round_trip(spark, tmp_path):
    timing_log.write_timing_log(frames(spark, [10, 26, 43]), str(tmp_path / "log"), [], ["ts_us", "frame_id"], "ts_ms")
    rows = timing_log.read_timing_log(spark, str(tmp_path / "log")).orderBy("row_no").collect()
    assert [(r["frame_index"], r["timestamp_ms"], r["interval_ms"], r["row_no"]) for r in rows] == [(0, 10, 0, 0), (1, 26, 16, 1), (2, 43, 17, 2)]


def test_dirty_log(spark, tmp_path):
    (tmp_path / "dirty.csv").write_text("frame_index,timestamp_ms,interval_ms\r\n0,,0\r\n1\r\n2,abc,5\r\n3,40,16\r\n")
    rows = timing_log.read_timing_log(spark, str(tmp_path / "dirty.csv")).orderBy("row_no").collect()
    assert [(r["frame_index"], r["timestamp_ms"]) for r in rows] == [(0, 0), (3, 40)]


def test_fallback_and_version(spark):
    assert timing_log.first_available(lambda: spark.read.parquet("/nowhere"), lambda: spark.range(3)).count() == 3
    df = spark.createDataFrame([(2,), (2,)], "v int")
    assert timing_log.require_version(df, F.col("v"), 2).count() == 2
    with pytest.raises(Exception, match="protocol version"):
        timing_log.require_version(df, F.col("v"), 3).collect()


def test_global_intervals_equal_window(spark):
    times = [0, 5, 86_400_100, 86_400_100, 200_000_000, 400_000_000]
    df = frames(spark, times)
    a = ordering.with_global_intervals(df, ["ts_us", "frame_id"]).orderBy("frame_index").collect()
    b = ordering.with_intervals(df, ["session_id"], ["ts_us", "frame_id"]).orderBy("frame_index").collect()
    assert [(r["frame_index"], r["interval_ms"]) for r in a] == [(r["frame_index"], r["interval_ms"]) for r in b]


def test_wav_images(spark):
    rows = [("s", 20, 1, 0, b"\x05\x06\x07\x08"), ("s", 10, 1, 0, b"\x01\x02\x03\x04"), ("s", 30, 2, 2, b"\x09" * 8)]
    df = spark.createDataFrame(rows, "stream string, ts_us bigint, num_frames int, flags int, data binary")
    (row,) = wav.wav_images(df, ["stream"]).collect()
    assert bytes(row["wav"]) == binary.wav_header(False, 2, 48_000, 16, 16) + bytes(range(1, 9)) + bytes(8)
