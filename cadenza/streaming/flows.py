"""Streaming forms of the flow operators, over Structured Streaming state.

Micro-batches don't keep the order inside a session: rows are sorted in each
batch, and a source that can be late needs a watermark before these operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cadenza.operators.flow import queue_steps


def throttle_stream(frames: DataFrame, interval_us: int, key: str = "session_id", time: str = "ts_us", ident: str = "frame_id") -> DataFrame:
    """(key, ident, time) of the rows that the fixed schedule accepts; state: the next slot of each session."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values([time, ident])
        now = rows[time].to_numpy()
        slot = state.get[0] if state.exists else int(now[0])
        # The number accepted up to a row: every row may add one, but none before its slot has begun.
        begun, place = np.maximum(0, (now - slot) // interval_us + 1), np.arange(1, len(now) + 1)
        count = place + np.minimum(0, np.minimum.accumulate(begun - place))
        state.update((slot + interval_us * int(count[-1]),))
        yield rows[np.diff(count, prepend=0) > 0][[key, ident, time]]

    out = f"{key} string, {ident} bigint, {time} bigint"
    return frames.select(F.col(key).cast("string").alias(key), ident, time).groupBy(key).applyInPandasWithState(step, out, "slot bigint", "append", GroupStateTimeout.NoTimeout)


def queue_stream(ops: DataFrame, capacity: int, key: str = "session_id", order: str = "seq", op: str = "op") -> DataFrame:
    """(key, order, op, ok, occupancy) of every push or pop; state: how many the ring holds."""
    held = capacity - 1

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(order)
        what = rows[op]
        begins = np.zeros(len(rows), bool)
        ok, left = queue_steps(held, state.get[0] if state.exists else 0, begins, *(what.isin(names).to_numpy() for names in (["push"], ["pop"], ["clear", "attach"])))
        state.update((int(left[-1]),))
        yield rows.assign(ok=ok, occupancy=left)[[key, order, op, "ok", "occupancy"]]

    out = f"{key} string, {order} bigint, {op} string, ok boolean, occupancy bigint"
    return ops.select(F.col(key).cast("string").alias(key), order, op).groupBy(key).applyInPandasWithState(step, out, "n bigint", "append", GroupStateTimeout.NoTimeout)


def restarted_rate_stream(frames: DataFrame, window_us: int, key: str = "session_id", time: str = "ts_us", ident: str = "frame_id") -> DataFrame:
    """(key, window_no, start_us, end_us, n) of every window that a row closes, as ``rates.live_rate_greedy``; state: the open window."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pd.concat(list(parts)).sort_values([time, ident])[time].to_numpy()
        start, n, no = state.get if state.exists else (int(now[0]), -1, 0)
        closed, i = [], 0
        while (j := i + int(np.searchsorted(now[i:], start + window_us))) < len(now):
            closed.append((group[0], no, start, int(now[j]), n + j + 1 - i))
            start, n, no, i = int(now[j]), 0, no + 1, j + 1
        state.update((start, n + len(now) - i, no))
        yield pd.DataFrame(closed, columns=[key, "window_no", "start_us", "end_us", "n"])

    out = f"{key} string, window_no bigint, start_us bigint, end_us bigint, n bigint"
    return frames.select(F.col(key).cast("string").alias(key), ident, time).groupBy(key).applyInPandasWithState(step, out, "start bigint, n bigint, no bigint", "append", GroupStateTimeout.NoTimeout)


def drain_latest_stream(frames: DataFrame, period: str, columns: list[str], time: str = "ts", ident: str = "frame_id", lateness: str = "0 seconds") -> DataFrame:
    """The newest row of each period and how many it stands for; for output mode complete, update or append."""
    newest = F.max_by(F.struct(*columns), F.struct(time, ident))
    return frames.withWatermark(time, lateness).groupBy(F.window(time, period)).agg(newest.alias("v"), F.count("*").alias("drained")).select(F.col("window.start").alias("wakeup"), "drained", "v.*")


def live_rate_stream(frames: DataFrame, period: str, time: str = "ts", lateness: str = "0 seconds") -> DataFrame:
    """Rows of each aligned period."""
    return frames.withWatermark(time, lateness).groupBy(F.window(time, period)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source has, stops, and gives the rows from memory: for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def log_lines(stream: DataFrame, path: str, checkpoint: str, every: str = "1 second"):
    """Appends a stream's rows to JSON files, one micro-batch a period; the running query is returned."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
