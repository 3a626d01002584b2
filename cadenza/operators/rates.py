"""Rates and diagnostics by windows, fixed or restarted by the rows themselves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import bucket_of, is_slow_write, rounded_rate
from cadenza.operators.flow import folded, segments
from cadenza.schema import SLOW_WRITE_MS


def live_rate_tumbling(df: DataFrame, window_us: int, keys: list[str], unit_us: int = 1_000_000, time: str = "ts_us") -> DataFrame:
    """Rows in aligned windows of fixed length, and their rate a unit."""
    begin = bucket_of(F.col(time), window_us) * window_us
    return df.groupBy(*keys, begin.alias("window_us")).agg(F.count("*").alias("n")).withColumn("rate", rounded_rate(F.col("n"), F.lit(window_us / unit_us)))


def restarted_windows(df: DataFrame, window_us: int, keys: list[str], order: list[str], columns: list[str], time: str = "ts_us") -> DataFrame:
    """Rows with ``window_no``, ``start_us`` and ``closes``: a window ends with the first row at least ``window_us`` after its start, and the next one starts there.

    The first row of a session starts its first window and is not in it (``window_no``
    null); rows after the last end are in an open window. ``order`` has to begin with
    ``time``: the next end is found by binary search.
    """

    def scan(state, begins, when):
        t = when.to_numpy(zero_copy_only=False).astype(np.int64)
        number, start, closes = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        for a, b in segments(begins):
            if begins[a]:
                (begun, no), i = (int(t[a]), 0), a + 1
                start[a] = begun
            else:
                (begun, no), i = state, a
            while i < b:
                j = i + int(np.searchsorted(t[i:b], begun + window_us))
                number[i : j + 1], start[i : j + 1] = no, begun
                if j < b:
                    closes[j], begun, no = True, int(t[j]), no + 1
                i = j + 1
            state = begun, no
        return (pa.array(number, mask=begins), start, closes), state

    return folded(df, keys, order, [time], columns, scan, "window_no bigint, start_us bigint, closes boolean")


def live_rate_greedy(df: DataFrame, window_us: int, keys: list[str], order: list[str], unit_us: int = 1_000_000, time: str = "ts_us") -> DataFrame:
    """(keys, window_no, start_us, end_us, n, rate) of every closed restarted window."""
    rows = restarted_windows(df, window_us, keys, order, [], time).filter("window_no IS NOT NULL")
    closed = rows.groupBy(*keys, "window_no", "start_us").agg(F.count("*").alias("n"), F.max(F.when(F.col("closes"), F.col(time))).alias("end_us")).filter("end_us IS NOT NULL")
    return closed.withColumn("rate", rounded_rate(F.col("n"), (F.col("end_us") - F.col("start_us")) / F.lit(float(unit_us))))


def stage_means(df: DataFrame, window: Column, keys: list[str], order: list[str], columns: list[str], counted: Column | None = None) -> DataFrame:
    """By window: rows, the mean of each stage, the last row's value of each, and how often ``counted`` holds."""
    aggregates = [F.count("*").alias("n")]
    for c in columns:
        aggregates += [F.avg(c).alias(f"avg_{c}"), F.max_by(c, F.struct(*order)).alias(f"last_{c}")]
    if counted is not None:
        aggregates.append(F.count_if(counted).alias("n_counted"))
    return df.groupBy(*keys, window.alias("window")).agg(*aggregates)


def closed_stage_means(df: DataFrame, window_us: int, keys: list[str], order: list[str], columns: list[str], time: str = "ts_us") -> DataFrame:
    """``stage_means`` over the closed windows that the rows themselves restart."""
    rows = restarted_windows(df, window_us, keys, order, columns, time).filter("window_no IS NOT NULL")
    told = stage_means(rows, F.col("window_no"), keys, order, columns, F.col("closes"))
    return told.filter("n_counted > 0").drop("n_counted").withColumnRenamed("window", "window_no")


def write_stats(df: DataFrame, window: Column, keys: list[str], value: str, threshold: float = SLOW_WRITE_MS) -> DataFrame:
    """By window: mean, largest and number of writes, and how many were slow."""
    return df.groupBy(*keys, window.alias("window")).agg(F.avg(value).alias("avg_write"), F.max(value).alias("max_write"), F.count(value).alias("n"), F.count_if(is_slow_write(F.col(value), threshold)).alias("slow"))


def slow_writes(df: DataFrame, value: str, threshold: float = SLOW_WRITE_MS) -> DataFrame:
    """Writes longer than the threshold."""
    return df.filter(is_slow_write(F.col(value), threshold))


def queue_counters(pushes: DataFrame, keys: list[str], ok: str = "ok", backfill: str = "is_backfill") -> DataFrame:
    """Recorded and dropped rows; a failed back-fill is not a drop."""
    whole = pushes.groupBy(*keys) if keys else pushes.groupBy()
    return whole.agg(F.count_if(F.col(ok)).alias("recorded"), F.count_if(~F.col(ok) & ~F.col(backfill)).alias("dropped"))
