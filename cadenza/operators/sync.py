"""Clocks of several streams: anchors, offsets, rates of sessions, audio totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scalars import silenced_frames
from cadenza.operators.ordering import sessionize


def first_anchor(df: DataFrame, keys: list[str], counts: Column, time: str = "ts_us", name: str = "anchor_us") -> DataFrame:
    """When each session first has a row that counts; null if it has none."""
    return df.groupBy(*keys).agg(F.min(F.when(counts, F.col(time))).alias(name))


def session_rate(df: DataFrame, keys: list[str], default: float, unit_us: int = 1_000_000, time: str = "ts_us") -> DataFrame:
    """Rows, elapsed units and measured rate of each session; the default for no elapsed time."""
    elapsed = (F.max(time) - F.min(time)) / F.lit(float(unit_us))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), elapsed.alias("elapsed")).withColumn("rate", F.coalesce(F.try_divide(F.col("n"), F.col("elapsed")), F.lit(default)))


def recording_rates(df: DataFrame, is_toggle: Column, keys: list[str], order: list[str], default: float, unit_us: int = 1_000_000, time: str = "ts_us") -> DataFrame:
    """(keys, recording_no, started_us, stopped_us, n, elapsed, rate) of every recording that was stopped.

    A toggle starts a recording and the next one stops it; elapsed time runs from start
    to stop, not from the first row to the last, and toggles are no frames.
    """
    told = sessionize(df.withColumn("__toggle", F.coalesce(is_toggle, F.lit(False))), F.col("__toggle"), keys, order)
    number = F.floor((F.col("toggles") + 1) / 2).cast("bigint")
    rows = told.filter(F.col("recording") | (F.col("__toggle") & (F.col("toggles") > 0))).withColumn("recording_no", number)
    whole = rows.groupBy(*keys, "recording_no").agg(
        F.min(F.when(F.col("__toggle") & F.col("recording"), F.col(time))).alias("started_us"),
        F.max(F.when(F.col("__toggle") & ~F.col("recording"), F.col(time))).alias("stopped_us"),
        F.count_if(~F.col("__toggle")).alias("n"),
    )
    elapsed = (F.col("stopped_us") - F.col("started_us")) / F.lit(float(unit_us))
    return whole.filter("stopped_us IS NOT NULL").withColumn("elapsed", elapsed).withColumn("rate", F.coalesce(F.try_divide(F.col("n"), F.col("elapsed")), F.lit(default)))


def sync_offsets(video: DataFrame, tracks: DataFrame, keys: list[str], stream: str = "stream", unit_us: int = 1_000_000) -> DataFrame:
    """(keys, stream, raw_s, track_s, video_s): delays, none negative, that put all streams on one clock.

    ``video`` and ``tracks`` have ``anchor_us``; a session without a video anchor has
    no tracks. The least raw offset is one aggregate a session, joined back.
    """
    v = video.filter("anchor_us IS NOT NULL").select(*keys, F.col("anchor_us").alias("__v"))
    raw = tracks.filter("anchor_us IS NOT NULL").join(v, keys).withColumn("raw_s", (F.col("anchor_us") - F.col("__v")) / F.lit(float(unit_us)))
    least = raw.groupBy(*keys).agg(F.least(F.lit(0.0), F.min("raw_s")).alias("__m"))
    return raw.join(least, keys).select(*keys, stream, "raw_s", (F.col("raw_s") - F.col("__m")).alias("track_s"), (-F.col("__m") + F.lit(0.0)).alias("video_s"))


def audio_summary(packets: DataFrame, keys: list[str], rate: int = 48_000) -> DataFrame:
    """By stream: packets, frames, silent frames, bytes, the 32-bit size a header can hold, seconds and the first packet with frames."""
    n, size = F.col("num_frames").cast("bigint"), F.col("num_frames").cast("bigint") * F.col("block_align")
    return packets.groupBy(*keys).agg(
        F.count("*").alias("packets"),
        F.sum(n).alias("frames"),
        F.sum(silenced_frames(n, F.col("flags"))).alias("silent_frames"),
        F.sum(size).alias("bytes"),
        (F.sum(size) % (1 << 32)).alias("header_bytes"),
        (F.sum(n) / F.lit(float(rate))).alias("seconds"),
        F.min(F.when(n > 0, F.col("ts_us"))).alias("anchor_us"),
    )


def zip_tracks(tracks: dict[str, DataFrame]) -> DataFrame:
    """Streams side by side under ``track_id``, never matched with each other."""
    out = None
    for name, df in tracks.items():
        own = df.withColumn("track_id", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tracks")
    return out
