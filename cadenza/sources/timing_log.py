"""Frame-timing logs: CSV files, one per session, with a header line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import number_or_null
from cadenza.operators.ordering import with_intervals
from cadenza.schema import PROTOCOL_VERSION


def coerced(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Text fields as numbers; rows without a timestamp go, and ``row_no`` counts what is left of each session from 0."""
    typed = rows.withColumns({c: number_or_null(F.col(c)) for c in ("frame_index", "timestamp_ms", "interval_ms")}).filter("timestamp_ms IS NOT NULL")
    return typed.withColumn("row_no", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def split_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of three comma-separated fields as columns of text; missing fields are null."""
    parts = F.split(F.regexp_replace(line, r"\r$", ""), ",")
    return lines.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(("frame_index", "timestamp_ms", "interval_ms"))}).drop(line)


def read_timing_log(spark: SparkSession, path: str) -> DataFrame:
    """Every session's rows in file order: session_id (the file's path), frame_index, timestamp_ms, interval_ms, row_no."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("session_id"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    # The header is skipped by place, not by content; a CSV reader would not tell an empty field from a missing one.
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("at")) == 1
    placed = split_lines(lines.withColumn("first", first).filter("NOT first AND trim(line) <> ''").drop("first"))
    return coerced(placed, ["session_id"], ["at"]).select("session_id", "frame_index", "timestamp_ms", "interval_ms", "row_no")


def write_timing_log(frames: DataFrame, path: str, keys: list[str], order: list[str], time: str = "timestamp_ms") -> None:
    """Index, time and interval of every frame, as CSV with a header; a folder for each session if there are keys."""
    rows = with_intervals(frames, keys, order, time).select(*keys, "frame_index", F.col(time).alias("timestamp_ms"), "interval_ms")
    if keys:
        rows.repartition(*keys).sortWithinPartitions(*keys, "frame_index").write.partitionBy(*keys).option("header", True).mode("overwrite").csv(path)
    else:
        rows.coalesce(1).sortWithinPartitions("frame_index").write.option("header", True).mode("overwrite").csv(path)


def tab_separated(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text line a row, as a table printed to a console."""
    return df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns)).alias("line"))


def first_available(*readers: Callable[[], DataFrame]) -> DataFrame:
    """The first reader that can be planned; the last one's error if none can."""
    for reader in readers[:-1]:
        try:
            return reader()
        except Exception:  # noqa: BLE001  whatever a source raises makes the next one count
            continue
    return readers[-1]()


def require_version(df: DataFrame, version: Column, expected: int = PROTOCOL_VERSION) -> DataFrame:
    """``df``, or a failure while it runs, if any row has another version."""
    return df.filter(F.coalesce(F.assert_true(F.coalesce(version == expected, F.lit(False)), F.lit(f"protocol version is not {expected}")).isNull(), F.lit(True)))
