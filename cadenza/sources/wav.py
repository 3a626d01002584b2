"""WAV images of packet streams, built from SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.schema import SILENT_FLAG


def _little(value: Column, width: int) -> Column:
    """Hex digits of an integer, least byte first, wrapped to the width."""
    digits = F.lpad(F.hex(value.cast("bigint") % F.lit(1 << (8 * width))), 2 * width, "0")
    return F.concat(*(F.substring(digits, 2 * (width - 1 - i) + 1, 2) for i in range(width)))


def _text(value: str) -> Column:
    return F.lit(value.encode().hex().upper())


def header_hex(is_float: Column, channels: Column, rate: Column, bits: Column, data_size: Column) -> Column:
    """The 44 bytes before the samples, as hex digits."""
    align = F.floor(channels * bits / 8).cast("bigint")
    return F.concat(
        _text("RIFF"), _little(data_size + 36, 4), _text("WAVE"), _text("fmt "), _little(F.lit(16), 4), _little(F.when(is_float, 3).otherwise(1), 2),
        _little(channels, 2), _little(rate, 4), _little(rate * align, 4), _little(align, 2), _little(bits, 2), _text("data"), _little(data_size, 4),
    )


def wav_images(packets: DataFrame, keys: list[str], channels: int = 2, rate: int = 48_000, bits: int = 16, is_float: bool = False) -> DataFrame:
    """(keys, wav): one file a stream from packets (ts_us, num_frames, flags, data), silent ones as zeros of the same length.

    The sizes are known when the header is made, so nothing is patched afterwards; a
    stream is one value by nature. Packets of equal time are ordered by their data.
    """
    align = channels * bits // 8
    zeros = F.repeat(F.lit("00"), (F.col("num_frames") * align).cast("int"))
    body = F.when(F.col("flags").bitwiseAND(SILENT_FLAG) != 0, zeros).otherwise(F.coalesce(F.hex("data"), zeros))
    joined = packets.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts_us", body.alias("hex")))), lambda p: p["hex"]), "").alias("hex"))
    head = header_hex(F.lit(is_float), F.lit(channels), F.lit(rate), F.lit(bits), F.length("hex") / 2)
    return joined.select(*keys, F.unhex(F.concat(head, F.col("hex"))).alias("wav"))
