"""Binary payloads: pixel rows and WAV headers, in Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_pixels(data: Column, width: Column, height: Column, pitch: Column, swap: Column) -> Column:
    """Rows of four-byte pixels without padding, first and third byte exchanged where ``swap``; null for short or null data."""

    def normalized(d: pa.Array, w: pa.Array, h: pa.Array, p: pa.Array, s: pa.Array) -> pa.Array:
        out = []
        for raw, cols, rows, stride, exchange in zip(d.to_pylist(), w.to_pylist(), h.to_pylist(), p.to_pylist(), s.to_pylist(), strict=True):
            if raw is None or cols is None or rows is None or stride is None or stride < cols * 4 or len(raw) < stride * rows:
                out.append(None)
                continue
            pixels = np.frombuffer(raw, np.uint8, stride * rows).reshape(rows, stride)[:, : cols * 4].reshape(rows, cols, 4)
            out.append((pixels[:, :, [2, 1, 0, 3]] if exchange else pixels).tobytes())
        return pa.array(out, pa.binary())

    return F.arrow_udf(normalized, "binary")(data, width, height, pitch, swap)


def wav_header(is_float: bool, channels: int, rate: int, bits: int, data_size: int) -> bytes:
    """The 44 bytes before the samples; sizes are 32 bits and wrap."""
    align = channels * bits // 8
    wrap = 1 << 32
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + data_size) % wrap, b"WAVE", b"fmt ", 16, 3 if is_float else 1, channels, rate, rate * align, align, bits, b"data", data_size % wrap)


def decoded_wav_header(data: Column) -> Column:
    """The fields of a WAV header; null if there are fewer than 44 bytes. No Python runs here."""
    little = lambda at, n: sum((F.conv(F.hex(F.substring(data, at + 1 + i, 1)), 16, 10).cast("bigint") * (1 << (8 * i)) for i in range(n)), F.lit(0).cast("bigint"))
    text = lambda at: F.decode(F.substring(data, at + 1, 4), "US-ASCII")
    names = (("riff", text(0)), ("riff_size", little(4, 4)), ("format", little(20, 2)), ("channels", little(22, 2)), ("rate", little(24, 4)), ("byte_rate", little(28, 4)), ("block_align", little(32, 2)), ("bits", little(34, 2)), ("data_size", little(40, 4)))
    return F.when(F.octet_length(data) >= 44, F.struct(*(c.alias(n) for n, c in names)))
