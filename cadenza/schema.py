"""Schemas and constants of the event-pacing data model."""

from __future__ import annotations

# The data model's limits and defaults.
FPS_DEFAULT, FPS_MIN, FPS_MAX = 30, 1, 240
QUEUE_SECONDS = 5
IPC_SLOTS = 4
MAX_WIDTH, MAX_HEIGHT, BYTES_PER_PIXEL = 1920, 1080, 4
MAX_FRAME_BYTES = MAX_WIDTH * MAX_HEIGHT * BYTES_PER_PIXEL
SLOW_WRITE_MS = 20.0
SEVERITY_GOOD, SEVERITY_WARN = 0.15, 0.40
CLASS_WARN, CLASS_CRIT = 1.15, 1.5
WORST_GAPS, AXIS_LABELS = 25, 8
SILENT_FLAG = 2
PROTOCOL_VERSION = 2
# A chart's height, paddings, least width, and width by frame.
CHART_HEIGHT, CHART_LEFT, CHART_RIGHT, CHART_TOP, CHART_BOTTOM = 220, 50, 16, 12, 28
CHART_MIN_WIDTH, CHART_STEP = 700, 4
# Pixel formats that a producer accepts.
FORMATS = ("B8G8R8A8_UNORM", "B8G8R8A8_UNORM_SRGB", "R8G8B8A8_UNORM", "R8G8B8A8_UNORM_SRGB")

TIMING_LOG = "frame_index BIGINT, timestamp_ms BIGINT, interval_ms BIGINT"
FRAMES = "session_id STRING, frame_id BIGINT, capture_us BIGINT, timestamp_ms BIGINT, width INT, height INT, byte_count BIGINT, is_backfill BOOLEAN, data BINARY"
QUEUE_OPS = "session_id STRING, seq BIGINT, op STRING"
AUDIO_PACKETS = "session_id STRING, stream STRING, ts_us BIGINT, num_frames INT, block_align INT, flags INT"
CONTROL_EVENTS = "ts_us BIGINT, key STRING"
PROCESSES = "pid BIGINT, name STRING"
WINDOWS = "pid BIGINT, visible BOOLEAN, title STRING"
