"""A pluggable frame source: synthetic sessions as a batch or a stream, registered as ``cadenza_frames``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

_SCHEMA = "session_id string, frame_id bigint, ts_us bigint, width int, height int"


class _Session(InputPartition):
    def __init__(self, number: int):
        self.number = number


def _frame(session: int, i: int, fps: int) -> tuple:
    """Frames on the schedule, but for every seventh, which is late by a quarter of an interval."""
    interval = 1_000_000 // fps
    return f"s{session}", i, i * interval + (interval // 4 if i % 7 == 6 else 0), 1920, 1080


class _Batch(DataSourceReader):
    def __init__(self, sessions: int, frames: int, fps: int):
        self.sessions, self.frames, self.fps = sessions, frames, fps

    def partitions(self) -> list[InputPartition]:
        return [_Session(s) for s in range(self.sessions)]

    def read(self, partition: _Session) -> Iterator[tuple]:
        for i in range(self.frames):
            yield _frame(partition.number, i, self.fps)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, frames: int, fps: int, step: int):
        self.frames, self.fps, self.step = frames, fps, step

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(start["frame"] + self.step, self.frames)
        return iter([_frame(0, i, self.fps) for i in range(start["frame"], end)]), {"frame": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([_frame(0, i, self.fps) for i in range(start["frame"], end["frame"])])


class FrameSource(DataSource):
    """Options: sessions, frames, fps, step (frames a micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return "cadenza_frames"

    def schema(self) -> str:
        return _SCHEMA

    def _option(self, key: str, default: int) -> int:
        return int(self.options.get(key, default))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._option("sessions", 1), self._option("frames", 60), self._option("fps", 30))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Stream(self._option("frames", 60), self._option("fps", 30), self._option("step", 20))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
