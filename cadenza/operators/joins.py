"""The one relational join of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidate_processes(processes: DataFrame, windows: DataFrame, key: str = "pid") -> DataFrame:
    """Processes, but for number 0, with a visible window that has a title; each once."""
    shown = windows.filter(F.col("visible") & (F.length("title") > 0)).select(key)
    return processes.filter(F.col(key) != 0).join(shown, key, "left_semi")
