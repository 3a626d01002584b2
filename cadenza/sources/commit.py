"""Commit by replace: a table is written beside its place and moved there once it is whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or what the context has; a temporary folder only on a local master, where both are unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cadenza-"))
    return sc.getCheckpointDir()


def replace_parquet(df: DataFrame, path: str) -> None:
    """Puts ``df`` in the place of the table at ``path``, if there is one.

    The rows are written beside it first and the old table is moved aside, and removed
    only when the new one is in its place, so ``df`` may read what it replaces. If
    writing fails the old table stays where it is and the unfinished one beside it; if
    moving fails the old one is moved back.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    mark = uuid.uuid4().hex
    whole, new, old = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{mark}", f"{path}.old-{mark}"))
    files = whole.getFileSystem(sc._jsc.hadoopConfiguration())
    df.write.parquet(f"{path}.new-{mark}")
    replaced = files.exists(whole)
    if replaced and not files.rename(whole, old):
        raise OSError(f"could not move {path} aside; the new table is {new}")
    if not files.rename(new, whole):
        if replaced:
            files.rename(old, whole)
        raise OSError(f"could not move {new} to {path}")
    if replaced:
        files.delete(old, True)
