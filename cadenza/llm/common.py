"""What several operators share: lineage cuts, word rules, the deterministic split."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word patterns of the query contracts.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Bytes to bytes: A-Z to a-z, other ASCII that is no letter or digit to a space.
ALNUM_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def shared_folder(spark) -> str:
    """The checkpoint folder: ``spark.checkpoint.dir``, else what the context has.

    A temporary folder is made only where neither is set and the master is local, as in
    tests. On a cluster each executor would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="cadenza-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder.

    Spark removes the files when the result is no longer referenced, if its cleaner is told to.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of rows that Spark hands to Python at once, where the session leaves its default of 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark) -> None:
    """Keeps Arrow batches small: without it long texts make batches that two workers and the JVM hold several times over.

    This is a setting of the whole session. The contract queries and the pipeline, which
    are applications, call it; the operators leave the caller's settings alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "64MB", "67108864b"):
        spark.conf.set(name, str(BATCH_BYTES))


def tidy() -> None:
    """Gives memory that a batch has freed back to the system; workers outlive their tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def few(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has so many rows at most; no more than one above are counted."""
    return df.limit(most + 1).count() <= most


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table beside the checkpoints; removed by ``unstored``, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _located(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def unstored(table: DataFrame) -> None:
    """Removes the files of a table that ``stored`` has written and nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("table-"):
            where, files = _located(table.sparkSession, path)
            files.delete(where, True)


def _located(spark, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def shipped(spark, thing):
    """A function that gives ``thing`` in any task; its attributes are broadcast, its class travels with the function."""
    sent, kind = spark.sparkContext.broadcast(vars(thing)), type(thing)

    def here():
        held = object.__new__(kind)
        held.__dict__ = sent.value
        return held

    return here


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and non-ASCII characters, as UTF-8."""
    return text.translate(ALNUM_TABLE).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but ASCII white space, as UTF-8."""
    return text.lower().split() if text else []


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def slices(lengths: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose lengths add up to about ``budget``; a longer row is alone."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
