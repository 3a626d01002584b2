"""Order-dependent operators: intervals, indexes, delays, sessions.

Within sessions these are windows partitioned by the session. For one global order
there is no key to partition by; time is cut into buckets, buckets are put together
by their counts, each such range is a window partition, and what crosses a border
comes from one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import bucket_of

MINUTE_US = 60_000_000

#: Rows that one range of a global order has, but for those of its last bucket.
RANGE_ROWS = 1_000_000

#: Buckets up to this number are broadcast to the rows; more are joined by a shuffle.
MAX_BROADCAST_BUCKETS = 1_000_000


def in_order(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_intervals(df: DataFrame, keys: list[str], order: list[str], time: str = "ts_ms", index: str = "frame_index", interval: str = "interval_ms") -> DataFrame:
    """Adds the place in the session from 0 and the time since the row before, 0 for the first."""
    w = in_order(keys, order)
    return df.withColumns({index: (F.row_number().over(w) - 1).cast("bigint"), interval: F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0)).cast("bigint")})


def with_global_intervals(df: DataFrame, order: list[str], time: str = "ts_ms", clock_us: str = "ts_us", bucket_us: int = MINUTE_US, index: str = "frame_index", interval: str = "interval_ms", rows: int = RANGE_ROWS, keys: list[str] | None = None) -> DataFrame:
    """As ``with_intervals`` for one global order that ``clock_us`` leads, without gathering all rows.

    ``time`` must not decrease along the order, as a coarser form of the clock does not.
    Rows are counted by bucket; consecutive buckets make ranges of about ``rows`` rows,
    however they lie in time, and rows are windowed by range. Only one row a bucket (its
    count and its last time) is windowed globally and joined back. With ``keys``, which
    must not be null, the same for every session: the form for sessions that are too
    large for one task.
    """
    keys = keys or []
    cut = df.withColumn("__bucket", bucket_of(F.col(clock_us), bucket_us))
    buckets = cut.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"), F.max(time).alias("__last"))
    everything = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__bucket")
    counted = buckets.withColumns({"__sum": F.coalesce(F.sum("__n").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__before": F.lag("__last").over(everything)})
    ranged = counted.withColumn("__range", F.floor(F.col("__sum") / F.lit(rows)))
    own = in_order([*keys, "__range"], ["__bucket"])
    placed = ranged.select(*keys, "__bucket", "__range", F.first("__sum").over(own).alias("__offset"), F.first("__before").over(own).alias("__before"))
    few = placed.limit(MAX_BROADCAST_BUCKETS + 1).count() <= MAX_BROADCAST_BUCKETS
    w = in_order([*keys, "__range"], order)
    return (
        cut.join(F.broadcast(placed) if few else placed, [*keys, "__bucket"])
        .withColumns({index: (F.col("__offset") + F.row_number().over(w) - 1).cast("bigint"), interval: F.coalesce(F.col(time) - F.coalesce(F.lag(time).over(w), F.col("__before")), F.lit(0)).cast("bigint")})
        .drop("__bucket", "__range", "__offset", "__before")
    )


def stage_deltas(df: DataFrame, marks: list[str]) -> DataFrame:
    """Adds ``d_<mark>`` for each mark after the first, the time since the one before, and ``d_total``."""
    deltas = {f"d_{b}": F.col(b) - F.col(a) for a, b in zip(marks, marks[1:], strict=False)}
    return df.withColumns(deltas | {"d_total": F.col(marks[-1]) - F.col(marks[0])})


def sample_evenly(indexed: DataFrame, k: int = 8, keys: list[str] | None = None, index: str = "frame_index") -> DataFrame:
    """Of every session the rows at k evenly spaced places (all, if there are fewer), with ``label_no`` from 0."""
    keys = keys or []
    sizes = indexed.groupBy(*keys).agg(F.count("*").alias("__n")) if keys else indexed.agg(F.count("*").alias("__n"))
    n, labels = F.col("__n"), F.least(F.lit(k), F.col("__n"))
    spots = sizes.filter("__n > 0").select(*keys, "__n", F.explode(F.sequence(F.lit(0).cast("bigint"), labels - 1)).alias("label_no"))
    at = F.when(labels > 1, F.floor(F.col("label_no") * (n - 1) / (labels - 1) + 0.5)).otherwise(0).cast("bigint")
    return indexed.join(spots.select(*keys, "label_no", at.alias(index)), [*keys, index])


def delay_one(df: DataFrame, keys: list[str], order: list[str], shape: list[str], payload: str) -> DataFrame:
    """Each row with the payload of the one before in its run of equal shape; a run's first row is dropped."""
    w = in_order(keys, order)
    changed = F.coalesce(~F.struct(*shape).eqNullSafe(F.lag(F.struct(*shape)).over(w)), F.lit(True))
    runs = df.withColumn("__changed", F.when((F.row_number().over(w) == 1) | changed, 1).otherwise(0)).withColumn("run", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = in_order([*keys, "run"], order)
    return runs.withColumns({"delayed": F.lag(payload).over(inside), "__first": F.row_number().over(inside) == 1}).filter(~F.col("__first")).drop("__changed", "__first")


def sessionize(df: DataFrame, is_toggle: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``toggles`` so far, whether the state is ``recording`` (odd), and the number of the recording, null outside."""
    w = in_order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    counted = df.withColumn("toggles", F.sum(F.when(is_toggle, 1).otherwise(0)).over(w).cast("bigint"))
    recording = F.col("toggles") % 2 == 1
    return counted.withColumns({"recording": recording, "recording_no": F.when(recording, F.floor((F.col("toggles") + 1) / 2).cast("bigint"))})


def carry_forward(df: DataFrame, columns: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``last_<column>``: the latest value that isn't null, this row included."""
    w = in_order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"last_{c}": F.last(c, ignorenulls=True).over(w) for c in columns})
