"""Pacing statistics of intervals: summaries, classes, worst gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalars import fixed, interval_class, is_spike, severity, verdict
from cadenza.schema import CHART_BOTTOM, CHART_HEIGHT, CHART_LEFT, CHART_MIN_WIDTH, CHART_RIGHT, CHART_STEP, CHART_TOP, WORST_GAPS


def implied_rate(mean_ms: Column, rate_unit_ms: int) -> Column:
    return F.try_divide(F.lit(float(rate_unit_ms)), mean_ms)


def target_interval(rate: Column, rate_unit_ms: int) -> Column:
    """The unit over the rate, rounded halves up; null where that is 0."""
    return F.try_divide(F.lit(float(rate_unit_ms)), F.floor(rate + 0.5))


def pacing_summary(indexed: DataFrame, keys: list[str], rate_unit_ms: int = 1000, interval: str = "interval_ms", index: str = "frame_index") -> DataFrame:
    """One row a session with two intervals or more: n, frames, mean, stddev (population), least, largest, rate, target, cov, severity.

    The first row's interval doesn't count. The target is the unit over the rounded
    rate, null where that is 0; cov is null for a mean of 0.
    """
    own = indexed.filter(F.col(index) > 0)
    x = F.col(interval)
    grouped = own.groupBy(*keys) if keys else own.groupBy()
    stats = grouped.agg(F.count(x).alias("n"), F.avg(x).alias("mean_ms"), F.stddev_pop(x).alias("stddev_ms"), F.min(x).alias("min_ms"), F.max(x).alias("max_ms")).filter("n >= 2")
    rate = implied_rate(F.col("mean_ms"), rate_unit_ms)
    cov = F.try_divide(F.col("stddev_ms"), F.col("mean_ms"))
    return stats.select(*keys, "n", (F.col("n") + 1).alias("frames"), "mean_ms", "stddev_ms", "min_ms", "max_ms", rate.alias("rate"), target_interval(rate, rate_unit_ms).alias("target_ms"), cov.alias("cov"), severity(cov).alias("severity"))


def classify_intervals(indexed: DataFrame, keys: list[str], rate_unit_ms: int = 1000, interval: str = "interval_ms", index: str = "frame_index") -> DataFrame:
    """Rows after the first of sessions with two intervals or more: their session's target, the ratio to it, class and spike flag.

    With keys the mean is a window aggregate over the partitioning that the index
    already has, so nothing is read or shuffled twice; without, one row is broadcast.
    """
    own = indexed.filter(F.col(index) > 0)
    if keys:
        session = Window.partitionBy(*keys)
        target = target_interval(implied_rate(F.avg(interval).over(session), rate_unit_ms), rate_unit_ms)
        rows = own.withColumns({"target_ms": target, "__n": F.count(interval).over(session)}).filter("__n >= 2").drop("__n")
    else:
        rows = own.join(F.broadcast(pacing_summary(indexed, keys, rate_unit_ms, interval, index).select("target_ms").limit(1)))
    ratio = F.try_divide(F.col(interval).cast("double"), F.col("target_ms"))
    return rows.withColumns({"ratio": ratio, "class": interval_class(ratio), "is_spike": is_spike(ratio)})


def worst_gaps(classified: DataFrame, k: int = WORST_GAPS, keys: list[str] | None = None, interval: str = "interval_ms", index: str = "frame_index") -> DataFrame:
    """The k largest intervals, ties in order of place; of each session if there are keys."""
    if not keys:
        return classified.orderBy(F.desc(interval), F.asc(index)).limit(k)
    w = Window.partitionBy(*keys).orderBy(F.desc(interval), F.asc(index))
    return classified.withColumn("gap_rank", F.row_number().over(w)).filter(F.col("gap_rank") <= k)


def chart_scale(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Top of a chart's axis: the largest interval or one and a half targets."""
    return summary.select(*keys, F.greatest(F.col("max_ms").cast("double"), F.coalesce(F.col("target_ms") * 1.5, F.lit(0.0))).alias("scale_ms"))


def chart_points(rows: DataFrame, summary: DataFrame, keys: list[str], interval: str = "interval_ms", index: str = "frame_index") -> DataFrame:
    """Adds ``x`` and ``y``, where a linear chart draws each interval after the first of its session; the chart is as wide as the session is long."""
    scale = chart_scale(summary, keys).join(summary.select(*keys, "n"), keys)
    told = rows.filter(F.col(index) > 0).join(scale, keys)
    width = F.greatest(F.lit(CHART_MIN_WIDTH), F.col("n") * CHART_STEP) - CHART_LEFT - CHART_RIGHT
    height = CHART_HEIGHT - CHART_TOP - CHART_BOTTOM
    x = F.lit(CHART_LEFT) + F.try_divide((F.col(index) - 1).cast("double"), F.col("n") - 1) * width
    y = F.lit(CHART_TOP + height) - F.try_divide(F.col(interval).cast("double"), F.col("scale_ms")) * height
    return told.withColumns({"x": x, "y": y}).drop("scale_ms", "n")


def format_summary(summary: DataFrame, keys: list[str]) -> DataFrame:
    """The summary as texts, with the verdict."""
    return summary.select(
        *keys,
        F.col("frames").cast("string").alias("frames"),
        fixed(F.col("mean_ms"), 2).alias("mean"),
        fixed(F.col("stddev_ms"), 2).alias("stddev"),
        F.concat(fixed(F.col("min_ms"), 0), F.lit("-"), fixed(F.col("max_ms"), 0)).alias("range"),
        fixed(F.col("rate"), 1).alias("rate"),
        F.concat(fixed(F.col("cov") * 100, 1), F.lit("%")).alias("cov"),
        verdict(F.col("cov"), F.col("max_ms"), F.col("target_ms")).alias("verdict"),
    )
