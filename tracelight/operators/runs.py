"""Continuity: no operator reads across a gap, a missing sample or a change of state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.model import RECORDING, recording_window


def intervals_of(samples: DataFrame, keys=RECORDING) -> DataFrame:
    """Samples with the seconds since the one before (``dt``), null at the first."""
    return samples.withColumn("dt", (F.col("t_us") - F.lag("t_us").over(recording_window(keys))) / 1e6)


def clock_summary(samples: DataFrame, keys=RECORDING, *, value: str = "signal", tolerance: float = 0.01) -> DataFrame:
    """Rows, span, median interval, rate, share of irregular intervals and of finite values per recording."""
    timed = intervals_of(samples, keys)
    middle = timed.groupBy(*keys).agg(F.percentile("dt", F.lit(0.5)).alias("median_dt"))
    joined = timed.join(middle, list(keys))
    odd = (F.abs(F.col("dt") - F.col("median_dt")) > tolerance * F.col("median_dt")).cast("double")
    return joined.groupBy(*keys).agg(
        F.count("*").alias("n"), (F.min("t_us") / 1e6).alias("start_s"), (F.max("t_us") / 1e6).alias("stop_s"), F.first("median_dt").alias("median_dt"),
        (1 / F.first("median_dt")).alias("rate_hz"), F.avg(odd).alias("irregular_fraction"), F.avg(F.col(value).isNotNull().cast("double")).alias("finite_fraction"),
    )


def mark_runs(samples: DataFrame, keys=RECORDING, *, value: str = "signal", gap_factor: float | None = None, max_gap_s: float | None = None, partition: str | None = None) -> DataFrame:
    """Finite samples with ``run_id``, counted from 1 within the recording.

    A run ends at a missing sample, at a gap over ``max_gap_s`` or over ``gap_factor`` times the
    recording's median interval (gaps included in that median), and where ``partition`` changes."""
    keys = list(keys)
    timed = intervals_of(samples, keys)
    if gap_factor is not None:
        limit = timed.groupBy(*keys).agg((F.percentile("dt", F.lit(0.5)) * gap_factor).alias("_limit"))
        timed = timed.join(limit, keys)
    w = recording_window(keys)
    breaks = F.col("dt").isNull() | F.lag(value).over(w).isNull()
    if gap_factor is not None:
        breaks = breaks | (F.col("dt") > F.col("_limit"))
    if max_gap_s is not None:
        breaks = breaks | (F.col("dt") > max_gap_s)
    if partition is not None:
        breaks = breaks | ~F.col(partition).eqNullSafe(F.lag(partition).over(w))
    timed = timed.withColumn("_new", (F.col(value).isNotNull() & breaks).cast("long"))
    timed = timed.withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return timed.where(F.col(value).isNotNull()).drop("_new", "_limit", "dt")


def run_table(marked: DataFrame, keys=RECORDING) -> DataFrame:
    """One row per run: first and last time, samples, exposure."""
    out = marked.groupBy(*keys, "run_id").agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("stop_us"), F.count("*").alias("n"))
    return out.withColumn("exposure_s", (F.col("stop_us") - F.col("start_us")) / 1e6)


def analyzed_duration(runs: DataFrame, keys=RECORDING) -> DataFrame:
    """Seconds inside runs of two samples or more, per recording."""
    return runs.groupBy(*keys).agg(F.sum(F.when(F.col("n") > 1, F.col("exposure_s")).otherwise(0.0)).alias("duration_s"))


def run_length_encode(rows: DataFrame, label: str, keys, *, order: str = "t_us") -> DataFrame:
    """Bouts of equal labels that follow each other: one row per bout with its first and last time and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_new", (~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)).cast("long"))
    marked = marked.withColumn("bout", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "bout", label).agg(F.min(order).alias("start_us"), F.max(order).alias("last_us"), F.count("*").alias("n"))


def regular_clock(samples: DataFrame, keys=RECORDING, *, maximum_cv: float = 0.01) -> DataFrame:
    """Recordings whose clock an operator that needs a regular one must refuse: coefficient of variation of the
    intervals within 1.5 medians above ``maximum_cv``."""
    timed = intervals_of(samples, keys)
    middle = timed.groupBy(*keys).agg(F.percentile("dt", F.lit(0.5)).alias("_m"))
    inside = timed.join(middle, list(keys)).where(F.col("dt") <= 1.5 * F.col("_m"))
    return inside.groupBy(*keys).agg((F.stddev_pop("dt") / F.avg("dt")).alias("interval_cv")).where(F.col("interval_cv") > maximum_cv)
