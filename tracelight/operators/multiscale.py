"""Physical-time windows inside continuity runs, at several scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.model import RECORDING
from tracelight.operators.runs import mark_runs, run_table

US = 1_000_000


def summarize_multiscale(samples: DataFrame, keys=RECORDING, *, windows: list[tuple[str, float, float]], value: str = "signal", gap_factor: float = 3.0, minimum_coverage: float = 0.95, minimum_samples: int = 3, partition: str | None = None) -> DataFrame:
    """Windows (name, duration, step) on a grid from each run's start, a last one cut at the run's end included.

    Per window: samples, coverage (the part of its duration inside the run), whether it is accepted,
    sample mean, median, sd (n - 1), interquartile range, rms and slope, and the time-weighted mean over straight
    lines between samples, with the values at the window's edges interpolated."""
    keys = list(keys)
    marked = mark_runs(samples, keys, value=value, gap_factor=gap_factor, partition=partition)
    runs = run_table(marked, keys).where("n >= 2 and stop_us > start_us")  # samples at one time span no window
    specs = F.explode(F.array(*[F.struct(F.lit(n).alias("scale"), F.lit(int(round(d * US))).cast("long").alias("dur"), F.lit(int(round(s * US))).cast("long").alias("step")) for n, d, s in windows])).alias("_w")
    grid = runs.select(*keys, "run_id", "start_us", "stop_us", specs).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("stop_us") - F.col("start_us")) / F.col("_w.step")).cast("long") - 1)))
    grid = grid.select(*keys, "run_id", F.col("_w.scale").alias("scale"), F.col("_at").alias("ordinal"), F.col("_w.dur").alias("duration_us"), (F.col("start_us") + F.col("_at") * F.col("_w.step")).alias("w0"), F.col("stop_us").alias("run_stop_us"))
    grid = grid.withColumn("w1", F.least(F.col("w0") + F.col("duration_us"), F.col("run_stop_us")))
    order = Window.partitionBy(*keys, "run_id").orderBy("t_us")
    pieces = marked.select(*keys, "run_id", "t_us", F.col(value).alias("v"), F.lead("t_us").over(order).alias("t1"), F.lead(value).over(order).alias("v1"))
    bucket = max(int(round(d * US)) for _, d, _ in windows)
    longest = pieces.select(*keys, "run_id", F.col("t_us").alias("start_us"), F.coalesce("t1", F.col("t_us") + 1).alias("stop_us"), "t_us", "v", "t1", "v1")
    # a sample stands for the stretch to the next one: stretches that touch a window are cut at its edges
    touched = _touching(grid, longest, [*keys, "run_id"], bucket)
    a, b = F.greatest("t_us", "w0"), F.least(F.coalesce("t1", "t_us"), "w1")

    def at(t):
        return F.when(F.col("t1").isNull() | (F.col("t1") == F.col("t_us")), F.col("v")).otherwise(F.col("v") + (F.col("v1") - F.col("v")) * ((t - F.col("t_us")) / (F.col("t1") - F.col("t_us"))))

    length = F.greatest((b - a) / 1e6, F.lit(0.0))
    inside = (F.col("t_us") >= F.col("w0")) & ((F.col("t_us") < F.col("w1")) | ((F.col("w1") == F.col("run_stop_us")) & (F.col("t_us") == F.col("w1"))))
    own = F.when(inside, F.col("v"))
    group = [*keys, "run_id", "scale", "ordinal"]
    out = touched.groupBy(*group).agg(
        F.first("w0").alias("w0"), F.first("w1").alias("w1"), F.first("duration_us").alias("duration_us"), F.count(own).alias("n"), F.avg(own).alias("sample_mean"), F.percentile(own, F.lit(0.5)).alias("sample_median"),
        F.stddev_samp(own).alias("sample_sd"), (F.percentile(own, F.lit(0.75)) - F.percentile(own, F.lit(0.25))).alias("sample_iqr"), F.sqrt(F.avg(own * own)).alias("sample_rms"),
        F.regr_slope(own, F.when(inside, (F.col("t_us") - F.col("w0")) / 1e6)).alias("sample_slope"), (F.sum((at(a) + at(b)) / 2 * length) / F.sum(length)).alias("time_weighted_mean"),
    )
    out = out.withColumn("coverage", (F.col("w1") - F.col("w0")) / F.col("duration_us"))
    return out.withColumn("accepted", (F.col("coverage") >= minimum_coverage) & (F.col("n") >= minimum_samples)).drop("duration_us")


def _touching(windows: DataFrame, pieces: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Windows with the stretches that share time with them, found in the bucket where the shared time begins."""
    a = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("w0") / bucket), F.floor(F.col("w1") / bucket))))
    b = pieces.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_us") / bucket), F.floor(F.col("stop_us") / bucket))))
    begins = F.greatest("w0", "start_us")
    joined = a.join(b, [*keys, "_b"]).where((F.col("start_us") <= F.col("w1")) & (F.col("stop_us") > F.col("w0")) & (F.floor(begins / bucket) == F.col("_b")))
    return joined.drop("_b")


def time_bins(samples: DataFrame, events: DataFrame, keys=RECORDING, *, width_s: float, value: str = "signal", gap_factor: float = 3.0) -> DataFrame:
    """Events per fixed-width bin from each recording's start, over the seconds of its runs that fall into the bin."""
    keys = list(keys)
    width = int(round(width_s * US))
    begin = samples.groupBy(*keys).agg(F.min("t_us").alias("_begin"))
    runs = run_table(mark_runs(samples, keys, value=value, gap_factor=gap_factor), keys).where("n > 1").join(begin, keys)
    listed = runs.withColumn("bin", F.explode(F.sequence(F.floor((F.col("start_us") - F.col("_begin")) / width), F.floor((F.col("stop_us") - F.col("_begin")) / width))))
    lo, hi = F.col("_begin") + F.col("bin") * width, F.col("_begin") + (F.col("bin") + 1) * width
    exposure = listed.groupBy(*keys, "bin").agg(F.sum(F.greatest(F.least("stop_us", hi) - F.greatest("start_us", lo), F.lit(0)) / 1e6).alias("exposure_s"))
    counts = events.join(begin, keys).groupBy(*keys, F.floor((F.col("t_us") - F.col("_begin")) / width).alias("bin")).agg(F.count("*").alias("n_events"))
    out = exposure.join(counts, [*keys, "bin"], "left").fillna(0, ["n_events"])
    return out.withColumn("rate_per_min", F.when(F.col("exposure_s") > 0, 60 * F.col("n_events") / F.col("exposure_s")))
