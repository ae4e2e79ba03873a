"""Spectra, autocorrelation and coherence of regular recordings; windows never leave a run."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.model import RECORDING, require
from tracelight.operators.runs import mark_runs, regular_clock

US = 1_000_000


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def _windows(marked: DataFrame, keys, n: int, step: int) -> DataFrame:
    """Rows of complete windows of ``n`` samples every ``step`` samples of a run, with place ``k`` in the window."""
    order = Window.partitionBy(*keys, "run_id").orderBy("t_us")
    rows = marked.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "run_id")))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("_i") - n + 1) / step)), F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - n) / step))
    listed = rows.where(F.col("_n") >= n).withColumn("window", F.explode(F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    return listed.withColumn("k", F.col("_i") - F.col("window") * step).drop("_i", "_n")


def _spectra(x: np.ndarray, rate: float, detrend: str) -> np.ndarray:
    """Hann-weighted spectra of windows, one in each row."""
    n = x.shape[1]
    if detrend in ("constant", "linear"):
        x = x - x.mean(axis=1, keepdims=True)
    if detrend == "linear":
        t = np.arange(n) - (n - 1) / 2
        x = x - np.outer(x @ t, t) / (t @ t)
    weight = hann(n)
    return np.fft.rfft(x * weight, axis=1) / math.sqrt(rate * float(weight @ weight))


def _by_bin(rows: DataFrame, by: list[str], values: list[str], made: list[str], measure, *, n: int, rate: float, detrend: str) -> DataFrame:
    """Windows gathered to one row each, transformed many at a time, and laid out as a row for each window and bin.

    ``measure`` turns the spectra of the values (windows by bins) into the columns ``made``."""
    gathered = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", *values))).alias("_w"), F.min("t_us").alias("_a"), F.max("t_us").alias("_b"))
    gathered = gathered.select(*by, F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias("center_us"), *[F.col(f"_w.{v}").cast("array<double>").alias(f"_{v}") for v in values])
    kept = [*by, "center_us"]
    schema = T.StructType([*[gathered.schema[c] for c in kept], T.StructField("bin", T.LongType()), T.StructField("frequency_hz", T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in made]])

    def transform(batches):
        for batch in batches:
            spectra = [_spectra(np.asarray(batch.column(len(kept) + i).flatten()).reshape(-1, n), rate, detrend) for i in range(len(values))]
            windows, bins = batch.num_rows, n // 2 + 1
            row = pa.array(np.repeat(np.arange(windows), bins))
            place = np.tile(np.arange(bins), windows)
            columns = [batch.column(i).take(row) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place), pa.array(place * rate / n), *[pa.array(np.ascontiguousarray(m).ravel()) for m in measure(*spectra)]], names=schema.fieldNames())

    return gathered.mapInArrow(transform, schema)


def _one_sided(power: np.ndarray, n: int) -> np.ndarray:
    power = power.copy()
    power[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return power


def spectrogram(samples: DataFrame, keys=RECORDING, *, rate_hz: float, window_s: float = 10.0, overlap: float = 0.5, detrend: str = "constant", value: str = "signal", partition: str | None = None) -> DataFrame:
    """One-sided Hann power density of every complete window of every run: one row per window and frequency."""
    if not 0 <= overlap < 1 or window_s <= 0:
        raise ValueError("a window lasts and overlaps by less than itself")
    require(regular_clock(samples.where(F.col(value).isNotNull()), keys), "spectra need a regular clock")
    keys, n = list(keys), int(round(window_s * rate_hz))
    step = max(1, n - int(round(n * overlap)))
    marked = mark_runs(samples, keys, value=value, gap_factor=1.5, partition=partition)
    extra = [partition] if partition else []
    rows = _windows(marked.select(*keys, *extra, "run_id", "t_us", value), keys, n, step)
    density = lambda x: [_one_sided(np.abs(x) ** 2, n)]
    return _by_bin(rows, [*keys, *extra, "run_id", "window"], [value], ["power"], density, n=n, rate=rate_hz, detrend=detrend)


def welch_psd(windows: DataFrame, keys=RECORDING, *, partition: str | None = None) -> DataFrame:
    """Mean power over all complete windows (runs weigh by their windows), per state if given."""
    by = [*keys, *([partition] if partition else [])]
    return windows.groupBy(*by, "bin", "frequency_hz").agg(F.avg("power").alias("power"), F.count("*").alias("windows"))


def band_power(psd: DataFrame, keys=RECORDING, *, low: float, high: float) -> DataFrame:
    """Integral of the density from ``low`` to ``high`` by trapezoids, with the values at the edges interpolated; null if not covered."""
    w = Window.partitionBy(*keys).orderBy("frequency_hz")
    piece = psd.withColumn("_f1", F.lead("frequency_hz").over(w)).withColumn("_p1", F.lead("power").over(w)).where("_f1 is not null")
    a, b = F.greatest("frequency_hz", F.lit(low)), F.least("_f1", F.lit(high))

    def at(f):
        return F.col("power") + (F.col("_p1") - F.col("power")) * ((f - F.col("frequency_hz")) / (F.col("_f1") - F.col("frequency_hz")))

    area = F.when(b > a, (at(a) + at(b)) / 2 * (b - a)).otherwise(0.0)
    covered = (F.min("frequency_hz") <= low) & (F.max("_f1") >= high)
    return piece.groupBy(*keys).agg(F.when(covered, F.sum(area)).alias("band_power"))


def fourier_power(rows: DataFrame, keys, *, n: int, index: str = "idx", value: str = "value") -> DataFrame:
    """Squared sine and cosine sums per frequency, as plain aggregates: for short regular series."""
    listed = rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n // 2))))
    angle = F.col("bin") * F.col(index) * (2 * math.pi / n)
    sums = listed.groupBy(*keys, "bin").agg(F.sum(F.col(value) * F.cos(angle)).alias("_c"), F.sum(F.col(value) * F.sin(angle)).alias("_s"))
    return sums.withColumn("power", F.col("_c") ** 2 + F.col("_s") ** 2).drop("_c", "_s")


def autocorrelation(samples: DataFrame, keys=RECORDING, *, max_lag: int, value: str = "signal", gap_factor: float | None = 1.5, max_gap_s: float | None = None, partition: str | None = None) -> DataFrame:
    """Correlation of run-centred values ``lag`` samples apart, pooled over runs; pairs never cross a gap.

    The product sum over the root of the product of both sides' square sums."""
    keys = list(keys)
    marked = mark_runs(samples, keys, value=value, gap_factor=gap_factor, max_gap_s=max_gap_s, partition=partition)
    by = [*keys, *([partition] if partition else [])]
    run = Window.partitionBy(*keys, "run_id")
    order = run.orderBy("t_us")
    centred = marked.withColumn("_x", F.col(value) - F.avg(value).over(run))
    later = [F.struct(F.lit(k).alias("lag"), F.lead("_x", k).over(order).alias("y")) for k in range(max_lag + 1)]
    pairs = centred.select(*by, "_x", F.array(*later).alias("_ls")).select(*by, "_x", F.explode("_ls").alias("_l")).where(F.col("_l.y").isNotNull())
    x, y = F.col("_x"), F.col("_l.y")
    return pairs.groupBy(*by, F.col("_l.lag").alias("lag")).agg((F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y))).alias("autocorrelation"), F.count("*").alias("n_pairs"))


def coherence(samples: DataFrame, keys=RECORDING, *, first: str = "signal", second: str = "reference", rate_hz: float, window_s: float = 10.0, overlap: float = 0.5, detrend: str = "constant", partition: str | None = None) -> DataFrame:
    """Magnitude-squared coherence and phase per frequency from auto- and cross-spectra pooled over all windows."""
    both = samples.withColumn("_both", F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.lit(1.0)))
    require(regular_clock(both.where("_both is not null"), keys), "coherence needs a regular clock")
    keys, n = list(keys), int(round(window_s * rate_hz))
    step = max(1, n - int(round(n * overlap)))
    extra = [partition] if partition else []
    marked = mark_runs(both, keys, value="_both", gap_factor=1.5, partition=partition)
    rows = _windows(marked.select(*keys, *extra, "run_id", "t_us", first, second), keys, n, step)
    names = ("pxx", "pyy", "pxy_re", "pxy_im")

    def cross(x, y):
        both = np.conj(x) * y
        return [np.abs(x) ** 2, np.abs(y) ** 2, both.real, both.imag]

    spectra = _by_bin(rows, [*keys, *extra, "run_id", "window"], [first, second], list(names), cross, n=n, rate=rate_hz, detrend=detrend)
    pooled = spectra.groupBy(*keys, *extra, "bin", "frequency_hz").agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("windows"))
    size = F.col("pxy_re") ** 2 + F.col("pxy_im") ** 2
    return pooled.withColumn("coherence", F.when(F.col("pxx") * F.col("pyy") > 0, size / (F.col("pxx") * F.col("pyy")))).withColumn("phase_rad", F.atan2("pxy_im", "pxy_re"))


def coherence_band(result: DataFrame, keys=RECORDING, *, low: float, high: float) -> DataFrame:
    """Mean coherence over a band, and the phase of its summed cross-spectrum."""
    inside = result.where((F.col("frequency_hz") >= low) & (F.col("frequency_hz") <= high))
    return inside.groupBy(*keys).agg(F.avg("coherence").alias("band_coherence"), F.atan2(F.sum("pxy_im"), F.sum("pxy_re")).alias("band_phase_rad"))
