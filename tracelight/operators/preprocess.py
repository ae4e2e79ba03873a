"""Baselines, reference correction, resampling and filtering of recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import lerp
from tracelight.kernels import fits, filters
from tracelight.model import RECORDING, require
from tracelight.operators.joins import bracket
from tracelight.operators.runs import mark_runs, regular_clock

EPS = float(np.finfo(float).eps)


def normalized(value, baseline, how: str):
    """``divide``: (x - b) / b, missing where b is 0 in floating point; ``subtract``: x - b."""
    if how == "subtract":
        return value - baseline
    return F.when(F.abs(baseline) > EPS, (value - baseline) / baseline)


def rolling_baseline(samples: DataFrame, keys=RECORDING, *, value: str = "signal", window_samples: int, gap_factor: float = 1.5, normalization: str = "divide") -> DataFrame:
    """Centred mean over exactly ``window_samples`` samples of one run as ``baseline``; ``dff`` from it.

    Samples whose window the run does not fill have neither."""
    if window_samples < 2:
        raise ValueError("a rolling window has two samples at least")
    marked = mark_runs(samples, keys, value=value, gap_factor=gap_factor)
    half = window_samples // 2
    w = Window.partitionBy(*keys, "run_id").orderBy("t_us").rowsBetween(-half, window_samples - 1 - half)
    out = marked.withColumn("baseline", F.when(F.count(value).over(w) == window_samples, F.avg(value).over(w)))
    return out.withColumn("dff", normalized(F.col(value), F.col("baseline"), normalization))


def reference_fit(samples: DataFrame, keys=RECORDING) -> DataFrame:
    """Least-squares slope and intercept of signal on reference per recording, over paired finite samples; three at least."""
    pair = F.col("signal").isNotNull() & F.col("reference").isNotNull()
    y, x = F.when(pair, F.col("signal")), F.when(pair, F.col("reference"))
    out = samples.groupBy(*keys).agg(F.count(F.when(pair, 1)).alias("n_pairs"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return out.select(*keys, "n_pairs", *[F.when(F.col("n_pairs") >= 3, F.col(c)).alias(c) for c in ("slope", "intercept")])


def reference_dff(samples: DataFrame, keys=RECORDING, *, method: str = "irls") -> DataFrame:
    """``fitted`` and ``dff`` of each sample against its reference: least squares, or Huber-weighted least squares."""
    keys = list(keys)
    if method == "ols":
        fit = reference_fit(samples, keys)
    elif method == "irls":
        fields = [samples.schema[k] for k in keys]
        schema = T.StructType([*fields, T.StructField("slope", T.DoubleType()), T.StructField("intercept", T.DoubleType())])

        def huber(pdf: pd.DataFrame) -> pd.DataFrame:
            pair = pdf.dropna()
            slope = intercept = np.nan
            if len(pair) >= 3:
                slope, intercept = fits.huber_line(pair["reference"].to_numpy(), pair["signal"].to_numpy())
            return pd.DataFrame([[*pdf.iloc[0][keys], slope, intercept]], columns=schema.fieldNames())

        fit = samples.select(*keys, "signal", "reference").groupBy(*keys).applyInPandas(huber, schema)
    else:
        raise ValueError(f"unknown method {method!r}")
    fit = fit.select(*keys, *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in ("slope", "intercept")])
    out = samples.join(fit, keys).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("reference")).drop("slope", "intercept")
    return out.withColumn("dff", normalized(F.col("signal"), F.col("fitted"), "divide"))


def resample(samples: DataFrame, keys=RECORDING, *, rate_hz: float, values: tuple[str, ...] = ("signal", "reference"), max_gap_s: float | None = None, mask: str | None = None) -> DataFrame:
    """Values on an even clock from each recording's first sample on, straight lines between finite neighbours.

    ``protected_gap`` marks grid points between samples further apart than ``max_gap_s``; they stay
    missing. Without a limit, lines also cross missing samples. ``interpolated`` marks grid points that are no
    sample's time. A boolean ``mask`` takes the nearest sample's value, the earlier one of two as near."""
    if rate_hz <= 0:
        raise ValueError("the rate must be positive")
    keys = list(keys)
    step = 1e6 / rate_hz
    span = samples.groupBy(*keys).agg(F.min("t_us").alias("_start"), F.max("t_us").alias("_stop"))
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_stop") - F.col("_start")) / step + 1e-9).cast("long"))).alias("idx")
    targets = span.select(*keys, "_start", index).select(*keys, "idx", (F.col("_start") + F.round(F.col("idx") * step)).cast("long").alias("t_us"))
    clock = bracket(targets, samples, keys, carry=tuple([mask] if mask else []))
    wide = (F.col("a_t_us") - F.col("b_t_us")) / 1e6 > (max_gap_s if max_gap_s is not None else float("inf"))
    base = [*keys, "idx", "t_us", wide.alias("protected_gap"), ((F.col("t_us") != F.col("b_t_us")) & (F.col("t_us") != F.col("a_t_us"))).alias("interpolated")]
    if mask:
        base.append(F.when(F.col("t_us") - F.col("b_t_us") <= F.col("a_t_us") - F.col("t_us"), F.col(f"b_{mask}")).otherwise(F.col(f"a_{mask}")).alias(mask))
    out = clock.select(*base)
    for value in values:
        known = samples.where(F.col(value).isNotNull()).select(*keys, "t_us", value)
        sides = bracket(out, known, keys, carry=(value,))
        line = lerp(F.col("t_us"), F.col("b_t_us"), F.col(f"b_{value}"), F.col("a_t_us"), F.col(f"a_{value}"))
        out = sides.select(*out.columns, F.when(~F.col("protected_gap") & F.col("b_t_us").isNotNull() & F.col("a_t_us").isNotNull(), line).alias(value))
    return out


def block_mean(samples: DataFrame, keys=RECORDING, *, block: int, values: tuple[str, ...] = ("signal", "reference")) -> DataFrame:
    """Means over blocks of ``block`` samples; a last block that is not full is dropped."""
    w = Window.partitionBy(*keys).orderBy("t_us")
    numbered = samples.withColumn("block", F.floor((F.row_number().over(w) - 1) / block))
    means = numbered.groupBy(*keys, "block").agg(F.min("t_us").alias("t_us"), F.count("*").alias("_n"), *[F.avg(v).alias(v) for v in values])
    return means.where(F.col("_n") == block).drop("_n")


def _per_run(samples: DataFrame, keys, value: str, out: str, kernel, *, gap_factor: float | None = 1.5) -> DataFrame:
    """A NumPy kernel (times, values) -> values over each run; one run is one task's work."""
    keys = list(keys)
    marked = mark_runs(samples.select(*keys, "t_us", value), keys, value=value, gap_factor=gap_factor)
    schema = T.StructType([*[samples.schema[k] for k in keys], T.StructField("t_us", T.LongType()), T.StructField(out, T.DoubleType())])

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_us")
        pdf[out] = kernel(pdf["t_us"].to_numpy() / 1e6, pdf[value].to_numpy(dtype=float))
        return pdf[schema.fieldNames()]

    found = marked.groupBy(*keys, "run_id").applyInPandas(apply, schema)
    found = found.select(*keys, "t_us", F.nanvl(F.col(out), F.lit(None).cast("double")).alias(out))
    return samples.join(found, [*keys, "t_us"], "left")


def lowpass(samples: DataFrame, keys=RECORDING, *, cutoff_hz: float, order: int = 4, value: str = "signal") -> DataFrame:
    """Zero-phase Butterworth low-pass per run; runs too short for the edge padding become missing; the source stays as ``prefilter_*``.

    The clock must be regular; other recordings are refused."""
    require(regular_clock(samples.where(F.col(value).isNotNull()), keys), "a filter needs a regular clock")
    prior = samples.withColumnRenamed(value, f"prefilter_{value}")
    return _per_run(prior, keys, f"prefilter_{value}", value, lambda t, x: filters.zero_phase_lowpass(t, x, cutoff_hz, order))


def baseline_dff(samples: DataFrame, keys=RECORDING, *, method: str = "double_exponential", value: str = "signal", normalization: str = "divide", **options) -> DataFrame:
    """``baseline`` and ``dff`` by a fitted baseline: ``double_exponential``, ``asls`` or ``rolling_mean``."""
    if method == "rolling_mean":
        return rolling_baseline(samples, keys, value=value, normalization=normalization, **options)
    kernels = {"double_exponential": fits.double_exponential_baseline, "asls": fits.asls_baseline}
    if method not in kernels:
        raise ValueError(f"unknown method {method!r}")
    if method == "asls":
        require(regular_clock(samples.where(F.col(value).isNotNull()), keys), "asymmetric least squares needs a regular clock")
    out = _per_run(samples, keys, value, "baseline", lambda t, x: kernels[method](t, x, **options))
    return out.withColumn("dff", normalized(F.col(value), F.col("baseline"), normalization))
