"""Made-up recordings with known truth, for any number of sessions: closed forms of the sample's place, no loops.

Events come at equal steps, so what their decaying responses add up to at a time is a geometric sum. Noise is
normal by two hashes of session, sample and seed, so it does not depend on how rows are partitioned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.plans.spec_base import Spec

US = 1_000_000

# Baselines as (offset, ((amplitude, time constant), ...)), and sizes and periods of what scenarios add.
SINGLE, DOUBLE = (1.2, ((0.8, 70.0),)), (1.1, ((0.55, 25.0), (0.4, 180.0)))
SCENARIOS = ("single_exponential", "double_exponential", "large_transients", "slow_drift", "motion_without_control", "event_locked_artifact")
MECHANISMS = ("indicator_bleaching", "autofluorescence_bleaching")


def _clock(sessions: DataFrame, duration: float, rate: float) -> DataFrame:
    """A row for each session and sample, with its time in seconds from the start."""
    n = math.ceil(duration * rate - 1e-9)
    rows = sessions.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return rows.withColumn("t", F.col("_i") / float(rate)).withColumn("t_us", F.round(F.col("t") * US).cast("long"))


def _responses(t: Column, first: float, step: float, last: float, tau: float) -> Column:
    """Sum of exp(-(t - e) / tau) over events e = first, first + step, ... before ``last`` that lie at or before t."""
    count = math.ceil((last - first) / step - 1e-9)
    past = F.least(F.floor((t - first) / step + 1e-9), F.lit(count - 1))
    ratio = math.exp(-step / tau)
    newest = F.exp(-(t - first - past * step) / tau)
    return F.when(t + 1e-9 >= first, newest * (1 - F.pow(F.lit(ratio), past + 1)) / (1 - ratio)).otherwise(0.0)


def _noise(size: float, seed: int, name: str, keys) -> Column:
    if not size:
        return F.lit(0.0)
    u, v = ((F.pmod(F.xxhash64(F.lit(seed), F.lit(name + part), *keys, "_i"), F.lit(1 << 52)) + 0.5) / float(1 << 52) for part in "uv")
    return size * F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def event_table(sessions: DataFrame, first: float, step: float, last: float) -> DataFrame:
    count = math.ceil((last - first) / step - 1e-9)
    rows = sessions.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return rows.select(*sessions.columns, F.col("_k").cast("string").alias("event_id"), F.round((first + F.col("_k") * step) * US).cast("long").alias("t_us"))


def simulate_recording(
    sessions: DataFrame, *, duration: float = 120.0, rate: float = 20.0, seed: int = 0, artifact_scale: float = 0.25, transient_scale: float = 0.08, reference_contamination: float = 0.0, event_artifact_scale: float = 0.0,
    nonlinear_signal_scale: float = 0.0, reference_lag_s: float = 0.0, dropout_fraction: float = 0.0, noise: float = 0.01,
) -> DataFrame:
    """Signal and reference that share an artifact, the signal with transients; ``truth_neural`` and ``truth_dff`` tell what is in it.

    The reference may lag, hold some of the transients, or be bent; dropouts leave three gaps in both."""
    keys, rows = sessions.columns, _clock(sessions, duration, rate)
    n, lag = math.ceil(duration * rate - 1e-9), round(reference_lag_s * rate)

    def neural(t):
        return _responses(t, 10.0, 15.0, duration - 5, 1.2)

    def artifact(t):
        return artifact_scale * F.sin(t / 3) + 0.1 * F.exp(-t / 80) + event_artifact_scale * neural(t)

    before = (F.col("_i") - lag) / float(rate)  # a reference that leads wraps around, one that lags holds its first value
    delayed = artifact(F.greatest(before, F.lit(0.0)) if lag >= 0 else F.pmod(F.col("_i") - lag, F.lit(n)) / float(rate))
    t = F.col("t")
    rows = rows.withColumn("truth_neural", neural(t)).withColumn("_shared", artifact(t))
    rows = rows.withColumn("_base", 2.0 + 1.4 * F.col("_shared") + nonlinear_signal_scale * F.col("_shared") ** 2)
    rows = rows.withColumn("reference", 1.0 + delayed + reference_contamination * F.col("truth_neural") + _noise(noise, seed, "reference", keys))
    rows = rows.withColumn("signal", F.col("_base") + transient_scale * F.col("truth_neural") + _noise(noise, seed, "signal", keys))
    rows = rows.withColumn("truth_dff", transient_scale * F.col("truth_neural") / F.col("_base"))
    if dropout_fraction > 0:
        length = round(n * dropout_fraction / 3)
        lost = F.lit(False)
        for share in (0.2, 0.5, 0.8):
            lost = lost | F.col("_i").between(round(n * share), round(n * share) + length - 1)
        rows = rows.withColumns({c: F.when(~lost, F.col(c)) for c in ("signal", "reference")})
    return rows.drop("_i", "_shared", "_base")


def _decay(t: Column, shape) -> Column:
    offset, parts = shape
    return sum((a * F.exp(-t / tau) for a, tau in parts), F.lit(offset))


def simulate_bleaching(sessions: DataFrame, *, scenario: str, seed: int = 0, duration: float = 300.0, rate: float = 20.0, noise: float = 0.004) -> DataFrame:
    """A bleaching signal without a reference, with ``truth_baseline`` and ``truth_dff``."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}")
    t, keys = F.col("t"), sessions.columns
    base = _decay(t, SINGLE if scenario == "single_exponential" else DOUBLE)
    if scenario == "slow_drift":
        base = base * (1 + 0.035 * F.sin(2 * math.pi * t / 150))
    neural = _responses(t, 15.0, 20.0, duration - 5, 0.8)
    extra = {"motion_without_control": 0.04 * F.sin(2 * math.pi * t / 7), "event_locked_artifact": 0.04 * neural}.get(scenario, F.lit(0.0))
    rows = _clock(sessions, duration, rate).withColumn("truth_baseline", base).withColumn("truth_dff", (0.15 if scenario == "large_transients" else 0.03) * neural)
    return rows.withColumn("signal", F.col("truth_baseline") * (1 + F.col("truth_dff") + extra) + _noise(noise, seed, "signal", keys)).drop("_i")


def simulate_normalization(sessions: DataFrame, *, mechanism: str, seed: int = 0, duration: float = 300.0, rate: float = 20.0, noise: float = 0.002) -> DataFrame:
    """The same transients over a baseline whose indicator bleaches, or only its autofluorescence."""
    if mechanism not in MECHANISMS:
        raise ValueError(f"unknown mechanism {mechanism!r}")
    t, keys = F.col("t"), sessions.columns
    rows = _clock(sessions, duration, rate).withColumn("truth_baseline", 1.0 + 0.8 * F.exp(-t / 70)).withColumn("truth_dff", 0.03 * _responses(t, 15.0, 15.0, duration - 5, 0.8))
    bright = F.col("truth_baseline") if mechanism == "indicator_bleaching" else F.lit(1.0)
    return rows.withColumn("signal", F.col("truth_baseline") + bright * F.col("truth_dff") + _noise(noise, seed, "signal", keys)).drop("_i")


def transient_shape(relative_s: Column, spec: Spec, rate_hz: float) -> Column:
    """A transient ``relative_s`` after its event, before it is scaled to its largest sample."""
    needed = {"gaussian": ("width_samples",), "alpha": ("rise_samples", "decay_samples"), "biphasic": ("width_samples", "separation_samples")}[spec.family]
    if any(spec.values[name] is None for name in needed):
        raise ValueError(f"a {spec.family} transient needs {' and '.join(needed)}")
    sizes = [spec.values[name] / rate_hz for name in needed]
    bell = lambda x: F.exp(-0.5 * (x / sizes[0]) ** 2)
    if spec.family == "alpha":
        return F.when(relative_s < 0, 0.0).otherwise((1 - F.exp(-relative_s / sizes[0])) * F.exp(-relative_s / sizes[1]))
    return bell(relative_s) if spec.family == "gaussian" else bell(relative_s) - 0.6 * bell(relative_s - sizes[1])


def generate_transient(samples: DataFrame, spec: Spec, keys, *, event_s: float, rate_hz: float, time: str = "t") -> DataFrame:
    """Samples with ``transient``, of which the largest sample of each recording is 1."""
    shaped = samples.withColumn("_v", transient_shape(F.col(time) - event_s, spec, rate_hz))
    top = shaped.groupBy(*keys).agg(F.max("_v").alias("_top"))
    return shaped.join(top, list(keys)).withColumn("transient", F.col("_v") / F.col("_top")).drop("_v", "_top")
