"""Transient detection, waveforms, quantification and summaries."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.kernels.peaks import find_peaks
from tracelight.model import RECORDING
from tracelight.operators.joins import range_join
from tracelight.operators.runs import analyzed_duration, mark_runs, run_table

US = 1_000_000
MAD = 1.4826


def detect_chunked(samples: DataFrame, keys=RECORDING, *, chunk: int, high_mad: float = 4.0, detection_mad: float = 3.0, value: str = "signal", gap_factor: float | None = 3.0) -> DataFrame:
    """Two-stage threshold per chunk of ``chunk`` samples of a run: values over median + ``high_mad`` raw MADs are set aside,
    median and MAD taken again, and strict maxima of the trace above the new threshold (0 below it) are candidates."""
    keys = list(keys)
    marked = mark_runs(samples, keys, value=value, gap_factor=gap_factor)
    order = Window.partitionBy(*keys, "run_id").orderBy("t_us")
    rows = marked.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / chunk))
    group = [*keys, "run_id", "chunk"]
    first = rows.groupBy(*group).agg(F.percentile(value, F.lit(0.5)).alias("_m1"))
    rows = rows.join(first, group)
    rows = rows.join(rows.groupBy(*group).agg(F.percentile(F.abs(F.col(value) - F.col("_m1")), F.lit(0.5)).alias("_d1")), group)
    low = F.when(F.col(value) <= F.col("_m1") + high_mad * F.col("_d1"), F.col(value))
    rows = rows.withColumn("_low", low)
    second = rows.groupBy(*group).agg(F.percentile("_low", F.lit(0.5)).alias("_m2"))
    rows = rows.join(second, group)
    rows = rows.join(rows.groupBy(*group).agg(F.percentile(F.abs(F.col("_low") - F.col("_m2")), F.lit(0.5)).alias("_d2")), group)
    rows = rows.withColumn("threshold", F.col("_m2") + detection_mad * F.col("_d2")).withColumn("_z", F.when(F.col(value) > F.col("threshold"), F.col(value)).otherwise(0.0))
    found = rows.withColumn("_before", F.lag("_z").over(order)).withColumn("_after", F.lead("_z").over(order))
    return found.where((F.col("_z") > F.col("_before")) & (F.col("_z") > F.col("_after"))).select(*group, "t_us", F.col(value).alias("peak"), "threshold", F.col("_m2").alias("median"))


def _kernel_rows(samples: DataFrame, keys, value: str, kernel, *, gap_factor: float | None, fields) -> DataFrame:
    keys = list(keys)
    marked = mark_runs(samples, keys, value=value, gap_factor=gap_factor)
    by = [*keys, "run_id"]
    schema = T.StructType([*[samples.schema[k] for k in keys], T.StructField("run_id", T.LongType()), *fields])

    def rows_of(table: pa.Table):
        """Kernel rows of the runs of a table in order of run and time, as one table."""
        t, x = table.column("t_us").to_numpy(), table.column(value).to_numpy().astype(float)
        new = np.zeros(len(t), bool)
        for k in by:
            codes = table.column(k).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(table.schema.field(k).type) else table.column(k).to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new), [len(t)]])
        found, places = [], []
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a > 2:  # a maximum has a lower sample on either side
                for row in kernel(t[a:b], x[a:b]):
                    found.append(row)
                    places.append(a)
        heads = table.select(by).take(pa.array(places, pa.int64()))
        columns = list(zip(*found)) or [[] for _ in fields]
        kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() for f in fields]
        return pa.table([*heads.columns, *[pa.array(c, kind) for c, kind in zip(columns, kinds)]], names=schema.fieldNames())

    def run(batches):
        """Whole runs of many batches at a time; the last run waits for the batch after it."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            same = lambda i, other, j: all(batch.column(k)[i].as_py() == other.column(k)[j].as_py() for k in by)
            if held and same(batch.num_rows - 1, held[0], 0):
                held.append(batch)  # one run so far
                continue
            low, high = 0, batch.num_rows - 1  # first row of the batch's last run
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if same(mid, batch, batch.num_rows - 1) else (mid + 1, high)
            whole = [*held, *([batch.slice(0, low)] if low else [])]
            held = [batch.slice(low)]
            if whole:
                yield from rows_of(pa.Table.from_batches(whole)).to_batches()
        if held:
            yield from rows_of(pa.Table.from_batches(held)).to_batches()

    ordered = marked.select(*by, "t_us", value).repartition(*by).sortWithinPartitions(*by, "t_us")
    return ordered.mapInArrow(run, schema)


CANDIDATE = [T.StructField("sample", T.LongType()), T.StructField("t_us", T.LongType()), T.StructField("peak", T.DoubleType()), T.StructField("score", T.DoubleType())]


def _samples_in(seconds: float, t: np.ndarray) -> int:
    """A distance in median steps of a run, one at least; all of a run whose samples mostly share their times."""
    step = float(np.median(np.diff(t)))
    return max(1, int(np.ceil(seconds * US / step))) if step else len(t) if seconds else 1


def _baseline(t: np.ndarray, x: np.ndarray, at: int, start_s: float, end_s: float, how: str) -> float:
    """Statistic of the samples from ``start_s`` to ``end_s`` before a peak; NaN without any."""
    a, b = np.searchsorted(t, [t[at] - start_s * US, t[at] - end_s * US])
    part = x[a:b]
    return float({"mean": np.mean, "median": np.median, "minimum": np.min}[how](part)) if len(part) else np.nan


def detect_amplitude(samples: DataFrame, keys=RECORDING, *, amplitude: float, baseline: str = "mean", start_s: float = 1.0, end_s: float = 0.2, distance_s: float = 0.0, value: str = "signal", gap_factor: float | None = 3.0) -> DataFrame:
    """Maxima at least ``amplitude`` above their local baseline; ``score`` is that amplitude."""

    def kernel(t, x):
        for p in find_peaks(x, distance=_samples_in(distance_s, t)):
            score = x[p] - _baseline(t, x, p, start_s, end_s, baseline)
            if score >= amplitude:
                yield int(p), int(t[p]), float(x[p]), float(score)

    return _kernel_rows(samples, keys, value, kernel, gap_factor=gap_factor, fields=CANDIDATE)


def detect_prominence(samples: DataFrame, keys=RECORDING, *, height_z: float = 1.0, prominence_z: float = 2.0, distance_s: float = 0.25, detrend_s: float = 100.0, value: str = "signal", gap_factor: float | None = 3.0) -> DataFrame:
    """Maxima of the z-scored trace (population deviation) after its moving mean is taken off, by height, distance and prominence."""

    def kernel(t, x):
        if len(x) < 3:
            return
        step = float(np.median(np.diff(t)))
        n = max(1, min(len(x), int(round(detrend_s * US / step)))) if step else len(x)
        sums = np.concatenate([[0.0], np.cumsum(x)])
        lo, hi = np.maximum(np.arange(len(x)) - n // 2, 0), np.minimum(np.arange(len(x)) + n - n // 2, len(x))
        z = x - (sums[hi] - sums[lo]) / (hi - lo)
        z = (z - z.mean()) / (z.std() or 1.0)
        for p in find_peaks(z, height=height_z, distance=_samples_in(distance_s, t), prominence=prominence_z):
            yield int(p), int(t[p]), float(x[p]), float(z[p])

    return _kernel_rows(samples, keys, value, kernel, gap_factor=gap_factor, fields=CANDIDATE)


def detect_transients(samples: DataFrame, keys=RECORDING, *, mode: str = "rolling_mad", threshold: float = 3.0, duration_s: float = 0.9, gap_s: float = 0.1, statistic: str = "median", noise_s: float = 15.0, distance_s: float = 0.2, value: str = "signal", gap_factor: float | None = 3.0) -> DataFrame:
    """Maxima over a local baseline by ``threshold`` units (absolute, global or rolling scaled MAD), with half-height
    width and area; crossings that the run's edge hides leave both missing."""

    def kernel(t, x):
        overall = max(MAD * float(np.median(np.abs(x - np.median(x)))), np.finfo(float).eps)
        peaks = find_peaks(x)
        rows = []
        for p in peaks:
            base = _baseline(t, x, p, gap_s + duration_s, gap_s, statistic)
            if np.isnan(base):
                continue
            unit = 1.0
            if mode == "global_mad":
                unit = overall
            elif mode == "rolling_mad":
                a, b = np.searchsorted(t, t[p] - noise_s / 2 * US), np.searchsorted(t, t[p] + noise_s / 2 * US, side="right")
                unit = max(MAD * float(np.median(np.abs(x[a:b] - np.median(x[a:b])))), np.finfo(float).eps)
            if x[p] - base >= threshold * unit:
                rows.append((p, base, x[p] - base))
        kept = set(_spread([r[0] for r in rows], [r[2] for r in rows], _samples_in(distance_s, t)))
        for p, base, amplitude in rows:
            if p in kept:
                left, right = _half_crossing(t, x, p, base, -1), _half_crossing(t, x, p, base, 1)
                width = (right - left) / US if left is not None and right is not None else np.nan
                area = np.nan
                if not np.isnan(width):
                    inside = (t > left) & (t < right)
                    half = base + amplitude / 2
                    tt, xx = np.concatenate([[left], t[inside], [right]]), np.concatenate([[half], x[inside], [half]])
                    area = float(np.trapezoid(xx - base, tt / US))
                yield int(p), int(t[p]), float(x[p]), float(amplitude), float(base), float(width), area

    fields = [*CANDIDATE, T.StructField("baseline", T.DoubleType()), T.StructField("half_width_s", T.DoubleType()), T.StructField("auc", T.DoubleType())]
    found = _kernel_rows(samples, keys, value, kernel, gap_factor=gap_factor, fields=fields)
    return found.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in ("half_width_s", "auc") else F.col(c) for c in found.columns])


def _spread(peaks, heights, distance):
    from tracelight.kernels.peaks import keep_distant

    return keep_distant(np.array(peaks, int), np.array(heights, float), distance).tolist()


def _half_crossing(t, x, p, base, side):
    """Time where the trace first falls to half height on one side, on a straight line; None at the run's edge."""
    half = base + (x[p] - base) / 2
    i = p
    while 0 <= i < len(x) and x[i] > half:
        i += side
    if not 0 <= i < len(x):
        return None
    j = i - side
    return t[i] + (t[j] - t[i]) * (half - x[i]) / (x[j] - x[i])


def quantify(events: DataFrame, keys=RECORDING, *, compound_window_s: float = 2.0) -> DataFrame:
    """Candidates with the interval from the one before in their run, and compound groups: chains with gaps under the window."""
    keys = list(keys)
    order = Window.partitionBy(*keys, "run_id").orderBy("t_us")
    out = events.withColumn("previous_interval_s", (F.col("t_us") - F.lag("t_us").over(order)) / 1e6)
    new = (F.col("previous_interval_s").isNull() | (F.col("previous_interval_s") >= compound_window_s)).cast("long")
    out = out.withColumn("_g", F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(*keys, "run_id", "_g")
    out = out.withColumn("_n", F.count("*").over(group)).withColumn("compound_rank", F.when(F.col("_n") > 1, F.row_number().over(group.orderBy("t_us"))))
    return out.withColumn("compound_group", F.when(F.col("_n") > 1, F.col("_g"))).withColumnRenamed("_n", "compound_size").drop("_g")


def summarize_transients(samples: DataFrame, events: DataFrame, keys=RECORDING, *, value: str = "signal", gap_factor: float | None = 3.0, amplitude: str = "peak") -> DataFrame:
    """Count, analysed seconds, rate a minute and median amplitude per recording; recordings without events have rate 0."""
    keys = list(keys)
    duration = analyzed_duration(run_table(mark_runs(samples, keys, value=value, gap_factor=gap_factor), keys), keys)
    found = events.groupBy(*keys).agg(F.count("*").alias("n_events"), F.percentile(amplitude, F.lit(0.5)).alias("median_amplitude"))
    out = duration.join(found, keys, "left").fillna(0, ["n_events"])
    return out.withColumn("rate_per_min", F.when(F.col("duration_s") > 0, 60 * F.col("n_events") / F.col("duration_s")))


def cut_waveforms(samples: DataFrame, events: DataFrame, keys=RECORDING, *, pre_s: float = 1.0, post_s: float = 2.0, value: str = "signal", gap_factor: float | None = 3.0, ceiling: float | None = None) -> DataFrame:
    """Native samples around each candidate inside its run, as an array, with quality codes: cut before or after, saturated, flat, another peak near."""
    keys = list(keys)
    marked = mark_runs(samples, keys, value=value, gap_factor=gap_factor)
    runs = run_table(marked, keys).select(*keys, "run_id", F.col("start_us").alias("_r0"), F.col("stop_us").alias("_r1"))
    by = [*keys, "run_id"]
    order = Window.partitionBy(*by).orderBy("t_us")
    near = F.least(F.coalesce(F.col("t_us") - F.lag("t_us").over(order), F.lit(1 << 60)), F.coalesce(F.lead("t_us").over(order) - F.col("t_us"), F.lit(1 << 60)))
    spans = events.select(*by, F.col("t_us").alias("peak_us"), near.alias("_near"), (F.col("t_us") - int(pre_s * US)).alias("start_us"), (F.col("t_us") + int(post_s * US)).alias("stop_us")).join(runs, by)
    hit = range_join(marked.select(*by, "t_us", value), spans, by, bucket_us=int((pre_s + post_s) * US), closed=True)
    v = F.col(f"p_{value}")
    wave = F.transform(F.array_sort(F.collect_list(F.struct((F.col("p_t_us") - F.col("peak_us")).alias("rel_us"), v.alias("v")))), lambda s: s["v"])
    out = hit.groupBy(*by, "peak_us", "_near", "start_us", "stop_us", "_r0", "_r1").agg(wave.alias("waveform"), F.count("*").alias("n_samples"), F.max(v).alias("_top"), F.min(v).alias("_low"))
    codes = {"pre_truncated": F.col("start_us") < F.col("_r0"), "post_truncated": F.col("stop_us") > F.col("_r1"), "saturated": F.col("_top") >= ceiling if ceiling is not None else F.lit(False), "flat": F.col("_top") == F.col("_low"), "nearby_peak": F.col("_near") <= int(post_s * US)}
    out = out.withColumn("codes", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in codes.items()])))
    return out.select(*by, "peak_us", "waveform", "n_samples", "codes")


def calibrate_threshold(scores: DataFrame, keys=("channel",), *, estimator: str = "median_mad", multiplier: float = 6.0, quantile: float = 0.999, minimum: int = 20, context: dict | None = None) -> DataFrame:
    """A frozen score gate per channel and a fingerprint of how it came about; null with fewer than ``minimum`` scores."""
    keys = list(keys)
    if estimator in ("quantile", "empirical_quantile"):
        out = scores.groupBy(*keys).agg(F.count("score").alias("n_scores"), F.percentile("score", F.lit(quantile)).alias("gate"))
    else:
        middle = scores.groupBy(*keys).agg(F.percentile("score", F.lit(0.5)).alias("_m"))
        out = scores.join(middle, keys).groupBy(*keys).agg(F.count("score").alias("n_scores"), (F.first("_m") + multiplier * MAD * F.percentile(F.abs(F.col("score") - F.col("_m")), F.lit(0.5))).alias("gate"))
    told = json.dumps({"estimator": estimator, "multiplier": multiplier, "quantile": quantile, "minimum": minimum, **(context or {})}, sort_keys=True)
    return out.withColumn("gate", F.when(F.col("n_scores") >= minimum, F.col("gate"))).withColumn("fingerprint", F.lit(hashlib.sha256(told.encode()).hexdigest()))
