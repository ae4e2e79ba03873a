"""Interval algebra: filter, merge, split, contextualize, resolve overlaps, masks, annotations and clocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.kernels.order import Windows, first_stable
from tracelight.model import require
from tracelight.operators.joins import overlap_join, overlap_us, range_join
from tracelight.operators.slices import per_slice

KEYS = ("subject", "session")
US = 1_000_000


def duration_s() -> Column:
    return (F.col("stop_us") - F.col("start_us")) / 1e6


def filter_intervals(intervals: DataFrame, *, include=(), exclude=(), minimum_s: float | None = None, maximum_s: float | None = None, minimum_confidence: float | None = None) -> DataFrame:
    """Every interval with the first ``reason`` that drops it, null if it stays."""
    reason = F.lit(None).cast("string")
    rules = [
        ("label_not_included", ~F.col("label").isin(list(include)) if include else None),
        ("label_excluded", F.col("label").isin(list(exclude)) if exclude else None),
        ("below_minimum_duration", duration_s() < minimum_s if minimum_s is not None else None),
        ("above_maximum_duration", duration_s() > maximum_s if maximum_s is not None else None),
        ("below_minimum_confidence", F.col("confidence").isNull() | (F.col("confidence") < minimum_confidence) if minimum_confidence is not None else None),
    ]
    for name, rule in reversed(rules):
        if rule is not None:
            reason = F.when(rule, F.lit(name)).otherwise(reason)
    return intervals.withColumn("reason", reason)


def merge_intervals(intervals: DataFrame, keys=KEYS, *, maximum_gap_s: float, confidence: str = "minimum", by_label: bool = True) -> DataFrame:
    """Intervals of one label joined when one starts no later than ``maximum_gap_s`` after the furthest stop so far.

    The confidence is the minimum, maximum or mean, null if any is, or dropped."""
    group = [*keys, *(["label"] if by_label else [])]
    order = Window.partitionBy(*group).orderBy("start_us", "stop_us", "interval_id")
    furthest = F.max("stop_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (furthest.isNull() | (F.col("start_us") - furthest > int(round(maximum_gap_s * US)))).cast("long")
    marked = intervals.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pick = {"minimum": F.min, "maximum": F.max, "mean": F.avg}
    found = F.lit(None).cast("double") if confidence == "drop" else F.when(F.count("confidence") == F.count("*"), pick[confidence]("confidence"))
    return marked.groupBy(*group, "island").agg(F.min("start_us").alias("start_us"), F.max("stop_us").alias("stop_us"), found.alias("confidence"), F.count("*").alias("n_sources"), F.min("interval_id").alias("interval_id"))


def split_intervals(intervals: DataFrame, *, maximum_s: float | None = None, cuts_us: tuple[int, ...] = ()) -> DataFrame:
    """Intervals cut at the points strictly inside them and, after each piece's start, at every ``maximum_s``."""
    inside = F.filter(F.array(*[F.lit(int(c)) for c in cuts_us]).cast("array<bigint>"), lambda c: (c > F.col("start_us")) & (c < F.col("stop_us")))
    edges = F.array_sort(F.array_distinct(F.concat(F.array("start_us"), inside, F.array("stop_us"))))
    pieces = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(F.element_at(edges, i).alias("a"), F.element_at(edges, i + 1).alias("b")))
    out = intervals.where("stop_us > start_us").withColumn("_p", F.explode(pieces))
    if maximum_s is not None:
        step = int(round(maximum_s * US))
        starts = F.sequence(F.col("_p.a"), F.col("_p.b") - 1, F.lit(step).cast("long"))
        out = out.withColumn("_p", F.explode(F.transform(starts, lambda a: F.struct(a.alias("a"), F.least(a + step, F.col("_p.b")).alias("b")))))
    order = Window.partitionBy(*KEYS, "interval_id").orderBy("_p.a")
    return out.withColumn("piece", F.row_number().over(order)).withColumn("start_us", F.col("_p.a")).withColumn("stop_us", F.col("_p.b")).drop("_p")


def contextualize(intervals: DataFrame, context: DataFrame, *, minimum_fraction: float = 0.0, multiple: str = "duplicate", bucket_us: int = 3600 * US, template: str = "{label}@{context}", keep_unmatched: bool = True) -> DataFrame:
    """Labels with the label of the context they overlap by a share of their own length.

    ``multiple``: ``duplicate`` one row per match, ``first`` the earliest context, ``reject`` refuses."""
    pairs = overlap_join(intervals, context, bucket_us=bucket_us)
    share = overlap_us(F.col("start_us"), F.col("stop_us"), F.col("c_start_us"), F.col("c_stop_us")) / (F.col("stop_us") - F.col("start_us"))
    pairs = pairs.withColumn("fraction", share).where((F.col("fraction") > 0) & (F.col("fraction") >= minimum_fraction))
    rank = Window.partitionBy(*KEYS, "interval_id").orderBy("c_start_us", "c_interval_id")
    pairs = pairs.withColumn("match", F.row_number().over(rank))
    if multiple == "reject":
        require(pairs.where("match > 1").select("interval_id"), "an interval overlaps several contexts")
    if multiple == "first":
        pairs = pairs.where("match = 1")
    before, _, after = template.partition("{label}")
    named = F.concat(F.lit(before), F.col("label"), *[x for part in [after.partition("{context}")] for x in (F.lit(part[0]), F.col("c_label"), F.lit(part[2]))])
    out = pairs.withColumn("label", named).withColumnRenamed("c_label", "context").select(*intervals.columns, "context", "fraction")
    if keep_unmatched:
        left = intervals.join(pairs.select(*KEYS, "interval_id").distinct(), [*KEYS, "interval_id"], "left_anti")
        out = out.unionByName(left, allowMissingColumns=True)
    return out


def overlapping(intervals: DataFrame, keys=KEYS, *, by_label: bool = True) -> DataFrame:
    """Intervals that start before one that started earlier has stopped."""
    w = Window.partitionBy(*keys, *(["label"] if by_label else [])).orderBy("start_us", "stop_us", "interval_id").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("_to", F.max("stop_us").over(w)).where("_to > start_us").drop("_to")


def resolve_overlaps(intervals: DataFrame, priority: list[str], keys=KEYS) -> DataFrame:
    """Intervals of the labels first in ``priority`` keep their time; the others lose what those take (then earlier before later).

    Sequential by nature, so each recording is one task's work."""
    rank = {label: i for i, label in enumerate(priority)}
    schema = T.StructType([*intervals.schema.fields, T.StructField("piece", T.LongType())])

    def trim(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple[int, int]] = []
        rows = []
        order = pdf.assign(_r=[rank.get(x, len(rank)) for x in pdf["label"]]).sort_values(["_r", "start_us", "stop_us", "interval_id"]).drop(columns="_r")
        for row in order.itertuples(index=False):
            pieces = [(row.start_us, row.stop_us)]
            for a, b in taken:
                pieces = [p for x, y in pieces for p in ((x, min(y, a)), (max(x, b), y)) if p[0] < p[1]] if any(x < b and a < y for x, y in pieces) else pieces
            for k, (a, b) in enumerate(sorted(pieces)):
                rows.append({**row._asdict(), "start_us": a, "stop_us": b, "piece": k + 1})
            taken += pieces
        return pd.DataFrame(rows, columns=schema.fieldNames())

    return intervals.groupBy(*keys).applyInPandas(trim, schema)


def artifact_mask(samples: DataFrame, pulses: DataFrame, keys=KEYS, *, pre_s: float = 0.01, post_s: float = 0.2, value: str = "signal") -> DataFrame:
    """Samples with ``kept``: finite and outside every pulse widened by ``pre_s`` and ``post_s``, both ends included."""
    wide = pulses.select(*keys, F.col("interval_id"), F.lit("pulse").alias("label"), (F.col("start_us") - int(round(pre_s * US))).alias("start_us"), (F.col("stop_us") + int(round(post_s * US))).alias("stop_us"), F.lit(None).cast("double").alias("confidence"))
    merged = merge_intervals(wide, keys, maximum_gap_s=0.0).select(*keys, "start_us", "stop_us")
    hit = range_join(samples.select(*keys, "t_us"), merged, keys, bucket_us=600 * US, closed=True).select(*keys, F.col("p_t_us").alias("t_us"), F.lit(True).alias("_hit")).distinct()
    return samples.join(hit, [*keys, "t_us"], "left").withColumn("kept", F.col(value).isNotNull() & F.col("_hit").isNull()).drop("_hit")


def recovery_times(samples: DataFrame, pulses: DataFrame, keys=KEYS, *, baseline_s: float, guard_s: float, assessment_s: float, threshold_sd: float = 3.0, stable: int = 3, minimum_baseline: int = 3, value: str = "signal") -> DataFrame:
    """Per pulse: baseline median and scaled MAD before it, peak deviation after it, and the first sample from which
    ``stable`` samples in a row lie within ``threshold_sd``. The assessment stops at the next pulse (``censored``)."""
    keys = list(keys)
    after = F.lead("start_us").over(Window.partitionBy(*keys).orderBy("start_us", "interval_id"))
    spans = pulses.withColumn("_end", F.least(F.col("stop_us") + int(assessment_s * US), F.coalesce(after, F.lit(1 << 62)))).withColumn("censored", F.coalesce(after < F.col("stop_us") + int(assessment_s * US), F.lit(False)))
    kept = samples.where(F.col(value).isNotNull()).select(*keys, "t_us", F.col(value).cast("double").alias("v"))
    far, guard = int((baseline_s + guard_s) * US), int(guard_s * US)

    def before(asked: dict, points: dict) -> dict:
        start, back = np.unique(asked["start_us"], return_inverse=True)
        i, j = np.searchsorted(points["t_us"], start - far), np.searchsorted(points["t_us"], start - guard)
        n, some = j - i, np.flatnonzero(j > i)
        middle, scale = np.zeros(len(n)), np.zeros(len(n))
        if len(some):
            windows = Windows(points["v"])
            middle[some] = windows.median(i[some], j[some])
            scale[some] = 1.4826 * windows.median_deviation(i[some], j[some], middle[some])
        none = (n == 0)[back]
        return {"baseline": np.ma.array(middle[back], mask=none), "n_baseline": np.ma.array(n[back], mask=none), "scale": np.ma.array(scale[back], mask=none)}

    def after_it(asked: dict, points: dict) -> dict:
        stop, end, middle, scale = (asked[c] for c in ("stop_us", "_end", "baseline", "scale"))
        t, x = points["t_us"], points["v"]
        i, j = np.searchsorted(t, stop), np.searchsorted(t, end)
        peak, recovery = np.ma.masked_all(len(i)), np.ma.masked_all(len(i))
        some = np.flatnonzero((j > i) & ~np.isnan(middle))
        if len(some):
            windows = Windows(x)
            low, high = windows.kth(i[some], j[some], np.zeros(len(some), np.int64)), windows.kth(i[some], j[some], j[some] - i[some] - 1)
            furthest, spread = np.maximum(np.abs(low - middle[some]), np.abs(high - middle[some])), scale[some] > 0
            peak[some[spread]] = furthest[spread] / scale[some][spread]
            place = first_stable(x, i[some], j[some], middle[some], threshold_sd * scale[some], stable)
            recovery[some[place >= 0]] = (t[place[place >= 0]] - stop[some[place >= 0]]) / 1e6
        return {"peak_sd": peak, "recovery_s": recovery}

    double = lambda c: T.StructField(c, T.DoubleType())
    spans = spans.select(*keys, "interval_id", "censored", "start_us", "stop_us", "_end")
    found = per_slice(spans, kept, keys, before, [double("baseline"), T.StructField("n_baseline", T.LongType()), double("scale")], before_us=far, after_us=0, at="start_us")
    out = per_slice(found, kept, keys, after_it, [double("peak_sd"), double("recovery_s")], before_us=0, after_us=int(assessment_s * US), at="stop_us", asks=("_end", "baseline", "scale"))
    return out.drop("start_us", "stop_us", "_end").withColumn("assessed", F.coalesce(F.col("n_baseline") >= minimum_baseline, F.lit(False)))


def pair_start_stop(rows: DataFrame, keys=KEYS, *, behavior: str = "label", status: str = "status") -> DataFrame:
    """START and STOP rows of a behaviour, in time order, as intervals; other rows are points. Rows that break the
    alternation come back with an ``error`` (repeated start, stop without start, start left open)."""
    w = Window.partitionBy(*keys, behavior).orderBy("t_us", "row_id")
    state = rows.where(F.upper(status).isin("START", "STOP")).withColumn("_s", F.upper(status))
    state = state.withColumn("_next", F.lead("_s").over(w)).withColumn("_prev", F.lag("_s").over(w)).withColumn("stop_us", F.lead("t_us").over(w))
    error = F.when((F.col("_s") == "START") & F.col("_next").isNull(), "open_start").when((F.col("_s") == "START") & (F.col("_next") == "START"), "repeated_start").when((F.col("_s") == "STOP") & (F.col("_prev").isNull() | (F.col("_prev") == "STOP")), "stop_without_start")
    state = state.withColumn("error", error).where((F.col("_s") == "START") | F.col("error").isNotNull())
    out = state.select(*keys, F.col(behavior).alias("label"), F.when(F.col("error").isNull(), "interval").otherwise("error").alias("kind"), F.col("t_us").alias("start_us"), F.when(F.col("error").isNull(), F.col("stop_us")).alias("stop_us"), "error")
    points = rows.where(F.coalesce(F.upper(status), F.lit("")).isin("", "POINT"))
    return out.unionByName(points.select(*keys, F.col(behavior).alias("label"), F.lit("point").alias("kind"), F.col("t_us").alias("start_us"), F.lit(None).cast("long").alias("stop_us"), F.lit(None).cast("string").alias("error")))


def normalized_progress(times: DataFrame, intervals: DataFrame, keys=KEYS, *, bucket_us: int = 3600 * US) -> DataFrame:
    """(t - start) / (stop - start) of the times inside an interval, both ends included.

    The result has a row for each time in each interval, so it grows with the square of a recording's density; what is made
    on the way to it does not."""
    hit = range_join(times, intervals.where("stop_us > start_us"), keys, bucket_us=bucket_us, closed=True, packed=True)
    return hit.withColumn("progress", (F.col("p_t_us") - F.col("start_us")) / (F.col("stop_us") - F.col("start_us")))


def event_times(intervals: DataFrame, points: DataFrame | None = None, *, edge: str = "onset") -> DataFrame:
    """Onsets or offsets of intervals, and point events if given, as events."""
    at = {"onset": "start_us", "offset": "stop_us"}[edge]
    out = intervals.select(*KEYS, F.col("interval_id").alias("event_id"), F.col(at).alias("t_us"), F.col("label").alias("condition"))
    return out if points is None else out.unionByName(points.select(*out.columns))


def interval_encoding_inputs(intervals: DataFrame, keys=KEYS, *, edge: str = "onset") -> DataFrame:
    """Per interval the event at its edge, its duration as the event's value, its bounds, and its place among the label's edges."""
    at, other = {"onset": ("start_us", "stop_us"), "offset": ("stop_us", "start_us")}[edge]
    order = Window.partitionBy(*keys, "label").orderBy(at, other, "interval_id")
    return intervals.select(*keys, "label", F.row_number().over(order).alias("place"), F.col(at).alias("t_us"), duration_s().alias("duration_s"), "start_us", "stop_us")


def fit_clock(matches: DataFrame, keys=("clock",), *, maximum_residual_s: float, maximum_drift_ppm: float, minimum_matches: int = 3, minimum_span_s: float = 1.0) -> DataFrame:
    """Least-squares map target = intercept + scale * source per clock, with its residuals, drift and whether it is accepted."""
    fit = matches.groupBy(*keys).agg(F.regr_slope("target_t", "source_t").alias("scale"), F.regr_intercept("target_t", "source_t").alias("intercept"), F.count("*").alias("n"), (F.max("source_t") - F.min("source_t")).alias("span_s"))
    worst = matches.join(fit, list(keys)).groupBy(*keys).agg(F.max(F.abs(F.col("target_t") - F.col("intercept") - F.col("scale") * F.col("source_t"))).alias("max_residual_s"))
    out = fit.join(worst, list(keys)).withColumn("drift_ppm", (F.col("scale") - 1) * 1e6)
    accepted = (F.col("n") >= minimum_matches) & (F.col("span_s") >= minimum_span_s) & (F.col("max_residual_s") <= maximum_residual_s) & (F.abs("drift_ppm") <= maximum_drift_ppm)
    return out.withColumn("accepted", F.coalesce(accepted, F.lit(False)))


def transform_time(rows: DataFrame, fit: DataFrame, matches: DataFrame, keys=("clock",), *, time: str = "source_t", maximum_extrapolation_s: float = 0.0) -> DataFrame:
    """Times on the target clock; null further outside the matched span than allowed."""
    span = matches.groupBy(*keys).agg(F.min("source_t").alias("_lo"), F.max("source_t").alias("_hi"))
    out = rows.join(fit.select(*keys, "intercept", "scale"), list(keys)).join(span, list(keys))
    inside = (F.col(time) >= F.col("_lo") - maximum_extrapolation_s) & (F.col(time) <= F.col("_hi") + maximum_extrapolation_s)
    return out.withColumn("target_t", F.when(inside, F.col("intercept") + F.col("scale") * F.col(time))).drop("_lo", "_hi", "intercept", "scale")


def pose_speed(pose: DataFrame, keys=(*KEYS, "keypoint"), *, minimum_confidence: float, scale: float = 1.0) -> DataFrame:
    """Speed from the sample before; null unless both are confident."""
    w = Window.partitionBy(*keys).orderBy("t_us")
    ok = (F.col("confidence") >= minimum_confidence) & (F.lag("confidence").over(w) >= minimum_confidence)
    away = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2) * scale
    return pose.withColumn("speed", F.when(ok, away / ((F.col("t_us") - F.lag("t_us").over(w)) / 1e6)))


def edges_of(rows: DataFrame, state: Column, keys=KEYS, *, edge: str = "rising") -> DataFrame:
    """Times at which a boolean state turns on, off, or either; the first sample is no edge."""
    w = Window.partitionBy(*keys).orderBy("t_us")
    marked = rows.withColumn("_now", state).withColumn("_was", F.lag("_now").over(w))
    up, down = F.col("_now") & ~F.col("_was"), ~F.col("_now") & F.col("_was")
    wanted = {"rising": up, "falling": down, "both": up | down}[edge]
    return marked.where(wanted).withColumn("edge", F.when(F.col("_now"), "rising").otherwise("falling")).drop("_now", "_was")
