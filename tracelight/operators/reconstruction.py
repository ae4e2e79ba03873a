"""What a gap or its reconstruction does to events: coverage classes and errors against a known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators.events import level_differences
from tracelight.operators.joins import nearest, range_join

KEYS = ("subject", "session")
US = 1_000_000


def _around(samples: DataFrame, events: DataFrame, keys, baseline, response, carry) -> DataFrame:
    """Samples of each event's two windows: the baseline's end is open, the response's is closed."""
    low, high = min(baseline[0], response[0]), max(baseline[1], response[1])
    ranges = events.select(*keys, "event_id", F.col("t_us").alias("_e"), (F.col("t_us") + round(low * US)).alias("start_us"), (F.col("t_us") + round(high * US)).alias("stop_us"))
    hit = range_join(samples.select(*keys, "t_us", *carry), ranges, keys, bucket_us=max(1, round((high - low) * US)), closed=True)
    rel = F.col("p_t_us") - F.col("_e")
    hit = hit.withColumn("_base", (rel >= round(baseline[0] * US)) & (rel < round(baseline[1] * US))).withColumn("_resp", (rel >= round(response[0] * US)) & (rel <= round(response[1] * US)))
    return hit.where("_base or _resp")


def event_disposition(samples: DataFrame, events: DataFrame, keys=KEYS, *, value: str = "signal", baseline=(-1.0, 0.0), response=(0.0, 1.0)) -> DataFrame:
    """Events with their coverage class; a window that holds a missing sample is not accepted in part."""
    keys = list(keys)
    own = nearest(events, samples.select(*keys, "t_us", value), keys, carry=(value,))
    lost = lambda side: F.count_if(F.col(side) & F.col(f"p_{value}").isNull()) > 0
    found = _around(samples, events, keys, baseline, response, [value]).groupBy(*keys, "event_id").agg(lost("_base").alias("_b"), lost("_resp").alias("_r"), (F.max("_base") & F.max("_resp")).alias("_all"))
    out = own.join(found, [*keys, "event_id"], "left")
    kind = (
        F.when(F.col(f"n_{value}").isNull(), "event_inside_gap").when(F.col("_b") & F.col("_r"), "baseline_and_response_intersect_gap").when(F.col("_b"), "baseline_intersects_gap").when(F.col("_r"), "response_intersects_gap")
        .when(~F.coalesce("_all", F.lit(False)), "insufficient_window_coverage").otherwise("complete")
    )
    return out.select(*events.columns, kind.alias("disposition"))


def reconstruction_metrics(samples: DataFrame, events: DataFrame, keys=KEYS, *, truth: str, observed: str, reconstructed: str, rate_hz: float, contrast_denominator: str = "truth_contrast") -> DataFrame:
    """Per event: errors of the waveform, the peak and its time in samples, the response and the contrast, relative to
    the truth, over a second on either side; null unless the event is complete."""
    keys = list(keys)
    rows = _around(samples, events, keys, (-1.0, 0.0), (0.0, 1.0), [truth, observed, reconstructed])
    t, o, flag = F.col(f"p_{truth}"), F.col(f"p_{observed}"), F.col(f"p_{reconstructed}")
    side = lambda which, v: F.avg(F.when(F.col(which), v))
    peak = lambda v: F.max(F.when(F.col("_resp") & v.isNotNull(), F.struct(v.alias("v"), (-F.col("p_t_us")).alias("back"))))
    found = rows.groupBy(*keys, "event_id").agg(
        F.sqrt(F.avg((o - t) ** 2)).alias("_rmse"), F.max(F.abs(t)).alias("_scale"), peak(t).alias("_tp"), peak(o).alias("_op"), side("_resp", t).alias("_tr"), side("_resp", o).alias("_or"), side("_base", t).alias("_tb"), side("_base", o).alias("_ob"),
        F.avg(flag.cast("double")).alias("reconstructed_fraction"),
    )
    out = event_disposition(samples, events, keys, value=observed).join(found, [*keys, "event_id"], "left")
    least = lambda c: F.greatest(F.abs(c), F.lit(1e-12))
    contrast = F.col("_tr") - F.col("_tb")
    measures = {
        "waveform_rmse": F.col("_rmse") / F.greatest("_scale", F.lit(2.220446049250313e-16)), "peak_error": F.abs(F.col("_op.v") - F.col("_tp.v")) / least(F.col("_tp.v")), "peak_time_error_samples": F.abs(F.col("_op.back") - F.col("_tp.back")) / 1e6 * rate_hz,
        "response_error": F.abs(F.col("_or") - F.col("_tr")) / least(F.col("_tr")), "contrast_error": F.abs(F.col("_or") - F.col("_ob") - contrast) / least(contrast if contrast_denominator == "truth_contrast" else F.col("_scale")),
    }
    complete = F.col("disposition") == "complete"
    return out.select(*events.columns, "disposition", "reconstructed_fraction", *[F.when(complete, m).alias(name) for name, m in measures.items()])


def condition_reconstruction_warning(flagged: DataFrame, condition: str = "condition", share: str = "flagged") -> DataFrame:
    """Whether conditions differ in the mean share of reconstructed samples."""
    return level_differences(flagged, condition, F.col(share))
