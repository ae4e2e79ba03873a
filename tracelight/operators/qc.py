"""Recording and event quality, coverage and comparability: ledgers that warn and delete nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelight.functions import fraction, tasks_for
from tracelight.model import RECORDING, recording_window
from tracelight.operators.preprocess import reference_fit
from tracelight.operators.runs import intervals_of, run_length_encode
from tracelight.operators.slices import window_sums

KEYS = ("subject", "session")
GAP_FACTOR = 1.5


def assess_signal_recording(samples: DataFrame, keys=RECORDING, *, value: str = "signal") -> DataFrame:
    """Clock and channel metrics of each recording, with a list of warnings."""
    keys = list(keys)
    timed = intervals_of(samples, keys)
    middle = timed.groupBy(*keys).agg(F.percentile("dt", F.lit(0.5)).alias("median_dt"))
    clock = timed.join(middle, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("median_dt").alias("median_dt"), (F.stddev_pop("dt") / F.avg("dt")).alias("interval_cv"),
        F.count_if(F.col("dt") > GAP_FACTOR * F.col("median_dt")).alias("large_gaps"), F.avg(F.col(value).isNotNull().cast("double")).alias("finite_fraction"),
    )
    flags = samples.withColumn("_ok", F.col(value).isNotNull())
    longest = run_length_encode(flags, "_ok", keys).groupBy(*keys).agg(F.max(F.when(F.col("_ok"), F.col("n")).otherwise(0)).alias("longest_finite_run"))
    finite = samples.where(F.col(value).isNotNull())
    per = Window.partitionBy(*keys)
    w = recording_window(keys)
    known = finite.withColumn("_lo", F.min(value).over(per)).withColumn("_hi", F.max(value).over(per)).withColumn("_sd", F.stddev_pop(value).over(per)).withColumn("_step", F.abs(F.col(value) - F.lag(value).over(w)))
    channel = known.groupBy(*keys).agg(
        ((F.count_if(F.col(value) == F.col("_lo")) - 1 + F.count_if(F.col(value) == F.col("_hi")) - 1) / F.count("*")).alias("extreme_repeat_fraction"),
        F.avg((F.col("_step") <= F.col("_sd") * 1e-12).cast("double")).alias("flat_step_fraction"),
    )
    out = clock.join(longest, keys).join(channel, keys, "left")
    checks = {"irregular_sampling": F.col("interval_cv") > 0.01, "large_gaps": F.col("large_gaps") > 0, "missing_samples": F.col("finite_fraction") < 1, "repeated_extremes": F.col("extreme_repeat_fraction") > 0.01, "flat_steps": F.col("flat_step_fraction") > 0.05}
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()])))


def assess_recording(samples: DataFrame, keys=RECORDING) -> DataFrame:
    """The signal's metrics, and how a least-squares line on the reference fits it."""
    keys = list(keys)
    fit = reference_fit(samples, keys)
    pairs = samples.where("signal is not null and reference is not null").join(fit, keys).withColumn("_f", F.col("intercept") + F.col("slope") * F.col("reference"))
    found = pairs.groupBy(*keys).agg(
        F.corr("signal", "reference").alias("correlation"), F.first("slope").alias("ols_slope"), F.first("n_pairs").alias("n_pairs"),
        F.sqrt(F.avg((F.col("signal") - F.col("_f")) ** 2)).alias("residual_rmse"), (F.min(F.abs("_f")) / F.percentile(F.abs("_f"), F.lit(0.5))).alias("min_denominator_ratio"),
    )
    return assess_signal_recording(samples, keys).join(found, keys, "left")


def derivative_lags(samples: DataFrame, keys=RECORDING, *, max_lag: int) -> DataFrame:
    """Correlation of the first differences of signal and reference at each lag in samples, and the lag where it is
    largest in size (the smallest of equals) per recording."""
    keys = list(keys)
    w = recording_window(keys)
    steps = samples.withColumn("_ds", F.col("signal") - F.lag("signal").over(w)).withColumn("_dr", F.col("reference") - F.lag("reference").over(w))
    lags = [F.struct(F.lit(k).alias("lag"), (F.lag("_dr", k).over(w) if k >= 0 else F.lead("_dr", -k).over(w)).alias("r")) for k in range(-max_lag, max_lag + 1)]
    pairs = steps.select(*keys, "_ds", F.array(*lags).alias("_ls")).select(*keys, "_ds", F.explode("_ls").alias("_l")).where(F.col("_ds").isNotNull() & F.col("_l.r").isNotNull())
    return pairs.groupBy(*keys, F.col("_l.lag").alias("lag")).agg(F.corr("_ds", "_l.r").alias("correlation"), F.count("*").alias("n_pairs"))


def best_lag(lags: DataFrame, keys=RECORDING) -> DataFrame:
    """Where the rounded size of the correlation is largest; ties go to the smallest lag."""
    order = F.struct(F.round(F.abs("correlation"), 9).alias("r"), (-F.col("lag")).alias("k"))
    return lags.where("correlation is not null").groupBy(*keys).agg(F.max_by("lag", order).alias("best_lag"), F.max_by("correlation", order).alias("best_correlation"))


def event_confounds(samples: DataFrame, events: DataFrame, *, baseline=(-0.5, 0.0), response=(0.0, 0.5), keys=KEYS) -> DataFrame:
    """Per recording: mean event response of the reference in its own standard deviations, and the events' correlation of signal and reference responses."""
    keys = list(keys)
    spread = samples.groupBy(*keys).agg(F.stddev_pop("reference").alias("_sd"))
    parts = window_sums(events.select(*keys, "event_id", "t_us"), samples, {"b": baseline, "r": response}, ["signal", "reference"], keys)
    mean = lambda name, value: F.when(F.col(f"{name}_n") == F.col(f"{name}_{value}_k"), F.col(f"{name}_{value}_m"))
    parts = parts.withColumn("_s", mean("r", "signal") - mean("b", "signal")).withColumn("_r", mean("r", "reference") - mean("b", "reference"))
    out = parts.groupBy(*keys).agg(F.count("_r").alias("n_events"), F.avg("_r").alias("_m"), F.corr("_s", "_r").alias("event_correlation")).join(spread, keys)
    out = out.withColumn("reference_event_effect_sd", F.when(F.col("_sd") > 0, F.col("_m") / F.col("_sd")))
    return out.withColumn("warning", F.coalesce(F.abs("reference_event_effect_sd") >= 0.5, F.lit(False))).drop("_m", "_sd")


def assess_event_coverage(records: DataFrame, *, animal: str = "subject", session: str = "session", condition: str = "condition") -> DataFrame:
    """Candidate, gated and complete events with retention at study, condition, animal and session level.

    records: one row per candidate event with booleans ``gated`` and ``complete``."""
    sets = [(), (condition,), (animal,), (animal, condition), (animal, session), (animal, session, condition)]
    cols = [animal, session, condition]
    out = records.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(
        F.grouping_id(*[F.col(c) for c in cols]).alias("level"), F.count("*").alias("candidates"), F.count_if(F.col("gated")).alias("gated_events"), F.count_if(F.col("gated") & F.col("complete")).alias("complete_events")
    )
    return out.withColumn("gate_retention", fraction(F.col("gated_events"), F.col("candidates"))).withColumn("completion", fraction(F.col("complete_events"), F.col("gated_events")))


def _fold(x: str) -> Column:
    return F.max(x) / F.min(x)


def assess_session_comparability(sessions: DataFrame, *, subject: str = "subject", identity: tuple[str, ...] = ("sensor", "site", "unit"), scale: tuple[str, ...] = ("baseline", "noise"), finite: str = "finite_fraction", coverage: str = "event_coverage", fold_warning: float = 2.0, fold_error: float = 5.0) -> DataFrame:
    """Whether a subject's sessions can be compared: identity must not change; scales may by a factor; coverage has floors.

    One row per subject with errors and warnings; nothing is dropped."""
    grades = {}
    for c in identity:
        grades[f"{c}_changed"] = (F.count_distinct(c) > 1, F.lit(False))
    for c in scale:
        grades[f"{c}_fold_change"] = (_fold(c) > fold_error, _fold(c) > fold_warning)
    grades["finite_fraction"] = (F.min(finite) < 0.8, F.min(finite) < 0.95)
    grades["event_coverage"] = (F.min(coverage) < 0.5, F.min(coverage) < 0.8)
    errors = F.array_compact(F.array(*[F.when(e, F.lit(k)) for k, (e, _) in grades.items()])).alias("errors")
    warnings = F.array_compact(F.array(*[F.when(w & ~F.coalesce(e, F.lit(False)), F.lit(k)) for k, (e, w) in grades.items()])).alias("warnings")
    out = sessions.groupBy(subject).agg(F.count("*").alias("sessions"), errors, warnings)
    return out.withColumn("status", F.when(F.size("errors") > 0, "not_comparable").when(F.size("warnings") > 0, "comparable_with_warnings").otherwise("comparable"))


def validate_design(table: DataFrame, *, observation: str, nesting: dict[str, str], factors: dict[str, str]) -> DataFrame:
    """Violations of a study design: repeated observations, a unit in two parents, a factor that varies inside its assignment unit.

    nesting: child unit -> parent unit; factors: factor -> the unit it is assigned to (``observation`` allows any)."""
    # observations hardly repeat, so counting them before they are dealt out would only hold them all
    dealt = table.select(observation).repartition(tasks_for(table), observation)
    checks = [dealt.groupBy(observation).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_observation").alias("check"), F.col(observation).cast("string").alias("unit"), F.col("n").alias("found"))]
    for child, parent in nesting.items():
        found = table.groupBy(child).agg(F.count_distinct(parent).alias("n")).where("n > 1")
        checks.append(found.select(F.lit(f"{child}_in_two_{parent}").alias("check"), F.col(child).cast("string").alias("unit"), F.col("n").alias("found")))
    for factor, unit in factors.items():
        if unit != observation:
            found = table.groupBy(unit).agg(F.count_distinct(factor).alias("n")).where("n > 1")
            checks.append(found.select(F.lit(f"{factor}_varies_in_{unit}").alias("check"), F.col(unit).cast("string").alias("unit"), F.col("n").alias("found")))
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out
