"""Session estimates to animals, and contrasts between conditions on animals.

Sign conventions differ by family and are part of the results: transients, multiscale, spatial edges give b - a (or
b / a); association and band power give a - b."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelight.operators.inference import bootstrap_units, label_shuffle_p, sign_flip_p, simultaneous_band

AVERAGE = {"mean": F.avg, "median": lambda c: F.percentile(c, F.lit(0.5))}


def pooled_rates(sessions: DataFrame, *, animal: str = "subject", level: str = "condition") -> DataFrame:
    """Events a minute per animal and level: 60 times all events over all seconds, not a mean of rates."""
    out = sessions.groupBy(animal, level).agg(F.sum("n_events").alias("n_events"), F.sum("duration_s").alias("duration_s"))
    return out.withColumn("estimate", F.when(F.col("duration_s") > 0, 60 * F.col("n_events") / F.col("duration_s")))


def session_estimates(sessions: DataFrame, metric: str, *, animal: str = "subject", level: str = "condition", how: str = "median") -> DataFrame:
    """Mean or median of session values per animal and level; sessions without a value are left out."""
    return sessions.where(F.col(metric).isNotNull()).groupBy(animal, level).agg(AVERAGE[how](metric).alias("estimate"), F.count("*").alias("sessions"))


def lag_estimate(curve: DataFrame, keys, *, interval_s: float, lag_s: float = 0.0) -> DataFrame:
    """The correlation at the lag nearest ``lag_s``; null if it is more than half a sample away."""
    away = F.abs(F.col("lag") * interval_s - lag_s)
    out = curve.groupBy(*keys).agg(F.min_by("correlation", F.struct(away.alias("d"), F.col("lag"))).alias("estimate"), F.min(away).alias("_d"))
    return out.withColumn("estimate", F.when(F.col("_d") <= interval_s / 2 + 1e-12, F.col("estimate"))).drop("_d")


def paired_rows(estimates: DataFrame, *, animal: str, level: str, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Animals with both levels (columns a and b), and the ledger of those without."""
    pick = lambda x: F.max(F.when(F.col(level) == x, F.col("estimate")))
    wide = estimates.groupBy(animal).agg(pick(a).alias("a"), pick(b).alias("b"))
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    return wide.where(whole), wide.where(~whole).select(animal, F.when(F.col("a").isNull() & F.col("b").isNull(), "neither").when(F.col("a").isNull(), a).otherwise(b).alias("missing"))


@dataclass(frozen=True)
class AnimalContrast:
    estimate: float
    low: float
    high: float
    p: float
    animals: int
    excluded: list


class TooFewAnimals(ValueError):
    """Fewer than two animals with both levels; ``animals`` says how many there are."""

    def __init__(self, animals: int):
        super().__init__("two animals per level at least")
        self.animals = animals


def infer_animals(estimates: DataFrame, *, a: str, b: str, animal: str = "subject", level: str = "condition", design: str = "paired", scale: str = "difference", sign: str = "b-a", draws: int = 10_000, seed: int = 0) -> AnimalContrast:
    """Contrast of levels over animals: bootstrap interval, sign flips or label shuffles for the p value.

    Ratios are taken on logarithms, so the paired ratio is a geometric mean; values of either sign are refused.
    One row per animal reaches the driver."""
    turn = 1 if sign == "b-a" else -1
    if design == "paired":
        pairs, missing = paired_rows(estimates, animal=animal, level=level, a=a, b=b)
        rows = pairs.orderBy(animal).collect()
        x, y = np.array([r["a"] for r in rows], float), np.array([r["b"] for r in rows], float)
        excluded = [r[animal] for r in missing.orderBy(animal).collect()]
    else:
        found = estimates.where(F.col("estimate").isNotNull()).orderBy(animal).collect()
        x, y = (np.array([r["estimate"] for r in found if r[level] == v], float) for v in (a, b))
        excluded = []
    if min(len(x), len(y)) < 2:
        raise TooFewAnimals(len(x) if design == "paired" else len(x) + len(y))
    if scale == "ratio":
        if (x <= 0).any() or (y <= 0).any():
            raise ValueError("a ratio needs positive estimates")
        x, y = np.log(x), np.log(y)
    if design == "paired":
        values = turn * (y - x)
        low, high = bootstrap_units(values, draws=draws, seed=seed)
        estimate, p = float(values.mean()), sign_flip_p(values, resamples=draws, seed=seed)
    else:
        rng = np.random.default_rng(seed)
        spread = turn * (y[rng.integers(0, len(y), (draws, len(y)))].mean(axis=1) - x[rng.integers(0, len(x), (draws, len(x)))].mean(axis=1))
        low, high = (float(v) for v in np.quantile(spread, [0.025, 0.975]))
        estimate, p = float(turn * (y.mean() - x.mean())), label_shuffle_p(y, x, resamples=draws, seed=seed)
    back = np.exp if scale == "ratio" else float
    return AnimalContrast(float(back(estimate)), float(back(low)), float(back(high)), p, len(x) if design == "paired" else len(x) + len(y), excluded)


def infer_curves(curves: DataFrame, *, numerator: str, denominator: str, animal: str = "subject", level: str = "condition", axis: str = "rel_idx", draws: int = 2000, seed: int = 0) -> list[dict]:
    """Paired curve contrast with pointwise errors and a simultaneous band; animals that lack a point are excluded whole."""
    rows = curves.where(F.col(level).isin(numerator, denominator) & F.col("estimate").isNotNull()).groupBy(animal, axis).agg(
        (F.max(F.when(F.col(level) == numerator, F.col("estimate"))) - F.max(F.when(F.col(level) == denominator, F.col("estimate")))).alias("d")
    )
    found = [r for r in rows.collect() if r["d"] is not None]
    places = sorted({r[axis] for r in found})
    by: dict = {}
    for r in found:
        by.setdefault(r[animal], {})[r[axis]] = r["d"]
    whole = sorted(a for a, points in by.items() if len(points) == len(places))
    if len(whole) < 2:
        raise ValueError("two animals with whole curves at least")
    matrix = np.array([[by[a][p] for p in places] for a in whole])
    centre, se, critical = simultaneous_band(matrix, draws=draws, seed=seed)
    return [{axis: p, "estimate": float(c), "se": float(s), "low": float(c - critical * s), "high": float(c + critical * s), "animals": len(whole)} for p, c, s in zip(places, centre, se)]


def calibrate_mixing(known: DataFrame, channels: list[str], components: list[str], *, minimum: int = 20, maximum_condition: float = 1000.0) -> dict:
    """Mixing coefficients and offsets per channel by least squares of wide rows of known components and measurements.

    The normal equations are one aggregate; only they reach the driver."""
    names = [*components, "1"]
    value = {**{c: F.col(c) for c in components}, "1": F.lit(1.0)}
    whole = known.where(sum((F.col(c).isNotNull().cast("int") for c in [*components, *channels]), F.lit(0)) == len(components) + len(channels))
    sums = [F.sum(value[x] * value[y]).alias(f"xx_{i}_{j}") for i, x in enumerate(names) for j, y in enumerate(names)]
    sums += [F.sum(value[x] * F.col(c)).alias(f"xy_{i}_{k}") for i, x in enumerate(names) for k, c in enumerate(channels)]
    row = whole.agg(F.count("*").alias("n"), *sums).first()
    if row["n"] < minimum:
        raise ValueError(f"{minimum} calibration samples at least, there are {row['n']}")
    xx = np.array([[row[f"xx_{i}_{j}"] for j in range(len(names))] for i in range(len(names))])
    xy = np.array([[row[f"xy_{i}_{k}"] for k in range(len(channels))] for i in range(len(names))])
    solved = np.linalg.lstsq(xx, xy, rcond=None)[0]
    matrix = solved[:-1].T
    condition = float(np.linalg.cond(matrix))
    if not condition <= maximum_condition:
        raise ValueError(f"the mixing matrix has condition {condition:.3g}")
    return {"matrix": {ch: dict(zip(components, map(float, row_))) for ch, row_ in zip(channels, matrix)}, "offsets": dict(zip(channels, map(float, solved[-1]))), "n": row["n"], "condition": condition}


def assess_sensor_validity(quality: DataFrame, assignments: DataFrame, profiles: DataFrame, keys=("subject", "session", "channel"), *, sensor: str = "sensor") -> DataFrame:
    """Recordings' metrics and wavelengths against their sensor's profile: pass, warning or error with the reasons.

    assignments: keys, sensor, excitation_nm, emission_nm; profiles: sensor and ranges of both. Unknown sensors are an error."""
    table = quality.join(assignments, list(keys), "left").join(profiles, sensor, "left")
    inside = lambda c: F.col(f"{c}_nm").between(F.col(f"{c}_min_nm"), F.col(f"{c}_max_nm"))
    errors = {"unknown_sensor": F.col("excitation_min_nm").isNull(), "excitation_outside_profile": ~inside("excitation"), "emission_outside_profile": ~inside("emission"), "few_finite_samples": F.col("finite_fraction") < 0.8, "repeated_extremes": F.col("extreme_repeat_fraction") > 0.05}
    warnings = {"some_missing_samples": F.col("finite_fraction").between(0.8, 0.95), "some_repeated_extremes": (F.col("extreme_repeat_fraction") > 0.01) & (F.col("extreme_repeat_fraction") <= 0.05)}
    told = lambda checks: F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    out = table.withColumn("errors", told(errors)).withColumn("warnings", told(warnings))
    return out.withColumn("status", F.when(F.size("errors") > 0, "error").when(F.size("warnings") > 0, "warning").otherwise("pass")).select(*keys, sensor, "status", "errors", "warnings")


def longitudinal_export(table: DataFrame, *, subject: str, session: str, trial: str, order: str, comparable: DataFrame | None = None) -> DataFrame:
    """Columns renamed for longitudinal tools, keys checked for uniqueness; subjects judged not comparable are refused."""
    from tracelight.model import require

    out = table.withColumnsRenamed({subject: "subject_id", session: "session_id", trial: "trial_id", order: "session_order"})
    require(out.groupBy("subject_id", "session_id", "trial_id").count().where("count > 1"), "a trial is repeated")
    if comparable is not None:
        require(out.select("subject_id").distinct().join(comparable.where("status = 'not_comparable'"), F.col("subject_id") == F.col("subject"), "left_semi"), "a subject's sessions are not comparable")
    return out


def curve_sessions(rows: DataFrame, *, axis: str, value: str, support: str | None = None, level: str | None = None, keys=("subject", "session"), named: str | None = None) -> DataFrame:
    """Spectra, autocorrelations, lag curves or coherences of sessions as curves: ``axis``, ``value``, ``n`` and the level.

    The level is a column (a state, a condition) or, with ``named``, one name for all; points without a value stay out."""
    condition = F.lit(named) if level is None else F.col(level).cast("string")
    curve = rows.select(*keys, condition.alias("condition"), F.col(axis).cast("double").alias("axis"), F.col(value).alias("value"), (F.col(support) if support else F.lit(1)).cast("long").alias("n"))
    return curve.where("value is not null and condition is not null")


def curve_population(curves: DataFrame, *, animal: str = "subject", session: str = "session") -> DataFrame:
    """Session curves to animal curves, point by point, sessions weighing the same."""
    return curves.groupBy(animal, "condition", "axis").agg(F.avg("value").alias("estimate"), F.sum("n").alias("support"), F.count_distinct(session).alias("sessions"))


def state_band_power_population(psd: DataFrame, *, state: str, low: float, high: float, animal: str = "subject", session: str = "session") -> DataFrame:
    """Band power of each session's states, then its mean over an animal's sessions: ready for ``infer_animals``."""
    from tracelight.operators.spectral import band_power

    power = band_power(psd, (animal, session, state), low=low, high=high).where("band_power is not null")
    return power.groupBy(animal, F.col(state).cast("string").alias("condition")).agg(F.avg("band_power").alias("estimate"), F.count("*").alias("sessions"))


def infer_curve_interaction(curves: DataFrame, assignments: DataFrame, *, conditions: tuple[str, str], groups: tuple[str, str], animal: str = "subject", level: str = "condition", group: str = "group", axis: str = "rel_idx") -> DataFrame:
    """At each point, the difference between groups of animals in their difference between conditions, by Welch's t."""
    from tracelight.operators.inference import interaction

    return interaction(curves.withColumnRenamed("estimate", "mean"), assignments, unit=animal, condition=level, group=group, conditions=conditions, groups=groups, by=[axis])


def isosbestic_metrics(samples: DataFrame, keys=("subject", "session", "channel"), *, max_lag: int, gap_factor: float | None = 1.5, max_gap_s: float | None = None) -> DataFrame:
    """How a reference goes with its signal: correlation of run-centred values, spread against the signal's, and the
    correlation of their steps at lag zero and where it is largest in size."""
    from tracelight.operators.association import lagged_association
    from tracelight.operators.runs import mark_runs

    keys = list(keys)
    both = samples.withColumn("_both", F.when(F.col("signal").isNotNull() & F.col("reference").isNotNull(), F.lit(1.0)))
    marked = mark_runs(both, keys, value="_both", gap_factor=gap_factor, max_gap_s=max_gap_s)
    run = Window.partitionBy(*keys, "run_id")
    order = run.orderBy("t_us")
    for name in ("signal", "reference"):
        marked = marked.withColumn(f"_{name}", F.col(name) - F.avg(name).over(run)).withColumn(f"_d{name}", F.col(name) - F.lag(name).over(order))
    spread = marked.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("_signal").alias("_ss"), F.stddev_pop("_reference").alias("_rs"))
    zero = lagged_association(samples, keys, max_lag=0, gap_factor=gap_factor, max_gap_s=max_gap_s).select(*keys, F.col("correlation").alias("zero_lag"))
    ahead = [F.struct(F.lit(k).alias("lag"), (F.lead("_dreference", k).over(order) if k >= 0 else F.lag("_dreference", -k).over(order)).alias("r")) for k in range(-max_lag, max_lag + 1)]
    pairs = marked.select(*keys, F.col("_dsignal").alias("x"), F.array(*ahead).alias("_ls")).select(*keys, "x", F.explode("_ls").alias("_l")).where("x is not null and _l.r is not null")
    r = F.col("_l.r")
    steps = pairs.groupBy(*keys, F.col("_l.lag").alias("lag")).agg((F.sum(F.col("x") * r) / F.sqrt(F.nullif(F.sum(F.col("x") ** 2) * F.sum(r * r), F.lit(0.0)))).alias("c"))
    best = F.struct(F.round(F.abs("c"), 9).alias("size"), (-F.col("lag")).alias("first"))
    steps = steps.where("c is not null").groupBy(*keys).agg(F.max(F.when(F.col("lag") == 0, F.col("c"))).alias("step_zero"), F.max_by("c", best).alias("step_best"), F.max_by("lag", best).alias("best_lag"))
    out = spread.join(zero, keys, "left").join(steps, keys, "left")
    return out.withColumn("sd_ratio", F.col("_rs") / F.greatest("_ss", F.lit(2.220446049250313e-16))).withColumn("lag_improvement", F.abs("step_best") - F.abs("step_zero")).drop("_ss", "_rs")
