"""Unit-level estimates and tests: data work as DataFrames, draws on the collected units.

What reaches the driver has one row per unit and level (animals), which study designs bound."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.functions import hedges
from tracelight.kernels.student import t_quantile, t_two_sided


def unit_means(table: DataFrame, *, units: list[str], factor: str, outcome: str) -> DataFrame:
    """Mean finite outcome per unit and level."""
    return table.where(F.col(outcome).isNotNull()).groupBy(*units, factor).agg(F.avg(outcome).alias("mean"), F.count("*").alias("n"))


def nested_contrasts(table: DataFrame, *, unit: str, factor: str, outcome: str, numerator: str, denominator: str, contrast_unit: str | None = None) -> DataFrame:
    """Numerator minus denominator per unit: of its pooled means, or the mean of its contrast units' contrasts.

    With a contrast unit, a unit in which any of them lacks a level has none."""
    by = [unit, *([contrast_unit] if contrast_unit else [])]
    level = lambda x: F.avg(F.when(F.col(factor) == x, F.col(outcome)))
    cells = table.where(F.col(outcome).isNotNull()).groupBy(*by).agg((level(numerator) - level(denominator)).alias("contrast"))
    if contrast_unit:
        cells = cells.groupBy(unit).agg(F.when(F.count("contrast") == F.count("*"), F.avg("contrast")).alias("contrast"))
    return cells.where("contrast is not null")


def t_from_sums(mean: Column, sd: Column, n: Column) -> list[Column]:
    se = sd / F.sqrt(n)
    return [mean.alias("estimate"), se.alias("se"), (n - 1).cast("double").alias("df"), (mean / F.nullif(se, F.lit(0.0))).alias("t"), n.alias("n")]


def paired_t(contrasts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Estimate, standard error, degrees of freedom and t of unit contrasts."""
    grouped = contrasts.groupBy(*(by or []))
    return grouped.agg(*t_from_sums(F.avg("contrast"), F.stddev_samp("contrast"), F.count("contrast")))


def welch_t(cells: DataFrame, *, factor: str, numerator: str, denominator: str, by: list[str] | None = None) -> DataFrame:
    """Welch's t of unit means (``mean``) between two levels."""
    pick = lambda level: F.when(F.col(factor) == level, F.col("mean"))
    a, b = pick(numerator), pick(denominator)
    out = cells.groupBy(*(by or [])).agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"), F.count(a).alias("n_numerator"), F.count(b).alias("n_denominator"))
    qa, qb = F.col("_va") / F.col("n_numerator"), F.col("_vb") / F.col("n_denominator")
    pooled = F.sqrt(((F.col("n_numerator") - 1) * F.col("_va") + (F.col("n_denominator") - 1) * F.col("_vb")) / (F.col("n_numerator") + F.col("n_denominator") - 2))
    df = (qa + qb) ** 2 / (qa**2 / (F.col("n_numerator") - 1) + qb**2 / (F.col("n_denominator") - 1))
    effect = (F.col("_ma") - F.col("_mb")) / pooled * hedges(F.col("n_numerator") + F.col("n_denominator") - 2, 1)
    return out.select(*(by or []), (F.col("_ma") - F.col("_mb")).alias("estimate"), F.sqrt(qa + qb).alias("se"), df.alias("df"), ((F.col("_ma") - F.col("_mb")) / F.sqrt(qa + qb)).alias("t"), effect.alias("hedges_g"), "n_numerator", "n_denominator")


def leave_one_out(contrasts: DataFrame, unit: str, by: list[str] | None = None) -> DataFrame:
    """The mean contrast without each unit, and how far that moves it; NaN for a unit that is alone."""
    by = by or []
    sums = contrasts.groupBy(*by).agg(F.sum("contrast").alias("_s"), F.count("contrast").alias("_n"))
    joined = contrasts.join(sums, by) if by else contrasts.crossJoin(F.broadcast(sums))  # one row
    out = joined.withColumn("without", F.when(F.col("_n") > 1, F.try_divide(F.col("_s") - F.col("contrast"), F.col("_n") - 1)).otherwise(float("nan")))
    return out.select(*by, unit, "without", (F.col("without") - F.col("_s") / F.col("_n")).alias("shift"))


def hedges_gz(mean: Column, sd: Column, n: Column) -> Column:
    return mean / sd * (1 - 3 / (4 * n - 5))


def exact_sign_flips(contrasts: DataFrame, unit: str, *, most: int = 20) -> DataFrame:
    """Share of all sign assignments with a mean at least as large in size: 2**n rows of a sequence times n units.

    More than ``most`` units are refused. Without a unit there is the empty assignment alone, and no estimate."""
    n = contrasts.count()
    if n > most:
        raise ValueError(f"exact enumeration takes {most} units at most, there are {n}")
    if n == 0:
        return contrasts.sparkSession.createDataFrame([(None, None, 1)], "estimate double, p_value double, assignments long")
    values = contrasts.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), F.col("contrast").alias("c")))), lambda s: s["c"]).alias("c"))
    flips = values.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    total = F.aggregate(F.transform("c", lambda x, i: F.when(F.expr("k").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    own = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    return flips.agg((F.first(own) / n).alias("estimate"), F.avg((F.abs(total) >= F.abs(own) - 1e-12).cast("double")).alias("p_value"), F.count("*").alias("assignments"))


def interval(estimate: float, se: float, df: float, confidence: float = 0.95) -> tuple[float, float, float]:
    """(low, high, two-sided p) of a t estimate."""
    half = t_quantile(0.5 + confidence / 2, df) * se
    return estimate - half, estimate + half, t_two_sided(estimate / se, df) if se else float(estimate == 0)


def bootstrap_units(values: np.ndarray, *, draws: int = 2000, seed: int = 0, confidence: float = 0.95, method: str = "percentile") -> tuple[float, float]:
    """Interval of the mean by resampling units whole; ``percentile``, ``basic`` or ``bca``."""
    rng = np.random.default_rng(seed)
    n = len(values)
    means = values[rng.integers(0, n, (draws, n))].mean(axis=1)
    centre, tail = float(values.mean()), (1 - confidence) / 2
    if method == "bca":
        from statistics import NormalDist

        normal = NormalDist()
        share = min(max((means < centre).mean(), 1 / (2 * draws)), 1 - 1 / (2 * draws))
        z0 = normal.inv_cdf(float(share))
        jack = (values.sum() - values) / (n - 1)
        d = jack.mean() - jack
        a = float((d**3).sum() / (6 * ((d**2).sum() ** 1.5))) if d.any() else 0.0
        adjust = lambda q: normal.cdf(z0 + (z0 + normal.inv_cdf(q)) / (1 - a * (z0 + normal.inv_cdf(q))))
        low, high = np.quantile(means, [adjust(tail), adjust(1 - tail)])
    else:
        low, high = np.quantile(means, [tail, 1 - tail])
        if method == "basic":
            low, high = 2 * centre - high, 2 * centre - low
    return float(low), float(high)


def sign_flip_p(values: np.ndarray, *, resamples: int = 10_000, seed: int = 0, most: int = 16) -> float:
    """(1 + assignments as large) / (assignments + 1): all of them up to ``most`` units if they are few enough, else drawn."""
    n, observed = len(values), abs(float(values.mean())) - 1e-12
    if n <= most and 1 << n <= resamples:
        signs = 1 - 2 * ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1)
    else:
        signs = np.random.default_rng(seed).choice([-1, 1], (resamples, n))
    return float((1 + (np.abs(signs @ values / n) >= observed).sum()) / (len(signs) + 1))


def label_shuffle_p(a: np.ndarray, b: np.ndarray, *, resamples: int = 10_000, seed: int = 0) -> float:
    """Permutation of labels of independent units, enumerated when the combinations are few enough."""
    from math import comb

    pool, k = np.concatenate([a, b]), len(a)
    observed = abs(float(a.mean() - b.mean())) - 1e-12 * max(1.0, float(np.abs(pool).max()))
    total = pool.sum()
    if comb(len(pool), k) <= resamples:
        sums = np.array([pool[list(c)].sum() for c in combinations(range(len(pool)), k)])
    else:
        rng = np.random.default_rng(seed)
        sums = np.array([pool[rng.permutation(len(pool))[:k]].sum() for _ in range(resamples)])
    found = np.abs(sums / k - (total - sums) / (len(pool) - k)) >= observed
    return float((1 + found.sum()) / (len(sums) + 1))


def simultaneous_band(curves: np.ndarray, *, draws: int = 2000, seed: int = 0, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray, float]:
    """Estimate, standard error and the max-t critical value of unit curves (rows), which the t quantile bounds from below.

    Whole curves are resampled, never points."""
    n = len(curves)
    centre, se = curves.mean(axis=0), curves.std(axis=0, ddof=1) / np.sqrt(n)
    rng = np.random.default_rng(seed)
    top = np.empty(draws)
    for i in range(draws):
        pick = curves[rng.integers(0, n, n)]
        spread = pick.std(axis=0, ddof=1) / np.sqrt(n)
        top[i] = np.max(np.abs(pick.mean(axis=0) - centre) / np.where(spread > 0, spread, np.inf))
    return centre, se, max(float(np.quantile(top, confidence)), t_quantile(0.5 + confidence / 2, n - 1))


def recommend(n_units: int, *, assigned_to_unit: bool, randomized: bool, most: int = 20) -> str:
    """Which method a design calls for."""
    if assigned_to_unit:
        return "label_permutation" if randomized else "welch_t"
    if randomized:
        return "exact_sign_flip" if n_units <= most else "monte_carlo_sign_flip"
    return "paired_t"


def interaction(cells: DataFrame, assignments: DataFrame, *, unit: str, condition: str, group: str, conditions: tuple[str, str], groups: tuple[str, str], by: list[str] | None = None) -> DataFrame:
    """Difference between groups of the within-unit condition differences."""
    by = by or []
    level = lambda x: F.avg(F.when(F.col(condition) == x, F.col("mean")))
    differences = cells.groupBy(unit, *by).agg((level(conditions[0]) - level(conditions[1])).alias("mean")).where("mean is not null")
    return welch_t(differences.join(assignments, unit), factor=group, numerator=groups[0], denominator=groups[1], by=by)


def welch_power(animals: int, effects: tuple[float, ...], deviations: tuple[float, ...], *, alpha: float = 0.05) -> list[dict]:
    """Power of two groups of ``animals`` each for every effect and deviation, by the noncentral t."""
    from tracelight.kernels.student import noncentral_power

    if animals < 2 or min(deviations) <= 0:
        raise ValueError("two animals per group and positive deviations")
    return [{"effect": e, "deviation": s, "power": noncentral_power(abs(e) / s * (animals / 2) ** 0.5, 2 * animals - 2, alpha)} for e in effects for s in deviations]


def influence(cells: DataFrame, *, unit: str, factor: str, numerator: str, denominator: str) -> DataFrame:
    """Difference of level means (``mean``) of independent units without each unit in turn."""
    sums = cells.groupBy(factor).agg(F.sum("mean").alias("_s"), F.count("mean").alias("_n"))
    wide = sums.agg(*[F.max(F.when(F.col(factor) == level, F.col(c))).alias(f"{c}{i}") for i, level in enumerate((numerator, denominator)) for c in ("_s", "_n")])
    rows = cells.where(F.col(factor).isin(numerator, denominator)).crossJoin(F.broadcast(wide))  # one row
    own = [F.when(F.col(factor) == level, 1).otherwise(0) for level in (numerator, denominator)]
    a, b = ((F.col(f"_s{i}") - own[i] * F.col("mean")) / (F.col(f"_n{i}") - own[i]) for i in (0, 1))
    return rows.where((F.col("_n0") > 1) & (F.col("_n1") > 1)).select(unit, factor, (a - b).alias("without"), (a - b - (F.col("_s0") / F.col("_n0") - F.col("_s1") / F.col("_n1"))).alias("shift"))
