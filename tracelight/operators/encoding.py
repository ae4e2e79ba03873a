"""Event-kernel regression: sparse lagged design, one Gram per group, held-out ridge strength, jackknife bands."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("subject", "session")


def fir_design(samples: DataFrame, events: DataFrame, keys=KEYS, *, kernels: dict[str, tuple[int, int]], value: str = "signal") -> DataFrame:
    """Design cells (keys, idx, column, x): one per event, lag and sample of its recording; lags in samples, ends included.

    samples: an ``idx`` that counts the recording's regular samples; events: ``idx`` of their nearest sample and ``kind``.
    Cells outside the recording, and of samples without a response, are left out."""
    keys = list(keys)
    lags = None
    for kind, (a, b) in kernels.items():
        here = F.when(F.col("kind") == kind, F.sequence(F.lit(a), F.lit(b)))
        lags = here if lags is None else F.coalesce(lags, here)
    cells = events.withColumn("lag", F.explode(lags)).select(*keys, (F.col("idx") + F.col("lag")).alias("idx"), F.concat_ws(":", "kind", "lag").alias("column"))
    cells = cells.groupBy(*keys, "idx", "column").agg(F.count("*").cast("double").alias("x"))
    return cells.join(samples.where(F.col(value).isNotNull()).select(*keys, "idx"), [*keys, "idx"], "left_semi")


def raised_cosines(n_lags: int, functions: int) -> np.ndarray:
    """Overlapping raised cosines over the lags, each lag's row summing to one."""
    if functions < 2:
        raise ValueError("two functions at least")
    centres = np.linspace(0, n_lags - 1, functions)
    width = centres[1] - centres[0]
    phase = np.clip((np.arange(n_lags)[:, None] - centres) / width, -1, 1)
    basis = 0.5 * (1 + np.cos(np.pi * phase))
    return basis / basis.sum(axis=1, keepdims=True)


def progress_hats(progress, functions: int):
    """Piecewise-linear bumps over progress 0 to 1, as columns."""
    return [F.greatest(F.lit(0.0), 1 - F.abs(progress * (functions - 1) - k)) for k in range(functions)]


def grams(design: DataFrame, samples: DataFrame, keys=KEYS, *, group: str, value: str = "signal") -> DataFrame:
    """Normal equations per group as cells (group, a, b, s): products of columns, of columns with the response (``y``) and ones (``1``).

    A fold's Gram is the total less its groups', so cross-validation needs one pass over the data."""
    keys = list(keys)
    response = samples.where(F.col(value).isNotNull()).select(*keys, "idx", F.lit("y").alias("column"), F.col(value).alias("x"))
    ones = response.select(*keys, "idx", F.lit("1").alias("column"), F.lit(1.0).alias("x"))
    long = design.unionByName(response).unionByName(ones)
    # a sample's cells meet in one array: its products are made where it is, without joining rows to rows
    vectors = long.groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(F.struct("column", "x"))).alias("v"))
    pairs = vectors.select(*keys, F.explode(F.flatten(F.transform("v", lambda p: F.transform(F.filter("v", lambda q: q["column"] >= p["column"]), lambda q: F.struct(p["column"].alias("a"), q["column"].alias("b"), (p["x"] * q["x"]).alias("p")))))).alias("_c"))
    return pairs.groupBy(F.col(group).alias("group"), F.col("_c.a").alias("a"), F.col("_c.b").alias("b")).agg(F.sum("_c.p").alias("s"))


@dataclass(frozen=True)
class GroupGrams:
    columns: list[str]
    groups: list[str]
    tables: np.ndarray  # group, column, column; the last two columns are ones and the response

    @classmethod
    def collect(cls, cells: DataFrame) -> GroupGrams:
        """Of a size that the model and the number of groups bound, not the samples."""
        rows = cells.collect()
        names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
        columns = [c for c in names if c not in ("1", "y")] + ["1", "y"]
        groups = sorted({r["group"] for r in rows})
        at, g = {c: i for i, c in enumerate(columns)}, {x: i for i, x in enumerate(groups)}
        tables = np.zeros((len(groups), len(columns), len(columns)))
        for r in rows:
            i, j = at[r["a"]], at[r["b"]]
            tables[g[r["group"]], i, j] = tables[g[r["group"]], j, i] = r["s"]
        return cls(columns[:-2], groups, tables)


def fit_ridge(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of centred ridge from a Gram whose last two columns are ones and the response."""
    n = gram[-2, -2]
    means = gram[:-2, -2] / n
    y = gram[-1, -2] / n
    a = gram[:-2, :-2] - n * np.outer(means, means)
    b = gram[:-2, -1] - n * means * y
    coef = np.linalg.pinv(a + alpha * np.eye(len(a))) @ b
    return coef, float(y - means @ coef)


def r_squared(gram: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    """Of predictions on the data behind a Gram, by its sums alone."""
    full = np.concatenate([coef, [intercept]])
    residual = gram[-1, -1] - 2 * full @ gram[:-1, -1] + full @ gram[:-1, :-1] @ full
    total = gram[-1, -1] - gram[-1, -2] ** 2 / gram[-2, -2]
    return float(1 - residual / total)


def group_folds(sizes: dict[str, float], folds: int) -> list[list[str]]:
    """Groups dealt from the largest down to the fold with the least so far."""
    if not 2 <= folds <= len(sizes):
        raise ValueError("folds lie between 2 and the number of groups")
    out: list[list[str]] = [[] for _ in range(folds)]
    load = [0.0] * folds
    for name in sorted(sizes, key=lambda g: (-sizes[g], g)):
        k = load.index(min(load))
        out[k].append(name)
        load[k] += sizes[name]
    return out


def choose_alpha(grams_: GroupGrams, alphas: tuple[float, ...], folds: int) -> tuple[float, dict[float, float]]:
    """The strength with the best mean over folds of held-out groups' mean R squared; the smaller of equals."""
    total = grams_.tables.sum(axis=0)
    at = {g: i for i, g in enumerate(grams_.groups)}
    dealt = group_folds({g: grams_.tables[i, -2, -2] for g, i in at.items()}, folds)
    scores = {}
    for alpha in sorted(alphas):
        means = []
        for fold in dealt:
            held = [grams_.tables[at[g]] for g in fold]
            model = fit_ridge(total - sum(held), alpha)
            means.append(np.mean([r_squared(h, *model) for h in held]))
        scores[alpha] = float(np.mean(means))
    return max(scores, key=lambda a: (scores[a], -a)), scores


def jackknife(grams_: GroupGrams, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, and their standard errors by leaving each group out."""
    total = grams_.tables.sum(axis=0)
    coef, _ = fit_ridge(total, alpha)
    left = np.stack([fit_ridge(total - g, alpha)[0] for g in grams_.tables])
    n = len(left)
    return coef, np.sqrt((n - 1) / n * ((left - left.mean(axis=0)) ** 2).sum(axis=0))


def residual_metrics(rows: DataFrame, by: list[str], *, segment: list[str], order: str = "t_us", observed: str = "observed", predicted: str = "predicted") -> DataFrame:
    """R squared, rmse, mean size, lag-1 autocorrelation and Durbin-Watson of residuals; neighbours only within segments."""
    w = Window.partitionBy(*segment).orderBy(order)
    res = rows.withColumn("_r", F.col(observed) - F.col(predicted)).withColumn("_q", F.lag("_r").over(w))
    mean = res.groupBy(*by).agg(F.avg(observed).alias("_m"), F.avg("_r").alias("_rm"))
    joined = res.join(mean, by)
    out = joined.groupBy(*by).agg(
        F.count("*").alias("n"), (1 - F.sum(F.col("_r") ** 2) / F.nullif(F.sum((F.col(observed) - F.col("_m")) ** 2), F.lit(0.0))).alias("r2"), F.sqrt(F.avg(F.col("_r") ** 2)).alias("rmse"), F.avg(F.abs("_r")).alias("mae"),
        (F.sum(F.when(F.col("_q").isNotNull(), (F.col("_r") - F.col("_rm")) * (F.col("_q") - F.col("_rm")))) / F.nullif(F.sum((F.col("_r") - F.col("_rm")) ** 2), F.lit(0.0))).alias("lag1"),
        (F.sum((F.col("_r") - F.col("_q")) ** 2) / F.nullif(F.sum(F.col("_r") ** 2), F.lit(0.0))).alias("durbin_watson"),
    )
    return out


def submodel(grams_: GroupGrams, keep: list[str]) -> GroupGrams:
    """The Grams of a model with some of the columns: rows and columns are picked, no data is read again."""
    at = [grams_.columns.index(c) for c in keep] + [len(grams_.columns), len(grams_.columns) + 1]
    return GroupGrams(list(keep), grams_.groups, grams_.tables[:, at][:, :, at])


def held_out_scores(grams_: GroupGrams, alpha: float, folds: int) -> dict[str, float]:
    """R squared of each group under the model fitted without its fold."""
    total = grams_.tables.sum(axis=0)
    at = {g: i for i, g in enumerate(grams_.groups)}
    out = {}
    for fold in group_folds({g: grams_.tables[i, -2, -2] for g, i in at.items()}, folds):
        model = fit_ridge(total - sum(grams_.tables[at[g]] for g in fold), alpha)
        out |= {g: r_squared(grams_.tables[at[g]], *model) for g in fold}
    return out


def family_contributions(grams_: GroupGrams, families: dict[str, list[str]], *, alphas: tuple[float, ...] = (0.0, 0.1, 1.0, 10.0), folds: int = 5, confidence: float = 0.95) -> list[dict]:
    """What each family of columns adds to held-out R squared: paired differences over groups with a t interval.

    Both models choose their own strength; the folds are the same."""
    from tracelight.operators.inference import interval

    full = held_out_scores(grams_, choose_alpha(grams_, alphas, folds)[0], folds)
    out = []
    for family, columns in families.items():
        unknown = set(columns) - set(grams_.columns)
        if unknown or not columns:
            raise ValueError(f"family {family!r} names no or unknown columns {sorted(unknown)}")
        less = submodel(grams_, [c for c in grams_.columns if c not in columns])
        reduced = held_out_scores(less, choose_alpha(less, alphas, folds)[0], folds)
        gain = np.array([full[g] - reduced[g] for g in grams_.groups])
        se = float(gain.std(ddof=1) / np.sqrt(len(gain)))
        low, high, p = interval(float(gain.mean()), se, len(gain) - 1, confidence)
        out.append({"family": family, "gain": float(gain.mean()), "low": low, "high": high, "p": p, "groups": len(gain)})
    return out


def run_models(grams_: GroupGrams, models: dict[str, list[str]], *, alphas: tuple[float, ...] = (0.0, 0.1, 1.0, 10.0), folds: int = 5) -> list[dict]:
    """Named models over the same evidence: chosen strength and mean held-out R squared; a model that fails is kept with its reason."""
    out = []
    for name, columns in models.items():
        try:
            own = submodel(grams_, columns)
            alpha, scores = choose_alpha(own, alphas, folds)
            out.append({"model": name, "status": "success", "alpha": alpha, "score": scores[alpha], "reason": ""})
        except Exception as error:  # kept in the ledger
            out.append({"model": name, "status": "failed", "alpha": None, "score": None, "reason": f"{type(error).__name__}: {error}"[:300]})
    return out
