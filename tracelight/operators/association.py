"""Lagged association of channels, crosstalk, spatial networks, optical mixing and sensor kinetics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelight.functions import fisher_z
from tracelight.model import RECORDING
from tracelight.operators.runs import mark_runs


def lagged_association(samples: DataFrame, keys=RECORDING, *, first: str = "signal", second: str = "reference", max_lag: int, minimum_pairs: int = 10, gap_factor: float | None = 1.5, max_gap_s: float | None = None, covariate: str | None = None, partition: str | None = None) -> DataFrame:
    """Pooled correlation of the first value with the second ``lag`` samples later, for lags of either sign.

    Values are centred within runs; with a covariate, they are residuals of a line on it within the run. Pairs never
    cross a gap; lags with too few pairs have no correlation."""
    keys = list(keys)
    present = F.col(first).isNotNull() & F.col(second).isNotNull()
    if covariate:
        present = present & F.col(covariate).isNotNull()
    both = samples.withColumn("_both", F.when(present, F.lit(1.0)))
    marked = mark_runs(both, keys, value="_both", gap_factor=gap_factor, max_gap_s=max_gap_s, partition=partition)
    run = Window.partitionBy(*keys, "run_id")
    order = run.orderBy("t_us")
    for name, source in (("_x", first), ("_y", second)):
        value = F.col(source) - F.avg(source).over(run)
        if covariate:
            slope = F.coalesce(F.covar_pop(source, covariate).over(run) / F.nullif(F.var_pop(covariate).over(run), F.lit(0.0)), F.lit(0.0))
            value = value - slope * (F.col(covariate) - F.avg(covariate).over(run))
        marked = marked.withColumn(name, value)
    by = [*keys, *([partition] if partition else [])]
    lags = [F.struct(F.lit(k).alias("lag"), (F.lead("_y", k).over(order) if k >= 0 else F.lag("_y", -k).over(order)).alias("y")) for k in range(-max_lag, max_lag + 1)]
    pairs = marked.select(*by, "_x", F.array(*lags).alias("_ls")).select(*by, "_x", F.explode("_ls").alias("_l")).where(F.col("_l.y").isNotNull())
    x, y = F.col("_x"), F.col("_l.y")
    out = pairs.groupBy(*by, F.col("_l.lag").alias("lag")).agg((F.sum(x * y) / F.sqrt(F.nullif(F.sum(x * x) * F.sum(y * y), F.lit(0.0)))).alias("correlation"), F.count("*").alias("n_pairs"))
    return out.withColumn("correlation", F.when(F.col("n_pairs") >= minimum_pairs, F.col("correlation")))


def assess_crosstalk(lags: DataFrame, keys=RECORDING, *, interval_s: float, high: float = 0.8, near_zero_s: float = 0.1) -> DataFrame:
    """Flags from a lag curve: zero-lag size, and whether the largest size lies near lag zero."""
    size = F.round(F.abs("correlation"), 9)
    out = lags.where(F.col("correlation").isNotNull()).groupBy(*keys).agg(F.max(F.when(F.col("lag") == 0, F.col("correlation"))).alias("zero_lag"), F.max_by("lag", F.struct(size.alias("r"), (-F.abs("lag")).alias("d"), (-F.col("lag")).alias("k"))).alias("peak_lag"))
    return out.withColumn("high_zero_lag", F.coalesce(F.abs("zero_lag") >= high, F.lit(False))).withColumn("near_zero_peak", F.abs(F.col("peak_lag") * interval_s) <= near_zero_s)


def blocked_permutation(samples: DataFrame, keys=RECORDING, *, first: str = "signal", second: str = "reference", block: int, resamples: int = 1000, seed: int = 0, gap_factor: float | None = 1.5) -> DataFrame:
    """Zero-lag correlation against re-pairings of whole blocks: p = (1 + as large or larger) / (resamples + 1). One recording is one task's work."""
    keys = list(keys)
    both = samples.withColumn("_both", F.when(F.col(first).isNotNull() & F.col(second).isNotNull(), F.lit(1.0)))
    marked = mark_runs(both, keys, value="_both", gap_factor=gap_factor)
    schema = T.StructType([*[samples.schema[k] for k in keys], T.StructField("blocks", T.LongType()), T.StructField("zero_lag", T.DoubleType()), T.StructField("p_value", T.DoubleType())])

    def permute(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, ys = [], []
        for _, run in pdf.sort_values("t_us").groupby("run_id"):
            x, y = run[first].to_numpy(float), run[second].to_numpy(float)
            x, y = x - x.mean(), y - y.mean()
            for i in range(0, len(x) - block + 1, block):
                xs.append(x[i : i + block])
                ys.append(y[i : i + block])
        head = [pdf.iloc[0][k] for k in keys]
        if len(xs) < 2:
            return pd.DataFrame([[*head, len(xs), None, None]], columns=schema.fieldNames())
        x, y = np.stack(xs), np.stack(ys)
        scale = np.sqrt((x * x).sum() * (y * y).sum())
        cross = x @ y.T / (scale or 1.0)
        observed = float(np.trace(cross))
        rng = np.random.default_rng(seed)
        n = len(x)
        larger = sum(abs(cross[np.arange(n), rng.permutation(n)].sum()) >= abs(observed) - 1e-12 for _ in range(resamples))
        return pd.DataFrame([[*head, n, observed, (1 + larger) / (resamples + 1)]], columns=schema.fieldNames())

    return marked.groupBy(*keys).applyInPandas(permute, schema)


def spatial_edges(samples: DataFrame, sites: DataFrame, keys=("subject", "session"), *, minimum_support: int = 20, value: str = "signal") -> DataFrame:
    """Each two channels of a recording: zero-lag correlation over shared times, its Fisher z and their distance.

    samples are joined on time, so the cost is samples times channels, not samples squared."""
    keys = list(keys)
    kept = samples.where(F.col(value).isNotNull()).select(*keys, "t_us", "channel", F.col(value).alias("v"))
    other = kept.select(*keys, "t_us", F.col("channel").alias("channel_b"), F.col("v").alias("w"))
    pairs = kept.join(other, [*keys, "t_us"]).where("channel < channel_b")
    edges = pairs.groupBy(*keys, F.col("channel").alias("a"), F.col("channel_b").alias("b")).agg(F.corr("v", "w").alias("correlation"), F.count("*").alias("support"))
    edges = edges.where(F.col("support") >= minimum_support)
    for side in ("a", "b"):
        edges = edges.join(sites.select(F.col("channel").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("x", "y", "z")]), side)
    distance = F.sqrt(sum((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in ("x", "y", "z")))
    return edges.withColumn("distance", distance).withColumn("fisher_z", fisher_z(F.col("correlation"))).select(*keys, "a", "b", "correlation", "fisher_z", "support", "distance")


def distance_summaries(edges: DataFrame, keys=("subject", "session"), *, bins: list[tuple[str, float, float]]) -> DataFrame:
    """Edges in half-open distance bins: count and the mean correlation by way of Fisher z."""
    label = F.coalesce(*[F.when((F.col("distance") >= lo) & (F.col("distance") < hi), F.lit(name)) for name, lo, hi in bins])
    return edges.withColumn("bin", label).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("edges"), F.tanh(F.avg("fisher_z")).alias("mean_correlation"), F.avg("distance").alias("mean_distance"))


def kinetic_kernel(rise_s: float, decay_s: float, interval_s: float, *, length_s: float | None = None) -> np.ndarray:
    """Difference of exponentials sampled at the interval, of unit sum."""
    if not 0 < rise_s < decay_s:
        raise ValueError("the rise is shorter than the decay")
    t = np.arange(0, length_s if length_s is not None else 6 * decay_s, interval_s)
    k = np.exp(-t / decay_s) - np.exp(-t / rise_s)
    return k / k.sum()


def predict_sensor(samples: DataFrame, weights: np.ndarray, keys=RECORDING, *, value: str = "signal", gap_factor: float | None = 1.5, max_gap_s: float | None = None) -> DataFrame:
    """Causal convolution with the kernel inside each run, zero before its start."""
    marked = mark_runs(samples, keys, value=value, gap_factor=gap_factor, max_gap_s=max_gap_s)
    order = Window.partitionBy(*keys, "run_id").orderBy("t_us")
    recent = F.collect_list(value).over(order.rowsBetween(-(len(weights) - 1), 0))
    kernel = F.array(*[F.lit(float(w)) for w in weights])
    # the newest value is the last of the list
    predicted = F.aggregate(F.zip_with(F.reverse(recent), F.slice(kernel, 1, F.size(recent)), lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    return marked.withColumn("predicted", predicted)


def deconvolve(samples: DataFrame, weights: np.ndarray, keys=RECORDING, *, strength: float, order: int = 1, value: str = "signal", gap_factor: float | None = 1.5) -> DataFrame:
    """Tikhonov estimate of the kernel's input per run, with a constant baseline; differences of ``order`` are penalized.

    Runs shorter than two kernels are left out. One run is one task's work."""
    keys = list(keys)
    marked = mark_runs(samples, keys, value=value, gap_factor=gap_factor)
    schema = T.StructType([*[samples.schema[k] for k in keys], T.StructField("t_us", T.LongType()), T.StructField("latent", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_us")
        y = pdf[value].to_numpy(float)
        n = len(y)
        out = pdf[[*keys, "t_us"]].copy()
        if n < 2 * len(weights):
            out["latent"] = np.nan
            return out[schema.fieldNames()]

        def forward(x):
            return np.convolve(x[:-1], weights)[:n] + x[-1]

        def adjoint(r):
            return np.append(np.convolve(r[::-1], weights)[:n][::-1], r.sum())

        def penalty(x):
            d = np.diff(x[:-1], n=order) if order else x[:-1]
            for _ in range(order):
                d = np.concatenate([[-d[0]], d[:-1] - d[1:], [d[-1]]])
            return np.append(strength * d, 0.0)

        x = np.zeros(n + 1)
        r = adjoint(y)
        p, rs = r.copy(), float(r @ r)
        goal = rs * 1e-20
        for _ in range(4 * n):
            if rs <= goal:
                break
            ap = adjoint(forward(p)) + penalty(p)
            alpha = rs / float(p @ ap)
            x += alpha * p
            r -= alpha * ap
            new = float(r @ r)
            p = r + new / rs * p
            rs = new
        out["latent"] = x[:-1]
        return out[schema.fieldNames()]

    found = marked.select(*keys, "run_id", "t_us", value).groupBy(*keys, "run_id").applyInPandas(solve, schema)
    return found.withColumn("latent", F.nanvl("latent", F.lit(None).cast("double")))


def assess_mixing(matrix: np.ndarray, *, maximum_condition: float = 1000.0) -> dict:
    """Rank, condition and whether the design still has full rank with any one channel left out."""
    rank = int(np.linalg.matrix_rank(matrix))
    condition = float(np.linalg.cond(matrix)) if rank == matrix.shape[1] else float("inf")
    holdouts = [int(np.linalg.matrix_rank(np.delete(matrix, i, axis=0))) == matrix.shape[1] for i in range(len(matrix))]
    return {"rank": rank, "condition": condition, "identifiable": rank == matrix.shape[1] and condition <= maximum_condition, "solvable_without": holdouts}


def unmix(samples: DataFrame, matrix: dict[str, dict[str, float]], offsets: dict[str, float] | None = None, keys=("subject", "session"), *, value: str = "signal") -> DataFrame:
    """Least-squares components per time from the channels present, where those have full rank.

    Times are grouped by which channels they have; each pattern's pseudo-inverse is a small literal, so the solution is a weighted sum."""
    keys, channels = list(keys), sorted(matrix)
    components = sorted({c for row in matrix.values() for c in row})
    offsets = offsets or {}
    full = np.array([[matrix[ch].get(co, 0.0) for co in components] for ch in channels])
    weights, rows = {}, []
    for bits in range(1, 1 << len(channels)):
        have = [i for i in range(len(channels)) if bits >> i & 1]
        if np.linalg.matrix_rank(full[have]) == len(components):
            inverse = np.linalg.pinv(full[have])
            weights[bits] = True
            rows += [(bits, components[c], channels[i], float(inverse[c, j])) for c in range(len(components)) for j, i in enumerate(have)]
    spark = samples.sparkSession
    table = F.broadcast(spark.createDataFrame(rows, "pattern int, component string, channel string, weight double"))  # 2**channels * channels * components rows
    place = F.create_map(*[F.lit(x) for i, ch in enumerate(channels) for x in (ch, 1 << i)])
    shift = F.create_map(*[F.lit(x) for ch in channels for x in (ch, float(offsets.get(ch, 0.0)))])
    kept = samples.where(F.col("channel").isin(channels) & F.col(value).isNotNull()).select(*keys, "t_us", "channel", (F.col(value) - shift[F.col("channel")]).alias("v"))
    patterns = kept.groupBy(*keys, "t_us").agg(F.sum(place[F.col("channel")]).cast("int").alias("pattern"))
    out = kept.join(patterns, [*keys, "t_us"]).join(table, ["pattern", "channel"])
    return out.groupBy(*keys, "t_us", "pattern", "component").agg(F.sum(F.col("v") * F.col("weight")).alias("value"))


def kinetic_identifiability(weights: np.ndarray, runs_samples: list[int], interval_s: float, rise_s: float, *, strength: float = 0.0, minimum_per_rise: float = 3.0, minimum_ratio: float = 2.0, maximum_condition: float = 1e6) -> dict:
    """Whether a kernel can be undone on runs of these lengths, judged before outcomes: samples per rise, spectrum, runs."""
    gain = np.abs(np.fft.rfft(weights, 4 * len(weights)))
    power = gain**2 + strength
    ratios = [n / len(weights) for n in runs_samples]
    facts = {"samples_per_rise": rise_s / interval_s, "condition": float(power.max() / max(power.min(), 1e-300)), "eligible_runs": sum(r >= minimum_ratio for r in ratios), "runs": len(ratios)}
    problems = {"rise_undersampled": facts["samples_per_rise"] < minimum_per_rise, "ill_conditioned": facts["condition"] > maximum_condition, "no_run_long_enough": not facts["eligible_runs"]}
    return facts | {"problems": [k for k, v in problems.items() if v]}


def pair_hazards(first: dict, second: dict, *, minimum_nm: float = 20.0) -> list[str]:
    """Reasons in two channels' metadata to expect crosstalk: shared detector or fibre, wavelengths too near."""
    out = [f"shared_{k}" for k in ("detector", "fiber") if first.get(k) is not None and first.get(k) == second.get(k)]
    for k in ("excitation", "emission"):
        a, b = first.get(f"{k}_nm"), second.get(f"{k}_nm")
        if a is not None and b is not None and abs(a - b) < minimum_nm:
            out.append(f"{k}_too_near")
    return out


def node_permutation(edges: list[dict], *, resamples: int = 1000, seed: int = 0) -> tuple[float, float]:
    """Correlation of edge strength (``fisher_z``) with ``distance``, and its p value under shuffled sites.

    edges: all pairs (a, b) of one network; sites keep their places, strengths move with relabelled nodes."""
    nodes = sorted({e["a"] for e in edges} | {e["b"] for e in edges})
    at = {n: i for i, n in enumerate(nodes)}
    z, d = np.full((len(nodes),) * 2, np.nan), np.full((len(nodes),) * 2, np.nan)
    for e in edges:
        i, j = at[e["a"]], at[e["b"]]
        z[i, j] = z[j, i] = e["fisher_z"]
        d[i, j] = d[j, i] = e["distance"]

    def strength(order):
        x, y = z[np.ix_(order, order)][np.triu_indices(len(nodes), 1)], d[np.triu_indices(len(nodes), 1)]
        ok = ~np.isnan(x) & ~np.isnan(y)
        return float(np.corrcoef(x[ok], y[ok])[0, 1])

    observed = strength(np.arange(len(nodes)))
    rng = np.random.default_rng(seed)
    larger = sum(abs(strength(rng.permutation(len(nodes)))) >= abs(observed) - 1e-12 for _ in range(resamples))
    return observed, (1 + larger) / (resamples + 1)


def holdout_channels(samples: DataFrame, matrix: dict[str, dict[str, float]], offsets: dict[str, float] | None = None, keys=("subject", "session"), *, value: str = "signal") -> DataFrame:
    """Each channel predicted from the others at times that have all channels: correlation, rmse and samples."""
    keys, offsets = list(keys), offsets or {}
    whole = samples.where(F.col("channel").isin(list(matrix)) & F.col(value).isNotNull()).groupBy(*keys, "t_us").agg(F.count_distinct("channel").alias("_n")).where(F.col("_n") == len(matrix)).drop("_n")
    rows, out = samples.join(whole, [*keys, "t_us"], "left_semi"), None
    for held in sorted(matrix):
        rest = {c: m for c, m in matrix.items() if c != held}
        parts = unmix(rows, rest, offsets, keys, value=value)
        weight = F.create_map(*[F.lit(x) for co, w in matrix[held].items() for x in (co, float(w))])
        predicted = parts.groupBy(*keys, "t_us").agg((F.sum(F.col("value") * F.coalesce(weight[F.col("component")], F.lit(0.0))) + float(offsets.get(held, 0.0))).alias("predicted"))
        both = rows.where(F.col("channel") == held).select(*keys, "t_us", F.col(value).alias("observed")).join(predicted, [*keys, "t_us"])
        found = both.groupBy(*keys).agg(F.corr("observed", "predicted").alias("correlation"), F.sqrt(F.avg((F.col("observed") - F.col("predicted")) ** 2)).alias("rmse"), F.count("*").alias("n")).withColumn("held_out", F.lit(held))
        out = found if out is None else out.unionByName(found)
    return out
