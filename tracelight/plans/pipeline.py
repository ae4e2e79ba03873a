"""Runs a declared pipeline: quality on raw recordings, preprocessing, event summaries, units, inference."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators import events as ev
from tracelight.operators import inference, qc, runs
from tracelight.plans.operations import apply_operation, violations
from tracelight.plans.specs import ASSUMPTIONS, PipelineSpec, canonical, fingerprint


def clock_facts(samples: DataFrame, keys) -> DataFrame:
    """Per recording ``session``, ``interval_cv`` and ``median_dt``."""
    timed = runs.intervals_of(samples, keys).groupBy(*keys).agg((F.stddev_pop("dt") / F.avg("dt")).alias("interval_cv"), F.percentile("dt", F.lit(0.5)).alias("median_dt"))
    return timed.select(F.concat_ws("/", *keys).alias("session"), "interval_cv", "median_dt")


def compatibility(spec: PipelineSpec, clocks: DataFrame, variables: set[str]) -> list[dict]:
    """Problems of a pipeline with the recordings' clocks and variables, by code and step; no value is looked at."""
    return [r.asDict() for r in violations(spec.preprocessing, clocks, frozenset(variables), spec.event_summary.variable).collect()]


class PrefixCache:
    """Preprocessed tables by the operations that made them, so that universes share common beginnings."""

    def __init__(self, samples: DataFrame, keys):
        self.keys, self.made, self.hits = list(keys), {(): samples}, 0

    def get(self, operations: tuple) -> DataFrame:
        if operations in self.made:
            self.hits += 1
            return self.made[operations]
        out = apply_operation(self.get(operations[:-1]), operations[-1], self.keys).persist()
        self.made[operations] = out
        return out

    def close(self) -> None:
        for steps, table in self.made.items():
            if steps:
                table.unpersist()


def plan(spec: PipelineSpec, n_units: int) -> dict:
    """The method a design calls for and the assumptions still to be acknowledged; executable when none is left."""
    method = inference.recommend(n_units, assigned_to_unit=spec.design.assigned_to_unit, randomized=spec.design.randomized)
    missing = [a for a in ASSUMPTIONS[method] if a not in spec.acknowledged]
    return {"method": method, "missing_assumptions": missing, "executable": not missing, "fingerprint": fingerprint(spec)}


def infer(cells: list[dict], spec: PipelineSpec, method: str, *, seed: int = 0) -> dict:
    """Estimate, interval and p from unit rows: ``contrast`` for paired designs, ``level`` and ``mean`` for others."""
    c = spec.design
    if method in ("welch_t", "label_permutation"):
        groups = defaultdict(list)
        for r in cells:
            groups[r["level"]].append(r["mean"])
        a, b = np.array(groups[c.numerator]), np.array(groups[c.denominator])
        if min(len(a), len(b)) < 2:
            raise ValueError("two units per level at least")
        estimate, se = float(a.mean() - b.mean()), float(np.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)))
        df = se**4 / ((a.var(ddof=1) / len(a)) ** 2 / (len(a) - 1) + (b.var(ddof=1) / len(b)) ** 2 / (len(b) - 1))
        low, high, p = inference.interval(estimate, se, df, c.confidence)
        if method == "label_permutation":
            p = inference.label_shuffle_p(a, b, seed=seed)
        return {"estimate": estimate, "se": se, "df": float(df), "low": low, "high": high, "p": p, "n": [len(a), len(b)]}
    values = np.array([r["contrast"] for r in cells])
    if len(values) < 2:
        raise ValueError("two units with both levels at least")
    estimate, se = float(values.mean()), float(values.std(ddof=1) / np.sqrt(len(values)))
    low, high, p = inference.interval(estimate, se, len(values) - 1, c.confidence)
    if method != "paired_t":
        p = inference.sign_flip_p(values, seed=seed)
        low, high = inference.bootstrap_units(values, seed=seed, confidence=c.confidence)
    return {"estimate": estimate, "se": se, "df": float(len(values) - 1), "low": low, "high": high, "p": p, "n": len(values)}


def run_pipeline(spec: PipelineSpec, samples: DataFrame, events: DataFrame, keys=("subject", "session"), *, cache: PrefixCache | None = None) -> dict:
    """The whole ledger of one run: quality, blocking, dispositions, coverage, units, plan and result.

    Quality is judged on the raw recordings. A blocked run keeps its ledger and has no result."""
    keys = list(keys)
    quality = qc.assess_signal_recording(samples, keys).select(*keys, "warnings").collect()
    blocking = sorted({w for r in quality for w in r["warnings"] if w in spec.quality_gate.blocking_warnings})
    ledger = {"fingerprint": fingerprint(spec), "spec": canonical(spec), "recordings": len(quality), "blocking": blocking}
    if blocking:
        return ledger | {"status": "blocked", "result": None}
    processed = (cache or PrefixCache(samples, keys)).get(tuple(spec.preprocessing))
    summary = ev.summarize_event_windows(processed, events, baseline=spec.event_summary.baseline, response=spec.event_summary.response, value=spec.event_summary.variable, keys=keys).persist()
    try:
        ledger["dispositions"] = {r["disposition"]: r["count"] for r in summary.groupBy("disposition").count().collect()}
        outcome = {"delta": "delta", "response": "response_mean", "baseline": "baseline_mean"}[spec.event_summary.statistic]
        c = spec.design
        if c.assigned_to_unit:
            cells = inference.unit_means(summary, units=[c.unit], factor=c.factor, outcome=outcome).select(c.unit, F.col(c.factor).alias("level"), "mean")
        else:
            cells = inference.nested_contrasts(summary, unit=c.unit, factor=c.factor, outcome=outcome, numerator=c.numerator, denominator=c.denominator, contrast_unit=c.contrast_unit)
        rows = [r.asDict() for r in cells.orderBy(c.unit).collect()]
    finally:
        summary.unpersist()
    ledger["units"] = rows
    ledger["plan"] = plan(spec, len(rows))
    if not ledger["plan"]["executable"]:
        return ledger | {"status": "planned", "result": None}
    return ledger | {"status": "success", "result": infer(rows, spec, ledger["plan"]["method"])}
