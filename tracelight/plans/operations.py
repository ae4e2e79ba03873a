"""Preprocessing operations, each in one place: parameters, what it needs of a recording, what it makes of it, how it runs.

What an operation needs and makes is stated on ``Facts`` of a recording, whose clock is in columns: so all
recordings are judged in one aggregate, and the same statements serve planning, compatibility and execution."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelight.operators import preprocess, runs
from tracelight.plans.spec_base import P, Spec, declare


@dataclass(frozen=True)
class Facts:
    """What is known of recordings ahead of a step: columns of their clocks, names of their variables."""

    regular: Column
    rate: Column
    variables: frozenset[str]


@dataclass(frozen=True)
class Behaviour:
    """needs: code -> when (parameters, facts) it is violated, a column or a truth value; makes: the facts after the step."""

    needs: dict[str, Callable[[Spec, Facts], Column | bool]]
    makes: Callable[[Spec, Facts], Facts]
    run: Callable[[Spec, DataFrame, list[str]], DataFrame]


BEHAVIOUR: dict[type[Spec], Behaviour] = {}


def _resample(op: Spec, samples: DataFrame, keys: list[str]) -> DataFrame:
    rate, gap = op.rate_hz, op.max_gap_s
    if rate == "median" or op.max_gap_factor is not None:
        middle = runs.clock_summary(samples, keys).agg(F.percentile("median_dt", F.lit(0.5))).first()[0]
        rate, gap = (1 / middle if rate == "median" else rate), (gap if op.max_gap_factor is None else op.max_gap_factor * middle)
    return preprocess.resample(samples, keys, rate_hz=rate, max_gap_s=gap).withColumn("t", F.col("t_us") / 1e6)


def _lowpass(op: Spec, samples: DataFrame, keys: list[str]) -> DataFrame:
    for v in op.variables:
        samples = preprocess.lowpass(samples, keys, cutoff_hz=op.cutoff_hz, order=op.order, value=v).drop(f"prefilter_{v}")
    return samples


def _baseline(op: Spec, samples: DataFrame, keys: list[str]) -> DataFrame:
    if op.method == "rolling_mean":
        middle = runs.clock_summary(samples, keys, value=op.variable).agg(F.percentile("median_dt", F.lit(0.5))).first()[0]
        options = {"window_samples": max(1, round(op.rolling_window_s / middle)), "gap_factor": op.rolling_gap_factor}
    elif op.method == "asls":
        options = {"smoothness": op.asls_smoothness, "asymmetry": op.asls_asymmetry, "iterations": op.max_iterations, "reference_rate_hz": op.asls_reference_rate_hz}
    else:
        options = {"min_tau_s": op.min_tau_s}
    out = preprocess.baseline_dff(samples, keys, method=op.method, value=op.variable, normalization=op.normalization, **options)
    return out if op.normalization == "divide" else out.withColumnRenamed("dff", "baseline_subtracted")


def _resampled(op: Spec, facts: Facts) -> Facts:
    return replace(facts, regular=F.lit(True), rate=facts.rate if op.rate_hz == "median" else F.lit(float(op.rate_hz)))


ResampleOperation = declare("ResampleOperation", rate_hz=P(), max_gap_s=P(None), max_gap_factor=P(None))
LowpassFilterOperation = declare("LowpassFilterOperation", cutoff_hz=P(above=0), order=P(4, least=1), variables=P(("signal", "reference")))
ReferenceDFFOperation = declare("ReferenceDFFOperation", method=P("irls"), max_iterations=P(50, least=1, only=True), tolerance=P(1e-8, above=0, only=True))
BaselineDFFOperation = declare(
    "BaselineDFFOperation", method=P(), normalization=P("divide", among=("divide", "subtract")), variable=P("signal"), min_tau_s=P(5.0, above=0), asls_smoothness=P(1e8, above=0), asls_asymmetry=P(0.01, above=0, below=1),
    max_iterations=P(20, least=1), asls_reference_rate_hz=P(20.0, above=0), rolling_window_s=P(60.0, above=0), rolling_gap_factor=P(1.5, above=1),
)

BEHAVIOUR[ResampleOperation] = Behaviour(
    needs={
        "invalid_resampling_rate": lambda op, _: op.rate_hz != "median" and op.rate_hz <= 0,
        "invalid_resampling_gap": lambda op, _: op.max_gap_s is not None and op.max_gap_s <= 0,
        "invalid_resampling_gap_factor": lambda op, _: op.max_gap_factor is not None and op.max_gap_factor <= 1,
        "ambiguous_resampling_gap_policy": lambda op, _: None not in (op.max_gap_s, op.max_gap_factor),
    },
    makes=_resampled,
    run=_resample,
)
BEHAVIOUR[LowpassFilterOperation] = Behaviour(needs={"filter_above_nyquist": lambda op, facts: facts.rate <= 2 * op.cutoff_hz}, makes=lambda op, facts: facts, run=_lowpass)
BEHAVIOUR[ReferenceDFFOperation] = Behaviour(
    needs={"reference_channel_missing": lambda op, facts: "reference" not in facts.variables},
    makes=lambda op, facts: replace(facts, variables=facts.variables | {"dff"}),
    run=lambda op, samples, keys: preprocess.reference_dff(samples, keys, method=op.method),
)
BEHAVIOUR[BaselineDFFOperation] = Behaviour(
    needs={
        "baseline_variable_missing": lambda op, facts: op.variable not in facts.variables,
        "asls_requires_regular_sampling": lambda op, facts: ~facts.regular if op.method == "asls" else False,
    },
    makes=lambda op, facts: replace(facts, variables=facts.variables | {"dff" if op.normalization == "divide" else "baseline_subtracted"}),
    run=_baseline,
)


def apply_operation(samples: DataFrame, op: Spec, keys) -> DataFrame:
    return BEHAVIOUR[type(op)].run(op, samples, list(keys))


def violations(operations: tuple[Spec, ...], clocks: DataFrame, variables: frozenset[str], wanted: str) -> DataFrame:
    """``code``, ``step`` (null: none), ``recordings`` and the smallest ``session`` with the problem; no problem, no rows.

    clocks: per recording ``session``, ``interval_cv``, ``median_dt``. A recording without a clock has that problem alone."""
    timed = F.col("interval_cv").isNotNull() & (F.coalesce(F.col("median_dt"), F.lit(0.0)) > 0)
    facts = Facts(F.col("interval_cv") <= 1e-6, 1 / F.col("median_dt"), variables)
    found = [(~timed, "invalid_time_axis", None)]
    for step, op in enumerate(operations):
        behaviour = BEHAVIOUR[type(op)]
        judged = {code: violated(op, facts) for code, violated in behaviour.needs.items()}
        found += [(timed & (v if isinstance(v, Column) else F.lit(bool(v))), code, step) for code, v in judged.items()]
        if not any(v is True for v in judged.values()):  # parameters that contradict themselves make nothing
            facts = behaviour.makes(op, facts)
        elif type(op) in (ReferenceDFFOperation, BaselineDFFOperation):
            facts = replace(facts, variables=behaviour.makes(op, facts).variables)  # one missing input is one problem
    found.append((timed & F.lit(wanted not in facts.variables), "event_summary_variable_missing", None))
    cases = [F.when(when, F.struct(F.lit(at).alias("at"), F.lit(code).alias("code"), F.lit(step).cast("int").alias("step"))) for at, (when, code, step) in enumerate(found)]
    rows = clocks.select("session", F.explode(F.array_compact(F.array(*cases))).alias("_p"))
    return rows.groupBy("_p.at", "_p.code", "_p.step").agg(F.count("*").alias("recordings"), F.min("session").alias("session")).orderBy("at").drop("at")
