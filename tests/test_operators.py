"""Operators on small recordings with known answers: gaps, boundaries, refusals."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelight import model
from tracelight.operators import association, encoding, events, inference, intervals, joins, multiscale, preprocess, qc, runs, spectral, transients
from tracelight.plans import multiverse
from tracelight.plans.pipeline import compatibility, run_pipeline
from tracelight.plans.operations import BaselineDFFOperation as BaselineDFF
from tracelight.plans.operations import LowpassFilterOperation as Lowpass
from tracelight.plans.operations import ReferenceDFFOperation as ReferenceDFF
from tracelight.plans.operations import ResampleOperation as Resample
from tracelight.plans.specs import Alternative, ContrastDesign, DecisionNode, EventSummarySpec, MultiverseSpec, PipelineSpec, QualityGateSpec
from tracelight.sources import evidence, photometry, tabular

KEYS = ("subject", "session")
S = 1_000_000


def recording(spark, t_s, signal, reference=None, subject="a", session="1"):
    reference = [None] * len(t_s) if reference is None else reference
    rows = [(subject, session, "green", int(round(t * S)), float(t), None if s is None or (isinstance(s, float) and math.isnan(s)) else float(s), None if r is None else float(r)) for t, s, r in zip(t_s, signal, reference)]
    return spark.createDataFrame(rows, model.SAMPLES)


def marks(spark, rows):
    return spark.createDataFrame([("a", "1", str(i), int(round(t * S)), c) for i, (t, c) in enumerate(rows)], model.EVENTS)


def spans(spark, rows):
    return spark.createDataFrame([("a", "1", str(i), label, int(a * S), int(b * S), c) for i, (label, a, b, c) in enumerate(rows)], model.INTERVALS)


def test_ingestion_makes_missing_null(spark):
    raw = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, float("inf")), (3, None)], "t long, x double")
    out = model.make_recording(raw, subject=F.lit("a"), session=F.lit("1"), time_us=F.col("t") * S, signals={"green": F.col("x")})
    assert [r["signal"] for r in out.orderBy("t_us").collect()] == [1.0, None, None, None]
    row = model.validate_recording(out).first()
    assert (row["n"], row["violations"], row["n_finite"], row["valid"]) == (4, 0, 1, True)
    twice = out.unionByName(out.where("t_us = 0"))
    assert not model.validate_recording(twice).first()["valid"]


def test_runs_break_at_gaps_missing_samples_and_states(spark):
    t = [0, 1, 2, 3, 10, 11, 12, 13]
    s = recording(spark, t, [1, 1, None, 1, 1, 1, 1, 1]).withColumn("state", F.when(F.col("t") >= 12, "b").otherwise("a"))
    table = runs.run_table(runs.mark_runs(s, KEYS, gap_factor=3.0, partition="state"), KEYS).orderBy("run_id").collect()
    assert [(r["start_us"] // S, r["stop_us"] // S, r["n"]) for r in table] == [(0, 1, 2), (3, 3, 1), (10, 11, 2), (12, 13, 2)]
    assert runs.analyzed_duration(runs.run_table(runs.mark_runs(s, KEYS, gap_factor=3.0), KEYS), KEYS).first()["duration_s"] == 4.0


def test_event_windows_are_half_open_and_need_every_sample(spark):
    s = recording(spark, range(12), [0, 1, 2, 3, 4, None, 6, 7, 8, 9, 10, 11])
    out = {r["event_id"]: r for r in events.summarize_event_windows(s, marks(spark, [(3, "x"), (5, "x"), (7, "x"), (8, "x"), (100, "x")]), baseline=(-2, 0), response=(0, 2), keys=KEYS).collect()}
    assert (out["0"]["baseline_mean"], out["0"]["response_mean"], out["0"]["disposition"]) == (1.5, 3.5, "complete")
    assert out["1"]["disposition"] == "event_inside_gap"
    assert out["2"]["disposition"] == "baseline_gap" and out["2"]["baseline_fraction"] == 0.5
    assert out["3"]["delta"] == 8.5 - 6.5
    assert out["4"]["disposition"] == "baseline_and_response_gap" and out["4"]["response_fraction"] == 0
    with pytest.raises(ValueError):
        events.summarize_event_windows(s, marks(spark, [(3, "x")]), baseline=(0, 0), response=(0, 1))


def test_alignment_never_bridges(spark):
    t = [0, 1, 2, 5, 6, 7]
    s = recording(spark, t, [0, 10, 20, 50, 60, 70])
    out = events.align_events(s, marks(spark, [(2, "x"), (50, "x")]), window=(-1, 4), rate=2, keys=KEYS, max_gap_s=1.5)
    rows = {(r["event_id"], r["rel_idx"]): r["value"] for r in out.collect()}
    assert len(rows) == 22 and rows["0", 1] == 15.0 and rows["0", 2] == 20.0 and rows["0", 8] == 50.0
    assert all(rows["0", k] is None for k in (3, 4, 5, 6, 7)) and all(rows["1", k] is None for k in range(11))


def test_nearest_prefers_the_earlier_sample(spark):
    s = recording(spark, [0, 2, 10], [1, 2, 3])
    out = {r["event_id"]: r["n_signal"] for r in joins.nearest(marks(spark, [(1, "x"), (1.2, "x"), (-5, "x"), (99, "x")]), s.select(*KEYS, "t_us", "signal"), carry=("signal",)).collect()}
    assert out == {"0": 1.0, "1": 2.0, "2": 1.0, "3": 3.0}


def test_range_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    points = [("a", "1", int(x)) for x in rng.integers(0, 1000, 80)]
    ranges = [("a", "1", i, int(x), int(x + w)) for i, (x, w) in enumerate(zip(rng.integers(0, 1000, 40), rng.integers(0, 300, 40)))]
    p, r = spark.createDataFrame(points, "subject string, session string, t_us long"), spark.createDataFrame(ranges, "subject string, session string, k long, start_us long, stop_us long")
    for closed in (False, True):
        got = sorted((x["k"], x["p_t_us"]) for x in joins.range_join(p, r, bucket_us=70, closed=closed).collect())
        assert got == sorted((k, t) for _, _, k, a, b in ranges for _, _, t in points if a <= t < b + closed)
    left = joins.range_join(p, r, bucket_us=70, how="left")
    assert {x["k"] for x in left.collect()} == set(range(40))


def test_resample_protects_gaps_and_crosses_missing(spark):
    s = recording(spark, [0, 1, 2, 6, 7], [0, None, 20, 60, 70])
    out = preprocess.resample(s, KEYS, rate_hz=2, values=("signal",), max_gap_s=2).orderBy("idx").collect()
    assert len(out) == 15 and out[1]["signal"] == 5.0 and out[2]["signal"] == 10.0
    assert [r["protected_gap"] for r in out[4:13]] == [False] + [True] * 7 + [False] and out[6]["signal"] is None
    assert out[0]["interpolated"] is False and out[1]["interpolated"] is True
    with pytest.raises(ValueError):
        preprocess.resample(s, KEYS, rate_hz=0)


def test_baselines(spark):
    t = np.arange(400) / 20
    ref = 1 + 0.04 * np.sin(t / 3)
    s = recording(spark, t, 2 + 0.5 * ref, ref)
    for method in ("ols", "irls"):
        assert max(abs(r["dff"]) for r in preprocess.reference_dff(s, KEYS, method=method).collect()) < 1e-9
    roll = preprocess.rolling_baseline(s, KEYS, window_samples=5).orderBy("t_us").collect()
    assert [r["baseline"] is None for r in roll[:3]] == [True, True, False] and [r["baseline"] is None for r in roll[-3:]] == [False, True, True]
    low = preprocess.lowpass(s, KEYS, cutoff_hz=5.0).collect()
    assert all(abs(r["signal"] - r["prefilter_signal"]) < 0.01 for r in low)
    fitted = preprocess.baseline_dff(s, KEYS, method="asls", smoothness=1e3).collect()
    assert max(abs(r["dff"]) for r in fitted) < 0.02
    jagged = recording(spark, np.cumsum(np.linspace(0.01, 0.2, 50)), np.ones(50))
    with pytest.raises(ValueError, match="regular clock"):
        preprocess.lowpass(jagged, KEYS, cutoff_hz=1.0)
    with pytest.raises(ValueError, match="regular clock"):
        preprocess.baseline_dff(jagged, KEYS, method="asls")
    two = recording(spark, [0, 1], [1, 2], [1, 2])
    assert preprocess.reference_fit(two, KEYS).first()["slope"] is None


def test_quality_flags(spark):
    s = recording(spark, [0, 1, 2, 3, 20, 21], [5, 5, None, 5, 9, 9])
    row = qc.assess_signal_recording(s, KEYS).first()
    assert row["large_gaps"] == 1 and row["longest_finite_run"] == 3 and row["flat_step_fraction"] == 0.75
    assert row["extreme_repeat_fraction"] == pytest.approx(3 / 5)
    assert set(row["warnings"]) == {"irregular_sampling", "large_gaps", "missing_samples", "repeated_extremes", "flat_steps"}


def test_derivative_lag_finds_a_delay(spark):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=400))
    s = recording(spark, np.arange(395), x[5:], x[3:-2])
    best = qc.best_lag(qc.derivative_lags(s, KEYS, max_lag=4), KEYS).first()
    assert abs(best["best_lag"]) == 2 and best["best_correlation"] > 0.99
    lags = association.lagged_association(s, KEYS, max_lag=4)
    assert abs(association.assess_crosstalk(lags, KEYS, interval_s=1.0).first()["peak_lag"]) == 2


def test_interval_operations(spark):
    table = spans(spark, [("walk", 0, 2, 0.9), ("walk", 3, 4, None), ("walk", 3.5, 6, 0.5), ("rest", 2, 3, 0.8), ("walk", 20, 21, 0.2)])
    merged = intervals.merge_intervals(table, maximum_gap_s=1).orderBy("label", "start_us").collect()
    assert [(r["label"], r["start_us"] // S, r["stop_us"] // S, r["confidence"], r["n_sources"]) for r in merged] == [("rest", 2, 3, 0.8, 1), ("walk", 0, 6, None, 3), ("walk", 20, 21, 0.2, 1)]
    kept = intervals.filter_intervals(table, minimum_s=1.5).where("reason is null")
    assert intervals.merge_intervals(kept, maximum_gap_s=1).count() == 2
    parts = intervals.split_intervals(table.where("interval_id = '2'"), maximum_s=1, cuts_us=(int(4.2 * S), int(6 * S))).orderBy("piece").collect()
    assert [round((r["stop_us"] - r["start_us"]) / S, 3) for r in parts] == [0.7, 1.0, 0.8]
    assert [r["interval_id"] for r in intervals.overlapping(table).collect()] == ["2"]
    trimmed = {(r["interval_id"], r["piece"]): (r["start_us"] / S, r["stop_us"] / S) for r in intervals.resolve_overlaps(table, ["rest", "walk"]).collect()}
    assert trimmed["1", 1] == (3, 4) and trimmed["2", 1] == (4, 6)
    context = intervals.contextualize(table.where("label = 'walk'"), spans(spark, [("bout", 1, 3.2, None), ("bout", 3.2, 9, None)]), template="{label}@{context}")
    assert sorted((r["interval_id"], r["label"]) for r in context.collect()) == [("0", "walk@bout"), ("1", "walk@bout"), ("1", "walk@bout"), ("2", "walk@bout"), ("4", "walk")]
    with pytest.raises(ValueError):
        intervals.contextualize(table, spans(spark, [("bout", 1, 3.2, None), ("bout", 3.2, 9, None)]), multiple="reject").collect()


def test_masks_annotations_and_progress(spark):
    s = recording(spark, range(10), range(10))
    kept = intervals.artifact_mask(s, spans(spark, [("p", 3, 4, None), ("p", 5, 5, None)]), pre_s=0, post_s=1).orderBy("t_us").collect()
    assert [r["kept"] for r in kept] == [True, True, True, False, False, False, False, True, True, True]
    rows = spark.createDataFrame([("a", "1", i, t * S, "walk", st) for i, (t, st) in enumerate([(0, "START"), (2, "STOP"), (3, "START"), (4, "START"), (5, "STOP"), (6, "STOP"), (7, "POINT"), (8, "START")])], "subject string, session string, row_id long, t_us long, label string, status string")
    got = sorted((r["kind"], r["start_us"] // S, r["error"] or "") for r in intervals.pair_start_stop(rows).collect())
    assert got == [("error", 3, "repeated_start"), ("error", 6, "stop_without_start"), ("error", 8, "open_start"), ("interval", 0, ""), ("interval", 4, ""), ("point", 7, "")]
    progress = intervals.normalized_progress(s.select(*KEYS, "t_us"), spans(spark, [("w", 2, 6, None)])).orderBy("p_t_us").collect()
    assert [r["progress"] for r in progress] == [0, 0.25, 0.5, 0.75, 1.0]
    rec = recording(spark, np.arange(0, 20, 0.5), [1.0 + 0.01 * (k % 3) if not 20 <= k < 24 else 9.0 for k in range(40)])
    out = intervals.recovery_times(rec, spans(spark, [("p", 10, 10, None)]), baseline_s=5, guard_s=0.1, assessment_s=5).first()
    assert out["recovery_s"] == 2.0 and out["peak_sd"] > 100 and not out["censored"]


def test_clock_fit_accepts_and_refuses(spark):
    rows = [("good", float(t), 3 + t * 1.00001) for t in range(20)] + [("bad", float(t), t + (0.5 if t == 7 else 0.0)) for t in range(20)]
    matches = spark.createDataFrame(rows, "clock string, source_t double, target_t double")
    fit = intervals.fit_clock(matches, maximum_residual_s=0.001, maximum_drift_ppm=50)
    assert {r["clock"]: r["accepted"] for r in fit.collect()} == {"good": True, "bad": False}
    asked = spark.createDataFrame([("good", 5.0), ("good", 30.0)], "clock string, source_t double")
    assert [r["target_t"] is None for r in intervals.transform_time(asked, fit, matches).orderBy("source_t").collect()] == [False, True]


def test_spectrum_of_a_known_sine(spark):
    t = np.arange(400) / 20
    x = np.sin(2 * np.pi * 2 * t)
    x[200] = np.nan
    s = recording(spark, t, x, np.sin(2 * np.pi * 2 * t + 0.5))
    windows = spectral.spectrogram(s, KEYS, rate_hz=20, window_s=4, overlap=0.5)
    assert windows.select("run_id", "window").distinct().count() == 7
    psd = spectral.welch_psd(windows, KEYS)
    assert psd.orderBy(F.desc("power")).first()["frequency_hz"] == 2.0
    assert spectral.band_power(psd, KEYS, low=1, high=3).first()["band_power"] == pytest.approx(0.5, rel=0.01)
    assert spectral.band_power(psd, KEYS, low=1, high=30).first()["band_power"] is None
    co = spectral.coherence(s, KEYS, rate_hz=20, window_s=4).where("frequency_hz = 2").first()
    assert co["coherence"] > 0.999 and co["phase_rad"] == pytest.approx(0.5, abs=0.01)
    with pytest.raises(ValueError, match="regular clock"):
        spectral.spectrogram(recording(spark, np.cumsum(np.linspace(0.01, 0.2, 50)), np.ones(50)), KEYS, rate_hz=20, window_s=1)


def test_autocorrelation_pairs_stay_in_runs(spark):
    x = np.sin(np.arange(40))
    x[20] = np.nan
    out = {r["lag"]: r for r in spectral.autocorrelation(recording(spark, range(40), x), KEYS, max_lag=2).collect()}
    assert out[0]["autocorrelation"] == pytest.approx(1) and out[1]["n_pairs"] == 37 and out[2]["n_pairs"] == 35


def test_gaussian_transient_has_its_width_and_area(spark):
    t = np.arange(0, 20, 0.02)
    x = np.exp(-((t - 10) ** 2) / (2 * 0.5**2)) + 1e-3 * np.sin(9 * t)
    out = transients.detect_transients(recording(spark, t, x), KEYS, mode="absolute", threshold=0.5, duration_s=2, gap_s=3, distance_s=1).collect()
    assert len(out) == 1 and out[0]["score"] == pytest.approx(1, abs=0.01) and out[0]["half_width_s"] == pytest.approx(2.3548 * 0.5, abs=0.02)
    assert transients.detect_prominence(recording(spark, t, x), KEYS, detrend_s=20).count() == 1
    assert transients.detect_amplitude(recording(spark, t, x), KEYS, amplitude=0.5, start_s=3, end_s=2).count() == 1
    wave = transients.cut_waveforms(recording(spark, t, x), transients.detect_amplitude(recording(spark, t, x), KEYS, amplitude=0.5, start_s=3, end_s=2), KEYS, pre_s=1, post_s=15).first()
    assert wave["codes"] == ["post_truncated"] and len(wave["waveform"]) == wave["n_samples"]


def test_multiscale_windows_weigh_time(spark):
    s = recording(spark, [0, 1, 3, 4, 5, 6], [0, 2, 2, 4, 4, 4])
    out = multiscale.summarize_multiscale(s, KEYS, windows=[("w", 4, 4)], gap_factor=5.0).orderBy("ordinal").collect()
    assert [(r["n"], r["coverage"], r["accepted"]) for r in out] == [(3, 1.0, True), (3, 0.5, False)]
    assert out[0]["time_weighted_mean"] == pytest.approx((1 + 4 + 3) / 4) and out[0]["sample_mean"] == pytest.approx(4 / 3)


def test_unmixing_and_sensor_kinetics(spark):
    rows = [("a", "1", "g", 0, 0.0, 1 * 1 + 2 * 0.5, None), ("a", "1", "r", 0, 0.0, 1 * 0.5 + 2 * 1, None), ("a", "1", "g", S, 1.0, 5.0, None)]
    out = {(r["t_us"], r["component"]): r["value"] for r in association.unmix(spark.createDataFrame(rows, model.SAMPLES), {"g": {"x": 1, "y": 0.5}, "r": {"x": 0.5, "y": 1}}).collect()}
    assert out == {(0, "x"): pytest.approx(1), (0, "y"): pytest.approx(2)}
    weights = association.kinetic_kernel(0.05, 0.3, 0.05, length_s=1.0)
    t = np.arange(200) * 0.05
    latent = np.where((np.arange(200) % 40) == 10, 1.0, 0.0)
    observed = np.convolve(latent, weights)[:200]
    pulse = recording(spark, t, latent)
    forward = association.predict_sensor(pulse, weights, KEYS).orderBy("t_us").collect()
    assert np.allclose([r["predicted"] for r in forward], observed)
    back = association.deconvolve(recording(spark, t, observed), weights, KEYS, strength=1e-6, order=0).orderBy("t_us").collect()
    assert np.corrcoef([r["latent"] for r in back][:180], latent[:180])[0, 1] > 0.95


def test_units_not_events_are_replicates(spark):
    rows = [(f"u{u}", c, float(u + (1.5 if c == "a" else 0) + 0.1 * k)) for u in range(5) for c in "ab" for k in range(2)]
    table = spark.createDataFrame(rows, "unit string, level string, y double")
    one = inference.paired_t(inference.nested_contrasts(table, unit="unit", factor="level", outcome="y", numerator="a", denominator="b")).first()
    two = inference.paired_t(inference.nested_contrasts(table.unionByName(table), unit="unit", factor="level", outcome="y", numerator="a", denominator="b")).first()
    assert one["estimate"] == pytest.approx(1.5) and (one["n"], one["se"]) == (two["n"], pytest.approx(two["se"]))
    many = spark.createDataFrame([(str(i), 1.0) for i in range(21)], "unit string, contrast double")
    with pytest.raises(ValueError):
        inference.exact_sign_flips(many, "unit")
    assert inference.exact_sign_flips(many.limit(3), "unit").first()["p_value"] == 0.25


def test_encoding_recovers_overlapping_kernels(spark):
    rng = np.random.default_rng(5)
    rows, evs = [], []
    for a in range(4):
        n = 300
        y = np.zeros(n)
        for kind, shape in (("cue", [1, 2, 1]), ("reward", [3, 0, -1])):
            for i in rng.choice(n - 5, 25, replace=False):
                evs.append((f"m{a}", "1", int(i), kind))
                y[i : i + 3] += shape
        rows += [(f"m{a}", "1", i, float(v + 0.5)) for i, v in enumerate(y)]
    samples = spark.createDataFrame(rows, "subject string, session string, idx long, signal double")
    design = encoding.fir_design(samples, spark.createDataFrame(evs, "subject string, session string, idx long, kind string"), kernels={"cue": (0, 2), "reward": (0, 2)})
    found = encoding.GroupGrams.collect(encoding.grams(design, samples, group="subject"))
    alpha, _ = encoding.choose_alpha(found, (0.0, 1.0, 100.0), 4)
    coef, se = encoding.jackknife(found, 0.0)
    got = dict(zip(found.columns, coef))
    assert alpha == 0.0 and [round(got[f"cue:{k}"], 6) for k in range(3)] == [1, 2, 1] and [round(got[f"reward:{k}"], 6) for k in range(3)] == [3, 0, -1]
    assert (se < 1e-6).all()


def study(spark):
    rows, evs = [], []
    for a in range(4):
        t = np.arange(280) / 20
        ref = 1 + 0.04 * np.sin(t / 3)
        y = 2 + 0.5 * ref
        for e, c in ((6, "drug"), (10, "drug"), (4, "control"), (8, "control")):
            evs.append((f"m{a}", "1", f"{c}{e}", e * S, c))
            if c == "drug":
                y = y + np.where((t >= e) & (t < e + 0.5), 0.06 + 0.005 * a, 0)
        rows += [(f"m{a}", "1", "green", int(round(x * S)), float(x), float(v), float(r)) for x, v, r in zip(t, y, ref)]
    return spark.createDataFrame(rows, model.SAMPLES), spark.createDataFrame(evs, model.EVENTS)


SPEC = PipelineSpec((ReferenceDFF("ols"),), QualityGateSpec(("large_gaps",)), EventSummarySpec((-0.5, 0), (0, 0.5)), ContrastDesign("condition", "drug", "control"), ("unit_contrasts_roughly_normal", "units_independent"))


def test_pipeline_plans_blocks_and_answers(spark):
    samples, evs = study(spark)
    ledger = run_pipeline(SPEC, samples, evs)
    assert ledger["status"] == "success" and ledger["result"]["n"] == 4 and ledger["result"]["low"] > 0 and ledger["dispositions"] == {"complete": 16}
    assert all(u["contrast"] > 0 for u in ledger["units"])
    assert run_pipeline(SPEC.replace(acknowledged=()), samples, evs)["status"] == "planned"
    holed = samples.where("t < 2 or t > 3")
    blocked = run_pipeline(SPEC, holed, evs)
    assert blocked["status"] == "blocked" and blocked["blocking"] == ["large_gaps"] and blocked["result"] is None


def test_compatibility_is_blind_to_outcomes(spark):
    clocks = spark.createDataFrame([("a/1", 0.2, 0.05)], "session string, interval_cv double, median_dt double")

    def codes(*ops, variables=("signal", "reference"), v="dff"):
        return [i["code"] for i in compatibility(SPEC.replace(preprocessing=ops, event_summary=SPEC.event_summary.replace(variable=v)), clocks, set(variables))]

    assert codes(ReferenceDFF()) == []
    assert codes(ReferenceDFF(), variables=("signal",)) == ["reference_channel_missing"]
    assert codes(Lowpass(11.0), ReferenceDFF()) == ["filter_above_nyquist"]
    assert codes(BaselineDFF("asls")) == ["asls_requires_regular_sampling"] and codes(Resample(20.0), BaselineDFF("asls")) == []
    assert codes(Resample(20.0, 1.0, 2.0), ReferenceDFF()) == ["ambiguous_resampling_gap_policy"]
    assert codes() == ["event_summary_variable_missing"]
    several = clocks.union(spark.createDataFrame([("a/2", 1e-9, 0.05), ("b/1", None, None)], clocks.schema))
    found = compatibility(SPEC.replace(preprocessing=(BaselineDFF("asls"),)), several, {"signal"})
    assert found == [{"code": "invalid_time_axis", "step": None, "recordings": 1, "session": "b/1"}, {"code": "asls_requires_regular_sampling", "step": 0, "recordings": 1, "session": "a/1"}]


def test_multiverse_keeps_failures_and_shares_prefixes(spark):
    samples, evs = study(spark)
    nodes = (
        DecisionNode("fit", (Alternative("ols", (("preprocessing", (ReferenceDFF("ols"),)),)), Alternative("broken", (("preprocessing", (ReferenceDFF("nope"),)),)), Alternative("fast", (("preprocessing", (Lowpass(50.0), ReferenceDFF("ols"))),)))),
        DecisionNode("window", (Alternative("short", (("event_summary", EventSummarySpec((-0.5, 0), (0, 0.5))),)), Alternative("long", (("event_summary", EventSummarySpec((-1, 0), (0, 1))),)))),
    )
    spec = MultiverseSpec(SPEC, nodes, ("ols", "short"), smallest_effect=0.001, direction="positive")
    out = multiverse.run_multiverse(spec, samples, evs)
    assert [u["status"] for u in out["universes"]] == ["success", "success", "failed", "failed", "incompatible", "incompatible"]
    s = out["summary"]
    assert (s["valid"], s["success"], s["failed"], s["positive"], s["practical"]) == (4, 2, 2, 0.5, 0.5) and s["reference"] == out["universes"][0]["estimate"] and out["shared_prefixes"] >= 1
    lane = multiverse.lanes(out["universes"], {"dff": {"units": "dF/F", "node": "fit", "alternatives": ["ols", "broken"]}})
    assert lane[0]["universes"] == 4 and lane[0]["positive"] == 0.5
    with pytest.raises(ValueError):
        multiverse.lanes(out["universes"], {"dff": {"units": "dF/F", "node": "fit", "alternatives": ["ols"]}})


def test_tabular_sources(spark, tmp_path):
    path = tmp_path / "rec.csv"
    path.write_text("time,gcamp,iso,other\n0,1.0,0.5,x\n50,NA,0.6,y\n100,inf,,z\n")
    columns = tabular.RecordingColumns("time", {"green": ("gcamp", "iso")}, unit="milliseconds")
    rows = tabular.load_recording(spark, str(path), columns, subject="a", session="1").orderBy("t_us").collect()
    assert [(r["t_us"], r["signal"], r["reference"]) for r in rows] == [(0, 1.0, 0.5), (50_000, None, 0.6), (100_000, None, None)]
    (tmp_path / "bad.csv").write_text("time,gcamp\n0,oops\n")
    with pytest.raises(Exception, match="not a number"):
        tabular.load_recording(spark, str(tmp_path / "bad.csv"), tabular.RecordingColumns("time", {"g": ("gcamp", None)}), subject="a", session="1").collect()
    with pytest.raises(ValueError):
        tabular.load_recording(spark, str(path), tabular.RecordingColumns("when", {"g": ("gcamp", None)}), subject="a", session="1")
    (tmp_path / "ev.tsv").write_text("t\tid\tgo\tn\n1.5\te1\tyes\t3\n2\te2\tnone\t\n")
    evs = tabular.load_events(spark, str(tmp_path / "ev.tsv"), tabular.EventColumns("t", "id", {"go": "bool", "n": "int"}), subject="a", session="1").orderBy("t_us").collect()
    assert [(r["t_us"], r["go"], r["n"]) for r in evs] == [(1_500_000, True, 3), (2_000_000, None, None)]
    assert tabular.detect_format("x.ppd") == "pyphotometry" and tabular.detect_format("x.csv", "a,b") == "tabular" and tabular.detect_format("x.csv", "Timestamp,LedState,Region0G") == "neurophotometrics"
    assert tabular.file_digests(spark, str(path)).first()["length"] == path.stat().st_size


def test_photometry_sources(spark, tmp_path):
    header = json.dumps({"sampling_rate": 100, "volts_per_division": [0.001, 0.001], "mode": "2 colour pulsed", "version": "1.1", "n_analog_signals": 1, "n_digital_signals": 1, "ADC_max_value": 1000}).encode()
    words = np.array([(500 << 1) | 1, 100 << 1, 990 << 1, 10 << 1], "<u2")
    (tmp_path / "a.ppd").write_bytes(len(header).to_bytes(2, "little") + header + words.tobytes())
    rows = photometry.load_frames(spark, str(tmp_path), analog=1, digital=1).orderBy("t_us").collect()
    assert [(r["t_us"], round(r["analog_1"], 6), r["clipped_1"], r["digital_1"]) for r in rows] == [(0, 0.4, False, True), (10_000, 0.98, True, False)]
    with pytest.raises(ValueError):
        photometry.parse_frames(b"\x05\x00{}")
    led = spark.createDataFrame([("a", "1", i * 10, [1, 2][i % 2], float(i)) for i in range(7)], "subject string, session string, t_us long, state int, roi double")
    out = photometry.demultiplex(led, state="state", signal_nm=470, reference_nm=415, rois=["roi"]).orderBy("t_us").collect()
    assert [(r["t_us"], r["signal"], r["reference"]) for r in out] == [(10, 1.0, 1.0), (30, 3.0, 3.0), (50, 5.0, 5.0)]
    frames = spark.createDataFrame([("a", "1", i, s) for i, s in enumerate([3, 3, 5, 5, 5, 3])], "subject string, session string, frame long, syllable int")
    assert sorted((r["label"], r["start_us"], r["stop_us"]) for r in photometry.bouts_from_syllables(frames, fps=10).collect()) == [("3", 0, 200_000), ("3", 500_000, 600_000), ("5", 200_000, 500_000)]
    text = "scorer,n,n,n\nbodyparts,nose,nose,nose\ncoords,x,y,likelihood\n0,1,2,0.9\n1,3,4,0.8\n"
    pose = photometry.pose_from_headers(text, keypoint="nose", fps=10)
    assert pose["x"].tolist() == [1, 3] and pose["t_us"].tolist() == [0, 100_000]
    with pytest.raises(ValueError):
        photometry.pose_from_headers(text, keypoint="tail", fps=10)
    with pytest.raises(RuntimeError):
        photometry.series_reader("nwb")


def test_evidence_bundles(tmp_path):
    bundle = tmp_path / "bundle"
    evidence.write_atomic(bundle / "analysis.json", evidence.to_json({"estimate": 1.0}))
    evidence.write_atomic(bundle / "report.html", evidence.render_html("t <x>", {"rows": [{"a": 1}], "none": []}).encode())
    evidence.write_manifest(bundle, "complete")
    one, two = evidence.create_archive(bundle, tmp_path / "one.zip"), evidence.create_archive(bundle, tmp_path / "two.zip")
    assert one == two and evidence.verify_archive(tmp_path / "one.zip")["status"] == "complete"
    (bundle / "analysis.json").write_text("{}")
    with pytest.raises(ValueError, match="changed"):
        evidence.read_bundle(bundle)
    assert "&lt;x&gt;" in (bundle / "report.html").read_text()
    diff = evidence.compare({"a": 1.0, "b": [1], "created_at": 1}, {"a": 1.01, "b": [1, 2], "c": 0, "created_at": 2})
    assert sorted(d["kind"] for d in diff) == ["length", "missing_left", "number"]
    assert evidence.compare({"a": 1.0}, {"a": 1.01}, relative=0.02) == []


def test_streaming_bins(spark, tmp_path):
    from tracelight.streaming import binned_rates

    rows = pd.DataFrame({"subject": ["a"] * 4, "ts": pd.to_datetime(["2024-01-01 00:01", "2024-01-01 00:09", "2024-01-01 00:11", "2024-01-01 03:00"]), "value": [1.0, 3.0, 5.0, 7.0]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("subject string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    run = binned_rates(stream).writeStream.format("memory").queryName("bins").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["n"], r["mean"]) for r in spark.table("bins").collect())
    assert (2, 2.0) in got and (1, 5.0) in got
