"""The declared kinds of specifications, by subject. Defaults are contractual; ``to`` names the operator's argument."""

from __future__ import annotations

import math

from tracelight.operators import association, encoding, inference, intervals, multiscale, population, qc, spectral, transients
from tracelight.plans.operations import BaselineDFFOperation, LowpassFilterOperation, ReferenceDFFOperation, ResampleOperation, apply_operation
from tracelight.plans.spec_base import SPECS, P, Spec, declare, from_dict

__all__ = ["SPECS", "Spec", "P", "declare", "from_dict", "BaselineDFFOperation", "LowpassFilterOperation", "ReferenceDFFOperation", "ResampleOperation"]

SCHEMA = {"schema_version": P("1")}
CONFIDENCE, DRAWS, SEED = P(0.95, above=0, below=1), P(10_000, least=1), P(0, least=0, to="seed")
SHARE = {"least": 0, "most": 1}

#: Assumptions each method asks a reader to acknowledge before outcomes are used.
ASSUMPTIONS = {
    "paired_t": ("unit_contrasts_roughly_normal", "units_independent"),
    "welch_t": ("unit_means_roughly_normal", "units_independent"),
    "exact_sign_flip": ("within_unit_exchangeability",),
    "monte_carlo_sign_flip": ("within_unit_exchangeability",),
    "label_permutation": ("units_exchangeable_under_randomization",),
}


def canonical(spec: Spec) -> str:
    return spec.canonical()


def fingerprint(spec: Spec) -> str:
    return spec.fingerprint()


def with_changes(spec: Spec, changes) -> Spec:
    return spec.replace(**dict(changes))


def _window(name: str):
    return f"{name} does not begin before it ends", lambda s: getattr(s, name)[0] < getattr(s, name)[1]


# -- pipelines, designs and studies

EventSummarySpec = declare("EventSummarySpec", rules=(_window("baseline"), _window("response")), baseline=P(to="baseline"), response=P(to="response"), channel=P(None), statistic=P("delta", among=("delta", "response", "baseline")), variable=P("dff", to="value"), output_column=P("outcome"))
QualityGateSpec = declare("QualityGateSpec", blocking_warnings=P(()), scope=P("selected_channel", among=("selected_channel",)))
Estimand = declare("Estimand", outcome=P(), contrast=P(), aggregation_unit=P(), contrast_unit=P(None))
ResamplingPlan = declare("ResamplingPlan", resample_units=P(kind=tuple), strata=P(()))
PermutationPlan = declare("PermutationPlan", mode=P(among=("sign_flip", "shuffle")), exchangeability_unit=P(), within=P(()))
StudyDesign = declare("StudyDesign", lambda s, table: qc.validate_design(table, observation=s.observation_id, nesting=dict(s.units), factors=dict(s.factors)), observation_id=P(), units=P(), factors=P(()), **SCHEMA)
#: A condition contrast between the means of units; ``contrast_unit`` nests it, ``assigned_to_unit`` compares units.
ContrastDesign = declare("ContrastDesign", factor=P(), numerator=P(), denominator=P(), unit=P("subject"), contrast_unit=P(None), assigned_to_unit=P(False), randomized=P(False), confidence=CONFIDENCE)
PipelineSpec = declare("PipelineSpec", preprocessing=P(), quality_gate=P(kind=QualityGateSpec), event_summary=P(kind=EventSummarySpec), design=P(kind=ContrastDesign), acknowledged=P(()), schema_version=P("2"))
Preprocessing = declare("Preprocessing", label=P(), operations=P(kind=tuple), output_variable=P("dff"), units=P("dF/F"))
Alternative = declare("Alternative", label=P(), changes=P())
DecisionNode = declare("DecisionNode", name=P(), alternatives=P(kind=tuple))
MultiverseSpec = declare("MultiverseSpec", base_pipeline=P(kind=PipelineSpec), decision_nodes=P(kind=tuple), reference_selection=P(kind=tuple), compatibility_rules=P(()), intent=P("exploratory", among=("confirmatory", "exploratory", "descriptive")), smallest_effect=P(None, least=0), direction=P("either", among=("either", "positive", "negative")), leave_one_unit_out=P(False), **SCHEMA)
#: A choice of preprocessing that carries the windows and the variable it is summarized by.
PreprocessingOutcomeSpec = declare("PreprocessingOutcomeSpec", preprocessing=P(kind=tuple), event_summary=P(kind=EventSummarySpec))
ProjectMultiverseConfig = declare("ProjectMultiverseConfig", preprocessing=P(kind=tuple), response_windows=P(kind=tuple), reference_preprocessing=P(), reference_response_window=P(), intent=P(among=("confirmatory", "exploratory", "descriptive")), smallest_effect=P(None, least=0), direction=P("either", among=("either", "positive", "negative")), leave_one_animal_out=P(False), effect_thresholds=P(()), compatibility_rules=P(()), **SCHEMA)


def _preprocess(s: Spec, samples, keys=("subject", "session")):
    for op in s.operations:
        samples = apply_operation(samples, op, keys)
    return samples


Preprocessing.OPERATOR = _preprocess

_STUDY = {
    "title": P(), "numerator": P(), "denominator": P(), "factor_name": P("condition"), "channel": P(), "preprocessing_kind": P("reference", among=("reference", "baseline")), "preprocessing_method": P("irls"),
    "factor_assignment_unit": P("event", among=("event", "session", "subject")), "normalization": P("divide", among=("divide", "subtract")), "rolling_window_s": P(60.0, above=0), "resample_rate_hz": P(None, above=0),
    "resample_max_gap_factor": P(None, above=1), "baseline": P((-0.5, 0.0)), "response": P((0.0, 0.5)), "statistic": P("delta"), "randomized": P(False), "intent": P("exploratory", among=("confirmatory", "exploratory", "descriptive")),
    "acknowledged_assumptions": P(()), "blocking_warnings": P(()), "scalar_mixed_model": P(False, only=True), "contrast_unit": P(None), "timecourse": P(None), **SCHEMA,
}
EventAnalysisConfig = declare("EventAnalysisConfig", rules=(("the factor's two levels are one", lambda s: s.numerator != s.denominator), _window("baseline"), _window("response")), **_STUDY)


def pipeline_of(config: Spec) -> Spec:
    """The pipeline that a study's configuration declares."""
    steps = [ResampleOperation(config.resample_rate_hz, max_gap_factor=config.resample_max_gap_factor)] if config.resample_rate_hz else []
    variable = "dff"
    if config.preprocessing_kind == "reference":
        steps.append(ReferenceDFFOperation(config.preprocessing_method))
    else:
        steps.append(BaselineDFFOperation(config.preprocessing_method, normalization=config.normalization, rolling_window_s=config.rolling_window_s))
        variable = "dff" if config.normalization == "divide" else "baseline_subtracted"
    design = ContrastDesign(config.factor_name, config.numerator, config.denominator, contrast_unit=config.contrast_unit, assigned_to_unit=config.factor_assignment_unit == "subject", randomized=config.randomized)
    return PipelineSpec(tuple(steps), QualityGateSpec(config.blocking_warnings), EventSummarySpec(config.baseline, config.response, config.channel, config.statistic, variable), design, config.acknowledged_assumptions)


def _study(s: Spec, samples, events, keys=("subject", "session")):
    from tracelight.plans.pipeline import run_pipeline

    return run_pipeline(pipeline_of(s), samples, events, keys)


EventAnalysisConfig.OPERATOR = _study
#: A study over tables in hand; the configuration is its declaration and ``run`` takes samples and events.
EventAnalysis = declare("EventAnalysis", _study, EventAnalysisConfig.RULES, **_STUDY)

# -- sources

_MAPPED = {"channels": P(), "digital_events": P(()), **SCHEMA}
TDTBlockSchema = declare("TDTBlockSchema", channels=P(), events=P(()), **SCHEMA)
DoricSchema = declare("DoricSchema", **_MAPPED)
PyPhotometrySchema = declare("PyPhotometrySchema", **_MAPPED)
NeurophotometricsSchema = declare("NeurophotometricsSchema", channels=P(), digital_events=P(()), timestamp_column=P(None), led_state_column=P(None), time_unit=P("seconds", among=("seconds", "milliseconds")), drop_first_row=P(False), **SCHEMA)
TDTProjectConfig = declare("TDTProjectConfig", source_path=P(), source_sha256=P(), output_directory=P(), sources=P(kind=tuple), tdt_schema=P(kind=TDTBlockSchema), analysis=P(kind=EventAnalysisConfig), metadata=P(()), nwb=P(None, only=True), multiverse=P(None), **SCHEMA)

# -- spectra

GapHandlingSpec = declare("GapHandlingSpec", gap_factor=P(1.5, above=1, to="gap_factor"), maximum_interval_cv=P(0.01, least=0), minimum_run_samples=P(2, least=1))
GAP = P(GapHandlingSpec(), kind=GapHandlingSpec)


def _spectrum(s: Spec, samples, keys=("subject", "session", "channel"), *, rate_hz: float, **more):
    """Power per window; ``spectral.welch_psd`` averages it."""
    found = spectral.spectrogram(samples, keys, rate_hz=rate_hz, window_s=s.window_duration_s, overlap=s.overlap_fraction, detrend=s.detrend, **more)
    return found if s.maximum_frequency_hz is None else found.where(found["frequency_hz"] <= s.maximum_frequency_hz)


SpectralAnalysisSpec = declare("SpectralAnalysisSpec", _spectrum, window_duration_s=P(10.0, above=0), overlap_fraction=P(0.5, least=0, below=1), window=P("hann", among=("hann",)), detrend=P("constant", among=("constant", "linear", "none")), maximum_frequency_hz=P(None, above=0), gap=GAP)
AutocorrelationSpec = declare("AutocorrelationSpec", "spectral:autocorrelation", maximum_lag_s=P(10.0, above=0, to="max_lag", samples=True), detrend=P("constant", among=("constant",)), gap=GAP)
StateEpoch = declare("StateEpoch", rules=(("the epoch is empty", lambda s: s.start_s < s.stop_s),), state=P(kind=str), start_s=P(kind=(int, float)), stop_s=P(kind=(int, float)), epoch_id=P(""))


def epochs(spark, found: list[Spec], **keys):
    """State epochs of one recording (its ``keys`` by name) as rows of the intervals table."""
    rows = [(*keys.values(), e.epoch_id or f"epoch-{k}", e.state, round(e.start_s * 1e6), round(e.stop_s * 1e6), None) for k, e in enumerate(found)]
    return spark.createDataFrame(rows, ", ".join([*(f"{k} string" for k in keys), "interval_id string, label string, start_us long, stop_us long, confidence double"]))


def _animals(s: Spec, estimates, **more):
    scale = s.values.get("effect_scale", "difference")
    return population.infer_animals(estimates, a=s.condition_a, b=s.condition_b, design=s.values.get("design", "paired"), scale=scale, draws=s.bootstrap_resamples, seed=s.seed, **more)


_ANIMALS = {"confidence_level": P(0.95, only=True), "bootstrap_resamples": DRAWS, "permutation_resamples": DRAWS, "seed": SEED}
_LEVELS = ("the two conditions are one", lambda s: s.condition_a != s.condition_b)
_DESIGN, _SCALE, _HOW = P("independent", among=("independent", "paired")), P("difference", among=("difference", "ratio")), P("median", among=("median", "mean"))
StateBandPowerInferenceSpec = declare("StateBandPowerInferenceSpec", lambda s, estimates, **more: population.infer_animals(estimates, a=s.state_a, b=s.state_b, scale=s.effect_scale, draws=s.bootstrap_resamples, seed=s.seed, **more), (("the two states are one", lambda s: s.state_a != s.state_b), _window("frequency_band_hz")), state_a=P(), state_b=P(), frequency_band_hz=P(kind=tuple), effect_scale=_SCALE, **_ANIMALS)

# -- transients

_GAP3 = P(3.0, above=1, to="gap_factor")
TransientDetectionSpec = declare(
    "TransientDetectionSpec", "transients:detect_transients", threshold_mode=P("rolling_mad", among=("absolute", "global_mad", "rolling_mad"), to="mode"), threshold=P(3.0, above=0, to="threshold"), baseline_duration_s=P(0.9, above=0, to="duration_s"), baseline_gap_s=P(0.1, least=0, to="gap_s"),
    baseline_statistic=P("median", among=("mean", "median", "minimum"), to="statistic"), noise_window_s=P(15.0, above=0, to="noise_s"), minimum_distance_s=P(0.2, least=0, to="distance_s"), maximum_gap_factor=_GAP3, require_complete_shape=P(True), bin_width_s=P(30.0, above=0),
)
_BEFORE = {"baseline_start_s": P(1.0, above=0, to="start_s"), "baseline_end_s": P(0.2, least=0, to="end_s")}
_BEFORE_RULE = ("the baseline does not start before it ends", lambda s: s.baseline_start_s > s.baseline_end_s)
PastaTransientDetectorSpec = declare("PastaTransientDetectorSpec", "transients:detect_amplitude", (_BEFORE_RULE,), amplitude_threshold=P(above=0, to="amplitude"), baseline_method=P("mean", among=("mean", "minimum"), to="baseline"), **_BEFORE, minimum_distance_s=P(0.0, least=0, to="distance_s"), maximum_gap_factor=_GAP3, family=P("pasta", only=True))
GuppyTransientDetectorSpec = declare("GuppyTransientDetectorSpec", "transients:detect_chunked", chunk_duration_s=P(10.0, above=0, to="chunk", samples=True), high_amplitude_mad=P(4.0, above=0, to="high_mad"), detection_mad=P(3.0, above=0, to="detection_mad"), maximum_gap_factor=_GAP3, family=P("guppy", only=True))
ProminenceTransientDetectorSpec = declare("ProminenceTransientDetectorSpec", "transients:detect_prominence", minimum_height_z=P(1.0, to="height_z"), minimum_prominence_z=P(2.0, above=0, to="prominence_z"), minimum_distance_s=P(0.25, least=0, to="distance_s"), detrend_window_s=P(100.0, above=0, to="detrend_s"), maximum_gap_factor=_GAP3, family=P("prominence", only=True))
TransientThresholdCalibrationSpec = declare("TransientThresholdCalibrationSpec", "transients:calibrate_threshold", estimator=P("median_mad", among=("median_mad", "empirical_quantile"), to="estimator"), mad_multiplier=P(6.0, above=0, to="multiplier"), quantile=P(0.999, above=0, below=1, to="quantile"), minimum_score_count=P(20, least=2, to="minimum"))
TransientQuantificationSpec = declare("TransientQuantificationSpec", "transients:quantify", (_BEFORE_RULE,), baseline_method=P("mean", among=("mean", "minimum")), **_BEFORE, maximum_gap_factor=_GAP3, require_complete_shape=P(True), compound_window_s=P(2.0, least=0, to="compound_window_s"), bin_width_s=P(30.0, above=0), require_waveform_qc=P(False), allow_waveform_warnings=P(True))
TransientWaveformSpec = declare(
    "TransientWaveformSpec", "transients:cut_waveforms", pre_peak_s=P(1.0, above=0, to="pre_s"), post_peak_s=P(2.0, above=0, to="post_s"), maximum_gap_factor=_GAP3, require_complete_window=P(True), maximum_flat_step_fraction_warning=P(0.05, **SHARE), maximum_flat_step_fraction_error=P(0.20, **SHARE),
    detector_floor=P(None), detector_ceiling=P(None, to="ceiling"), saturation_tolerance=P(0.0, least=0), maximum_saturation_fraction_warning=P(0.001, **SHARE), maximum_saturation_fraction_error=P(0.01, **SHARE), warn_nearby_candidates=P(True),
)
TransientAnimalInferenceSpec = declare("TransientAnimalInferenceSpec", _animals, (_LEVELS,), metric=P(), condition_a=P(), condition_b=P(), channel=P(), design=_DESIGN, effect_scale=_SCALE, session_aggregation=_HOW, **_ANIMALS)

# -- time scales

MultiscaleContinuitySpec = declare("MultiscaleContinuitySpec", gap_factor=P(3.0, above=1, to="gap_factor"), maximum_gap_s=P(None, above=0))
MultiscaleWindowSpec = declare("MultiscaleWindowSpec", name=P(kind=str), duration_s=P(above=0), step_s=P(None, above=0), minimum_coverage=P(0.95, above=0, most=1), minimum_samples=P(3, least=1))
METRICS = ("time_weighted_mean", "time_weighted_standard_deviation", "sample_median", "sample_iqr", "sample_linear_slope")


def _multiscale(s: Spec, samples, keys=("subject", "session", "channel"), **more):
    """Windows of one coverage and support are one pass."""
    out = None
    for rule in dict.fromkeys((w.minimum_coverage, w.minimum_samples) for w in s.windows):
        windows = [(w.name, w.duration_s, w.step_s or w.duration_s) for w in s.windows if (w.minimum_coverage, w.minimum_samples) == rule]
        found = multiscale.summarize_multiscale(samples, keys, windows=windows, gap_factor=s.continuity.gap_factor, minimum_coverage=rule[0], minimum_samples=rule[1], **more)
        out = found if out is None else out.unionByName(found)
    return out


MultiscaleSummarySpec = declare("MultiscaleSummarySpec", _multiscale, (("windows share a name", lambda s: len({w.name for w in s.windows}) == len(s.windows) > 0),), windows=P(kind=tuple), metrics=P(METRICS), continuity=P(MultiscaleContinuitySpec(), kind=MultiscaleContinuitySpec))
MultiscaleAnimalInferenceSpec = declare("MultiscaleAnimalInferenceSpec", _animals, (_LEVELS,), scale=P(), metric=P(among=METRICS), condition_a=P(), condition_b=P(), state=P(None), design=_DESIGN, effect_scale=_SCALE, window_aggregation=_HOW, session_aggregation=_HOW, **_ANIMALS)

# -- associations and networks

ResidualizationSpec = declare("ResidualizationSpec", ridge_alpha=P(0.0, only=True), standardize_covariates=P(True))
BlockPermutationSpec = declare("BlockPermutationSpec", "association:blocked_permutation", block_duration_s=P(20.0, above=0, to="block", samples=True), resamples=P(1000, least=1, to="resamples"), seed=SEED)
LaggedAssociationSpec = declare("LaggedAssociationSpec", "association:lagged_association", maximum_lag_s=P(5.0, above=0, to="max_lag", samples=True), detrend=P("constant", among=("constant",)), minimum_pairs_per_lag=P(10, least=2, to="minimum_pairs"), gap=GAP, residualization=P(ResidualizationSpec(), kind=ResidualizationSpec), blocked_permutation=P(None, kind=BlockPermutationSpec))
CrosstalkDiagnosticSpec = declare("CrosstalkDiagnosticSpec", lambda s, lags, keys=("subject", "session", "channel"), *, rate_hz: association.assess_crosstalk(lags, keys, interval_s=1 / rate_hz, high=s.high_absolute_correlation, near_zero_s=s.near_zero_peak_s), maximum_lag_s=P(1.0, above=0), high_absolute_correlation=P(0.8, **SHARE), near_zero_peak_s=P(0.1, least=0), minimum_excitation_separation_nm=P(20.0, least=0), minimum_emission_separation_nm=P(20.0, least=0), high_control_loading=P(0.6, **SHARE), gap=GAP)
AssociationAnimalInferenceSpec = declare("AssociationAnimalInferenceSpec", _animals, (_LEVELS,), metric=P(), pair_id=P(), condition_a=P(), condition_b=P(), design=P("paired", among=("independent", "paired")), session_aggregation=P("mean", among=("median", "mean")), **_ANIMALS)
SpatialNodePermutationSpec = declare("SpatialNodePermutationSpec", lambda s, edges: association.node_permutation(edges, resamples=s.resamples, seed=s.seed), resamples=P(1000, least=1), seed=SEED)
SpatialNetworkSpec = declare("SpatialNetworkSpec", "association:spatial_edges", association=P(LaggedAssociationSpec(), kind=LaggedAssociationSpec), edge_metric=P("zero_lag_correlation", among=("zero_lag_correlation",)), correlation_scale=P("fisher_z", among=("raw", "fisher_z")), minimum_edge_support=P(20, least=4, to="minimum_support"), distance_bins=P(()), node_permutation=P(SpatialNodePermutationSpec(), kind=SpatialNodePermutationSpec))
SpatialNetworkSpec.arguments = lambda self, rate_hz=None: {"minimum_support": self.minimum_edge_support}
SpatialAnimalInferenceSpec = declare("SpatialAnimalInferenceSpec", _animals, (_LEVELS, ("a distance bin and a site exclude each other", lambda s: s.distance_bin_name is None or s.site is None)), metric=P(), condition_a=P(), condition_b=P(), distance_bin_name=P(None), site=P(None), design=P("paired", among=("independent", "paired")), session_aggregation=P("mean", among=("median", "mean")), **_ANIMALS)

# -- populations

_POPULATION = {"confidence": CONFIDENCE, "draws": P(2000, least=1, to="draws"), "seed": SEED}


def _contrast(s: Spec, cells, *, factor: str = "condition", by=None):
    if s.design == "paired":
        return inference.paired_t(cells, by)
    return inference.welch_t(cells, factor=factor, numerator=s.numerator, denominator=s.denominator, by=by)


PopulationContrastSpec = declare("PopulationContrastSpec", _contrast, (("the two levels are one", lambda s: s.numerator != s.denominator),), numerator=P(), denominator=P(), design=P(among=("paired", "independent")), **_POPULATION, **SCHEMA)
PopulationInteractionSpec = declare(
    "PopulationInteractionSpec", lambda s, cells, assignments, unit="subject", by=None: inference.interaction(cells, assignments, unit=unit, condition=s.condition_factor, group=s.group_factor, conditions=(s.condition_numerator, s.condition_denominator), groups=(s.group_numerator, s.group_denominator), by=by),
    (("two levels are one", lambda s: s.group_numerator != s.group_denominator and s.condition_numerator != s.condition_denominator),), group_numerator=P(), group_denominator=P(), condition_numerator=P(), condition_denominator=P(), group_factor=P("group"), condition_factor=P("condition"), **_POPULATION, **SCHEMA,
)
PeriEventInferenceSpec = declare("PeriEventInferenceSpec", lambda s, curves, **more: population.infer_curves(curves, draws=s.draws, seed=s.seed, **more), (_window("window"),), window=P((-1.0, 2.0)), rate_hz=P(20.0, above=0), **_POPULATION, within_animal=P("equal_session_means", among=("equal_session_means",)), design=P("paired", among=("paired",)))
ScalarMixedModelSpec = declare("ScalarMixedModelSpec", nested_random_intercept_unit=P("session"), random_condition_slope=P(True), confidence=CONFIDENCE, reml=P(True), optimizer=P("lbfgs"), role=P("sensitivity_analysis", only=True), **SCHEMA)

# -- encoding

FIRBasisSpec = declare("FIRBasisSpec", family=P("fir", only=True), **SCHEMA)
RaisedCosineBasisSpec = declare("RaisedCosineBasisSpec", lambda s, n_lags: encoding.raised_cosines(n_lags, s.functions), functions=P(least=1), family=P("raised_cosine", only=True), **SCHEMA)
LinearProgressBasisSpec = declare("LinearProgressBasisSpec", lambda s, progress: encoding.progress_hats(progress, s.functions), functions=P(5, least=2), evaluation_points=P(101, least=2), family=P("linear_progress", only=True), **SCHEMA)
EventModulationSpec = declare("EventModulationSpec", value=P(kind=str), lag_events=P(0, least=0), unavailable_value=P(0.0), **SCHEMA)
EventKernelSpec = declare("EventKernelSpec", rules=(_window("window_s"),), name=P(kind=str), window_s=P(kind=tuple), basis=P(FIRBasisSpec(), kind=(FIRBasisSpec, RaisedCosineBasisSpec)), source_event=P(None), modulation=P(None))
ProgressKernelSpec = declare("ProgressKernelSpec", name=P(kind=str), source_interval=P(None), basis=P(LinearProgressBasisSpec(), kind=LinearProgressBasisSpec), **SCHEMA)
KernelUncertaintySpec = declare("KernelUncertaintySpec", lambda s, grams, alpha: encoding.jackknife(grams, alpha), confidence_level=CONFIDENCE, simultaneous_method=P("none", among=("none",)), **SCHEMA)
MultiplierSimultaneousBandSpec = declare("MultiplierSimultaneousBandSpec", lambda s, curves: inference.simultaneous_band(curves, draws=s.simultaneous_draws, seed=s.simultaneous_seed, confidence=s.confidence_level), confidence_level=CONFIDENCE, simultaneous_method=P("jackknife_gaussian_multiplier_max_t", only=True), simultaneous_draws=P(2000, least=1), simultaneous_seed=P(20260727, least=0), **SCHEMA)


def _design(s: Spec, samples, events, keys=("subject", "session"), *, rate_hz: float, **more):
    """The lagged design of the event kernels; lags are samples of the clock."""
    lags = {k.source_event or k.name: (math.ceil(k.window_s[0] * rate_hz), math.floor(k.window_s[1] * rate_hz)) for k in s.event_kernels}
    return encoding.fir_design(samples, events, keys, kernels=lags, **more)


EncodingModelSpec = declare(
    "EncodingModelSpec", _design, (("kernels share a name", lambda s: len({k.name for k in (*s.event_kernels, *s.progress_kernels)}) == len(s.event_kernels) + len(s.progress_kernels)),),
    event_kernels=P(kind=tuple), continuous_covariates=P(()), alpha_grid=P((0.0, 0.1, 1.0, 10.0), least=0), group_by=P("animal", among=("animal", "session")), folds=P(5, least=2), sampling_tolerance=P(1e-3, above=0), minimum_session_coverage=P(0.5, **SHARE), minimum_session_observations=P(3, least=1), **SCHEMA,
    progress_kernels=P(()), uncertainty=P(KernelUncertaintySpec(), kind=(KernelUncertaintySpec, MultiplierSimultaneousBandSpec)),
)
EncodingMultiverseSpec = declare("EncodingMultiverseSpec", lambda s, grams, **more: encoding.run_models(grams, {name: list(terms) for name, terms in s.alternatives}, **more), (("the reference is none of the alternatives", lambda s: s.reference in dict(s.alternatives)),), alternatives=P(kind=tuple), reference=P(), intent=P(among=("confirmatory", "exploratory", "descriptive")), **SCHEMA)
PredictorFamilyDropSpec = declare("PredictorFamilyDropSpec", rules=(("nothing is removed", lambda s: len(s.removed_predictors) > 0), ("a removed predictor is still in the reduced model", lambda s: not set(s.removed_predictors) & set(s.reduced_model))), family=P(kind=str), reduced_model=P(kind=tuple), removed_predictors=P(kind=tuple), rationale=P(kind=str), **SCHEMA)
PredictorFamilyContributionSpec = declare(
    "PredictorFamilyContributionSpec", lambda s, grams, **more: encoding.family_contributions(grams, {d.family: list(d.removed_predictors) for d in s.families}, confidence=s.confidence_level, **more),
    (("families repeat", lambda s: len({d.family for d in s.families}) == len(s.families) > 0), ("a drop does not add up to the full model", lambda s: all(set(d.reduced_model) | set(d.removed_predictors) == set(s.full_model) for d in s.families))), full_model=P(kind=tuple), families=P(kind=tuple), confidence_level=CONFIDENCE, **SCHEMA,
)

# -- light, sensors and clocks

OptogeneticMaskSpec = declare("OptogeneticMaskSpec", "intervals:artifact_mask", pre_pulse_s=P(0.01, least=0, to="pre_s"), post_pulse_s=P(0.2, least=0, to="post_s"))
OptogeneticRecoverySpec = declare(
    "OptogeneticRecoverySpec", "intervals:recovery_times", baseline_duration_s=P(0.5, above=0, to="baseline_s"), baseline_guard_s=P(0.02, least=0, to="guard_s"), assessment_duration_s=P(1.0, above=0, to="assessment_s"), recovery_threshold_sd=P(3.0, above=0, to="threshold_sd"),
    stable_duration_s=P(0.05, above=0, to="stable", samples=True), minimum_baseline_samples=P(10, least=2, to="minimum_baseline"), control_artifact_threshold_sd=P(5.0, above=0), detector_floor=P(None), detector_ceiling=P(None), saturation_tolerance=P(0.0, least=0),
)
OpticalUnmixingSpec = declare("OpticalUnmixingSpec", "association:assess_mixing", maximum_condition_number=P(1000.0, least=1, to="maximum_condition"), require_wavelength_metadata=P(True), require_leave_one_channel_out=P(False), minimum_holdout_samples=P(20, least=1), gap_factor=P(3.0, above=1))
OpticalMixingCalibrationSpec = declare("OpticalMixingCalibrationSpec", "population:calibrate_mixing", fit_intercept=P(True, only=True), minimum_samples=P(20, least=2, to="minimum"), maximum_component_design_condition=P(1000.0, least=1), maximum_mixing_condition_number=P(1000.0, least=1, to="maximum_condition"), require_wavelength_metadata=P(True))
KineticForwardSpec = declare("KineticForwardSpec", "association:predict_sensor", gap=GAP, initial_state=P("zero_at_each_run", only=True))
KineticDeconvolutionSpec = declare(
    "KineticDeconvolutionSpec", "association:deconvolve", regularization_strength=P(above=0, to="strength"), regularization_source=P(kind=str), smoothness_order=P(1, among=(0, 1, 2), to="order"), nonnegative=P(False, only=True), fit_run_baseline=P(True), minimum_samples_per_rise=P(3.0, above=0), minimum_run_to_kernel_ratio=P(2.0, above=0),
    maximum_regularized_condition_number=P(1e8, above=1), minimum_transfer_fraction=P(0.05, **SHARE), require_independent_calibration=P(False), maximum_iterations=P(1000, least=1), gap=GAP,
)
SensorValiditySpec = declare(
    "SensorValiditySpec", "population:assess_sensor_validity", (_window("event_baseline"), _window("event_response")), minimum_finite_fraction_warning=P(0.95, **SHARE), minimum_finite_fraction_error=P(0.80, **SHARE), maximum_repeated_extreme_fraction_warning=P(0.01, **SHARE), maximum_repeated_extreme_fraction_error=P(0.05, **SHARE),
    maximum_flat_step_fraction_warning=P(0.01, **SHARE), maximum_flat_step_fraction_error=P(0.10, **SHARE), maximum_saturation_fraction_warning=P(0.001, **SHARE), maximum_saturation_fraction_error=P(0.01, **SHARE), maximum_out_of_profile_fraction_warning=P(0.001, **SHARE), maximum_out_of_profile_fraction_error=P(0.01, **SHARE),
    minimum_reference_sd_ratio=P(0.01, above=0), maximum_reference_sd_ratio=P(100.0, above=0), weak_reference_correlation=P(0.10, **SHARE), maximum_reference_lag_s=P(0.10, least=0), minimum_lag_improvement=P(0.05, least=0), maximum_reference_event_effect_sd=P(0.50, least=0), event_baseline=P((-0.5, 0.0)), event_response=P((0.0, 0.5)),
    detector_floor=P(None), detector_ceiling=P(None), saturation_tolerance=P(0.0, least=0), require_wavelength_metadata=P(True), require_isosbestic=P(False), gap=GAP,
)
SessionComparabilitySpec = declare(
    "SessionComparabilitySpec", "qc:assess_session_comparability", minimum_finite_fraction_error=P(0.80, **SHARE), minimum_finite_fraction_warning=P(0.95, **SHARE), minimum_event_coverage_error=P(0.50, **SHARE), minimum_event_coverage_warning=P(0.80, **SHARE), maximum_baseline_fold_change_warning=P(2.0, least=1, to="fold_warning"), maximum_baseline_fold_change_error=P(4.0, least=1, to="fold_error"),
    maximum_reference_correlation_range_warning=P(0.30, least=0), maximum_reference_correlation_range_error=P(0.60, least=0), maximum_sampling_rate_ratio_warning=P(1.20, least=1), maximum_sampling_rate_ratio_error=P(2.0, least=1), require_same_preprocessing=P(True), require_event_coverage=P(False), require_baseline_metric=P(False), require_reference_metric=P(False), require_sampling_rate=P(False), minimum_sessions=P(2, least=1), **SCHEMA,
)
ClockSynchronizationSpec = declare("ClockSynchronizationSpec", "intervals:fit_clock", maximum_absolute_residual_s=P(above=0, to="maximum_residual_s"), maximum_drift_ppm=P(above=0, to="maximum_drift_ppm"), minimum_matches=P(3, least=2, to="minimum_matches"), minimum_source_span_s=P(1.0, above=0, to="minimum_span_s"), **SCHEMA)

# -- interval policies

_ID = {"operation_id": P(kind=str)}


def _of_labels(s: Spec, rows):
    """(rows the step is for, the others): no labels, all rows."""
    return (rows.where(rows["label"].isin(list(s.labels))), rows.where(~rows["label"].isin(list(s.labels)))) if s.labels else (rows, None)


def _back(found, rest):
    return found if rest is None else found.unionByName(rest, allowMissingColumns=True)


def _filtered(s: Spec, rows, context=None):
    return intervals.filter_intervals(rows, include=s.include_labels, exclude=s.exclude_labels, minimum_s=s.minimum_duration_s, maximum_s=s.maximum_duration_s, minimum_confidence=s.minimum_confidence).where("reason is null").drop("reason")


def _merged(s: Spec, rows, context=None):
    own, rest = _of_labels(s, rows)
    return _back(intervals.merge_intervals(own, maximum_gap_s=s.maximum_gap_s, confidence=s.confidence).select(*rows.columns), rest)


def _split(s: Spec, rows, context=None):
    own, rest = _of_labels(s, rows)
    cut = intervals.split_intervals(own, maximum_s=s.maximum_duration_s, cuts_us=tuple(round(c * 1e6) for c in s.cut_points_s))
    return _back(cut.selectExpr(*[c for c in rows.columns if c != "interval_id"], "concat(interval_id, '/', piece) as interval_id").select(*rows.columns), rest)


def _contextualized(s: Spec, rows, context=None):
    if not context or s.context_source not in context:
        raise ValueError(f"{s.operation_id}: no context {s.context_source!r}")
    own, rest = _of_labels(s, rows)
    around = context[s.context_source]
    around = around.where(around["label"].isin(list(s.context_labels))) if s.context_labels else around
    return _back(intervals.contextualize(own, around, minimum_fraction=s.minimum_overlap_fraction, multiple=s.multiple_matches, template=s.label_template, keep_unmatched=s.keep_unmatched).select(*rows.columns), rest)


def _resolved(s: Spec, rows, context=None):
    if s.strategy == "reject":
        intervals.require(intervals.overlapping(rows, by_label=s.scope == "same_label").select("interval_id"), f"{s.operation_id}: intervals overlap")
        return rows
    trimmed = intervals.resolve_overlaps(rows, list(s.label_priority))
    return trimmed.selectExpr(*[c for c in rows.columns if c != "interval_id"], "concat(interval_id, '/', piece) as interval_id").select(*rows.columns)


FilterIntervals = declare("FilterIntervals", _filtered, **_ID, include_labels=P(()), exclude_labels=P(()), minimum_duration_s=P(None, least=0), maximum_duration_s=P(None, least=0), minimum_confidence=P(None, **SHARE))
MergeIntervals = declare("MergeIntervals", _merged, **_ID, maximum_gap_s=P(least=0), labels=P(()), confidence=P("minimum", among=("minimum", "maximum", "mean", "drop")))
SplitIntervals = declare("SplitIntervals", _split, (("nothing to split by", lambda s: s.maximum_duration_s is not None or s.cut_points_s),), **_ID, labels=P(()), maximum_duration_s=P(None, above=0), cut_points_s=P(()))
ContextualizeIntervals = declare("ContextualizeIntervals", _contextualized, **_ID, context_source=P(kind=str), labels=P(()), context_labels=P(()), minimum_overlap_fraction=P(0.0, **SHARE), multiple_matches=P("duplicate", among=("duplicate", "first", "reject")), keep_unmatched=P(True), label_template=P("{label}@{context}"))
ResolveIntervalOverlaps = declare("ResolveIntervalOverlaps", _resolved, (("a priority of labels is for trimming across them", lambda s: s.strategy != "priority" or s.label_priority),), **_ID, scope=P("same_label", among=("same_label", "all")), strategy=P("reject", among=("reject", "priority")), label_priority=P(()))


def _policy(s: Spec, rows, context=None):
    """The operations one after another; ``context`` has the tables that contextualizing steps name."""
    for op in s.operations:
        rows = op.run(rows, context=context)
    return rows


IntervalPolicy = declare("IntervalPolicy", _policy, (("operations share an id", lambda s: len({o.operation_id for o in s.operations}) == len(s.operations) > 0), ("an operation is none of intervals", lambda s: all("operation_id" in o.values for o in s.operations))), operations=P(kind=tuple), **SCHEMA)

# -- made-up signals

#: Shape of a made-up transient: a bell, a rise and a decay, or a bell and a smaller one against it some samples later.
TransientSpec = declare("TransientSpec", family=P(among=("gaussian", "alpha", "biphasic")), transient_class=P(kind=str), width_samples=P(None, above=0), rise_samples=P(None, above=0), decay_samples=P(None, above=0), separation_samples=P(None, above=0))
