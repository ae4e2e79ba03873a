"""Specifications as data, and the operators they run."""

import pickle

import pytest
from pyspark.sql import functions as F

from tracelight.operators import intervals, transients
from tracelight.plans import specs
from tracelight.plans.spec_base import from_dict

REQUIRED = {
    "EventSummarySpec": {"baseline": (-1, 0), "response": (0, 1)}, "ResampleOperation": {"rate_hz": 20.0}, "LowpassFilterOperation": {"cutoff_hz": 2.0}, "BaselineDFFOperation": {"method": "asls"},
    "EventKernelSpec": {"name": "cue", "window_s": (0, 1)}, "MultiscaleWindowSpec": {"name": "w", "duration_s": 5.0}, "ClockSynchronizationSpec": {"maximum_absolute_residual_s": 0.1, "maximum_drift_ppm": 50.0},
    "StateEpoch": {"state": "rest", "start_s": 0.0, "stop_s": 2.5}, "KineticDeconvolutionSpec": {"regularization_strength": 0.1, "regularization_source": "bench"}, "PermutationPlan": {"mode": "shuffle", "exchangeability_unit": "subject"},
}


def ready():
    for name, kind in specs.SPECS.items():
        if name in REQUIRED or all(p.default is not specs.P().default for p in kind.TABLE.values()):
            yield kind(**REQUIRED.get(name, {}))


def test_specifications_are_data():
    found = list(ready())
    assert len(found) > 35
    for spec in found:
        again = from_dict(spec.to_dict())
        assert again == spec and again.fingerprint() == spec.fingerprint() and hash(again) == hash(spec) and pickle.loads(pickle.dumps(spec)) == spec
        with pytest.raises(AttributeError):
            spec.anything = 1
        with pytest.raises(TypeError):
            type(spec)(**REQUIRED.get(type(spec).__name__, {}), nonsense=1)
    assert len({s.fingerprint() for s in found}) == len(found)


@pytest.mark.parametrize(
    "make",
    [
        lambda: specs.GapHandlingSpec(gap_factor=1.0), lambda: specs.StateEpoch("a", 2, 2), lambda: specs.EventSummarySpec((0, 0), (0, 1)), lambda: specs.SpectralAnalysisSpec(overlap_fraction=1.0),
        lambda: specs.IntervalPolicy(()), lambda: specs.TransientAnimalInferenceSpec("rate", "a", "a", "green"), lambda: specs.EventAnalysisConfig("t", "x", "x", channel="g"), lambda: specs.ResidualizationSpec(ridge_alpha=1.0),
        lambda: specs.PredictorFamilyDropSpec("cues", ("cue",), ("cue",), "why"), lambda: specs.EncodingModelSpec((specs.EventKernelSpec("a", (0, 1)), specs.EventKernelSpec("a", (0, 2)))),
    ],
)
def test_limits_are_kept(make):
    with pytest.raises(ValueError):
        make()


INTERVALS = "subject string, session string, interval_id string, label string, start_us long, stop_us long, confidence double"


def seconds(rows):
    return sorted((r["label"], r["start_us"] / 1e6, r["stop_us"] / 1e6) for r in rows.collect())


def test_the_order_of_a_policy_counts(spark):
    rows = spark.createDataFrame([("a", "1", f"i{k}", label, int(x * 1e6), int(y * 1e6), 0.9) for k, (label, x, y) in enumerate([("run", 0, 1), ("run", 1.2, 2), ("run", 5, 5.5), ("rest", 0, 9)])], INTERVALS)
    short = specs.FilterIntervals("short", minimum_duration_s=0.9)
    merge = specs.MergeIntervals("merge", 0.5, labels=("run",))
    one, two = specs.IntervalPolicy((short, merge)), specs.IntervalPolicy((merge, short))
    assert seconds(one.run(rows)) == [("rest", 0, 9), ("run", 0, 1)]
    assert seconds(two.run(rows)) == [("rest", 0, 9), ("run", 0, 2)]
    assert one.fingerprint() != two.fingerprint() and from_dict(one.to_dict()) == one
    cut = specs.IntervalPolicy((specs.SplitIntervals("cut", labels=("rest",), cut_points_s=(3.0,)), specs.ContextualizeIntervals("where", "arena", labels=("run",), keep_unmatched=False, multiple_matches="first")))
    arena = spark.createDataFrame([("a", "1", "c", "centre", 0, 2_000_000, None)], INTERVALS)
    assert seconds(cut.run(rows, context={"arena": arena})) == [("rest", 0, 3), ("rest", 3, 9), ("run@centre", 0, 1), ("run@centre", 1.2, 2)]
    with pytest.raises(ValueError):
        cut.run(rows)
    crossed = specs.ResolveIntervalOverlaps("trim", "all", "priority", ("run",))
    assert seconds(crossed.run(rows))[:4] == [("rest", 1, 1.2), ("rest", 2, 5), ("rest", 5.5, 9), ("run", 0, 1)]


def test_specifications_run_their_operators(spark):
    samples = spark.range(4000).select(F.lit("a").alias("subject"), F.lit("1").alias("session"), F.lit("g").alias("channel"), (F.col("id") * 50_000).alias("t_us"), (F.col("id") * 0.05).alias("t"), (F.sin(F.col("id") / 7) + (F.col("id") % 97 == 0).cast("int") * 4).alias("signal"), F.cos(F.col("id") / 9).alias("reference"))
    keys = ["subject", "session", "channel"]
    same = lambda x, y: sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))
    assert same(specs.GuppyTransientDetectorSpec(chunk_duration_s=5.0).run(samples, keys, rate_hz=20.0), transients.detect_chunked(samples, keys, chunk=100))
    assert same(specs.PastaTransientDetectorSpec(2.0).run(samples, keys), transients.detect_amplitude(samples, keys, amplitude=2.0))
    windows = specs.MultiscaleSummarySpec((specs.MultiscaleWindowSpec("short", 5.0), specs.MultiscaleWindowSpec("long", 60.0, 30.0, 0.5, 10)))
    assert {r["scale"] if "scale" in r else r["window"] for r in (x.asDict() for x in windows.run(samples, keys).select(F.expr("*")).limit(2000).collect())} >= {"short", "long"}
    assert same(specs.AutocorrelationSpec(1.0).run(samples, keys, rate_hz=20.0), specs.spectral.autocorrelation(samples, keys, max_lag=20))
    spectrum = specs.SpectralAnalysisSpec(20.0, maximum_frequency_hz=2.0).run(samples, keys, rate_hz=20.0)
    assert spectrum.agg(F.max("frequency_hz")).first()[0] == 2.0
    pulses = spark.createDataFrame([("a", "1", "p", 10_000_000, 10_500_000)], "subject string, session string, interval_id string, start_us long, stop_us long")
    kept = specs.OptogeneticMaskSpec().run(samples, pulses)
    assert kept.where("not kept").count() == 15 and same(kept, intervals.artifact_mask(samples, pulses))
    made = specs.Preprocessing("fit", (specs.ReferenceDFFOperation("ols"),)).run(samples, keys)
    assert "dff" in made.columns and made.count() == 4000
    rest = specs.epochs(spark, [specs.StateEpoch("rest", 0, 5), specs.StateEpoch("run", 5, 9, "second")], subject="a", session="1")
    assert seconds(rest) == [("rest", 0, 5), ("run", 5, 9)]
    with pytest.raises(ValueError):
        specs.AutocorrelationSpec().run(samples, keys)
    with pytest.raises(TypeError):
        specs.GapHandlingSpec().run(samples)
