"""Further queries: states, curves, intervals, made-up recordings and errors against their truth, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelight import views
from tracelight.operators import association, events, inference, intervals, population, preprocess, reconstruction, simulate, spectral
from tracelight.plans import operations, specs
from tracelight.plans.pipeline import clock_facts
from tracelight.queries import ALIGN, HOUR, LAGS, query
from tracelight.sources import tabular
from tracelight.views import KEYS


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- spectra by state: each half of a trace is a state

HALVES = """h as (select *, idx // 32 as half, idx % 32 as k from traces),
w as (select *, (signal - avg(signal) over p) * (0.5 - 0.5 * cos(2 * pi() * k / 32)) as v from h window p as (partition by subject, session, half)),
f as (select subject, session, half, b as bin, sum(v * cos(b * k * (2 * pi() / 32))) as c, sum(v * sin(b * k * (2 * pi() / 32))) as s from (select *, unnest(range(0, 17)) as b from w) group by all),
p as (select *, bin * 20.0 / 32 as frequency_hz, (c * c + s * s) * case when bin in (0, 16) then 1 else 2 end / (20.0 * 12) as power from f)"""


def _halves(spark, d):
    return views.traces(spark, d).withColumn("half", F.floor(F.col("idx") / 32).cast("long"))


def _half_windows(spark, d):
    return spectral.spectrogram(_halves(spark, d), KEYS, rate_hz=views.RATE_HZ, window_s=1.6, overlap=0.0, partition="half")


@query("with " + HALVES + " select subject, session, half, bin, round(frequency_hz, 6) as frequency_hz, round(power, 6) as power from p", "traces")
def state_spectrogram(spark, d):
    return rounded(_half_windows(spark, d), "frequency_hz", "power").select(*KEYS, "half", "bin", "frequency_hz", "power")


@query("with " + HALVES + " select subject, half, bin, round(avg(power), 6) as power, count(*) as windows from p group by all", "traces")
def state_psd(spark, d):
    return rounded(spectral.welch_psd(_half_windows(spark, d), ("subject",), partition="half"), "power").select("subject", "half", "bin", "power", "windows")


BAND = """, n as (select *, lead(frequency_hz) over o as f1, lead(power) over o as p1 from p window o as (partition by subject, session, half order by frequency_hz)),
e as (select *, greatest(frequency_hz, 1.0) as a, least(f1, 4.0) as b from n where f1 is not null),
bp as (select subject, session, half, sum(case when b > a then ((power + (p1 - power) * ((a - frequency_hz) / (f1 - frequency_hz))) + (power + (p1 - power) * ((b - frequency_hz) / (f1 - frequency_hz)))) / 2 * (b - a) else 0 end) as bp from e group by all)"""


def _state_band(spark, d):
    psd = spectral.welch_psd(_half_windows(spark, d), KEYS, partition="half")
    return population.state_band_power_population(psd, state="half", low=1.0, high=4.0)


@query("with " + HALVES + BAND + " select subject, half::varchar as condition, round(avg(bp), 6) as estimate, count(*) as sessions from bp group by all", "traces")
def state_band_power_population(spark, d):
    return rounded(_state_band(spark, d), "estimate")


@query("with " + HALVES + BAND + """, m as (select subject, half, avg(bp) as e from bp group by all), q as (select a.e - b.e as x from m a join m b on a.subject = b.subject and a.half = 0 and b.half = 1)
select round(avg(x), 6) as estimate, count(*) as animals from q""", "traces")
def state_band_power_contrast(spark, d):
    found = specs.StateBandPowerInferenceSpec("0", "1", (1.0, 4.0), bootstrap_resamples=200).run(_state_band(spark, d), sign="a-b")
    return spark.createDataFrame([(round(found.estimate, 6), found.animals)], "estimate double, animals long")


@query("""with h as (select *, idx // 32 as half from traces), c as (select *, signal - avg(signal) over (partition by subject, session, half) as x from h)
select a.subject, a.half, l as lag, round(sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)), 6) as autocorrelation, count(*) as n_pairs
from (select *, unnest(range(0, 5)) as l from c) a join c b on a.subject = b.subject and a.session = b.session and a.half = b.half and b.idx = a.idx + l group by all""", "traces")
def state_autocorrelation(spark, d):
    # traces of an animal follow each other a day apart, so that runs do not join them
    apart = _halves(spark, d).withColumn("t_us", F.col("t_us") + F.col("session").cast("long") * 86_400_000_000)
    out = spectral.autocorrelation(apart, ("subject",), max_lag=4, max_gap_s=1.0, gap_factor=None, partition="half")
    return rounded(out, "autocorrelation").select("subject", "half", "lag", "autocorrelation", "n_pairs")


CROSS = """r as (select *, lag(signal, 2) over (partition by subject, session order by idx) as reference from traces), j as (select *, idx // 32 as half, idx % 32 as k from r where idx >= 32),
w as (select *, (signal - avg(signal) over p) * (0.5 - 0.5 * cos(2 * pi() * k / 32)) as v, (reference - avg(reference) over p) * (0.5 - 0.5 * cos(2 * pi() * k / 32)) as u from j window p as (partition by subject, session, half)),
f as (select subject, session, half, b as bin, sum(v * cos(b * k * (2 * pi() / 32))) as xr, -sum(v * sin(b * k * (2 * pi() / 32))) as xi, sum(u * cos(b * k * (2 * pi() / 32))) as yr, -sum(u * sin(b * k * (2 * pi() / 32))) as yi from (select *, unnest(range(0, 17)) as b from w) group by all),
p as (select subject, bin, avg(xr * xr + xi * xi) as pxx, avg(yr * yr + yi * yi) as pyy, avg(xr * yr + xi * yi) as re, avg(xr * yi - xi * yr) as im, count(*) as windows from f group by all)"""


def _cross(spark, d):
    both = views.traces(spark, d).withColumn("reference", F.lag("signal", 2).over(Window.partitionBy(*KEYS).orderBy("idx"))).where("idx >= 32")
    apart = both.withColumn("t_us", F.col("t_us") + F.col("session").cast("long") * 86_400_000_000).withColumn("half", F.lit(1))
    kept = apart.withColumn("whole", F.col("session").cast("long"))
    return spectral.coherence(kept, ("subject", "whole"), rate_hz=views.RATE_HZ, window_s=1.6, overlap=0.0)


@query("with " + CROSS.replace("p as (select subject, bin,", "p as (select subject, session, bin,") + " select subject, session::bigint as whole, bin, round((re * re + im * im) / (pxx * pyy), 5) as coherence, windows from p where pxx * pyy > 0", "traces")
def coherence_by_bin(spark, d):
    return _cross(spark, d).where("coherence is not null").select("subject", "whole", "bin", F.round("coherence", 5).alias("coherence"), "windows")


# -- curves

@query("with " + HALVES + """, c as (select subject, half, frequency_hz, avg(power) as v, count(*) as sessions from p group by all)
select subject, half::varchar as condition, frequency_hz as axis, round(v, 6) as estimate, sessions as support, sessions from c""", "traces")
def state_psd_curves(spark, d):
    psd = spectral.welch_psd(_half_windows(spark, d), KEYS, partition="half")
    curves = population.curve_sessions(psd, axis="frequency_hz", value="power", support="windows", level="half")
    return rounded(population.curve_population(curves), "estimate")


@query(LAGS.replace("signal is not null and reference is not null", "signal is not null") + """, q as (select a.subject, l as lag, sum(a.x * b.x) / sqrt(sum(a.x * a.x) * sum(b.x * b.x)) as r, count(*) as n
from (select *, unnest(range(0, 4)) as l from c) a join c b on a.subject = b.subject and a.run_id = b.run_id and b.i = a.i + l group by all)
select subject, 'all' as condition, lag::double as axis, round(r, 6) as estimate, n as support, 1 as sessions from q""", "samples")
def autocorrelation_curves(spark, d):
    acf = spectral.autocorrelation(views.samples(spark, d), ("subject",), max_lag=3, gap_factor=None, max_gap_s=4 * HOUR).withColumn("session", F.lit("all"))
    curves = population.curve_sessions(acf, axis="lag", value="autocorrelation", support="n_pairs", named="all")
    return rounded(population.curve_population(curves), "estimate")


@query(ALIGN.replace("from markers)", "from markers where event_id::bigint % 5 < 4)") + """, s as (select subject, condition, rel_idx, avg(value) as v from al where value is not null group by all),
x as (select a.subject, a.rel_idx, a.v - b.v as c, case when substr(a.subject, 2)::int % 2 = 0 then 'even' else 'odd' end as g from s a join s b on a.subject = b.subject and a.rel_idx = b.rel_idx and a.condition = 'purchase' and b.condition = 'error')
select rel_idx, round(avg(c) filter (g = 'even') - avg(c) filter (g = 'odd'), 6) as estimate, count(*) filter (g = 'even') as n_numerator, count(*) filter (g = 'odd') as n_denominator from x group by rel_idx
having count(*) filter (g = 'even') > 0 and count(*) filter (g = 'odd') > 0""", "samples", "markers")
def peri_event_interaction(spark, d):
    marks = views.markers(spark, d).where("cast(event_id as long) % 5 < 4")
    aligned = events.align_events(views.samples(spark, d), marks, window=(-HOUR, 2 * HOUR), rate=1 / 1800, keys=("subject",), max_gap_s=4 * HOUR).where("value is not null").withColumn("session", F.lit("all"))
    curves = events.materialize_curves(aligned)
    groups = curves.select("subject").distinct().withColumn("group", F.when(F.substring("subject", 2, 4).cast("int") % 2 == 0, "even").otherwise("odd"))
    out = population.infer_curve_interaction(curves, groups, conditions=("purchase", "error"), groups=("even", "odd"))
    return rounded(out, "estimate").select("rel_idx", "estimate", "n_numerator", "n_denominator").where("n_numerator > 0 and n_denominator > 0")


# -- intervals and clocks

@query("""with k as (select * from bouts where label in ('view', 'click') and (stop_us - start_us) >= 600000000 and (stop_us - start_us) <= 21600000000),
m as (select *, max(stop_us) over (partition by subject, session, label order by start_us, stop_us, interval_id rows between unbounded preceding and 1 preceding) as far from k),
i as (select *, sum(case when far is null or start_us - far > 1800000000 then 1 else 0 end) over (partition by subject, session, label order by start_us, stop_us, interval_id rows unbounded preceding) as island from m),
g as (select subject, session, label, min(start_us) as start_us, max(stop_us) as stop_us, min(interval_id) as interval_id from i group by subject, session, label, island),
c as (select *, unnest(range(start_us, stop_us, 7200000000)) as a from g)
select subject, session, label, interval_id || '/' || row_number() over (partition by subject, session, label, interval_id, start_us order by a) as interval_id, a as start_us, least(a + 7200000000, stop_us) as stop_us from c""", "samples", "bouts")
def interval_policy(spark, d):
    policy = specs.IntervalPolicy((specs.FilterIntervals("use", include_labels=("view", "click"), minimum_duration_s=600.0, maximum_duration_s=21600.0), specs.MergeIntervals("join", 1800.0, confidence="drop"), specs.SplitIntervals("cut", maximum_duration_s=7200.0)))
    return policy.run(views.bouts(spark, d)).select(*KEYS, "label", "interval_id", "start_us", "stop_us")


@query("""select subject, session, label, row_number() over (partition by subject, session, label order by stop_us, start_us, interval_id) as place, stop_us as t_us, round((stop_us - start_us) / 1e6, 6) as duration_s from bouts""", "samples", "bouts")
def interval_encoding_inputs(spark, d):
    return rounded(intervals.interval_encoding_inputs(views.bouts(spark, d), edge="offset"), "duration_s").select(*KEYS, "label", "place", "t_us", "duration_s")


@query("select subject, session, interval_id as event_id, stop_us as t_us, label as condition from bouts where label = 'view' union all select subject, session, event_id, t_us, condition from markers", "samples", "bouts", "markers")
def annotation_event_times(spark, d):
    return intervals.event_times(views.bouts(spark, d).where("label = 'view'"), views.markers(spark, d), edge="offset")


@query("""with m as (select subject as clock, (t_us - 1704067200000000) / 1e6 as s, (t_us - 1704067200000000) / 1e6 * 1.00002 + 3 + reference / 1e5 as g from samples),
f as (select clock, regr_slope(g, s) as scale, regr_intercept(g, s) as intercept, min(s) as lo, max(s) as hi from m group by all)
select clock, event_id, round(case when t between lo - 60 and hi + 60 then intercept + scale * t end, 3) as target_t from (select subject as clock, event_id, (t_us - 1704067200000000) / 1e6 + (event_id::bigint % 3) * 100000 as t from markers) join f using (clock)""", "samples", "markers")
def clock_transform(spark, d):
    s = (F.col("t_us") - 1704067200000000) / 1e6
    matches = views.samples(spark, d).select(F.col("subject").alias("clock"), s.alias("source_t"), (s * 1.00002 + 3 + F.col("reference") / 1e5).alias("target_t"))
    fit = specs.ClockSynchronizationSpec(0.01, 50.0).run(matches)
    rows = views.markers(spark, d).select(F.col("subject").alias("clock"), "event_id", (s + (F.col("event_id").cast("long") % 3) * 100_000).alias("source_t"))
    return intervals.transform_time(rows, fit, matches, maximum_extrapolation_s=60.0).select("clock", "event_id", F.round("target_t", 3).alias("target_t"))


@query("""select b.subject, b.session, b.interval_id, k as hat, round(greatest(0, 1 - abs((s.t_us - b.start_us) / (b.stop_us - b.start_us) * 4 - k)), 6) as weight, s.t_us from (select *, unnest(range(0, 5)) as k from bouts where label = 'view') b
join samples s on s.subject = b.subject and s.session = b.session and s.t_us >= b.start_us and s.t_us <= b.stop_us and s.event_type = 'click'""", "samples", "bouts")
def progress_basis(spark, d):
    clicks = views.samples(spark, d).where("event_type = 'click'").select(*KEYS, "t_us")
    inside = intervals.normalized_progress(clicks, views.bouts(spark, d).where("label = 'view'"))
    hats = specs.LinearProgressBasisSpec(5).run(F.col("progress"))
    out = inside.select(*KEYS, "interval_id", F.col("p_t_us").alias("t_us"), F.posexplode(F.array(*hats)).alias("hat", "weight"))
    # weights are 0 to 1: rounded without a decimal number for each
    return out.withColumn("weight", F.floor(F.col("weight") * 1e6 + 0.5) / 1e6)


# -- compatibility

@query("""with x as (select subject, session, (t_us - lag(t_us) over (partition by subject, session order by t_us)) / 1e6 as dt from samples), c as (select subject || '/' || session as session, stddev_pop(dt) / avg(dt) as cv, quantile_cont(dt, 0.5) as m from x group by subject, x.session),
v as (select session, 'filter_above_nyquist' as code, 0 as step from c where cv is not null and m > 0 and 1 / m <= 0.0002 union all select session, 'asls_requires_regular_sampling', 1 from c where cv is not null and m > 0 and not cv <= 1e-6
union all select session, 'invalid_time_axis', null from c where cv is null or not coalesce(m, 0) > 0)
select code, step, count(*) as recordings, min(session) as session from v group by all""", "samples")
def pipeline_compatibility(spark, d):
    steps = (specs.LowpassFilterOperation(0.0001), specs.BaselineDFFOperation("asls"))
    return operations.violations(steps, clock_facts(views.samples(spark, d), KEYS), frozenset(("signal",)), "dff")


# -- made-up recordings and their truth

def _sessions(spark, d):
    return views.table(spark, d, "nation").select(F.col("n_name").alias("subject"), F.lit("made-up").alias("session"))


def _sim(first: int, step: int, last: int, tau: float, n: int) -> str:
    return f"""ev as (select unnest(range({first}, {last}, {step})) as e), c as (select n_name as subject, i, i / 20.0 as t from nation, range(0, {n}) as r(i)),
g as (select t, coalesce(sum(exp(-(t - e) / {tau})), 0) as v from (select distinct t from c) x left join ev on e <= t group by t)"""


@query("with " + _sim(10, 15, 55, 1.2, 1200) + """, a as (select c.subject, c.i, c.t, g.v, 0.25 * sin(c.t / 3) + 0.1 * exp(-c.t / 80) as s, 0.25 * sin(greatest(c.i - 4, 0) / 20.0 / 3) + 0.1 * exp(-greatest(c.i - 4, 0) / 20.0 / 80) as late from c join g using (t))
select subject, round(t, 6) as t, case when i between 240 and 279 or i between 600 and 639 or i between 960 and 999 then null else round(2 + 1.4 * s + 0.5 * s * s + 0.08 * v, 6) end as signal,
case when i between 240 and 279 or i between 600 and 639 or i between 960 and 999 then null else round(1 + late + 0.1 * v, 6) end as reference, round(0.08 * v / (2 + 1.4 * s + 0.5 * s * s), 6) as truth_dff from a""")
def simulated_recording(spark, d):
    rows = simulate.simulate_recording(_sessions(spark, d), duration=60.0, reference_lag_s=0.2, reference_contamination=0.1, nonlinear_signal_scale=0.5, dropout_fraction=0.1, noise=0.0)
    return rounded(rows, "t", "signal", "reference", "truth_dff").select("subject", "t", "signal", "reference", "truth_dff")


@query("with " + _sim(15, 20, 55, 0.8, 1200) + """, b as (select subject, c.t, 0.03 * v as dff, (1.1 + 0.55 * exp(-c.t / 25) + 0.4 * exp(-c.t / 180)) * (1 + 0.035 * sin(2 * pi() * c.t / 150)) as base from c join g using (t))
select subject, round(t, 6) as t, round(base * (1 + dff), 6) as signal, round(base, 6) as truth_baseline from b""")
def simulated_bleaching(spark, d):
    rows = simulate.simulate_bleaching(_sessions(spark, d), scenario="slow_drift", duration=60.0, noise=0.0)
    return rounded(rows, "t", "signal", "truth_baseline").select("subject", "t", "signal", "truth_baseline")


@query("with " + _sim(15, 15, 55, 0.8, 1200) + " select subject, round(c.t, 6) as t, round(1 + 0.8 * exp(-c.t / 70) + 0.03 * v, 6) as signal from c join g using (t)")
def simulated_normalization(spark, d):
    return rounded(simulate.simulate_normalization(_sessions(spark, d), mechanism="autofluorescence_bleaching", duration=60.0, noise=0.0), "t", "signal").select("subject", "t", "signal")


@query("""with c as (select n_name as subject, i / 20.0 - 2 as r from nation, range(0, 120) as x(i)), v as (select *, case when r < 0 then 0 else (1 - exp(-r / 0.1)) * exp(-r / 0.4) end as v from c)
select subject, round(r + 2, 6) as t, round(v / max(v) over (partition by subject), 6) as transient from v""")
def generated_transient(spark, d):
    clock = simulate._clock(_sessions(spark, d), 6.0, 20.0)
    out = simulate.generate_transient(clock, specs.TransientSpec("alpha", "made-up", rise_samples=2, decay_samples=8), KEYS, event_s=2.0, rate_hz=20.0)
    return rounded(out, "t", "transient").select("subject", "t", "transient")


@query("""select n_name as subject, i / 20.0 as t, round(1.2 + 0.8 * exp(-i / 20.0 / 70), 4) as baseline from nation, range(0, 6000, 100) as r(i) where n_regionkey = 1""")
def double_exponential_baseline(spark, d):
    """The fit finds a single exponential under transients of a few percent: to four digits without, within a promille with them."""
    here = views.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("subject"), F.lit("made-up").alias("session"))
    rows = simulate.simulate_bleaching(here, scenario="single_exponential", noise=0.0)
    clean = rows.withColumn("signal", F.col("truth_baseline"))
    fitted = preprocess.baseline_dff(clean, KEYS, method="double_exponential")
    return fitted.where("cast(round(t * 20) as long) % 100 = 0").select("subject", "t", F.round("baseline", 4).alias("baseline"))


def _gapped(spark, d):
    """Recordings with gaps, a stand-in where they were, and events near and in them."""
    rows = simulate.simulate_bleaching(_sessions(spark, d), scenario="double_exponential", duration=60.0, noise=0.0)
    i = F.round(F.col("t") * 20).cast("long")
    lost = (i % 300).between(250, 270)
    marks = simulate.event_table(_sessions(spark, d), 5.0, 3.5, 58.0)
    rows = rows.withColumn("held", F.when(~lost, F.col("signal"))).withColumn("filled", F.when(lost, F.col("signal") * 1.1).otherwise(F.col("signal"))).withColumn("made", lost)
    return rows, marks


GAPS = "with " + _sim(15, 20, 55, 0.8, 1200) + """, b as (select subject, i, c.t, (1.1 + 0.55 * exp(-c.t / 25) + 0.4 * exp(-c.t / 180)) * (1 + 0.03 * v) as truth from c join g using (t)),
h as (select *, i % 300 between 250 and 270 as made, case when i % 300 between 250 and 270 then null else truth end as held, case when i % 300 between 250 and 270 then truth * 1.1 else truth end as filled from b),
m as (select n_name as subject, k, 100 + k * 70 as ei from nation, range(0, 16) as r(k)),
j as (select m.subject, k, h.i - ei as rel, h.* exclude (subject, i) from m join h on h.subject = m.subject and h.i between ei - 20 and ei + 20)"""


@query(GAPS + """, q as (select subject, k, max(case when rel = 0 then held end) as own, bool_or(rel < 0 and held is null) as b, bool_or(rel >= 0 and held is null) as r from j group by all)
select subject, k::varchar as event_id, case when own is null then 'event_inside_gap' when b and r then 'baseline_and_response_intersect_gap' when b then 'baseline_intersects_gap' when r then 'response_intersects_gap' else 'complete' end as disposition from q""")
def gap_dispositions(spark, d):
    rows, marks = _gapped(spark, d)
    return reconstruction.event_disposition(rows, marks, value="held").select("subject", "event_id", "disposition")


@query(GAPS + """, q as (select subject, k, sqrt(avg((filled - truth) ** 2)) / max(abs(truth)) as rmse, max(truth) filter (rel >= 0) as tp, max(filled) filter (rel >= 0) as op, arg_max(rel, (truth, -rel)) filter (rel >= 0) as ti, arg_max(rel, (filled, -rel)) filter (rel >= 0) as oi,
avg(truth) filter (rel >= 0) as tr, avg(filled) filter (rel >= 0) as orr, avg(truth) filter (rel < 0) as tb, avg(filled) filter (rel < 0) as ob, avg(made::int) as share from j group by all)
select subject, k::varchar as event_id, round(share, 6) as reconstructed_fraction, round(rmse, 6) as waveform_rmse, round(abs(op - tp) / abs(tp), 6) as peak_error, round(abs(oi - ti)::double, 6) as peak_time_error_samples, round(abs(orr - tr) / abs(tr), 6) as response_error,
round(abs(orr - ob - (tr - tb)) / greatest(abs(tr - tb), 1e-12), 4) as contrast_error from q""")
def reconstruction_errors(spark, d):
    rows, marks = _gapped(spark, d)
    out = reconstruction.reconstruction_metrics(rows, marks, truth="signal", observed="filled", reconstructed="made", rate_hz=20.0)
    out = rounded(out, "reconstructed_fraction", "waveform_rmse", "peak_error", "peak_time_error_samples", "response_error").withColumn("contrast_error", F.round("contrast_error", 4))
    return out.select("subject", "event_id", "reconstructed_fraction", "waveform_rmse", "peak_error", "peak_time_error_samples", "response_error", "contrast_error")


FLAGS = """f as (select m.subject, m.session, m.event_id, m.condition, avg((s.reference > 90)::int) as r, avg((s.reference > 90)::int) filter (s.t_us < m.t_us) as b from markers m join samples s on s.subject = m.subject and s.session = m.session and s.t_us >= m.t_us - 3600000000 and s.t_us < m.t_us + 3600000000 group by all)"""


def _flagged(spark, d):
    marked = views.samples(spark, d).withColumn("rebuilt", F.col("reference") > 90)
    out = events.window_means(views.markers(spark, d), marked, (-HOUR, HOUR), value="signal", name="around", flag="rebuilt")
    return views.markers(spark, d).join(out, [*KEYS, "event_id"]).withColumnRenamed("around_flagged", "flagged")


@query("with " + FLAGS + " select subject, event_id, round(r, 6) as flagged from f", "samples", "markers")
def window_flag_fraction(spark, d):
    return rounded(_flagged(spark, d), "flagged").select("subject", "event_id", "flagged")


@query("with " + FLAGS + ", c as (select condition, avg(r) as m from f group by all) select round(min(m), 6) as lowest, round(max(m), 6) as highest, max(m) - min(m) > 1e-8 + 1e-5 * abs(min(m)) as warning from c", "samples", "markers")
def condition_reconstruction(spark, d):
    return rounded(reconstruction.condition_reconstruction_warning(_flagged(spark, d)), "lowest", "highest")


ISO = LAGS + """, k as (select c.*, x - lag(x) over o as dx, y - lag(y) over o as dy from c window o as (partition by subject, run_id order by i)), z as (select subject, count(*) as n, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) as zero, stddev_pop(y) / stddev_pop(x) as sd from c group by all),
s as (select a.subject, l, sum(a.dx * b.dy) / sqrt(sum(a.dx * a.dx) * sum(b.dy * b.dy)) as r from (select *, unnest(range(-2, 3)) as l from k) a join k b on a.subject = b.subject and a.run_id = b.run_id and b.i = a.i + l where a.dx is not null and b.dy is not null group by all),
t as (select subject, max(case when l = 0 then r end) as r0, arg_max(r, (round(abs(r), 9), -l)) as rb, arg_max(l, (round(abs(r), 9), -l)) as lb from s group by all)"""


@query(ISO + " select subject, n, round(zero, 6) as zero_lag, round(sd, 6) as sd_ratio, round(r0, 6) as step_zero, round(rb, 6) as step_best, lb as best_lag, round(abs(rb) - abs(r0), 6) as lag_improvement from z join t using (subject)", "samples")
def isosbestic(spark, d):
    out = population.isosbestic_metrics(views.samples(spark, d), ("subject",), max_lag=2, gap_factor=None, max_gap_s=4 * HOUR)
    return rounded(out, "zero_lag", "sd_ratio", "step_zero", "step_best", "lag_improvement").select("subject", "n", "zero_lag", "sd_ratio", "step_zero", "step_best", "best_lag", "lag_improvement")


# -- associations with a covariate and against blocks

SHIFTED = """r as (select *, lag(signal, 2) over (partition by subject, session order by idx) as reference from traces), k as (select * from r where reference is not null)"""


def _shifted(spark, d):
    return views.traces(spark, d).withColumn("reference", F.lag("signal", 2).over(Window.partitionBy(*KEYS).orderBy("idx")))


@query("with " + SHIFTED + """, f as (select *, covar_pop(signal, idx) over p / var_pop(idx) over p as sx, covar_pop(reference, idx) over p / var_pop(idx) over p as sy, avg(signal) over p as mx, avg(reference) over p as my, avg(idx) over p as mi from k window p as (partition by subject, session)),
c as (select subject, session, idx, signal - mx - sx * (idx - mi) as x, reference - my - sy * (idx - mi) as y from f)
select a.subject, a.session, l as lag, round(sum(a.x * b.y) / sqrt(sum(a.x * a.x) * sum(b.y * b.y)), 6) as correlation, count(*) as n_pairs from (select *, unnest(range(-1, 2)) as l from c) a join c b on a.subject = b.subject and a.session = b.session and b.idx = a.idx + l group by all""", "traces")
def residual_lags(spark, d):
    return rounded(association.lagged_association(_shifted(spark, d), KEYS, max_lag=1, covariate="idx"), "correlation").select(*KEYS, "lag", "correlation", "n_pairs")


@query("with " + SHIFTED + """, c as (select subject, session, idx, signal - avg(signal) over p as x, reference - avg(reference) over p as y from k window p as (partition by subject, session))
select subject, session, count(*) // 10 as blocks, round(sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) as zero_lag, true as p_possible from c where idx < 62 group by all""", "traces")
def block_permutation(spark, d):
    """Blocks and zero-lag correlation; the drawn p value is only held to the values that 19 draws can give."""
    out = association.blocked_permutation(_shifted(spark, d), KEYS, block=10, resamples=19)
    twentieths = F.col("p_value") * 20
    return rounded(out, "zero_lag").select(*KEYS, "blocks", "zero_lag", ((F.abs(twentieths - F.round(twentieths)) < 1e-9) & twentieths.between(1 - 1e-9, 20 + 1e-9)).alias("p_possible"))


# -- designs judged before outcomes

@query("""with m(ch, a, b) as (values (1, 2::double, 0.5::double), (2, 0.25, 3), (3, 1, 1)), g as (select sum(a * a) as p, sum(a * b) as q, sum(b * b) as r from m), e as (select (p + r) / 2 as mid, sqrt(((p - r) / 2) ** 2 + q * q) as off from g)
select case when mid - off > 0 then 2 else 1 end::bigint as rank, round(sqrt((mid + off) / (mid - off)), 6) as condition, sqrt((mid + off) / (mid - off)) <= 1000 as identifiable, (select count(*) from m x, m y where x.ch < y.ch and x.a * y.b <> x.b * y.a) as solvable from e""")
def mixing_design(spark, d):
    found = association.assess_mixing(np.array([[2, 0.5], [0.25, 3], [1, 1]]))
    return spark.createDataFrame([(found["rank"], round(found["condition"], 6), found["identifiable"], sum(found["solvable_without"]))], "rank long, condition double, identifiable boolean, solvable long")


@query("""with k as (select i, exp(-i * 0.05 / 0.5) - exp(-i * 0.05 / 0.1) as v from range(0, 60) as r(i)) select i as place, round(v / sum(v) over (), 9) as weight from k""")
def kinetic_kernel(spark, d):
    weights = association.kinetic_kernel(0.1, 0.5, 0.05)
    return spark.createDataFrame([(i, round(float(w), 9)) for i, w in enumerate(weights)], "place long, weight double")


# -- independent units

UNITS = """u as (select o_custkey as animal, avg(o_totalprice) as mean from orders group by all), g as (select animal, mean, c_mktsegment from u join customer on c_custkey = animal where c_mktsegment in ('BUILDING', 'MACHINERY')),
s as (select sum(mean) filter (c_mktsegment = 'BUILDING') as sa, count(*) filter (c_mktsegment = 'BUILDING') as na, sum(mean) filter (c_mktsegment = 'MACHINERY') as sb, count(*) filter (c_mktsegment = 'MACHINERY') as nb from g)"""


@query("with " + UNITS + """, w as (select animal, c_mktsegment, case when c_mktsegment = 'BUILDING' then (sa - mean) / (na - 1) - sb / nb else sa / na - (sb - mean) / (nb - 1) end as without, sa / na - sb / nb as whole from g, s where na > 1 and nb > 1)
select animal, c_mktsegment, round(without, 4) as without, round(without - whole, 4) as shift from w""")
def unit_influence(spark, d):
    means = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("animal")).agg(F.avg("o_totalprice").alias("mean"))
    cells = means.join(views.table(spark, d, "customer").select(F.col("c_custkey").alias("animal"), "c_mktsegment"), "animal")
    return rounded(inference.influence(cells, unit="animal", factor="c_mktsegment", numerator="BUILDING", denominator="MACHINERY"), "without", "shift", digits=4)


@query("""with u as (select n_regionkey as g, n_nationkey as k, avg(o_totalprice) as m from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where n_regionkey in (0, 1) group by all),
l as (select list(m order by g, k) as v, count(*) filter (g = 0) as na, count(*) as n, abs(avg(m) filter (g = 0) - avg(m) filter (g = 1)) as d, sum(m) as tot from u), x as (select *, unnest(range(0, 1::bigint << n)) as mask from l),
y as (select mask, na, n, d, tot, sum(case when (mask >> i) & 1 = 1 then v[i + 1] else 0 end) as s from (select *, unnest(range(0, n)) as i from x where bit_count(mask) = na) group by all)
select round((1 + count(*) filter (abs(s / na - (tot - s) / (n - na)) >= d - 1e-6)) / (count(*) + 1), 9) as p_value, max(n) as units from y""")
def label_permutation(spark, d):
    orders = views.table(spark, d, "orders").join(views.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nations = views.table(spark, d, "nation").where("n_regionkey in (0, 1)")
    cells = orders.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.avg("o_totalprice").alias("mean"))
    rows = cells.collect()  # a row for each unit
    a, b = (np.array([r["mean"] for r in rows if r["n_regionkey"] == level]) for level in (0, 1))
    return spark.createDataFrame([(round(inference.label_shuffle_p(a, b), 9), len(rows))], "p_value double, units long")


# -- delimited files

EPOCH_US = 1_704_067_200_000_000


def _folder(spark, name: str) -> str:
    """A new path in the shared folder; a machine's own folder serves local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or tempfile.mkdtemp()}/{uuid.uuid4().hex}-{name}"


def _seconds(column: str = "t_us"):
    return F.format_string("%.6f", (F.col(column) - EPOCH_US) / 1e6)


@query(f"select 'made-up' as subject, 's1' as session, 'green' as channel, t_us - {EPOCH_US} as t_us, signal, reference from samples", "samples")
def tabular_recording(spark, d):
    path = _folder(spark, "recording.csv")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c)
    views.samples(spark, d).select(_seconds().alias("time"), shown("signal"), shown("reference")).write.option("header", True).csv(path)
    return tabular.load_recording(spark, path, tabular.RecordingColumns("time", {"green": ("signal", "reference")}), subject="made-up", session="s1").select(*KEYS, "channel", "t_us", "signal", "reference")


@query(f"select 'made-up' as subject, 's1' as session, event_id, t_us - {EPOCH_US} as t_us, condition, condition = 'error' as failed, event_id::bigint % 7 as trial, (event_id::bigint % 7) / 4.0::double as score from markers", "samples", "markers")
def tabular_events(spark, d):
    path, trial = _folder(spark, "events.tsv"), F.col("event_id").cast("long") % 7
    failed = F.when(F.col("condition") == "error", "yes").otherwise("FALSE")
    views.markers(spark, d).select(_seconds().alias("onset"), "event_id", "condition", failed.alias("failed"), trial.alias("trial"), (trial / 4).alias("score")).write.option("header", True).option("sep", "\t").csv(path)
    kinds = {"condition": "string", "failed": "bool", "trial": "int", "score": "float"}
    return tabular.load_events(spark, path, tabular.EventColumns("onset", "event_id", kinds), subject="made-up", session="s1")
