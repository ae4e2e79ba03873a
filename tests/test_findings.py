"""Cases a reviewer found: few units, samples that share a time, dense recordings."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tracelight import functions, queries, views
from tracelight.kernels.order import Windows, first_stable
from tracelight.operators import events, inference, multiscale, transients
from tracelight.operators.joins import bracket, range_join

KEYS = ("subject", "session")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """The small events three times over, at the same times in the same recordings."""
    folder = tmp_path_factory.mktemp("tied")
    duckdb.sql(f"copy (select event_id + i * 1000000 as event_id, ts, user_id + i * 1200 as user_id, event_type, value, props from '/root/testdata/sf0.001/events.parquet', range(3) r(i)) to '{folder}/events.parquet'")
    return str(folder)


def sql_rows(tied, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tied}/events.parquet'")
    return con.sql(queries.ORACLE[name]).df()


def same(got: pd.DataFrame, want: pd.DataFrame):
    by = sorted(want.columns)
    got, want = (x[by].sort_values(by).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=2e-6, rtol=0)


def test_multiscale_animals_without_covered_windows(spark, tmp_path):
    # every other sample is missing, so no window is covered and no animal has an estimate
    duckdb.sql(f"copy (select event_id, ts, user_id, event_type, case when event_id % 2 = 0 then 300.0 else value end as value, props from '/root/testdata/sf0.001/events.parquet') to '{tmp_path}/events.parquet'")
    assert [tuple(r) for r in queries.REGISTRY["multiscale_animals"](spark, str(tmp_path)).collect()] == [(None, None, None, None, 0)]


def test_sign_flips_without_units(spark):
    # as the SQL says, one empty assignment and no estimate
    none = spark.createDataFrame([], "u string, contrast double")
    assert [tuple(r) for r in inference.exact_sign_flips(none, "u").collect()] == [(None, None, 1)]


def test_progress_of_every_sample_at_a_time(spark, tied):
    # F4
    same(queries.REGISTRY["interval_progress"](spark, tied).toPandas(), sql_rows(tied, "interval_progress"))


def test_influence_of_a_unit_alone(spark):
    # the SQL keeps the unit and divides nothing by nothing
    alone = spark.createDataFrame([("a", 0.5)], "u string, contrast double")
    (row,) = inference.leave_one_out(alone, "u").collect()
    assert row["u"] == "a" and math.isnan(row["without"]) and math.isnan(row["shift"])


def test_no_windows_in_a_run_without_span(spark):
    # three samples at one time are a run, but there is no time to lay a window on
    rows = spark.createDataFrame([("m", "s", t, float(v)) for t, v in ((0, 1), (0, 2), (0, 3), (50_000_000, 4), (51_000_000, 5), (52_000_000, 6))], "subject string, session string, t_us long, signal double")
    out = multiscale.summarize_multiscale(rows, KEYS, windows=[("two", 2.0, 1.0)], gap_factor=3.0).collect()
    assert sorted((r["ordinal"], r["w1"] - r["w0"]) for r in out) == [(0, 2_000_000), (1, 1_000_000)]


def test_unmixing_of_samples_that_share_a_time(spark, tied):
    # F7
    got, want = queries.REGISTRY["optical_unmixing"](spark, tied).toPandas(), sql_rows(tied, "optical_unmixing")
    assert len(want) % 3 == 0
    same(got, want)


def test_order_statistics_of_windows():
    # medians and deviations of windows against sorting each of them
    rng = np.random.default_rng(1)
    for size, digits in ((1, 0), (2, 0), (60, 0), (61, 1), (300, 3)):
        x = np.round(rng.normal(0, 3, size), digits)
        i = rng.integers(0, size, 200)
        j = i + 1 + rng.integers(0, size, 200) % (size - i)
        windows = Windows(x)
        middle = windows.median(i, j)
        assert np.array_equal(middle, [np.median(x[a:b]) for a, b in zip(i, j)])
        assert np.allclose(windows.median_deviation(i, j, middle), [np.median(np.abs(x[a:b] - m)) for a, b, m in zip(i, j, middle)], rtol=0, atol=1e-15)
        for stable in (1, 2, 3):
            reach = rng.random(200)
            want = [next((k for k in range(a, b - stable + 1) if (np.abs(x[k : k + stable] - m) <= r).all()), -1) for a, b, m, r in zip(i, j, middle, reach)]
            assert first_stable(x, i, j, middle, reach, stable, block=4).tolist() == want


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pulse_recovery", "event_confounds", "event_contrast", "condition_exclusion", "event_windows", "event_coverage", "condition_reconstruction", "window_flag_fraction"])
def test_windows_pair_no_samples(spark, name):
    # Targets are not joined with the samples of their windows, row by row
    plan = plan_of(queries.REGISTRY[name](spark, "/root/testdata/sf0.001"))
    assert "_bucket" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_window_means_keep_nulls_and_odd_values(spark):
    # a window with an infinite value does not spoil the ones beside it
    rows = spark.createDataFrame([("a", t * 1_000_000, v) for t, v in enumerate([1.0, None, float("inf"), 4.0, 6.0])], "subject string, t_us long, signal double")
    marks = spark.createDataFrame([("a", str(t), t * 1_000_000) for t in (0, 1, 2, 3, 9)], "subject string, event_id string, t_us long")
    out = {r["event_id"]: (r["w_mean"], r["w_fraction"]) for r in events.window_means(marks, rows, (0, 2), value="signal", name="w", keys=("subject",)).collect()}
    assert out == {"0": (None, 0.5), "1": (None, 0.5), "2": (float("inf"), 1.0), "3": (5.0, 1.0)}


def test_runs_are_streamed_whole(spark):
    # runs cut by batches, short runs between long ones, samples that share a time
    rows = [("m", f"s{k:03}", t * 1_000_000, float((t * 7 + k) % 5)) for k in range(40) for t in range(1 + (k * 13) % 50)] + [("m", "tied", 0, float(v)) for v in (1, 3, 2)]
    table = spark.createDataFrame(rows, "subject string, session string, t_us long, signal double")
    find = lambda: {(r["session"], r["sample"], r["t_us"], r["peak"]) for r in transients.detect_amplitude(table, KEYS, amplitude=1.0, start_s=3.0, end_s=0.0).collect()}
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        found = []
        for size in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found.append(find())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = set()
    for k in range(40):
        x = [float((t * 7 + k) % 5) for t in range(1 + (k * 13) % 50)]
        want |= {(f"s{k:03}", t, t * 1_000_000, x[t]) for t in range(1, len(x) - 1) if x[t] > max(x[t - 1], x[t + 1]) and x[t] - np.mean(x[max(0, t - 3) : t]) >= 1.0}
    assert found == [want, want]
    assert "MapInArrow" in plan_of(transients.detect_amplitude(table, KEYS, amplitude=1.0))


def test_bracket_reaches_over_empty_hours(spark):
    # a task holds an hour of a recording, neighbours may lie hours away or be missing
    hour = 3_600_000_000
    table = spark.createDataFrame([("a", t, v) for t, v in ((5 * hour, 1.0), (5 * hour + 7, 2.0), (9 * hour + 3, 3.0))] + [("b", 0, 9.0)], "k string, t_us long, v double")
    asked = spark.createDataFrame([("a", t) for t in (0, 5 * hour, 5 * hour + 1, 7 * hour, 9 * hour + 3, 30 * hour)] + [("c", 0)], "k string, t_us long")
    out = bracket(asked, table, ("k",), carry=("v",))
    got = {(r["k"], r["t_us"]): (r["b_v"], r["a_v"]) for r in out.collect()}
    assert got == {("a", 0): (None, 1.0), ("a", 5 * hour): (1.0, 1.0), ("a", 5 * hour + 1): (1.0, 2.0), ("a", 7 * hour): (2.0, 3.0), ("a", 9 * hour + 3): (3.0, 3.0), ("a", 30 * hour): (3.0, None), ("c", 0): (None, None)}
    assert "hashpartitioning(k#" in plan_of(out) and "_hour" in plan_of(out)


def test_progress_of_dense_recordings_unrolls_arrays(spark, tied):
    # a bucket's clicks are one row of the join, and no weight is rounded through a decimal number
    out = queries.REGISTRY["progress_basis"](spark, tied)
    same(out.toPandas(), sql_rows(tied, "progress_basis"))
    plan = plan_of(out)
    assert "Generate inline(_points" in plan and "round(" not in plan and "REPARTITION_BY_NUM" in plan


def test_packed_range_join_has_the_same_rows(spark):
    # ends, ranges over several buckets or turned around, points that share a time, missing keys
    points = spark.createDataFrame([(k, t, f"{k}{t}{i}") for k in ("a", "b", None) for t in (0, 9, 10, 10, 25, 39) for i in (0, 1)], "k string, t_us long, name string")
    ranges = spark.createDataFrame([("a", 1, 0, 10), ("a", 2, 5, 40), ("a", 3, 26, 24), ("b", 4, 25, 25), ("c", 5, 0, 99), (None, 6, 0, 99)], "k string, rid int, start_us long, stop_us long")
    for closed in (False, True):
        for how in ("inner", "left"):
            plain, packed = (range_join(points, ranges, ("k",), bucket_us=10, closed=closed, how=how, packed=p) for p in (False, True))
            assert plain.columns == packed.columns
            assert sorted(map(str, plain.collect())) == sorted(map(str, packed.collect()))


def test_tasks_of_a_design_grow_with_its_files(spark, monkeypatch):
    # the rows of a task stay as many when line items grow, and Spark does not join its partitions to fewer
    items = views.table(spark, SMALL, "lineitem")
    assert functions.tasks_for(items) == 1
    monkeypatch.setattr(functions, "TASK_BYTES", 1 << 14)
    tasks = functions.tasks_for(items)
    assert tasks > 4 and functions.tasks_for(items, items) in (2 * tasks - 1, 2 * tasks)
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "k long")
    assert functions.tasks_for(unknown) == 4 and functions.tasks_for(items.join(unknown, items["l_orderkey"] == unknown["k"])) == 4
    table = views.observations(spark, SMALL)
    assert table.rdd.getNumPartitions() >= tasks
    out = queries.REGISTRY["design_validation"](spark, SMALL)
    assert "hashpartitioning(observation#" in plan_of(out) and "REPARTITION_BY_NUM" in plan_of(out)
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    rows = lambda frame: sorted(map(tuple, frame[["check", "unit", "found"]].astype(str).itertuples(index=False)))
    assert rows(out.toPandas()) == rows(con.sql(queries.ORACLE["design_validation"]).df())
