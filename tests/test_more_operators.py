"""Model families, power, influence, kinetics gates, network nulls, held-out channels and behaviour files."""

import numpy as np
import pytest

from tracelight import model
from tracelight.operators import association, encoding, inference
from tracelight.sources import tabular


def group_grams():
    rng = np.random.default_rng(0)
    tables = []
    for _ in range(6):
        x = rng.normal(size=(80, 3))
        y = x @ [2.0, 0.0, 0.0] + rng.normal(0, 0.5, 80)
        full = np.column_stack([x, np.ones(80), y])
        tables.append(full.T @ full)
    return encoding.GroupGrams(["cue:0", "cue:1", "noise:0"], [f"m{i}" for i in range(6)], np.array(tables))


def test_families_and_models():
    found = group_grams()
    out = {r["family"]: r for r in encoding.family_contributions(found, {"cue": ["cue:0", "cue:1"], "noise": ["noise:0"]}, folds=3)}
    assert out["cue"]["low"] > 0.5 and abs(out["noise"]["gain"]) < 0.05
    with pytest.raises(ValueError):
        encoding.family_contributions(found, {"x": ["y"]})
    ledger = encoding.run_models(found, {"full": found.columns, "none": ["missing"]}, folds=3)
    assert [r["status"] for r in ledger] == ["success", "failed"] and ledger[0]["score"] > 0.8


def test_power_and_influence(spark):
    rows = inference.welch_power(6, (0.4, 0.8), (1.0, 2.0))
    assert len(rows) == 4 and rows[2]["power"] == pytest.approx(0.24, abs=0.02) and rows[0]["power"] < rows[2]["power"]
    cells = spark.createDataFrame([("u1", "a", 1.0), ("u2", "a", 3.0), ("u3", "b", 0.0), ("u4", "b", 1.0), ("u5", "b", 2.0)], "unit string, level string, mean double")
    got = {r["unit"]: r["without"] for r in inference.influence(cells, unit="unit", factor="level", numerator="a", denominator="b").collect()}
    assert got == {"u1": 2.0, "u2": 0.0, "u3": 0.5, "u4": 1.0, "u5": 1.5}


def test_gates_and_nulls():
    weights = association.kinetic_kernel(0.1, 0.5, 0.02)
    fine = association.kinetic_identifiability(weights, [1000, 10], 0.02, 0.1, strength=1e-3)
    assert fine["problems"] == [] and fine["eligible_runs"] == 1
    assert association.kinetic_identifiability(weights, [10], 0.1, 0.1)["problems"][-1] == "no_run_long_enough"
    assert association.pair_hazards({"detector": "d", "excitation_nm": 470, "emission_nm": 520}, {"detector": "d", "excitation_nm": 480, "emission_nm": 600}) == ["shared_detector", "excitation_too_near"]
    edges = [{"a": f"s{i}", "b": f"s{j}", "distance": float(j - i), "fisher_z": 1.0 / (j - i)} for i in range(8) for j in range(i + 1, 8)]
    r, p = association.node_permutation(edges, resamples=200)
    assert r < -0.8 and p < 0.05


def test_held_out_channels(spark):
    rng = np.random.default_rng(1)
    m = {"g": {"x": 1.0, "y": 0.2}, "r": {"x": 0.1, "y": 1.0}, "b": {"x": 0.5, "y": 0.5}}
    rows = []
    for i in range(50):
        x, y = map(float, rng.normal(size=2))
        rows += [("a", "1", c, i, float(i), x * w["x"] + y * w["y"], None) for c, w in m.items()]
    out = association.holdout_channels(spark.createDataFrame(rows, model.SAMPLES), m).collect()
    assert len(out) == 3 and all(r["correlation"] > 0.999999 and r["rmse"] < 1e-9 and r["n"] == 50 for r in out)


def test_aggregated_behaviour_file(spark, tmp_path):
    path = tmp_path / "b.tsv"
    path.write_text("Observation id\tSubject\tBehavior\tBehavior type\tStart (s)\tStop (s)\no1\tm1\tgroom\tSTATE\t1.5\t2\no1\tm1\tpeck\tPOINT\t3\t3\no1\tm2\tpeck\tPOINT\t9\t9\n")
    with pytest.raises(ValueError, match="choose one"):
        tabular.load_aggregated(spark, str(path), subject="m1", session="1")
    got = sorted((r["label"], r["kind"], r["start_us"], r["stop_us"]) for r in tabular.load_aggregated(spark, str(path), subject="m1", session="1", source_subject="m1").collect())
    assert got == [("groom", "interval", 1_500_000, 2_000_000), ("peck", "point", 3_000_000, None)]
