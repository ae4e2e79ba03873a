"""A declared project from files to evidence, and the command line on it."""

import json
import math

import pytest

from tracelight import cli
from tracelight.operators import population
from tracelight.plans.project import load_project, run_project

TOML = """
title = "contrast"
output = "results"
[recording]
time = "time"
channels.green = {signal = "gcamp", reference = "iso"}
[events]
time = "time"
id = "event_id"
condition = "condition"
[analysis]
numerator = "drug"
denominator = "control"
channel = "green"
method = "ols"
acknowledged = ["unit_contrasts_roughly_normal", "units_independent"]
"""


@pytest.fixture
def project(tmp_path):
    sessions = ""
    for a in range(4):
        lines = ["time,gcamp,iso"]
        for i in range(280):
            t = i / 20
            ref = 1 + 0.04 * math.sin(t / 3)
            bump = 0.06 + 0.005 * a if 6 <= t < 6.5 or 10 <= t < 10.5 else 0
            lines.append(f"{t},{2 + 0.5 * ref + bump},{ref}")
        (tmp_path / f"r{a}.csv").write_text("\n".join(lines))
        (tmp_path / f"e{a}.csv").write_text("time,event_id,condition\n6,a,drug\n10,b,drug\n4,c,control\n8,d,control\n")
        sessions += f'[[sessions]]\nsubject = "m{a}"\nsession = "1"\nrecording = "r{a}.csv"\nevents = "e{a}.csv"\n'
    path = tmp_path / "project.toml"
    path.write_text(TOML + sessions)
    return path


def test_project_runs_and_is_archived(spark, project, capsys):
    ledger = run_project(spark, load_project(project))
    out = project.parent / "results"
    assert ledger["status"] == "success" and ledger["result"]["low"] > 0
    manifest = json.loads((out / "manifest.json").read_text())
    assert manifest["status"] == "complete" and set(manifest["files"]) == {"preflight.json", "analysis.json", "report.html"}
    assert cli.main(["archive", str(out), str(project.parent / "a.zip")]) == 0
    assert cli.main(["verify-archive", str(project.parent / "a.zip")]) == 0
    assert cli.main(["compare", str(out / "analysis.json"), str(out / "analysis.json")]) == 0
    assert "complete" in capsys.readouterr().out


def test_unknown_keys_are_refused(project):
    project.write_text(project.read_text().replace('title = "contrast"', 'titel = "contrast"'))
    with pytest.raises(ValueError, match="unknown keys"):
        load_project(project)


def test_failed_runs_say_so(spark, project):
    (project.parent / "r0.csv").write_text("time,gcamp,iso\n0,oops,1\n")
    with pytest.raises(Exception):
        run_project(spark, load_project(project))
    assert json.loads((project.parent / "results" / "manifest.json").read_text())["status"] == "failed"


def test_animal_contrasts(spark):
    rows = [(f"m{i}", c, 1.0 + i + (2.0 if c == "b" else 0)) for i in range(6) for c in "ab"] + [("m9", "a", 5.0)]
    table = spark.createDataFrame(rows, "subject string, condition string, estimate double")
    up = population.infer_animals(table, a="a", b="b")
    assert up.estimate == pytest.approx(2) and up.excluded == ["m9"] and up.p == pytest.approx(3 / 65)
    assert population.infer_animals(table, a="a", b="b", sign="a-b").estimate == pytest.approx(-2)
    ratio = population.infer_animals(table, a="a", b="b", scale="ratio")
    assert ratio.estimate == pytest.approx(math.exp(sum(math.log((3 + i) / (1 + i)) for i in range(6)) / 6))
    with pytest.raises(ValueError):
        population.infer_animals(table.where("subject = 'm1'"), a="a", b="b")
