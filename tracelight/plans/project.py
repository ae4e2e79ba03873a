"""Projects declared in TOML: sessions, column roles and one analysis; unknown keys are refused."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelight.plans import specs
from tracelight.plans.pipeline import clock_facts, compatibility, run_pipeline
from tracelight.sources import evidence, tabular

ALLOWED = {
    "": {"title", "output", "sessions", "recording", "events", "analysis"},
    "sessions": {"subject", "session", "recording", "events"},
    "recording": {"time", "unit", "delimiter", "channels"},
    "channels": {"signal", "reference"},
    "events": {"time", "id", "condition", "unit", "delimiter"},
    "analysis": {"numerator", "denominator", "channel", "preprocessing", "method", "baseline", "response", "statistic", "blocking", "acknowledged", "randomized"},
}


def _known(table: dict, kind: str) -> dict:
    extra = set(table) - ALLOWED[kind]
    if extra:
        raise ValueError(f"unknown keys in [{kind or 'project'}]: {sorted(extra)}")
    return table


@dataclass(frozen=True)
class Project:
    title: str
    output: Path
    sessions: tuple[dict, ...]
    recording: tabular.RecordingColumns
    events: tabular.EventColumns
    channel: str
    spec: specs.PipelineSpec
    digest: str


def load_project(path: str | Path) -> Project:
    path = Path(path)
    raw = path.read_bytes()
    data = _known(tomllib.loads(raw.decode()), "")
    rec, ev, an = _known(data["recording"], "recording"), _known(data["events"], "events"), _known(data["analysis"], "analysis")
    channels = {name: (_known(c, "channels")["signal"], c.get("reference")) for name, c in rec["channels"].items()}
    config = specs.EventAnalysisConfig(
        data.get("title", path.stem), an["numerator"], an["denominator"], channel=an["channel"], preprocessing_kind=an.get("preprocessing", "reference"), preprocessing_method=an.get("method", "irls"), statistic=an.get("statistic", "delta"),
        **{k: an[k] for k in ("baseline", "response") if k in an}, randomized=bool(an.get("randomized", False)), acknowledged_assumptions=an.get("acknowledged", ()), blocking_warnings=an.get("blocking", ()),
    )
    spec = specs.pipeline_of(config)
    sessions = tuple({**_known(s, "sessions"), "recording": str(path.parent / s["recording"]), "events": str(path.parent / s["events"])} for s in data["sessions"])
    return Project(
        data.get("title", path.stem), path.parent / data.get("output", "results"), sessions, tabular.RecordingColumns(rec["time"], channels, rec.get("unit", "seconds"), rec.get("delimiter")),
        tabular.EventColumns(ev["time"], ev["id"], {ev["condition"]: "string"}, ev.get("unit", "seconds"), ev.get("delimiter")), an["channel"], spec, hashlib.sha256(raw).hexdigest(),
    )


def load_tables(spark: SparkSession, project: Project) -> tuple[DataFrame, DataFrame]:
    samples = events = None
    condition = next(iter(project.events.columns))
    for s in project.sessions:
        one = tabular.load_recording(spark, s["recording"], project.recording, subject=s["subject"], session=s["session"]).where(F.col("channel") == project.channel)
        two = tabular.load_events(spark, s["events"], project.events, subject=s["subject"], session=s["session"]).withColumnRenamed(condition, "condition")
        samples, events = (one, two) if samples is None else (samples.unionByName(one), events.unionByName(two))
    return samples, events


def run_project(spark: SparkSession, project: Project) -> dict:
    """Preflight, ledger, report and manifest under the output folder; a run that fails leaves a manifest that says so."""
    out = project.output
    evidence.write_manifest(out.resolve() if out.exists() else _made(out), "running")
    try:
        samples, events = load_tables(spark, project)
        variables = {"signal"} | ({"reference"} if any(ref for _, ref in project.recording.channels.values()) else set())
        issues = compatibility(project.spec, clock_facts(samples, ("subject", "session")), variables)
        evidence.write_atomic(out / "preflight.json", evidence.to_json({"issues": issues, "sessions": len(project.sessions), "source_sha256": project.digest}))
        ledger = {"status": "incompatible", "result": None, "blocking": [i["code"] for i in issues]} if issues else run_pipeline(project.spec, samples, events)
        evidence.write_atomic(out / "analysis.json", evidence.to_json(ledger | {"created_at": datetime.now(timezone.utc).isoformat()}))
        sections = {"Result": [ledger["result"]] if ledger["result"] else [], "Units": ledger.get("units", []), "Dispositions": [ledger["dispositions"]] if ledger.get("dispositions") else [], "Issues": issues}
        evidence.write_atomic(out / "report.html", evidence.render_html(project.title, sections).encode())
        evidence.write_manifest(out, {"success": "complete", "blocked": "blocked"}.get(ledger["status"], "failed"), source_sha256=project.digest)
        return ledger
    except Exception as error:
        evidence.write_manifest(out, "failed", error=f"{type(error).__name__}: {error}"[:500])
        raise


def _made(folder: Path) -> Path:
    folder.mkdir(parents=True)
    return folder
