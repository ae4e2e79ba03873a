"""Command line: inspect, run, compare, archive, verify-archive."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from tracelight.sources import evidence


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tracelight", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb, args in {"inspect": ["project"], "run": ["project"], "compare": ["left", "right"], "archive": ["bundle", "output"], "verify-archive": ["path"]}.items():
        sub = verbs.add_parser(verb)
        for a in args:
            sub.add_argument(a, type=Path)
        if verb == "compare":
            sub.add_argument("--absolute", type=float, default=0.0)
            sub.add_argument("--relative", type=float, default=0.0)
    told = parser.parse_args(argv)
    if told.verb == "compare":
        found = evidence.compare(json.loads(told.left.read_text()), json.loads(told.right.read_text()), absolute=told.absolute, relative=told.relative)
        print(json.dumps(found, indent=1))
        return int(bool(found))
    if told.verb == "archive":
        print(evidence.create_archive(told.bundle, told.output))
        return 0
    if told.verb == "verify-archive":
        print(evidence.verify_archive(told.path)["status"])
        return 0

    from pyspark.sql import SparkSession

    from tracelight.operators.runs import clock_summary
    from tracelight.plans.project import load_project, load_tables, run_project

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    project = load_project(told.project)
    if told.verb == "inspect":
        samples, events = load_tables(spark, project)
        for row in clock_summary(samples, ("subject", "session")).collect():
            print(json.dumps(row.asDict()))
        print(json.dumps({"events": events.count()}))
        return 0
    ledger = run_project(spark, project)
    print(json.dumps({"status": ledger["status"], "result": ledger["result"]}))
    return 0 if ledger["status"] == "success" else 2


if __name__ == "__main__":
    sys.exit(main())
