"""Every combination of declared alternatives, run over shared preprocessing, failures kept."""

from __future__ import annotations

from itertools import product
from statistics import median

from pyspark.sql import DataFrame

from tracelight.plans.pipeline import PrefixCache, clock_facts, compatibility, run_pipeline
from tracelight.plans.specs import MultiverseSpec, fingerprint, with_changes


def materialize(spec: MultiverseSpec) -> list[dict]:
    """Universes in the order of the product: id, choices, whether it is the reference or forbidden, and its pipeline."""
    names = [n.name for n in spec.decision_nodes]
    if len(set(names)) != len(names) or len(spec.reference_selection) != len(names):
        raise ValueError("nodes have distinct names and the reference one alternative of each")
    out = []
    for choice in product(*[n.alternatives for n in spec.decision_nodes]):
        labels = tuple(zip(names, (a.label for a in choice)))
        pipeline = spec.base_pipeline
        for a in choice:
            pipeline = with_changes(pipeline, a.changes)
        out.append({"id": fingerprint(pipeline)[:16], "choices": labels, "pipeline": pipeline, "is_reference": tuple(x for _, x in labels) == spec.reference_selection, "forbidden": any(rule <= set(labels) for rule in spec.compatibility_rules)})
    if sum(u["is_reference"] for u in out) != 1:
        raise ValueError("the reference is not one of the universes")
    return out


def run_multiverse(spec: MultiverseSpec, samples: DataFrame, events: DataFrame, keys=("subject", "session")) -> dict:
    """Status of every universe (success, blocked, failed, incompatible) and the summary over them."""
    clocks, cache = clock_facts(samples, keys).persist(), PrefixCache(samples, keys)
    results = []
    try:
        for u in materialize(spec):
            row = {k: u[k] for k in ("id", "choices", "is_reference")} | {"estimate": None, "p": None}
            issues = compatibility(u["pipeline"], clocks, {"signal", "reference"})
            if u["forbidden"] or issues:
                results.append(row | {"status": "incompatible", "reason": issues[0]["code"] if issues else "forbidden"})
                continue
            try:
                ledger = run_pipeline(u["pipeline"], samples, events, keys, cache=cache)
                found = ledger["result"] or {}
                results.append(row | {"status": ledger["status"], "reason": ",".join(ledger["blocking"]), "estimate": found.get("estimate"), "p": found.get("p")})
            except Exception as error:  # a universe that fails stays in the denominator
                results.append(row | {"status": "failed", "reason": f"{type(error).__name__}: {error}"[:300]})
    finally:
        cache.close()
        clocks.unpersist()
    return {"universes": results, "summary": summarize(spec, results), "shared_prefixes": cache.hits}


def meets(value: float, smallest: float, direction: str) -> bool:
    return {"positive": value >= smallest, "negative": value <= -smallest, "either": abs(value) >= smallest}[direction]


def summarize(spec: MultiverseSpec, results: list[dict]) -> dict:
    """Ranges and shares over all compatible universes; failed and blocked ones count in every share."""
    values = [r["estimate"] for r in results if r["status"] == "success" and r["estimate"] is not None]
    valid = sum(r["status"] != "incompatible" for r in results)
    share = lambda n: n / valid if valid else None
    decisions = {}
    for node in spec.decision_nodes:
        for a in node.alternatives:
            own = [r["estimate"] for r in results if r["status"] == "success" and r["estimate"] is not None and (node.name, a.label) in r["choices"]]
            decisions[f"{node.name}={a.label}"] = {"n": len(own), "median": median(own) if own else None}
    return {
        "total": len(results), "valid": valid, **{s: sum(r["status"] == s for r in results) for s in ("success", "blocked", "failed", "incompatible")},
        "range": (min(values), max(values)) if values else None, "median": median(values) if values else None, "positive": share(sum(v > 0 for v in values)), "negative": share(sum(v < 0 for v in values)),
        "practical": share(sum(meets(v, spec.smallest_effect, spec.direction) for v in values)) if spec.smallest_effect is not None else None,
        "reference": next((r["estimate"] for r in results if r["is_reference"]), None), "decisions": decisions,
    }


def lanes(results: list[dict], groups: dict[str, dict]) -> list[dict]:
    """Summaries of groups of universes with one unit each. groups: name -> units, node, alternatives.

    Each compatible universe lies in exactly one group, so units are never pooled."""
    used: dict[str, str] = {}
    out = []
    for name, g in groups.items():
        own = [r for r in results if r["status"] != "incompatible" and any(n == g["node"] and a in g["alternatives"] for n, a in r["choices"])]
        if not own:
            raise ValueError(f"group {name!r} selects no compatible universe")
        for r in own:
            if used.setdefault(r["id"], name) != name:
                raise ValueError(f"universe {r['id']} is in two groups")
        values = [r["estimate"] for r in own if r["status"] == "success" and r["estimate"] is not None]
        out.append({"group": name, "units": g["units"], "universes": len(own), "success": len(values), "range": (min(values), max(values)) if values else None, "median": median(values) if values else None, "positive": sum(v > 0 for v in values) / len(own), "negative": sum(v < 0 for v in values) / len(own)})
    missing = [r["id"] for r in results if r["status"] != "incompatible" and r["id"] not in used]
    if missing:
        raise ValueError(f"universes outside all groups: {missing}")
    return out
