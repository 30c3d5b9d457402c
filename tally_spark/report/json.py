"""The machine-readable report. Clusters and summaries are small; breaks are written one by one as they come from Spark."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict

from .. import VERSION
from ..functions.money import money_text
from ..operators.checks import TYPES
from ..plans.run import Report


def summary(report: Report) -> dict:
    by: dict[str, dict] = {}
    found = {f.cluster_id: f for f in report.findings}
    for c in report.clusters:
        explained = c["attribution"] and c["attribution"]["explained"]
        name = found[c["cluster_id"]].classification if c["cluster_id"] in found else "EXPLAINED" if explained else "NOT_INVESTIGATED"
        own = by.setdefault(name, {"clusters": 0, "breaks": 0, "magnitude_cents": 0})
        own["clusters"] += 1
        own["breaks"] += c["break_count"]
        own["magnitude_cents"] += abs(c["magnitude_cents"])
    ordered = dict(sorted(by.items(), key=lambda kv: (-kv[1]["magnitude_cents"], kv[0])))
    return {
        "break_count": sum(report.breaks_by_type.values()), "cluster_count": len(report.clusters), "row_level_impact": money_text(report.impact_cents), "row_level_impact_cents": report.impact_cents,
        "breaks_by_type": report.breaks_by_type, "by_classification": {k: v | {"magnitude": money_text(v["magnitude_cents"])} for k, v in ordered.items()},
    }


def usage(report: Report) -> dict:
    from ..explain.finding import Usage

    total = sum((f.usage for f in report.findings), Usage())
    return asdict(total) | {"total_tokens": total.total_tokens}


def _break(r: dict) -> dict:
    details = {k: v for k, v in r["details"].items() if v is not None}
    return {
        "id": r["id"], "type": r["type"], "level": r["level"], "label": TYPES[r["type"]][1], "partition": {"date": str(r["date"]) if r["date"] else None, "account_id": r["account_id"], "currency": r["currency"]},
        "magnitude": money_text(r["magnitude_cents"]), "magnitude_cents": r["magnitude_cents"], "ledger_refs": r["ledger_refs"], "warehouse_refs": r["warehouse_refs"], "details": details,
    }


def _cluster(report: Report, c: dict) -> dict:
    found = next((f for f in report.findings if f.cluster_id == c["cluster_id"]), None)
    out = {k: c[k] for k in ("cluster_id", "type", "level", "break_count", "magnitude_cents", "days", "rank")}
    out |= {"label": TYPES[c["type"]][1], "signature": json.loads(c["signature"]), "magnitude": money_text(c["magnitude_cents"]), "first_date": c["first_date"] and str(c["first_date"]), "last_date": c["last_date"] and str(c["last_date"])}
    out |= {"sample_breaks": [_break(s) for s in c["samples"]], "attribution": c["attribution"], "finding": found.to_dict() if found else None}
    return out | ({"history": report.history["cluster_ages"].get(c["cluster_id"])} if report.history else {})


def head(report: Report) -> dict:
    """The document without its breaks, which come last."""
    return {
        "schema_version": 1,
        "engine_version": VERSION,
        "run": {"started_at": report.started_at, "duration_seconds": round(report.seconds, 3), "deterministic_fingerprint": report.fingerprint},
        "config": asdict(report.settings),
        "inputs": report.inputs,
        "sources": report.profiles,
        "matching": report.matching,
        "summary": summary(report),
        "agent": {"enabled": report.settings.explain, "provider": report.settings.provider, "model_backed": any(f.model_backed for f in report.findings), "clusters_investigated": len(report.findings), "degraded": sum(f.degraded for f in report.findings), "usage": usage(report)},
        "history": report.history,
        "clusters": [_cluster(report, c) for c in report.clusters],
    }


def breaks(report: Report) -> Iterator[dict]:
    """All breaks in order, of which the driver holds one partition at a time."""
    for r in report.breaks.orderBy("type", "digest").toLocalIterator():
        yield _break(r.asDict(recursive=True))


def document(report: Report) -> dict:
    return head(report) | {"breaks": list(breaks(report))}


def write(report: Report, path: str) -> str:
    """The document, with all breaks however many, each on a line of its own."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(head(report), indent=2, default=str).removesuffix("\n}") + ',\n  "breaks": [')
        between = "\n    "
        for b in breaks(report):
            f.write(between + json.dumps(b, default=str))
            between = ",\n    "
        f.write("\n  ]\n}\n")
    return path
