"""A self-contained HTML page: no scripts, all text escaped."""

from __future__ import annotations

import os
from html import escape

from ..functions.money import humane_text
from ..operators.checks import TYPES
from ..plans.run import Report
from .json import summary

STYLE = "body{font:15px/1.5 sans-serif;max-width:60em;margin:2em auto;color:#222}table{border-collapse:collapse;width:100%}td,th{padding:.3em .6em;border-bottom:1px solid #ddd;text-align:left}.n{text-align:right}.bar{background:#4a76a8;height:.8em}code{font-size:.85em}"


def _table(head: list[str], rows: list[list[str]]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{c}</{tag}>" for c in row)
    return f"<table><tr>{cells('th', map(escape, head))}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def render(report: Report) -> str:
    s, e = summary(report), lambda x: escape(str(x))
    most = max((v["magnitude_cents"] for v in s["by_classification"].values()), default=0) or 1
    found = {f.cluster_id: f for f in report.findings}
    bars = [[e(k), str(v["clusters"]), str(v["breaks"]), e(humane_text(v["magnitude_cents"])), f'<div class="bar" style="width:{100 * v["magnitude_cents"] / most:.1f}%"></div>'] for k, v in s["by_classification"].items()]
    rows = []
    for c in report.clusters:
        f, a = found.get(c["cluster_id"]), c["attribution"]
        why = f"{e(f.classification)} ({f.confidence:.2f}): {e(f.explanation)}" if f else ""
        if a:
            parts = ", ".join(f"{e(p['label'])} {e(humane_text(p['value']) if a['measure'] == 'cents' else p['value'])}" for p in a["components"])
            why = f"{'explained' if a['explained'] else 'partly explained'}: {parts}" + (f"; {why}" if why else "")
        age = (report.history or {}).get("cluster_ages", {}).get(c["cluster_id"])
        since = f"{age['new']} new, {age['carried']} carried since run {age['since']}" if age and age["carried"] else "new" if age else ""
        rows.append([f"<code>{e(c['cluster_id'])}</code>", e(TYPES[c["type"]][1]), f"<code>{e(c['signature'])}</code>", str(c["break_count"]), e(humane_text(c["magnitude_cents"])), why, e(since)])
    past = ""
    if report.history:
        h = report.history
        past = "<h2>Since the last run</h2>" + _table(["", "Breaks", "Row-level money"], [[e(k.replace("_", " ")), str(h[k]["breaks"]), e(humane_text(h[k]["row_level_cents"]))] for k in ("new", "still_open", "resolved")])
        past += "".join(f"<p>{e(x['source'])}: {e(x['change'].replace('_', ' '))} {e(x['column'])}</p>" for x in h["schema_changes"])
    matched = _table(["Matching", ""], [[e(k.replace("_", " ")), e(v)] for k, v in report.matching.items()])
    return (
        f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Reconciliation report</title><style>{STYLE}</style></head><body><h1>{s["break_count"]} breaks in {s["cluster_count"]} clusters</h1>'
        f"<p>Row-level impact {e(humane_text(s['row_level_impact_cents']))}. Fingerprint <code>{e(report.fingerprint)}</code>.</p><h2>By cause</h2>{_table(['Class', 'Clusters', 'Breaks', 'Money', ''], bars)}"
        f"{past}<h2>Clusters</h2>{_table(['Id', 'Type', 'Signature', 'Breaks', 'Money', 'Why', 'Age'], rows)}<h2>Inputs</h2>{matched}"
        f"{_table(['Side', 'Path', 'Digest'], [[e(k), e(v['path']), f'<code>{e(v["digest"])}</code>'] for k, v in report.inputs.items()])}</body></html>\n"
    )


def write(report: Report, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(render(report))
    return path
