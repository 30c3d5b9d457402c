"""The report on a terminal: 78 columns, colour where the terminal has it, plain ASCII where it can't show more."""

from __future__ import annotations

import textwrap

from ..functions.money import humane_text
from ..operators.checks import TYPES
from ..plans.run import Report
from .json import summary

WIDTH, SHOWN = 78, 12
_PLAIN = str.maketrans({"─": "-", "•": "*", "…": "."})


def _colour(text: str, code: int, on: bool) -> str:
    return f"\x1b[{code}m{text}\x1b[0m" if on else text


def render(report: Report, colour: bool = False, ascii_only: bool = False) -> str:
    s, m = summary(report), report.matching
    rule = "─" * WIDTH
    out = [rule, f"{s['break_count']} breaks in {s['cluster_count']} clusters, row-level impact {humane_text(s['row_level_impact_cents'])}", rule]
    out.append(f"matched {m['match_rate']:.2%}: {m['exact_key_sets']} by id, {m['composite_sets']} by composite key, {m['split_sets']} splits; unmatched {m['unmatched_ledger']} ledger, {m['unmatched_warehouse']} warehouse")
    out += [f"  {n:>9,}  {TYPES[k][1]}" for k, n in s["breaks_by_type"].items()]
    if h := report.history:
        out += ["", f"run {h['run_number']}" + (" (same as the last one)" if h["rerun"] else "")]
        out += [f"  {k.replace('_', ' '):<11}{h[k]['breaks']:>8,}  {humane_text(h[k]['row_level_cents'])}" for k in ("new", "still_open", "resolved")]
        out += [f"  {x['source']}: {x['change'].replace('_', ' ')} {x['column']}" for x in h["schema_changes"]]
    out += ["", "clusters"]
    found = {f.cluster_id: f for f in report.findings}
    for c in report.clusters[:SHOWN]:
        out.append(f"• {_colour(TYPES[c['type']][1], 1, colour)}  {c['break_count']:,} breaks, {humane_text(c['magnitude_cents'])}")
        if a := c["attribution"]:
            parts = ", ".join(f"{p['label']} {humane_text(p['value']) if a['measure'] == 'cents' else p['value']}" for p in a["components"])
            out += textwrap.wrap(f"{'explained' if a['explained'] else 'partly explained'} by {parts or 'nothing'}", WIDTH, initial_indent="    ", subsequent_indent="    ")
        if f := found.get(c["cluster_id"]):
            out += textwrap.wrap(f"{f.classification} ({f.confidence:.2f}): {f.explanation}", WIDTH, initial_indent="    ", subsequent_indent="    ")
    if len(report.clusters) > SHOWN:
        out.append(f"… and {len(report.clusters) - SHOWN} more")
    out.append(f"fingerprint {report.fingerprint}")
    text = "\n".join(out)
    return text.translate(_PLAIN) if ascii_only else text
