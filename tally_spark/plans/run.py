"""The whole run: match, check, cluster, attribute; its report and fingerprint."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import VERSION
from ..config import Settings
from ..explain.finding import Finding
from ..operators import attribution, breaks, checks, history, matching, profile
from ..sources import csv
from .store import stored, stored_together


@dataclass
class Report:
    context: checks.Context
    breaks: DataFrame
    effects: DataFrame
    inputs: dict[str, dict]
    settings: Settings
    started_at: str
    seconds: float = 0.0
    findings: list[Finding] = field(default_factory=list)
    history: dict | None = None

    @cached_property
    def clusters(self) -> list[dict]:
        """All clusters in report order, with samples and attribution. There are as many as kinds of problem, not as many as breaks."""
        rows = [r.asDict() for r in breaks.clusters(self.breaks).orderBy("rank").collect()]
        shown: dict[str, list] = {}
        for r in breaks.samples(self.breaks).orderBy("cluster_id", "sample").collect():
            shown.setdefault(r.cluster_id, []).append(r.asDict(recursive=True))
        why = {r.cluster_id: r.asDict() for r in attribution.summaries(self.breaks, self.effects).collect()}
        parts: dict[str, list] = {}
        for r in attribution.components(self.breaks, self.effects).collect():
            parts.setdefault(r.cluster_id, []).append(r.asDict())
        for c in rows:
            c["samples"] = shown.get(c["cluster_id"], [])
            c["attribution"] = why.get(c["cluster_id"])
            if c["attribution"]:
                c["attribution"]["components"] = sorted(parts.get(c["cluster_id"], []), key=lambda p: (-abs(p["value"]), p["cause"]))
        return rows

    @cached_property
    def matching(self) -> dict:
        return matching.summary(self.context.ledger, self.context.members, self.context.left_ledger, self.context.left_warehouse).first().asDict()

    @cached_property
    def breaks_by_type(self) -> dict[str, int]:
        return {r.type: r["count"] for r in sorted(breaks.by_type(self.breaks).collect(), key=lambda r: (-r["count"], r.type))}

    @cached_property
    def impact_cents(self) -> int:
        return breaks.row_level_impact(self.breaks).first().impact_cents

    @cached_property
    def profiles(self) -> dict[str, dict]:
        out = {}
        for name, rows, types in (("ledger", self.context.ledger, self.context.ledger_types), ("warehouse", self.context.warehouse, self.context.warehouse_types)):
            own = profile.summary(rows).first().asDict()
            own["statuses"] = {r.status: r.row_count for r in profile.status_histogram(rows).orderBy("status").collect()}
            own["duplicate_keys"] = profile.duplicate_keys(rows).count()
            own["columns"] = types
            out[name] = own
        return out

    @cached_property
    def fingerprint(self) -> str:
        """SHA-256 of settings, inputs, matching and all breaks. Breaks' digests are combined by bucket first, so that no task or driver holds them all."""
        ids = self.breaks.select("digest").groupBy(F.substring("digest", 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ","), 256).alias("sha"))
        parts = [f"{r.bucket}:{r.sha}" for r in ids.orderBy("bucket").collect()]  # 4096 at most
        inputs = sorted(x["digest"] for x in self.inputs.values())
        return hashlib.sha256("\n".join([self.settings.digest(), *inputs, repr(sorted(self.matching.items())), *parts]).encode()).hexdigest()


def reconcile(ledger: DataFrame, warehouse: DataFrame, settings: Settings | None = None, inputs: dict | None = None, types: tuple[dict, dict] = ({}, {})) -> Report:
    """Compare two sides that are already transaction rows."""
    settings, began, started = settings or Settings(), time.time(), datetime.now(UTC).isoformat(timespec="seconds")
    inputs = inputs or {"ledger": {"path": None, "digest": csv.digest_rows(ledger)}, "warehouse": {"path": None, "digest": csv.digest_rows(warehouse)}}
    members, left_l, left_w = matching.match_rows(ledger, warehouse, settings, stored)
    context = checks.Context(ledger, warehouse, members, left_l, left_w, stored(matching.matches(members), "matches"), settings, *types)
    found = stored_together([breaks.identified(x) for x in checks.each_check(context)], "breaks")
    effects = stored(attribution.row_effects(found, members, context.matches, left_l, left_w), "effects")
    return Report(context, found, effects, inputs, settings, started, time.time() - began)


def run_files(spark: SparkSession, ledger: str, warehouse: str, settings: Settings | None = None, db: str | None = None) -> Report:
    """Two files: read, compare, explain, and append to the history if there is one."""
    from ..explain.loop import investigate

    settings = settings or Settings()
    raw = {n: stored(csv.read_text(spark, p), f"raw-{n}") for n, p in (("ledger", ledger), ("warehouse", warehouse))}
    rows = {n: stored(csv.load(r, n, p), n) for (n, r), p in zip(raw.items(), (ledger, warehouse), strict=True)}
    types = tuple({r.column: r.type for r in csv.infer_types(raw[n]).orderBy("position").collect()} for n in rows)
    inputs = {n: dict(zip(("path", "digest", "bytes"), (p, *csv.digest(spark, p)), strict=True)) for n, p in (("ledger", ledger), ("warehouse", warehouse))}
    report = reconcile(rows["ledger"], rows["warehouse"], settings, inputs, types)
    report.findings = investigate(report)
    if db:
        report.history = record(report, db)
    return report


def record(report: Report, db: str) -> dict:
    """Append to the history and say what changed since the run before."""
    spark = report.breaks.sparkSession
    store = history.History(spark, db)
    keyed = stored(history.stable_keys(report.breaks, report.context.ledger, report.context.warehouse), "keyed")
    schemas = {"ledger": report.context.ledger_types, "warehouse": report.context.warehouse_types}
    own = history.Run(0, report.started_at, report.fingerprint, report.settings.digest(), report.inputs["ledger"]["digest"], report.inputs["warehouse"]["digest"], sum(report.breaks_by_type.values()), report.impact_cents, VERSION, schemas)
    run, before, rerun = store.record(own, keyed)
    now = store.breaks(run.number)
    diff = history.difference(now, store.breaks(before.number) if before else None, run.number)
    parts = {s: {"breaks": 0, "row_level_cents": 0, "by_type": {}} for s in ("new", "still_open", "resolved")}
    for r in sorted(history.sections(diff).collect(), key=lambda r: (-r.breaks, r.type)):
        parts[r.state]["breaks"] += r.breaks
        parts[r.state]["row_level_cents"] += r.row_level_cents
        parts[r.state]["by_type"][r.type] = r.breaks
    oldest = now.filter(F.col("first_seen") < run.number).orderBy("first_seen", "break_key").select("break_key", "first_seen").first()
    ages = {r.cluster_id: {"new": r.new, "carried": r.carried, "since": r.since} for r in history.cluster_ages(now, run.number).collect()} if before else {}
    return {
        "database": db, "run_number": run.number, "previous_run": {"run_number": before.number, "started_at": before.started_at, "deterministic_fingerprint": before.fingerprint} if before else None,
        "rerun": rerun, "settings_changed": bool(before and before.config_digest != run.config_digest), **parts, "oldest": oldest.asDict() if oldest else None,
        "schema_changes": [dict(zip(("source", "change", "column", "from", "to"), x, strict=True)) for x in (history.schema_changes(before.schemas, run.schemas) if before else [])], "cluster_ages": ages,
    }
