"""Read-only lookups for explanations. Those that run for many clusters at once are DataFrames; single calls return small dicts."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ROW, sort_columns
from ..functions.money import money_text
from ..operators.checks import Context

MOST_ROWS = 20


def fetch_rows(rows: DataFrame, account_id: str | None = None, date: str | None = None, txn_id: str | None = None, limit: int = 10) -> DataFrame:
    """The first rows in the total order; at least 1, at most MOST_ROWS."""
    for column, value in (("account_id", account_id), ("txn_id", txn_id)):
        if value:
            rows = rows.filter(F.col(column) == value)
    if date:
        rows = rows.filter(F.col("posted_date") == F.lit(date).cast("date"))
    return rows.orderBy(*sort_columns()).limit(min(max(limit, 1), MOST_ROWS)).select(*ROW)


def adjacent_matches(wanted: DataFrame, c: Context) -> DataFrame:
    """wanted (key, account_id, currency, date, cents) with, for each key, rows of about that amount on other days of the window, by side.

    Wanted rows are repeated for each day, so that the join is on equal account, currency and day."""
    window, tolerance = c.settings.timing_window_days, c.settings.tolerance_cents
    shifts = [i for i in range(-window, window + 1) if i]
    days = wanted.select("key", "account_id", "currency", "cents", F.explode(F.array(*[F.date_add("date", i) for i in shifts]) if shifts else F.expr("cast(array() as array<date>)")).alias("posted_date"))
    rows = c.ledger.unionByName(c.warehouse).select("source", "account_id", "currency", "posted_date", "amount_cents")
    met = rows.join(days, ["account_id", "currency", "posted_date"]).filter(F.abs(F.col("amount_cents") - F.col("cents")) <= tolerance)
    counts = met.groupBy("key").agg(F.count_if(F.col("source") == "ledger").alias("ledger_matches"), F.count_if(F.col("source") == "warehouse").alias("warehouse_matches"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return wanted.select("key").join(counts, "key", "left").select("key", zero("ledger_matches"), zero("warehouse_matches"))


class Tools:
    """The same, by name, for a model. A wrong call gives an error to read, never an exception."""

    NAMES = ("fetch_rows", "check_adjacent_periods", "get_schema", "summarize_cluster")

    def __init__(self, context: Context, breaks: DataFrame) -> None:
        self.context, self.breaks, self.calls = context, breaks, 0

    def call(self, name: str, arguments: dict | None) -> dict:
        self.calls += 1
        if name not in self.NAMES:
            return {"error": f"unknown tool {name!r}; there are {', '.join(self.NAMES)}"}
        try:
            return getattr(self, name)(arguments or {})
        except (ValueError, TypeError, KeyError) as error:
            return {"error": f"{name} failed: {error}"}

    def _side(self, a: dict) -> tuple[DataFrame, dict]:
        if a.get("source") not in ("ledger", "warehouse"):
            raise ValueError('source must be "ledger" or "warehouse"')
        return getattr(self.context, a["source"]), getattr(self.context, f"{a['source']}_types")

    def fetch_rows(self, a: dict) -> dict:
        rows, _ = self._side(a)
        filters = {k: a.get(k) for k in ("account_id", "date", "txn_id")}
        if a.get("date"):
            Date.fromisoformat(a["date"])
        kept = rows
        for column, value in (("account_id", a.get("account_id")), ("txn_id", a.get("txn_id")), ("posted_date", a.get("date"))):
            kept = kept.filter(F.col(column) == value) if value else kept
        shown = [r.asDict() | {"posted_date": r.posted_date.isoformat(), "amount": money_text(r.amount_cents)} for r in fetch_rows(rows, **filters, limit=int(a.get("limit") or 10)).collect()]
        return {"source": a["source"], "matched_rows": kept.count(), "returned": len(shown), "rows": shown}

    def check_adjacent_periods(self, a: dict) -> dict:
        c, day = self.context, Date.fromisoformat(a["date"])
        window, currency = c.settings.timing_window_days, (a.get("currency") or "USD").upper()
        cents = round(float(str(a["amount"]).replace(",", "")) * 100) if a.get("amount") else None
        rows = c.ledger.unionByName(c.warehouse).filter((F.col("account_id") == a["account_id"]) & (F.col("currency") == currency) & (F.abs(F.datediff("posted_date", F.lit(day))) <= window))
        near = F.abs(F.col("amount_cents") - F.lit(cents)) <= c.settings.tolerance_cents if cents is not None else F.lit(False)
        found = rows.groupBy("source", "posted_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(near).alias("hits")).collect()
        at = {(r.source, r.posted_date): r for r in found}
        days = [Date.fromordinal(day.toordinal() + i) for i in range(-window, window + 1)]
        n = lambda s, d, f: getattr(at[s, d], f) if (s, d) in at else 0
        sides = {s: sum(n(s, d, "hits") for d in days if d != day) for s in ("ledger", "warehouse")}
        return {
            "account_id": a["account_id"], "currency": currency, "target_date": day.isoformat(), "window_days": window, "tolerance_cents": c.settings.tolerance_cents,
            "per_day": [{"date": d.isoformat(), "ledger_rows": n("ledger", d, "n"), "warehouse_rows": n("warehouse", d, "n")} for d in days],
            "ledger_matches": sides["ledger"], "warehouse_matches": sides["warehouse"], "candidate_matches_in_adjacent_period": sum(sides.values()),
        }

    def get_schema(self, a: dict) -> dict:
        rows, types = self._side(a)
        r = rows.agg(F.count(F.lit(1)).alias("n"), F.min("posted_date").alias("a"), F.max("posted_date").alias("z")).first()
        return {"source": a["source"], "columns": types, "row_count": r.n, "date_range": [x.isoformat() if x else None for x in (r.a, r.z)]}

    def summarize_cluster(self, a: dict) -> dict:
        ids = a.get("break_ids") or []
        if not isinstance(ids, list) or not ids:
            return {"error": "break_ids must be a list with at least one id"}
        found = self.breaks.filter(F.col("id").isin(ids)).orderBy("id").collect()  # as many as were asked for
        unknown = sorted(set(ids) - {r.id for r in found})
        if not found:
            return {"error": f"no such break ids: {', '.join(unknown)}"}
        types: dict[str, int] = {}
        for r in found:
            types[r.type] = types.get(r.type, 0) + 1
        details = [{k: v for k, v in r.details.asDict().items() if v is not None} for r in found[:3]]
        return {
            "requested": len(ids), "resolved": len(found), "unknown_ids": unknown, "types": types, "total_magnitude": money_text(sum(r.magnitude_cents for r in found)),
            "accounts": sorted({r.account_id for r in found if r.account_id})[:10], "dates": sorted({r.date.isoformat() for r in found if r.date}), "sample_details": details,
        }
