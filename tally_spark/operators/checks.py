"""Deterministic checks. Each gives breaks in one wide form: BREAK columns, details as typed nullable columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.keys import business_key, ref, sort_columns
from ..functions.money import money

#: type: level and label.
TYPES = {
    "missing_in_target": ("row", "Missing in warehouse"),
    "orphan_in_target": ("row", "Orphan in warehouse"),
    "duplicate": ("row", "Duplicate business key"),
    "value_mismatch": ("row", "Matched but values disagree"),
    "control_total_mismatch": ("aggregate", "Control total does not tie"),
    "row_count_mismatch": ("aggregate", "Row count does not tie"),
    "schema_drift": ("aggregate", "Schema drift between sources"),
}
DETAILS = {
    "amount": "string", "amount_delta": "string", "band": "string", "business_key": "string", "column": "string", "date_delta_days": "bigint", "delta": "string", "fields": "string",
    "kind": "string", "ledger_amount": "string", "ledger_rows": "bigint", "ledger_status": "string", "ledger_total": "string", "ledger_type": "string", "occurrences": "bigint",
    "row_numbers": "string", "source": "string", "status": "string", "strategy": "string", "summary": "string", "txn_id": "string", "unit_amount": "string", "warehouse_amount": "string",
    "warehouse_rows": "bigint", "warehouse_status": "string", "warehouse_total": "string", "warehouse_type": "string",
}
BREAK = ["type", "level", "date", "account_id", "currency", "magnitude_cents", "ledger_refs", "warehouse_refs", "details"]


@dataclass
class Context:
    """What a check may read."""

    ledger: DataFrame
    warehouse: DataFrame
    members: DataFrame
    left_ledger: DataFrame
    left_warehouse: DataFrame
    matches: DataFrame
    settings: Settings
    ledger_types: dict[str, str]
    warehouse_types: dict[str, str]


CHECKS: dict[str, Callable[[Context], DataFrame]] = {}


def check(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
    """Register a check; each_check() takes them in order of name."""
    CHECKS[f.__name__] = f
    return f


_NO_REFS = "cast(array() as array<string>)"


def as_break(df: DataFrame, kind: str, details: dict[str, Column], **columns: Column) -> DataFrame:
    unset = {"date": F.lit(None).cast("date"), "account_id": F.lit(None).cast("string"), "currency": F.lit(None).cast("string"), "magnitude_cents": F.lit(0), "ledger_refs": F.expr(_NO_REFS), "warehouse_refs": F.expr(_NO_REFS)}
    found = unset | columns
    found["magnitude_cents"] = found["magnitude_cents"].cast("bigint")
    struct = F.struct(*[details[k].cast(t).alias(k) if k in details else F.expr(f"cast(null as {t}) AS `{k}`") for k, t in DETAILS.items()])
    return df.select(F.lit(kind).alias("type"), F.lit(TYPES[kind][0]).alias("level"), *[found[c].alias(c) for c in BREAK[2:-1]], struct.alias("details"))


def without_surplus(left: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Unmatched rows of both sides but the first n - 1 of a key that its file has n times: those are the duplicate check's.

    Counts are taken of unmatched rows' keys only, so the files are read once and only their matching keys are counted."""
    own = left.withColumn("business_key", business_key())
    keyed = all_rows.withColumn("business_key", business_key())
    counts = keyed.join(own.select("source", "business_key").distinct().hint("shuffle_merge"), ["source", "business_key"], "left_semi").groupBy("source", "business_key").agg(F.count(F.lit(1)).alias("_n"))
    nth = F.row_number().over(Window.partitionBy("source", "business_key").orderBy(*sort_columns()))
    return own.join(counts.hint("shuffle_merge"), ["source", "business_key"]).withColumn("_nth", nth).filter("_n = 1 OR _nth = _n")


@check
def completeness(c: Context) -> DataFrame:
    found = without_surplus(c.left_ledger.unionByName(c.left_warehouse), c.ledger.unionByName(c.warehouse))
    details = {"amount": money(F.col("amount_cents")), "status": F.col("status"), "txn_id": F.col("txn_id")}
    refs = {f"{s}_refs": F.when(F.col("source") == s, F.array(ref())).otherwise(F.expr(_NO_REFS)) for s in ("ledger", "warehouse")}
    columns = {"date": F.col("posted_date"), "account_id": F.col("account_id"), "currency": F.col("currency"), "magnitude_cents": F.col("amount_cents")}
    # both kinds are of the same level
    both = as_break(found, "missing_in_target", details, **columns, **refs)
    return both.withColumn("type", F.when(F.size("ledger_refs") > 0, "missing_in_target").otherwise("orphan_in_target"))


def daily(c: Context) -> DataFrame:
    """Totals and counts of both sides by day and currency; a side without rows has 0. One aggregate over both sides, so no join."""
    both = c.ledger.select("posted_date", "currency", "amount_cents", F.lit(True).alias("_l")).unionByName(c.warehouse.select("posted_date", "currency", "amount_cents", F.lit(False).alias("_l")))
    total = lambda x: F.coalesce(F.sum(F.when(x, F.col("amount_cents"))), F.lit(0))
    l, w = F.col("_l"), ~F.col("_l")
    return both.groupBy("posted_date", "currency").agg(total(l).alias("ledger_total"), total(w).alias("warehouse_total"), F.count_if(l).alias("ledger_rows"), F.count_if(w).alias("warehouse_rows"))


@check
def control_totals(c: Context) -> DataFrame:
    days = daily(c)
    delta = F.col("warehouse_total") - F.col("ledger_total")
    details = {"delta": money(delta), "ledger_total": money(F.col("ledger_total")), "warehouse_total": money(F.col("warehouse_total"))}
    totals = as_break(days.filter(delta != 0), "control_total_mismatch", details, date=F.col("posted_date"), currency=F.col("currency"), magnitude_cents=delta)
    more = F.col("warehouse_rows") - F.col("ledger_rows")
    details = {"delta": more.cast("string"), "ledger_rows": F.col("ledger_rows"), "warehouse_rows": F.col("warehouse_rows")}
    return totals.unionByName(as_break(days.filter(more != 0), "row_count_mismatch", details, date=F.col("posted_date"), currency=F.col("currency")))


@check
def duplicates(c: Context) -> DataFrame:
    """Keys that one file has more than once. Counted before any list is made; a list holds the copies of one key."""
    both = c.ledger.unionByName(c.warehouse).withColumn("business_key", business_key("|"))
    many = both.groupBy("source", "business_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows = both.join(many.select("source", "business_key").hint("shuffle_merge"), ["source", "business_key"], "left_semi")
    first = F.min_by(F.struct("posted_date", "account_id", "currency", "amount_cents"), "row_number")
    keys = rows.groupBy("source", "business_key").agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list("row_number")).alias("_rows"), first.alias("f"))
    refs = F.array_sort(F.transform("_rows", lambda x: F.concat_ws(":", "source", x.cast("string"))))
    side = lambda s: F.when(F.col("source") == s, refs).otherwise(F.expr(_NO_REFS))
    details = {"source": F.col("source"), "business_key": F.col("business_key"), "occurrences": F.col("_n"), "row_numbers": F.array_join(F.transform("_rows", lambda x: x.cast("string")), ","), "unit_amount": money(F.col("f.amount_cents"))}
    return as_break(keys, "duplicate", details, date=F.col("f.posted_date"), account_id=F.col("f.account_id"), currency=F.col("f.currency"), magnitude_cents=F.col("f.amount_cents") * (F.col("_n") - 1), ledger_refs=side("ledger"), warehouse_refs=side("warehouse"))


def compared(matches: DataFrame, settings: Settings) -> DataFrame:
    """matches with fields (those that differ, in a fixed order) and band (the first that applies)."""
    differ = F.array_compact(F.array(F.when(F.col("delta_cents") != 0, "amount"), F.when(F.col("delta_days") != 0, "posted_date"), F.when(F.array_distinct("ledger_statuses") != F.array_distinct("warehouse_statuses"), "status")))
    band = F.when((F.col("delta_cents") != 0) & (F.abs("delta_cents") <= settings.tolerance_cents), "sub_tolerance").when(F.col("delta_cents") != 0, "material").when(F.col("delta_days") != 0, "date_shifted").otherwise("status_only")
    return matches.withColumn("fields", F.array_join(differ, ",")).withColumn("band", band)


@check
def values(c: Context) -> DataFrame:
    found = compared(c.matches, c.settings).filter("fields <> ''")
    status = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    details = {
        "fields": F.col("fields"), "band": F.col("band"), "strategy": F.col("strategy"), "ledger_amount": money(F.col("ledger_cents")), "warehouse_amount": money(F.col("warehouse_cents")), "amount_delta": money(F.col("delta_cents")),
        "date_delta_days": F.col("delta_days"), "ledger_status": status("ledger_statuses"), "warehouse_status": status("warehouse_statuses"),
    }
    return as_break(found, "value_mismatch", details, date=F.col("partition_date"), account_id=F.col("account_id"), currency=F.col("currency"), magnitude_cents=F.col("delta_cents"), ledger_refs=F.col("ledger_refs"), warehouse_refs=F.col("warehouse_refs"))


def drift_rows(ledger: dict[str, str], warehouse: dict[str, str]) -> list[tuple[str, str, str | None, str | None, str]]:
    """kind, column, both types and a sentence. Two lists of a file's columns are compared on the driver."""
    if not ledger or not warehouse:
        return []
    out = []
    for c in sorted(ledger.keys() - warehouse.keys()):
        out.append(("column_missing", c, ledger[c], None, f'column "{c}" is in the ledger but not in the warehouse'))
    for c in sorted(warehouse.keys() - ledger.keys()):
        out.append(("column_added", c, None, warehouse[c], f'column "{c}" is in the warehouse but not in the ledger'))
    for c in sorted(ledger.keys() & warehouse.keys()):
        if ledger[c] != warehouse[c] and "unknown" not in (ledger[c], warehouse[c]):
            out.append(("type_changed", c, ledger[c], warehouse[c], f'column "{c}" is {ledger[c]} in the ledger and {warehouse[c]} in the warehouse'))
    return out


@check
def schema_drift(c: Context) -> DataFrame:
    found = c.ledger.sparkSession.createDataFrame(drift_rows(c.ledger_types, c.warehouse_types), "kind string, column string, ledger_type string, warehouse_type string, summary string")
    return as_break(found, "schema_drift", {k: F.col(k) for k in found.columns})


def each_check(c: Context) -> list[DataFrame]:
    """Every check's breaks by themselves, in order of name. One plan of all of them is planned anew on the driver after each of its stages, which takes far more memory there than several small plans."""
    return [CHECKS[name](c) for name in sorted(CHECKS)]


def run_checks(c: Context) -> DataFrame:
    return reduce(DataFrame.unionByName, each_check(c))
