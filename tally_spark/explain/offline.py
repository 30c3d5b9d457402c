"""The rule table that explains clusters without a model: one verdict from a cluster's first sample and its neighbouring days."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.breaks import samples
from ..operators.checks import Context
from .tools import adjacent_matches

CONFIDENCE, UNSURE = 0.75, 0.2
ACTIONS = {
    "TIMING_DIFFERENCE": "Compare again after the next load, or allow this feed a wider settlement window.",
    "ROUNDING": "Check the number of decimals that each side stores for the column.",
    "DUPLICATE_IN_TARGET": "Make the load idempotent, then remove the extra copies of the affected day.",
    "MISSING_IN_TARGET": "Load the affected day again and see whether the row counts agree.",
    "SCHEMA_DRIFT": "Agree on one definition of the column before relying on this feed.",
    "GENUINE_DISCREPANCY": "Show the sample rows to whoever owns the data.",
    "UNKNOWN": "Look at it by hand: no rule applies.",
}


#: By type, and band or direction where these decide: the class, and what was looked at. Types and classes are fixed values.
RULES = {
    ("missing_in_target", "near"): ("TIMING_DIFFERENCE", "rows with its account, currency and amount on days around it: {adjacent}"),
    ("missing_in_target", ""): ("MISSING_IN_TARGET", "rows with its account, currency and amount on its day and days around it: none"),
    ("orphan_in_target", "near"): ("TIMING_DIFFERENCE", "rows with its account, currency and amount on days around it: {adjacent}"),
    ("orphan_in_target", ""): ("GENUINE_DISCREPANCY", "rows with its account, currency and amount on its day and days around it: none"),
    ("duplicate", ""): ("DUPLICATE_IN_TARGET", "copies of the key in the {source}: {occurrences}, rows {row_numbers}"),
    ("value_mismatch", "sub_tolerance"): ("ROUNDING", "amounts {ledger_amount} and {warehouse_amount}; difference {amount_delta}, tolerance not exceeded"),
    ("value_mismatch", "date_shifted"): ("TIMING_DIFFERENCE", "amounts {ledger_amount} and {warehouse_amount}; days between them {date_delta_days}"),
    ("value_mismatch", ""): ("GENUINE_DISCREPANCY", "fields that differ: {fields}; amounts {ledger_amount} and {warehouse_amount}, status {ledger_status} and {warehouse_status}"),
    ("control_total_mismatch", ""): ("UNKNOWN", "totals {ledger_total} and {warehouse_total}; the rows behind them weren't looked at"),
    ("row_count_mismatch", "fewer"): ("MISSING_IN_TARGET", "rows {ledger_rows} and {warehouse_rows}"),
    ("row_count_mismatch", ""): ("DUPLICATE_IN_TARGET", "rows {ledger_rows} and {warehouse_rows}"),
    ("schema_drift", ""): ("SCHEMA_DRIFT", "{summary}"),
}


def verdict(kind: str, details: dict, adjacent: int) -> tuple[str, str]:
    """Classification and what it rests on."""
    fewer = kind == "row_count_mismatch" and int(details.get("delta") or 0) < 0
    case = "near" if adjacent > 0 else "fewer" if fewer else details.get("band") or ""
    name, seen = RULES.get((kind, case)) or RULES.get((kind, ""), ("UNKNOWN", "type {type}, for which there is no rule"))
    known = defaultdict(lambda: "unknown", {k: v for k, v in details.items() if v is not None}) | {"adjacent": adjacent, "type": kind}
    return name, seen.format_map(known)


def classified(clusters: DataFrame, breaks: DataFrame, c: Context) -> DataFrame:
    """cluster_id, classification and confidence for all clusters in one plan, by the same rules as verdict()."""
    first = samples(breaks, 1).select("cluster_id", "type", "account_id", "currency", "date", "details")
    signed = F.regexp_replace("details.amount", r"\.", "").cast("bigint")
    wanted = first.filter("type IN ('missing_in_target', 'orphan_in_target')").select(F.col("cluster_id").alias("key"), "account_id", "currency", "date", signed.alias("cents"))
    near = adjacent_matches(wanted, c).select(F.col("key").alias("cluster_id"), (F.col("ledger_matches") + F.col("warehouse_matches")).alias("adjacent"))
    d = lambda x: F.col(f"details.{x}")
    band = F.when(d("band") == "sub_tolerance", "ROUNDING").when(d("band") == "date_shifted", "TIMING_DIFFERENCE").otherwise("GENUINE_DISCREPANCY")
    rule = (
        F.when(F.col("type").isin("missing_in_target", "orphan_in_target") & (F.col("adjacent") > 0), "TIMING_DIFFERENCE")
        .when(F.col("type") == "missing_in_target", "MISSING_IN_TARGET")
        .when(F.col("type") == "orphan_in_target", "GENUINE_DISCREPANCY")
        .when(F.col("type") == "duplicate", "DUPLICATE_IN_TARGET")
        .when(F.col("type") == "value_mismatch", band)
        .when(F.col("type") == "row_count_mismatch", F.when(d("delta").cast("bigint") < 0, "MISSING_IN_TARGET").otherwise("DUPLICATE_IN_TARGET"))
        .when(F.col("type") == "schema_drift", "SCHEMA_DRIFT")
        .otherwise("UNKNOWN")
    )
    found = first.join(near, "cluster_id", "left").select("cluster_id", rule.alias("classification"))
    return clusters.select("cluster_id").join(found, "cluster_id").withColumn("confidence", F.when(F.col("classification") == "UNKNOWN", UNSURE).otherwise(CONFIDENCE))


def targets(clusters: DataFrame, summaries: DataFrame, budget: int) -> DataFrame:
    """Clusters to explain: of those that attribution doesn't explain, the first by rank, and the largest quarter of the budget by count (one at least)."""
    known = summaries.filter("explained").select("cluster_id")
    # the budget is a feature: a run explains so many clusters at most
    left = clusters.join(known, "cluster_id", "left_anti")
    by_rank = left.orderBy("rank").limit(budget)
    by_count = left.orderBy(F.col("break_count").desc(), "rank").limit(max(budget // 4, 1))
    return by_rank.unionByName(by_count).distinct()


def classification_summary(clusters: DataFrame, summaries: DataFrame, findings: DataFrame) -> DataFrame:
    """By classification: clusters, breaks, and the sum of the clusters' absolute sums. findings: cluster_id, classification."""
    joined = clusters.join(findings.select("cluster_id", "classification"), "cluster_id", "left").join(summaries.select("cluster_id", "explained"), "cluster_id", "left")
    name = F.coalesce("classification", F.when(F.col("explained"), "EXPLAINED"), F.lit("NOT_INVESTIGATED"))
    return joined.groupBy(name.alias("classification")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("break_count").alias("breaks"), F.sum(F.abs("magnitude_cents")).alias("magnitude_cents"))
