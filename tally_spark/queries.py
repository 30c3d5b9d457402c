"""One query for each operator, over the fixture rows made from orders; oracles.py has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import evaluate, fixtures, generate
from .config import Settings
from .explain import offline, tools
from .functions.keys import business_key, ref
from .functions.money import cents_from_text, humane, money
from .operators import attribution, breaks, checks, history, matching, profile
from .plans.store import new_path, stored, stored_together
from .sources import csv

SETTINGS = Settings()
_made: dict[tuple, object] = {}


def _once(name: str, spark: SparkSession, sf_dir: str, make):
    """What several queries start from, made once for each session and folder."""
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def _sides(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return fixtures.sides(spark, sf_dir)


TYPES = {"txn_id": "string", "account_id": "string", "posted_date": "date", "amount": "decimal", "currency": "string", "status": "string"}


def _types(day: str) -> dict[str, str]:
    """Columns of the warehouse, which has one more on day two."""
    return TYPES | ({"batch_id": "string"} if day else {})


def _context(spark: SparkSession, sf_dir: str, day: str = "") -> checks.Context:
    def make() -> checks.Context:
        s = _sides(spark, sf_dir)
        ledger, warehouse = s["ledger" + day], s["warehouse" + day]
        members, l, w = matching.match_rows(ledger, warehouse, SETTINGS, stored)
        return checks.Context(ledger, warehouse, members, l, w, stored(matching.matches(members), "matches"), SETTINGS, TYPES, _types(day))

    return _once("context" + day, spark, sf_dir, make)


def _breaks(spark: SparkSession, sf_dir: str, day: str = "") -> DataFrame:
    return _once("breaks" + day, spark, sf_dir, lambda: stored_together([breaks.identified(found) for found in checks.each_check(_context(spark, sf_dir, day))], "breaks"))


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _context(spark, sf_dir)
    return _once("effects", spark, sf_dir, lambda: stored(attribution.row_effects(_breaks(spark, sf_dir), c.members, c.matches, c.left_ledger, c.left_warehouse), "effects"))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _breaks(spark, sf_dir)
    c = breaks.clusters(b)
    wanted = offline.targets(c, attribution.summaries(b, _effects(spark, sf_dir)), SETTINGS.max_clusters)
    return offline.classified(wanted, b, _context(spark, sf_dir)).withColumn("degraded", F.lit(False))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as untidy text columns."""
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    amount = F.concat(F.when(k % 5 == 0, "+").otherwise(""), F.expr("cast(cast(round(o_totalprice * 100) as bigint) div 100 as string)"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), (k % 10).cast("string"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        (k + 1).alias("row_number"), F.when(k % 8 == 0, "  ").otherwise(F.concat(F.lit(" TXN-"), k.cast("string"), F.lit("\t"))).alias("txn_id"), F.concat(F.lit("ACC-"), (F.col("o_custkey") % 50).cast("string"), F.lit(" ")).alias("account_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("posted_date"), amount.alias("amount"), F.when(k % 3 == 0, "eur").when(k % 3 == 1, "").otherwise("usd ").alias("currency"), F.when(k % 6 == 0, F.lit(None)).otherwise(F.lower("o_orderstatus")).alias("status"),
    )


# --- sources and scalar functions


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The untidy columns written as CSV files, and read back as text with row numbers."""

    def make() -> DataFrame:
        path = new_path(spark, "csv")
        _raw(spark, sf_dir).drop("row_number").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        return csv.read_text(spark, path)

    return _once("csv", spark, sf_dir, make)


def csv_scan(spark, sf_dir):
    rows = _read(spark, sf_dir)
    csv.require_columns(rows.columns)
    return csv.parsed(rows, "ledger").select("txn_id", "account_id", "posted_date", "amount_cents", "currency", "status")


def csv_row_numbers(spark, sf_dir):
    """Numbers run from 1 without a gap over all files."""
    return _read(spark, sf_dir).agg(F.count(F.lit(1)).alias("row_count"), F.min("row_number").alias("first_number"), F.max("row_number").alias("last_number"), F.countDistinct("row_number").alias("numbers"))


def normalize_rows(spark, sf_dir):
    return csv.parsed(_raw(spark, sf_dir), "ledger").select("row_number", "txn_id", "account_id", "posted_date", "amount_cents", "currency", "status")


def amount_to_cents(spark, sf_dir):
    return _raw(spark, sf_dir).select("row_number", "amount", cents_from_text(F.col("amount")).alias("amount_cents"))


def money_format(spark, sf_dir):
    return _sides(spark, sf_dir)["ledger"].select("row_number", money(F.col("amount_cents")).alias("money"), humane(F.col("amount_cents")).alias("humane"))


def infer_column_types(spark, sf_dir):
    return csv.infer_types(_raw(spark, sf_dir)).select("column", F.col("position").cast("bigint").alias("position"), "type")


def first_bad_row(spark, sf_dir):
    raw = _raw(spark, sf_dir).withColumn("amount", F.when(F.col("row_number") % 700 == 0, "12.34.56").otherwise(F.col("amount"))).withColumn("posted_date", F.when(F.col("row_number") % 450 == 0, "2026-13-01").otherwise(F.col("posted_date")))
    return csv.first_bad_row(csv.parsed(raw, "ledger"))


def business_keys(spark, sf_dir):
    return _sides(spark, sf_dir)["warehouse"].select("row_number", business_key().alias("business_key"), ref().alias("ref"))


# --- profile


def profile_summary(spark, sf_dir):
    return profile.summary(_sides(spark, sf_dir)["warehouse"])


def profile_partitions(spark, sf_dir):
    return profile.partitions(_sides(spark, sf_dir)["warehouse"])


def status_histogram(spark, sf_dir):
    return profile.status_histogram(_sides(spark, sf_dir)["warehouse"])


def duplicate_keys(spark, sf_dir):
    return profile.duplicate_keys(_sides(spark, sf_dir)["warehouse"])


# --- matching


def _rows(members: DataFrame) -> DataFrame:
    return members.select("match_id", "strategy", "source", F.col("leg_pos").cast("bigint").alias("leg_pos"), "row_number")


def match_exact(spark, sf_dir):
    s = _sides(spark, sf_dir)
    return _rows(matching.match_exact(s["ledger"], s["warehouse"]))


def _left_1(spark, sf_dir):
    s = _sides(spark, sf_dir)

    def make():
        exact = stored(matching.match_exact(s["ledger"], s["warehouse"]), "exact")
        return tuple(stored(matching.unmatched(s[n], exact, n), "left") for n in ("ledger", "warehouse"))

    return _once("left-1", spark, sf_dir, make)


def unmatched_after_exact(spark, sf_dir):
    s = _sides(spark, sf_dir)
    exact = matching.match_exact(s["ledger"], s["warehouse"])
    return matching.unmatched(s["ledger"], exact, "ledger").unionByName(matching.unmatched(s["warehouse"], exact, "warehouse")).select("source", "row_number")


def composite_edges(spark, sf_dir):
    return matching.composite_edges(*_left_1(spark, sf_dir), SETTINGS).select(F.col("l.row_number").alias("ledger_row"), F.col("w.row_number").alias("warehouse_row"), F.col("days").cast("bigint").alias("days"), F.col("cents").cast("bigint").alias("cents"))


def match_composite(spark, sf_dir):
    return _rows(matching.match_composite(*_left_1(spark, sf_dir), SETTINGS))


def match_composite_contested(spark, sf_dir):
    """All identifiers and cents dropped and accounts merged, so that rows compete; tests compare it with a sequential model."""
    coarse = lambda df: df.select("source", "row_number", F.lit(None).cast("string").alias("txn_id"), F.lit("ACC").alias("account_id"), "posted_date", F.expr("amount_cents div 1000000").alias("amount_cents"), "currency", "status")
    s = _sides(spark, sf_dir)
    return _rows(matching.match_composite(coarse(s["ledger"]), coarse(s["warehouse"]), SETTINGS))


def match_split(spark, sf_dir):
    def make():
        l, w = _left_1(spark, sf_dir)
        composite = stored(matching.match_composite(l, w, SETTINGS), "composite")
        return stored(matching.unmatched(l, composite, "ledger"), "l2"), stored(matching.unmatched(w, composite, "warehouse"), "w2")

    return _rows(matching.match_splits(*_once("left-2", spark, sf_dir, make), SETTINGS))


def match_summary(spark, sf_dir):
    c = _context(spark, sf_dir)
    return matching.summary(c.ledger, c.members, c.left_ledger, c.left_warehouse)


def unmatched_final(spark, sf_dir):
    c = _context(spark, sf_dir)
    return c.left_ledger.unionByName(c.left_warehouse).select("source", "row_number")


# --- checks


def _flat(found: DataFrame, *details: str) -> DataFrame:
    refs = lambda c: F.array_join(c, ",").alias(c)
    return found.select("type", "level", "date", "account_id", "currency", "magnitude_cents", refs("ledger_refs"), refs("warehouse_refs"), *[F.col(f"details.{d}").alias(f"d_{d}") for d in details])


def _of(found: DataFrame, kind: str) -> DataFrame:
    return found.filter(F.col("type") == kind)


def check_missing(spark, sf_dir):
    return _flat(_of(checks.completeness(_context(spark, sf_dir)), "missing_in_target"), "amount", "status", "txn_id")


def check_orphan(spark, sf_dir):
    return _flat(_of(checks.completeness(_context(spark, sf_dir)), "orphan_in_target"), "amount", "status", "txn_id")


def check_control_totals(spark, sf_dir):
    s = _sides(spark, sf_dir)
    c = checks.Context(s["ledger"], s["warehouse"], None, None, None, None, SETTINGS, {}, {})
    return _flat(_of(checks.control_totals(c), "control_total_mismatch"), "delta", "ledger_total", "warehouse_total")


def check_row_counts(spark, sf_dir):
    s = _sides(spark, sf_dir)
    c = checks.Context(s["ledger"], s["warehouse"], None, None, None, None, SETTINGS, {}, {})
    return _flat(_of(checks.control_totals(c), "row_count_mismatch"), "delta", "ledger_rows", "warehouse_rows")


def check_duplicates(spark, sf_dir):
    return _flat(checks.duplicates(_context(spark, sf_dir)), "source", "business_key", "occurrences", "row_numbers", "unit_amount")


def check_values(spark, sf_dir):
    return _flat(checks.values(_context(spark, sf_dir)), "fields", "band", "strategy", "ledger_amount", "warehouse_amount", "amount_delta", "date_delta_days", "ledger_status", "warehouse_status")


def value_bands(spark, sf_dir):
    return checks.values(_context(spark, sf_dir)).groupBy(F.col("details.band").alias("band")).agg(F.count(F.lit(1)).alias("breaks"), F.sum("magnitude_cents").alias("magnitude_cents"))


def check_schema_drift(spark, sf_dir):
    """Compares both sides' columns, so no rows are matched."""
    s = _sides(spark, sf_dir)
    c = checks.Context(s["ledger_2"], s["warehouse_2"], None, None, None, None, SETTINGS, TYPES, _types("_2"))
    return _flat(checks.schema_drift(c), "kind", "column", "ledger_type", "warehouse_type")


# --- breaks


def break_ids(spark, sf_dir):
    return _breaks(spark, sf_dir).select("id", "digest", "type", "signature", "cluster_id")


def breaks_by_type(spark, sf_dir):
    return breaks.by_type(_breaks(spark, sf_dir))


def row_level_impact(spark, sf_dir):
    return breaks.row_level_impact(_breaks(spark, sf_dir))


def clusters_ranked(spark, sf_dir):
    return breaks.clusters(_breaks(spark, sf_dir))


def cluster_samples(spark, sf_dir):
    return breaks.samples(_breaks(spark, sf_dir)).select("cluster_id", F.col("sample").cast("bigint").alias("sample"), "id")


# --- attribution


def attribution_effects(spark, sf_dir):
    return attribution.effects(_effects(spark, sf_dir))


def attribution_components(spark, sf_dir):
    return attribution.components(_breaks(spark, sf_dir), _effects(spark, sf_dir))


def attribution_summary(spark, sf_dir):
    return attribution.summaries(_breaks(spark, sf_dir), _effects(spark, sf_dir))


# --- history: day one is run 1, day two is run 2


def _keyed(spark, sf_dir, day: str = ""):
    c = _context(spark, sf_dir, day)
    return _once("keyed" + day, spark, sf_dir, lambda: stored(history.stable_keys(_breaks(spark, sf_dir, day), c.ledger, c.warehouse), "keyed"))


def stable_keys(spark, sf_dir):
    return _keyed(spark, sf_dir).select("break_key", "id", "type")


def _two_runs(spark, sf_dir):
    one = history.entries(_keyed(spark, sf_dir), None, 1)
    return history.entries(_keyed(spark, sf_dir, "_2"), one, 2), one


def history_diff(spark, sf_dir):
    return history.difference(*_two_runs(spark, sf_dir), 2).select("break_key", "state", "type", "magnitude_cents")


def history_streaks(spark, sf_dir):
    """Run 3 has day one's breaks again: what run 2 lacked starts anew."""
    two, _ = _two_runs(spark, sf_dir)
    return history.entries(_keyed(spark, sf_dir), two, 3).select("break_key", F.col("first_seen").cast("bigint").alias("first_seen"))


def history_sections(spark, sf_dir):
    return history.sections(history.difference(*_two_runs(spark, sf_dir), 2))


def schema_changes(spark, sf_dir):
    rows = history.schema_changes({"ledger": TYPES, "warehouse": TYPES}, {"ledger": TYPES, "warehouse": TYPES | {"batch_id": "string"}})
    return spark.createDataFrame(rows, "source string, change string, column string, from_type string, to_type string")


def history_age(spark, sf_dir):
    now, _ = _two_runs(spark, sf_dir)
    return history.cluster_ages(now, 2).withColumn("since", F.col("since").cast("bigint"))


# --- explanation and evaluation


def investigation_targets(spark, sf_dir):
    b = _breaks(spark, sf_dir)
    return offline.targets(breaks.clusters(b), attribution.summaries(b, _effects(spark, sf_dir)), SETTINGS.max_clusters).select("cluster_id", "type", "break_count", "magnitude_cents")


def adjacent_periods(spark, sf_dir):
    c = _context(spark, sf_dir)
    wanted = c.left_ledger.unionByName(c.left_warehouse).select(ref().alias("key"), "account_id", "currency", F.col("posted_date").alias("date"), F.col("amount_cents").alias("cents"))
    return tools.adjacent_matches(wanted, c)


def fetch_rows(spark, sf_dir):
    return tools.fetch_rows(_sides(spark, sf_dir)["ledger"], account_id="ACC-0007", limit=50)


def offline_classification(spark, sf_dir):
    b = _breaks(spark, sf_dir)
    return offline.classified(breaks.clusters(b), b, _context(spark, sf_dir))


def classification_summary(spark, sf_dir):
    b = _breaks(spark, sf_dir)
    return offline.classification_summary(breaks.clusters(b), attribution.summaries(b, _effects(spark, sf_dir)), _findings(spark, sf_dir))


def _all_findings(spark, sf_dir):
    b = _breaks(spark, sf_dir)
    return offline.classified(breaks.clusters(b), b, _context(spark, sf_dir)).withColumn("degraded", F.lit(False))


def eval_recall(spark, sf_dir):
    return evaluate.recall(evaluate.outcomes(_breaks(spark, sf_dir), _all_findings(spark, sf_dir)))


def eval_calibration(spark, sf_dir):
    return evaluate.calibration(evaluate.outcomes(_breaks(spark, sf_dir), _all_findings(spark, sf_dir)))


# --- generator


def generated_faults(spark, sf_dir):
    return generate.generate(spark, generate.Plan(rows=2000)).faults.groupBy("kind").agg(F.count(F.lit(1)).alias("faults"))


def next_day(spark, sf_dir):
    return generate.next_day(spark, generate.Plan(rows=2000)).warehouse.groupBy("posted_date").agg(F.count(F.lit(1)).alias("row_count"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_scan, csv_row_numbers, normalize_rows, amount_to_cents, money_format, infer_column_types, first_bad_row, business_keys, profile_summary, profile_partitions, status_histogram, duplicate_keys, match_exact, unmatched_after_exact,
        composite_edges, match_composite, match_composite_contested, match_split, match_summary, unmatched_final, check_missing, check_orphan, check_control_totals, check_row_counts, check_duplicates, check_values,
        value_bands, check_schema_drift, break_ids, breaks_by_type, row_level_impact, clusters_ranked, cluster_samples, attribution_effects, attribution_components, attribution_summary, stable_keys, history_diff,
        history_streaks, history_sections, schema_changes, history_age, investigation_targets, adjacent_periods, fetch_rows, offline_classification, classification_summary, eval_recall, eval_calibration,
        generated_faults, next_day,
    )
}
