"""Which row-level breaks explain each daily total that doesn't tie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = {
    "missing_in_target": "missing in warehouse",
    "orphan_in_target": "orphan in warehouse",
    "duplicate": "extra duplicate copies",
    "value_mismatch:date_shifted": "posted on a different day",
    "value_mismatch:sub_tolerance": "rounding within tolerance",
    "value_mismatch:material": "changed amounts",
    "split": "split deposits, reconciled",
}


def row_effects(breaks: DataFrame, members: DataFrame, matches: DataFrame, left_ledger: DataFrame, left_warehouse: DataFrame) -> DataFrame:
    """date, currency, cause, source_id, cents, rows: what each break does to warehouse minus ledger, on each row's own day."""
    sign = F.when(F.col("source") == "warehouse", 1).otherwise(-1)
    one_sided = breaks.filter("type IN ('missing_in_target', 'orphan_in_target')").select("date", "currency", F.col("type").alias("cause"), F.col("digest").alias("source_id"), F.when(F.col("type") == "orphan_in_target", F.col("magnitude_cents")).otherwise(-F.col("magnitude_cents")).alias("cents"), F.when(F.col("type") == "orphan_in_target", 1).otherwise(-1).cast("bigint").alias("rows"))
    duplicate_sign = F.when(F.col("details.source") == "warehouse", 1).otherwise(-1)
    copies = breaks.filter("type = 'duplicate'").select("date", "currency", F.lit("duplicate").alias("cause"), F.col("digest").alias("source_id"), (duplicate_sign * F.col("magnitude_cents")).alias("cents"), (duplicate_sign * (F.col("details.occurrences") - 1)).alias("rows"))
    # a break names its match by the ledger and warehouse refs, which are the match's own
    named = breaks.filter("type = 'value_mismatch'").select(F.col("digest").alias("_id"), F.concat(F.lit("value_mismatch:"), "details.band").alias("_cause"), "ledger_refs", "warehouse_refs")
    valued = matches.select("match_id", "ledger_refs", "warehouse_refs", "strategy").join(named, ["ledger_refs", "warehouse_refs"], "left")
    wanted = valued.filter("_id IS NOT NULL OR strategy = 'split'").select("match_id", F.coalesce("_cause", F.lit("split")).alias("cause"), F.coalesce("_id", F.concat(F.lit("split:"), "match_id")).alias("source_id"))
    paired = members.join(wanted, "match_id").select(F.col("posted_date").alias("date"), "currency", "cause", "source_id", (sign * F.col("amount_cents")).alias("cents"), sign.cast("bigint").alias("rows"))
    return one_sided.unionByName(copies).unionByName(paired)


def effects(rows: DataFrame) -> DataFrame:
    """By day, currency and cause: cents, rows and how many breaks. Breaks are counted once each, by a first grouping."""
    each = rows.groupBy("date", "currency", "cause", "source_id").agg(F.sum("cents").alias("cents"), F.sum("rows").alias("rows"))
    return each.groupBy("date", "currency", "cause").agg(F.sum("cents").alias("cents"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("breaks"))


def _targets(breaks: DataFrame) -> DataFrame:
    measure = F.when(F.col("type") == "control_total_mismatch", "cents").otherwise("rows")
    gap = F.when(F.col("type") == "control_total_mismatch", F.col("magnitude_cents")).otherwise(F.col("details.delta").cast("bigint"))
    return breaks.filter("type IN ('control_total_mismatch', 'row_count_mismatch')").select("cluster_id", "digest", "date", "currency", measure.alias("measure"), gap.alias("gap"))


def components(breaks: DataFrame, rows: DataFrame) -> DataFrame:
    """cluster_id, measure, cause, label, breaks, value: each cause that moved the measure on any of the cluster's days."""
    each = rows.groupBy("date", "currency", "cause", "source_id").agg(F.sum("cents").alias("cents"), F.sum("rows").alias("rows"))
    met = _targets(breaks).join(each, ["date", "currency"]).withColumn("_moved", F.when(F.col("measure") == "cents", F.col("cents")).otherwise(F.col("rows")))
    # a cause touches a day if its sum there isn't zero
    day = met.groupBy("cluster_id", "measure", "cause", "date", "currency").agg(F.sum("_moved").alias("_day"))
    value = day.groupBy("cluster_id", "measure", "cause").agg(F.sum("_day").alias("value"), F.max(F.col("_day") != 0).alias("_touched")).filter("_touched")
    ids = met.groupBy("cluster_id", "cause").agg(F.countDistinct("source_id").alias("breaks"))
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("cause")], F.col("cause"))
    return value.join(ids, ["cluster_id", "cause"]).select("cluster_id", "measure", "cause", label.alias("label"), "breaks", "value")


def summaries(breaks: DataFrame, rows: DataFrame) -> DataFrame:
    """cluster_id, measure, gap, residual, unexplained (days that don't balance by themselves), explained."""
    day = effects(rows).groupBy("date", "currency").agg(F.sum("cents").alias("_cents"), F.sum("rows").alias("_rows"))
    met = _targets(breaks).join(day, ["date", "currency"], "left").withColumn("_effect", F.coalesce(F.when(F.col("measure") == "cents", F.col("_cents")).otherwise(F.col("_rows")), F.lit(0)))
    found = met.groupBy("cluster_id", "measure").agg(F.sum("gap").alias("gap"), (F.sum("gap") - F.sum("_effect")).alias("residual"), F.count_if(F.col("gap") != F.col("_effect")).alias("unexplained"))
    return found.withColumn("explained", F.col("unexplained") == 0)
