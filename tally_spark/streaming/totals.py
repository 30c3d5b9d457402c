"""Control totals and profiles over streams of transactions: an addition, since a batch run needs none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(rows: DataFrame, arrived: str, lateness: str = "2 days") -> DataFrame:
    """Totals and counts of both sides by day and currency. rows: transactions of both sides with a time of arrival; days are closed once arrivals are lateness past them."""
    day = rows.withColumn("_day", F.to_timestamp("posted_date")).withWatermark("_day", lateness)
    side = lambda s, x: F.sum(F.when(F.col("source") == s, x).otherwise(0))
    return day.groupBy(F.window("_day", "1 day").alias("_w"), "currency").agg(
        side("ledger", F.col("amount_cents")).alias("ledger_total"), side("warehouse", F.col("amount_cents")).alias("warehouse_total"), side("ledger", F.lit(1)).alias("ledger_rows"), side("warehouse", F.lit(1)).alias("warehouse_rows"), F.max(arrived).alias("last_arrival"),
    ).select(F.col("_w.start").cast("date").alias("posted_date"), "currency", "ledger_total", "warehouse_total", "ledger_rows", "warehouse_rows", "last_arrival")
