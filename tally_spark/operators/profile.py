"""Facts about one side: counts, totals, duplicate keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import business_key


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("account_id").alias("accounts"), F.countDistinct("currency").alias("currencies"),
        F.min("posted_date").alias("min_date"), F.max("posted_date").alias("max_date"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("total_cents"),
    )


def partitions(rows: DataFrame) -> DataFrame:
    """Control totals and row counts by day and currency."""
    return rows.groupBy("posted_date", "currency").agg(F.sum("amount_cents").alias("total_cents"), F.count(F.lit(1)).alias("row_count"))


def status_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("row_count"))


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """Business keys with more than one row. Counted first, so that only repeated keys' rows are listed."""
    own = rows.withColumn("business_key", business_key())
    many = own.groupBy("business_key").agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    return many


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
