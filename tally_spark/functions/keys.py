"""Derived keys of a transaction row, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = ["source", "row_number", "txn_id", "account_id", "posted_date", "amount_cents", "currency", "status"]
SCHEMA = "source string, row_number bigint, txn_id string, account_id string, posted_date date, amount_cents bigint, currency string, status string"
SORT = ["posted_date", "account_id", "amount_cents", "_id_or_blank", "row_number"]


def keyed() -> Column:
    return F.col("txn_id").isNotNull() & (F.col("txn_id") != "")


def business_key(separator: str = ":") -> Column:
    """What names a row's subject: its identifier, or what it is about."""
    about = [F.lit("composite"), F.col("account_id"), F.col("currency"), F.col("amount_cents").cast("string"), F.col("posted_date").cast("string")]
    return F.when(keyed(), F.concat_ws(separator, F.lit("txn"), "txn_id")).otherwise(F.concat_ws(separator, *about))


def ref() -> Column:
    return F.concat_ws(":", "source", F.col("row_number").cast("string"))


def sort_columns(prefix: str = "") -> list[Column]:
    """Columns of the total order in which rows are consumed. Status and currency aren't in it."""
    c = lambda x: F.col(prefix + x)
    return [c("posted_date"), c("account_id"), c("amount_cents"), F.coalesce(c("txn_id"), F.lit("")), c("row_number")]


def with_keys(rows: DataFrame) -> DataFrame:
    return rows.withColumn("business_key", business_key()).withColumn("ref", ref())
