"""Ledger and warehouse rows with known faults, made from the orders table. The same text runs on Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import ROW
from .plans.store import stored
from .sources.csv import numbered

LEDGER = """
SELECT CAST(o_orderkey + 1 AS BIGINT) AS row_number,
       CONCAT('TXN-', LPAD(CAST(o_orderkey AS VARCHAR(20)), 8, '0')) AS txn_id,
       CONCAT('ACC-', LPAD(CAST(o_custkey % 50 AS VARCHAR(20)), 4, '0')) AS account_id,
       CAST(o_orderdate AS DATE) AS posted_date,
       CAST(ROUND(o_totalprice * 100) AS BIGINT) * (CASE WHEN o_orderkey % 10 < 4 THEN -1 ELSE 1 END) AS amount_cents,
       CASE o_orderkey % 7 WHEN 3 THEN 'EUR' WHEN 4 THEN 'CAD' ELSE 'USD' END AS currency,
       o_orderstatus AS status,
       o_orderkey % 100 AS fault
FROM orders"""

LEGS = """
SELECT row_number AS k, 0 AS leg,
       CASE WHEN fault = 8 THEN NULL ELSE txn_id END AS txn_id, account_id,
       CASE WHEN fault = 3 THEN CAST(posted_date + INTERVAL '1' DAY AS DATE) ELSE posted_date END AS posted_date,
       CASE WHEN fault = 4 AND amount_cents < 0 THEN amount_cents - 1
            WHEN fault = 4 THEN amount_cents + 1
            WHEN fault = 5 THEN amount_cents + 5000 ELSE amount_cents END AS amount_cents,
       currency,
       CASE WHEN fault = 6 THEN (CASE status WHEN 'P' THEN 'F' ELSE 'P' END) ELSE status END AS status, fault
FROM ledger WHERE fault NOT IN (1, 7)
UNION ALL
SELECT row_number, 1, txn_id, account_id, posted_date, amount_cents, currency, status, fault FROM ledger WHERE fault = 2
UNION ALL
SELECT row_number, leg, NULL, account_id, posted_date,
       CASE leg WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE amount_cents - l1 - l2 END, currency, status, fault
FROM (SELECT *, CAST(FLOOR(amount_cents * 0.5) AS BIGINT) AS l1,
                CAST(FLOOR(amount_cents * 0.3) AS BIGINT) AS l2 FROM ledger WHERE fault = 7) s
CROSS JOIN (SELECT 1 AS leg UNION ALL SELECT 2 UNION ALL SELECT 3) x
UNION ALL
SELECT row_number, 9, CONCAT('WHS-ORPHAN-', LPAD(CAST(row_number AS VARCHAR(20)), 8, '0')), account_id, posted_date,
       amount_cents + 777777, 'USD', 'P', fault FROM ledger WHERE (row_number - 1) % 300 = 9"""

LEDGER_2 = """
SELECT row_number, txn_id, account_id, posted_date, amount_cents, currency, status, fault, 0 AS is_new FROM ledger
UNION ALL
SELECT (SELECT MAX(row_number) FROM ledger) + row_number, CONCAT('NEW-', LPAD(CAST(row_number - 1 AS VARCHAR(20)), 8, '0')), account_id,
       DATE '2002-01-01', amount_cents, currency, status, 0, 1
FROM ledger WHERE row_number <= 200"""

LEGS_2 = """
SELECT k, leg, txn_id, account_id, posted_date, amount_cents, currency, status FROM legs WHERE NOT (fault = 2 AND leg = 1)
UNION ALL
SELECT row_number, 0, txn_id, account_id, posted_date, amount_cents, currency, status FROM ledger WHERE fault = 1 AND (row_number - 1) % 200 = 1
UNION ALL
SELECT row_number, 0, txn_id, account_id, posted_date, amount_cents, currency, status FROM ledger_2
WHERE is_new = 1 AND txn_id NOT IN ('NEW-00000000', 'NEW-00000001', 'NEW-00000002')"""


def _order(start: str) -> str:
    return f"MD5(CONCAT('{start}', CAST(k AS VARCHAR(20)), '-', CAST(leg AS VARCHAR(5))))"


def numbered_sql(legs: str, start: str = "") -> str:
    return f"SELECT CAST(ROW_NUMBER() OVER (ORDER BY {_order(start)}, leg) AS BIGINT) AS row_number, txn_id, account_id, posted_date, amount_cents, currency, status FROM {legs}"


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    for name in tables:
        text = re.sub(rf"\bFROM {name}\b", f"FROM {{{name}}}", text)
    return spark.sql(text, **tables)


def _shuffled(legs: DataFrame, start: str) -> DataFrame:
    """Numbered in the order of a hash: a range partitioning and a count for each partition, not one task's window.

    The order is stored with each row's place, since a range partitioning may be cut elsewhere when it is computed again."""
    ordered = legs.withColumn("_h", F.expr(_order(start))).repartitionByRange("_h", "leg").sortWithinPartitions("_h", "leg")
    return numbered(stored(ordered.withColumn("_place", F.monotonically_increasing_id()), "ordered"), placed=True)


_made: dict[tuple[str, str], dict[str, DataFrame]] = {}


def sides(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """ledger, warehouse and both of day two, made once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        ledger = stored(_sql(spark, LEDGER, orders=orders), "ledger")
        legs = stored(_sql(spark, LEGS, ledger=ledger), "legs")
        ledger_2 = stored(_sql(spark, LEDGER_2, ledger=ledger), "ledger2")
        legs_2 = _sql(spark, LEGS_2, legs=legs, ledger=ledger, ledger_2=ledger_2)
        row = lambda df, side: df.withColumn("source", F.lit(side)).select(*ROW)
        _made[key] = {
            "ledger": row(ledger, "ledger"),
            "warehouse": stored(row(_shuffled(legs, ""), "warehouse"), "warehouse"),
            "ledger_2": row(ledger_2, "ledger"),
            "warehouse_2": stored(row(_shuffled(legs_2, "day2-"), "warehouse"), "warehouse2"),
        }
    return _made[key]
