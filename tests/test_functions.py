"""Money, keys, settings."""

import pytest
from pyspark.sql import functions as F

from tally_spark.config import Settings
from tally_spark.functions import money
from tally_spark.functions.keys import with_keys


@pytest.mark.parametrize(("text", "cents"), [("1,234.56", 123456), ("+42.00", 4200), ("-0.01", -1), ("0.005", 1), ("-0.005", -1), ("0.0049999999999999999999", 0), ("7", 700), ("1,2,3", 12300), ("0.29", 29), ("1.15", 115), (" 5.1 ", 510)])
def test_amounts(spark, text, cents):
    assert spark.createDataFrame([(text,)], "t string").select(money.cents_from_text(F.col("t"))).first()[0] == cents


@pytest.mark.parametrize("text", ["", "  ", "abc", "12.34.56", "1e5", ".5", "5.", "$5", None, "9" * 30])
def test_no_amounts(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(money.cents_from_text(F.col("t"))).first()[0] is None


def test_formats(spark):
    values = [0, 5, -5, 123456, -123456, 99, 100, -100, 123456789]
    rows = spark.createDataFrame([(v,) for v in values], "c long").select("c", money.money(F.col("c")).alias("m"), money.humane(F.col("c")).alias("h")).collect()
    assert [(r.m, r.h) for r in rows] == [(money.money_text(v), money.humane_text(v)) for v in values]
    assert money.money_text(-123456) == "-1234.56" and money.humane_text(-123456) == "-$1,234.56"


def test_tolerance_is_inclusive(spark):
    r = spark.range(1).select(money.within(F.lit(10), F.lit(11), 1), money.within(F.lit(10), F.lit(12), 1)).first()
    assert tuple(r) == (True, False)


def test_business_keys(spark):
    rows = spark.createDataFrame([("ledger", 1, "T", "A", "2026-01-05", 100, "USD"), ("ledger", 2, None, "A", "2026-01-05", 100, "USD"), ("ledger", 3, "", "A", "2026-01-05", 100, "USD")], "source string, row_number long, txn_id string, account_id string, posted_date string, amount_cents long, currency string")
    found = with_keys(rows.withColumn("posted_date", F.to_date("posted_date"))).orderBy("row_number").collect()
    assert [r.business_key for r in found] == ["txn:T", "composite:A:USD:100:2026-01-05", "composite:A:USD:100:2026-01-05"]
    assert found[1].ref == "ledger:2"


def test_settings():
    assert Settings().digest() == Settings(explain=False, max_clusters=1).digest() != Settings(tolerance_cents=0).digest()
    assert len(Settings().digest()) == 16
    with pytest.raises(ValueError):
        Settings(tolerance_cents=-1)
