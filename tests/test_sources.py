"""Reading text: columns, rows, errors, types."""

import datetime

import pytest

from tally_spark.config import InputError
from tally_spark.sources import csv

HEAD = "txn_id, account_id ,posted_date,amount,currency,status\n"


def written(tmp_path, text, name="x.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_rows(spark, tmp_path):
    path = written(tmp_path, HEAD + ' T1 ,ACC-1,2026-01-05,"1,234.56",usd,posted\n,ACC-2,2026-01-06,-5,,\n"T\n3",ACC-3,2026-01-07,0.005,eur,x\n')
    found = csv.load(csv.read_text(spark, path), "ledger", path).orderBy("row_number").collect()
    assert [tuple(r)[1:] for r in found] == [(1, "T1", "ACC-1", datetime.date(2026, 1, 5), 123456, "USD", "POSTED"), (2, None, "ACC-2", datetime.date(2026, 1, 6), -500, "USD", "UNKNOWN"), (3, "T\n3", "ACC-3", datetime.date(2026, 1, 7), 1, "EUR", "X")]


def test_numbers_follow_the_file_whatever_the_splits(spark, tmp_path):
    path = written(tmp_path, "".join(f"{i}\n" for i in range(5000)))
    raw = spark.read.text(path).repartitionByRange(7, "value").sortWithinPartitions("value")
    found = csv.numbered(raw).select("value", "row_number").collect()
    assert [r.row_number for r in sorted(found, key=lambda r: r.value)] == list(range(1, 5001))


def test_missing_column(spark, tmp_path):
    path = written(tmp_path, "txn_id,account_id,amount\n1,2,3\n")
    with pytest.raises(InputError, match="posted_date, currency, status"):
        csv.load(csv.read_text(spark, path), "ledger", path)


@pytest.mark.parametrize(("row", "said"), [("T,,2026-01-05,1,USD,P", "account_id"), ("T,A,2026-13-05,1,USD,P", "2026-13-05"), ("T,A,2026-1-5,1,USD,P", "2026-1-5"), ("T,A,,1,USD,P", "posted_date"), ("T,A,2026-01-05,x1,USD,P", "x1"), ("T,A,2026-01-05,,USD,P", "amount")])
def test_first_bad_row_stops_the_run(spark, tmp_path, row, said):
    path = written(tmp_path, HEAD + f"T,A,2026-01-05,1,USD,P\n{row}\n,,,,,\n")
    with pytest.raises(InputError, match=f"row 2: .*{said}"):
        csv.load(csv.read_text(spark, path), "ledger", path)


def test_no_file(spark, tmp_path):
    with pytest.raises(InputError):
        csv.read_text(spark, str(tmp_path / "none.csv"))


def test_types(spark):
    raw = spark.createDataFrame([(1, "100", "1", "", "2026-01-05", "1,000"), (2, "100.50", "TXN-2", None, " 2026-01-06 ", "+5"), (60, "x", "2", "late", "x", "x")], "row_number long, a string, b string, c string, d string, e string")
    assert {r.column: r.type for r in csv.infer_types(raw).collect()} == {"a": "decimal", "b": "string", "c": "unknown", "d": "date", "e": "string"}
    assert csv.types_of_schema(spark.createDataFrame([], "a int, b decimal(5,2), c date, d string, e double")) == {"a": "integer", "b": "decimal", "c": "date", "d": "string", "e": "decimal"}


def test_digest(spark, tmp_path):
    import hashlib

    path = written(tmp_path, "abc")
    assert csv.digest(spark, path) == (hashlib.sha256(b"abc").hexdigest(), 3)
    written(tmp_path, "def", "y.csv")
    assert csv.digest(spark, str(tmp_path))[1] == 6
