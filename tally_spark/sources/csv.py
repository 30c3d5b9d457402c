"""Transactions from delimited text, or from any DataFrame of text columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import InputError
from ..functions.keys import ROW
from ..functions.money import cents_from_text

REQUIRED = ["txn_id", "account_id", "posted_date", "amount", "currency", "status"]
SAMPLE = 50


def stripped(c: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text with stripped names, and row_number from 1 in file order."""
    try:
        raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    except Exception as error:
        raise InputError(f"{path}: {error}") from error
    if not raw.columns:
        raise InputError(f"{path}: no header")
    return numbered(raw.toDF(*[c.strip() for c in raw.columns]))


def numbered(raw: DataFrame, name: str = "row_number", placed: bool = False) -> DataFrame:
    """Consecutive numbers in the order of partitions and of rows within them: one count for each partition, no global sort. placed: raw has them as _place already."""
    marked = (raw if placed else raw.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("_part"), F.coalesce(before, F.lit(0)).alias("_before"))
    # one row for each partition of the input
    joined = marked.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_place", "_part", "_before", "_n")


def require_columns(columns: list[str], path: str = "input") -> None:
    missing = [c for c in REQUIRED if c not in columns]
    if missing:
        raise InputError(f"{path}: missing columns {', '.join(missing)}")


def parsed(raw: DataFrame, source: str) -> DataFrame:
    """ROW with error: what is wrong with the row, or null."""
    date = F.expr("try_to_date(_date, 'yyyy-MM-dd')")
    text = raw.select(
        "row_number", stripped(F.col("txn_id")).alias("txn_id"), stripped(F.col("account_id")).alias("account_id"), stripped(F.col("posted_date")).alias("_date"), stripped(F.col("amount")).alias("_amount"),
        F.upper(F.coalesce(stripped(F.col("currency")), F.lit("USD"))).alias("currency"), F.upper(F.coalesce(stripped(F.col("status")), F.lit("UNKNOWN"))).alias("status"),
    ).withColumn("posted_date", F.when(F.col("_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), date)).withColumn("amount_cents", cents_from_text(F.col("_amount")))
    error = (
        F.when(F.col("account_id").isNull(), "account_id is missing")
        .when(F.col("_date").isNull(), "posted_date is missing")
        .when(F.col("posted_date").isNull(), F.concat(F.lit("posted_date "), "_date", F.lit(" isn't a date")))
        .when(F.col("_amount").isNull(), "amount is missing")
        .when(F.col("amount_cents").isNull(), F.concat(F.lit("amount "), "_amount", F.lit(" isn't a number")))
    )
    return text.withColumn("source", F.lit(source)).withColumn("error", error).select(*ROW, "error")


def first_bad_row(rows: DataFrame) -> DataFrame:
    return rows.filter("error IS NOT NULL").select("row_number", "error").orderBy("row_number").limit(1)


def load(raw: DataFrame, source: str, path: str = "input") -> DataFrame:
    """Transaction rows; the first malformed one stops the run."""
    require_columns(raw.columns, path)
    rows = parsed(raw, source)
    bad = first_bad_row(rows).first()
    if bad:
        raise InputError(f"{path}, row {bad.row_number}: {bad.error}")
    return rows.drop("error")


def value_type(c: Column) -> Column:
    return (
        F.when(stripped(c).isNull(), "unknown")
        .when(stripped(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), "date")
        .when(stripped(c).rlike(r"^-?\d+\.\d+$"), "decimal")
        .when(stripped(c).rlike(r"^-?\d+$"), "integer")
        .otherwise("string")
    )


def infer_types(raw: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """column, position and type over the first rows; for reports of drift only, never for parsing."""
    names = [c for c in raw.columns if c != "row_number"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(names)])
    long = raw.filter(F.col("row_number") <= sample).select(F.explode(pairs).alias("x")).select("x.*")
    types = long.groupBy("column", "position").agg(F.array_sort(F.collect_set(F.nullif(value_type(F.col("value")), F.lit("unknown")))).alias("t"))
    merged = F.when(F.size("t") == 0, "unknown").when(F.size("t") == 1, F.col("t")[0]).when(F.array_join("t", ",") == "decimal,integer", "decimal").otherwise("string")
    found = types.select("column", "position", merged.alias("type"))
    every = raw.sparkSession.createDataFrame([(c, i) for i, c in enumerate(names)], "column string, position int")
    return every.join(found.select("column", "type"), "column", "left").select("column", "position", F.coalesce("type", F.lit("unknown")).alias("type"))


def types_of_schema(df: DataFrame) -> dict[str, str]:
    """The same names for a typed source: an extension, since text sources have no types of their own."""
    kinds = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "date": "date", "double": "decimal", "float": "decimal"}
    return {c: "decimal" if t.startswith("decimal") else kinds.get(t, "string") for c, t in df.dtypes if c != "row_number"}


def digest(spark: SparkSession, path: str) -> tuple[str, int]:
    """SHA-256 of a file's bytes and its size; of several files, of their sorted names and digests."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"), "length")
    rows = sorted((r.name, r.sha, r.length) for r in files.collect())  # one row for each file
    if len(rows) == 1:
        return rows[0][1], rows[0][2]
    return hashlib.sha256("".join(f"{n}:{s}\n" for n, s, _ in rows).encode()).hexdigest(), sum(x for _, _, x in rows)


def digest_rows(rows: DataFrame) -> str:
    """A digest of rows that have no file, whatever their order: sums of two 64-bit hashes, exact, and the count. A hash is summed in parts of 16 bits, which no number of rows makes overflow."""
    hashes = rows.select(F.xxhash64(*ROW).alias("a"), F.xxhash64(F.lit("second"), *ROW).alias("b"))
    parts = [F.sum(F.shiftrightunsigned(x, 16 * k).bitwiseAND(0xFFFF)).alias(f"{x}{k}") for x in ("a", "b") for k in range(4)]
    r = hashes.agg(*parts, F.count(F.lit(1)).alias("n")).first()
    a, b = (sum((r[f"{x}{k}"] or 0) << 16 * k for k in range(4)) for x in ("a", "b"))
    return hashlib.sha256(f"{a}|{b}|{r.n}".encode()).hexdigest()


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """Required columns first, others after them."""
    order = [c for c in REQUIRED if c in df.columns] + [c for c in (columns or df.columns) if c not in REQUIRED]
    df.select(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
