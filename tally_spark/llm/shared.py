"""What the operators share: tables in the folder that all executors see, and small column helpers."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For the job that writes a table: its shuffle files go when it is done, not when the driver collects its garbage; and
#: fewer rows go to a Python worker at once, since a row is a whole text.
CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}

_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tally-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared folder and read it again. This cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    try:
        (writer.partitionBy(*by) if by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the tables from saved() that df reads and no later job does."""
    stored = {path for _, path in _written}
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        # a local path has file:/ or file:/// before it
        name = path.rsplit("/", 1)[1]
        if any(x.endswith("/" + name) for x in stored):
            drop_path(df.sparkSession, path)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended; its folder is the cluster's to clear
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, that no column of df has in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_mark(doc_id: Column, digest: Column) -> Column:
    """One value for an identifier, null or not, and the digest of a text; rows with equal ones are repeated rows."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), digest)


def only(docs: DataFrame, kept: DataFrame, mark: Column) -> DataFrame:
    """One row of docs for each of the distinct values in kept's only column; mark gives a row's value. The texts are shuffled once, by it."""
    own, there = fresh(docs, "_mark"), fresh(docs, "_kept")
    found = docs.withColumn(own, mark).join(kept.toDF(there), F.col(own) == F.col(there), "left_semi")
    return found.dropDuplicates([own]).drop(own)
