"""A corpus pipeline: quality classifier, exact and near deduplication, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is stored as Parquet and read again as the next one's
docs. All but the last return the columns of documents. Part of the subpackage llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tally_spark.llm import op04_quality, op05_packing, op06_decontaminate, op07_near_dedup, op08_exact_dedup
from tally_spark.llm.shared import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return op04_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return op08_exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return op07_near_dedup.drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return op06_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each with its token ids."""
    return op05_packing.pieces(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("clean", clean), ("pack", pack)]

#: The classifier and the near-duplicate search can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
