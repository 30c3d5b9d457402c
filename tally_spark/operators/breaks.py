"""Break identity, clusters and their rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import BREAK

_WHOLE = {"ignoreNullFields": "false"}


def payload() -> Column:
    """Canonical JSON of all that makes a break what it is."""
    return F.to_json(F.struct("type", F.struct(F.col("date").cast("string").alias("date"), "account_id", "currency").alias("partition"), "magnitude_cents", "ledger_refs", "warehouse_refs", "details"), _WHOLE)


def signature() -> Column:
    j = lambda *cols: F.to_json(F.struct(*cols), _WHOLE)
    day = j(F.col("date").cast("string").alias("date"), F.col("currency"))
    return (
        F.when(F.col("type").isin("missing_in_target", "orphan_in_target"), day)
        .when(F.col("type") == "value_mismatch", j(F.col("details.fields").alias("fields"), F.col("details.band").alias("band")))
        .when(F.col("type") == "duplicate", j(F.col("details.source").alias("source")))
        .when(F.col("type").isin("control_total_mismatch", "row_count_mismatch"), j(F.col("currency")))
        .otherwise(j(F.col("details.kind").alias("kind")))
    )


def identified(breaks: DataFrame) -> DataFrame:
    """BREAK with digest (the whole content's), id (its first digits, for people), signature and cluster_id. Keys inside the engine are digests: short ids may collide at tens of millions of breaks."""
    found = breaks.withColumn("digest", F.sha2(payload(), 256)).withColumn("signature", signature())
    return found.select(F.concat(F.lit("brk_"), F.substring("digest", 1, 12)).alias("id"), "digest", *BREAK, "signature", F.concat(F.lit("cls_"), F.substring(F.sha2(F.concat_ws("|", "type", "signature"), 256), 1, 10)).alias("cluster_id"))


def clusters(breaks: DataFrame) -> DataFrame:
    """One row for each type and signature: counts, signed sum, dates, and its place in the report.

    Membership stays in breaks (cluster_id): a cluster of millions isn't made one row. The order is total: row level
    first, then the larger absolute sum, the larger count, the id. There are few clusters; the rank sorts those only."""
    grouped = breaks.groupBy("cluster_id", "type", "level", "signature").agg(
        F.count(F.lit(1)).alias("break_count"), F.sum("magnitude_cents").alias("magnitude_cents"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("days")
    )
    order = Window.orderBy(F.when(F.col("level") == "row", 0).otherwise(1), F.abs("magnitude_cents").desc(), F.col("break_count").desc(), "cluster_id")
    return grouped.withColumn("rank", F.row_number().over(order).cast("bigint"))


def samples(breaks: DataFrame, n: int = 3) -> DataFrame:
    """The first breaks of each cluster by id; Spark keeps n of each task before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("cluster_id").orderBy("digest"))
    return breaks.withColumn("sample", nth).filter(F.col("sample") <= n)


def by_type(breaks: DataFrame) -> DataFrame:
    return breaks.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def row_level_impact(breaks: DataFrame) -> DataFrame:
    """Sum of absolute row-level magnitudes: aggregates describe the same money again."""
    return breaks.filter("level = 'row'").agg(F.coalesce(F.sum(F.abs("magnitude_cents")), F.lit(0)).alias("impact_cents"))
