"""Scores of an explanation layer against known faults: recall by kind, coverage, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind of fault: where its break is found (type, band, start of the identifier), and the class expected.
SCORED = {
    "missing": ("missing_in_target", None, None, "MISSING_IN_TARGET"),
    "orphan": ("orphan_in_target", None, "WHS-ORPHAN-", "GENUINE_DISCREPANCY"),
    "duplicated": ("duplicate", None, None, "DUPLICATE_IN_TARGET"),
    "timing": ("value_mismatch", "date_shifted", None, "TIMING_DIFFERENCE"),
    "rounding": ("value_mismatch", "sub_tolerance", None, "ROUNDING"),
    "material": ("value_mismatch", "material", None, "GENUINE_DISCREPANCY"),
    "status": ("value_mismatch", "status_only", None, "GENUINE_DISCREPANCY"),
}
BANDS = [(0.0, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.0)]


def _chosen(pick: int) -> Column:
    out = None
    for kind, (type_, band, start, expected) in SCORED.items():
        here = F.col("type") == type_
        if band:
            here = here & (F.col("details.band") == band)
        if start:
            here = here & F.coalesce(F.col("details.txn_id").startswith(start), F.lit(False))
        value = (kind, expected)[pick]
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def outcomes(breaks: DataFrame, findings: DataFrame) -> DataFrame:
    """kind, expected, actual, confidence, answered for each break at a fault's place. findings: cluster_id, classification, confidence, degraded."""
    placed = breaks.withColumn("kind", _chosen(0)).withColumn("expected", _chosen(1)).filter("kind IS NOT NULL")
    joined = placed.join(findings, "cluster_id", "left")
    answered = F.col("classification").isNotNull() & ~F.coalesce("degraded", F.lit(True))
    return joined.select("kind", "expected", F.coalesce("classification", F.lit("NOT_INVESTIGATED")).alias("actual"), "confidence", answered.alias("answered"))


def recall(found: DataFrame) -> DataFrame:
    correct = F.count_if(F.col("actual") == F.col("expected"))
    return found.groupBy("kind", "expected").agg(F.count(F.lit(1)).alias("breaks"), correct.alias("correct"), F.round(correct / F.count(F.lit(1)), 3).alias("recall"))


def overall(found: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    share = lambda x: F.when(n == 0, F.lit(0.0)).otherwise(F.round(F.count_if(x) / n, 3))
    return found.agg(share(F.col("actual") == F.col("expected")).alias("recall"), share(F.col("answered")).alias("coverage"), n.alias("breaks"))


def calibration(found: DataFrame) -> DataFrame:
    """By band of confidence (its lower end included; the last includes 1): breaks, mean confidence, accuracy."""
    band = F.lit(f"{BANDS[-1][0]}-{BANDS[-1][1]}")
    for low, high in reversed(BANDS[:-1]):
        band = F.when(F.col("confidence") < high, f"{low}-{high}").otherwise(band)
    n = F.count(F.lit(1))
    return found.filter("answered").groupBy(band.alias("band")).agg(n.alias("breaks"), F.round(F.avg("confidence"), 3).alias("mean_confidence"), F.round(F.count_if(F.col("actual") == F.col("expected")) / n, 3).alias("accuracy"))


def calibration_error(bands: DataFrame) -> DataFrame:
    """Mean of the bands' differences, weighted by breaks; null without answers."""
    return bands.agg(F.round(F.sum(F.col("breaks") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("breaks"), 3).alias("expected_calibration_error"))
