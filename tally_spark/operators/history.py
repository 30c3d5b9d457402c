"""Run-to-run state: stable names of breaks, and tables that only grow.

A run writes its parts under run=N and then a marker; readers see runs with a marker only, so a run that dies half-way
leaves nothing visible. All file access goes through Spark and Hadoop's file systems.

Both sides of a join here grow with the breaks. Spark's estimate of a few columns of a compressed file may be far below
what they take in memory, so the joins are shuffled: a broadcast would gather all keys on the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import HistoryError
from ..functions.keys import business_key

VERSION = 1


def row_keys(breaks: DataFrame, ledger: DataFrame, warehouse: DataFrame) -> DataFrame:
    """digest and subject of row breaks other than duplicates: the sorted business keys of their ledger rows, or else of their warehouse rows."""
    refs = F.when(F.size("ledger_refs") > 0, F.col("ledger_refs")).otherwise(F.col("warehouse_refs"))
    wanted = breaks.filter("type IN ('missing_in_target', 'orphan_in_target', 'value_mismatch')").select("digest", F.explode(refs).alias("_ref"))
    both = ledger.unionByName(warehouse).select(F.concat_ws(":", "source", F.col("row_number").cast("string")).alias("_ref"), business_key().alias("_key"))
    return wanted.hint("shuffle_merge").join(both, "_ref").groupBy("digest").agg(F.array_join(F.array_sort(F.collect_list("_key")), "|").alias("subject"))


def stable_keys(breaks: DataFrame, ledger: DataFrame, warehouse: DataFrame) -> DataFrame:
    """breaks with break_key: what a break is about, whatever the rows' order. Breaks with one key are numbered from 2 in order of id."""
    joined = breaks.join(row_keys(breaks, ledger, warehouse).hint("shuffle_merge"), "digest", "left")
    subject = (
        F.when(F.col("type").isin("control_total_mismatch", "row_count_mismatch"), F.concat_ws("|", F.col("date").cast("string"), "currency"))
        .when(F.col("type") == "schema_drift", F.concat_ws("|", "details.kind", "details.column"))
        .when(F.col("type") == "duplicate", F.concat_ws("|", "details.source", "details.business_key"))
        .otherwise(F.col("subject"))
    )
    keyed = joined.withColumn("_base", F.concat_ws("|", "type", subject))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("digest"))
    key: Column = F.when(nth == 1, F.col("_base")).otherwise(F.concat_ws("#", "_base", nth.cast("string")))
    return keyed.withColumn("break_key", key).drop("_base", "subject")


def entries(keyed: DataFrame, previous: DataFrame | None, run: int) -> DataFrame:
    """This run's rows for the history: a break that the previous run had keeps its first run."""
    now = keyed.select("break_key", F.col("id").alias("break_id"), "type", (F.col("level") == "row").alias("row_level"), "magnitude_cents", "cluster_id")
    if previous is None:
        return now.withColumn("first_seen", F.lit(run))
    before = previous.select(F.col("break_key").alias("_key"), F.col("first_seen").alias("_first"))
    return now.join(before.hint("shuffle_merge"), F.col("break_key") == F.col("_key"), "left").withColumn("first_seen", F.coalesce("_first", F.lit(run))).drop("_key", "_first")


def difference(now: DataFrame, previous: DataFrame | None, run: int) -> DataFrame:
    """state (new, still_open, resolved) of each key of this and the previous run; one full outer join."""
    if previous is None:
        return now.withColumn("state", F.lit("new"))
    columns = ["break_key", "break_id", "type", "row_level", "magnitude_cents", "first_seen"]
    gone = previous.select(*columns).join(now.select("break_key").hint("shuffle_merge"), "break_key", "left_anti").select(*columns).withColumn("state", F.lit("resolved"))
    return now.select(*columns).withColumn("state", F.when(F.col("first_seen") == run, "new").otherwise("still_open")).unionByName(gone)


def sections(diff: DataFrame) -> DataFrame:
    """By state and type: breaks and row-level money."""
    return diff.groupBy("state", "type").agg(F.count(F.lit(1)).alias("breaks"), F.coalesce(F.sum(F.when(F.col("row_level"), F.abs("magnitude_cents"))), F.lit(0)).alias("row_level_cents"))


def cluster_ages(now: DataFrame, run: int) -> DataFrame:
    """By cluster: new and carried breaks, and the earliest run of the carried ones."""
    old = F.col("first_seen") < run
    return now.groupBy("cluster_id").agg(F.count_if(~old).alias("new"), F.count_if(old).alias("carried"), F.min(F.when(old, F.col("first_seen"))).alias("since"))


def schema_changes(before: dict[str, dict[str, str]], now: dict[str, dict[str, str]]) -> list[tuple[str, str, str, str | None, str | None]]:
    """source, change, column, from and to: removed, added, then retyped columns; unknown types never count."""
    out = []
    for source in sorted(before.keys() & now.keys()):
        a, b = before[source], now[source]
        if not a or not b:
            continue
        out += [(source, "column_removed", c, a[c], None) for c in sorted(a.keys() - b.keys())]
        out += [(source, "column_added", c, None, b[c]) for c in sorted(b.keys() - a.keys())]
        out += [(source, "type_changed", c, a[c], b[c]) for c in sorted(a.keys() & b.keys()) if a[c] != b[c] and "unknown" not in (a[c], b[c])]
    return out


@dataclass
class Run:
    number: int
    started_at: str
    fingerprint: str
    config_digest: str
    ledger_digest: str
    warehouse_digest: str
    break_count: int
    row_level_impact_cents: int
    engine_version: str
    schemas: dict[str, dict[str, str]]


class History:
    """Runs under a folder: run=N/breaks (Parquet) and run=N/run.json, which is the marker."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.exists(self._at(f"{self.path}/VERSION")):
            text = self._read(f"{self.path}/VERSION").strip()
            if not text.isdigit():
                raise HistoryError(f"{path} isn't a run history")
            if int(text) > VERSION:
                raise HistoryError(f"{path} was written by a newer version ({text})")
        elif self._fs.exists(self._at(self.path)) and self._fs.listStatus(self._at(self.path)):
            raise HistoryError(f"{path} isn't a run history")

    def _read(self, path: str) -> str:
        return "\n".join(r.value for r in self.spark.read.option("wholetext", True).text(path).collect())

    def _write(self, path: str, text: str) -> None:
        """To another name first; the rename makes it visible at once."""
        temp = self._at(path + ".writing")
        out = self._fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(temp, self._at(path)):
            raise HistoryError(f"{path} can't be written")

    def runs(self) -> list[Run]:
        found = self._fs.globStatus(self._at(f"{self.path}/run=*/run.json")) or []
        return sorted((Run(**json.loads(self._read(x.getPath().toString()))) for x in found), key=lambda r: r.number)

    def breaks(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/run={number}/breaks")

    def record(self, run: Run, keyed: DataFrame) -> tuple[Run, Run | None, bool]:
        """Append unless the latest run has the same fingerprint. Returns the run, the one before it, and whether it is a rerun."""
        runs = self.runs()
        if runs and runs[-1].fingerprint == run.fingerprint:
            return runs[-1], runs[-2] if len(runs) > 1 else None, True
        previous = runs[-1] if runs else None
        run.number = previous.number + 1 if previous else 1
        if not previous:
            self._write(f"{self.path}/VERSION", str(VERSION))
        at = f"{self.path}/run={run.number}"
        # what an earlier attempt left without a marker goes
        entries(keyed, self.breaks(previous.number) if previous else None, run.number).write.mode("overwrite").parquet(f"{at}/breaks")
        self._write(f"{at}/run.json", json.dumps(run.__dict__))
        return run, previous, False
