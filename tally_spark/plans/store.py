"""Stage results in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a folder under the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir isn't set, and with master {master} no other folder is known to be shared")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tally-shared"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder that goes when the driver ends."""
    path = f"{shared_dir(spark)}/tally-{name}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def give_back(spark: SparkSession) -> None:
    """The driver's JVM returns free native memory to the system (some 0.05 s). Compiling the code that plans a stage takes and frees much of it, which malloc's arenas, one for each of many threads, would keep: some 200 MB after the history queries. JVMs without that command keep it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    try:
        # by the interface's method: py4j doesn't see those of the server's own class
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        of = gateway.new_array(jvm.java.lang.Object, 4)
        of[0], of[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), of)
    except Py4JError:
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: cuts lineage, and rows keep what was computed for them even if an executor is lost."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_together(parts: list[DataFrame], name: str) -> DataFrame:
    """Like stored() of the union of parts, which have the same columns; they are written one after another, so that no plan holds them all."""
    path = new_path(parts[0].sparkSession, name)
    for df in parts:
        df.select(*parts[0].columns).write.mode("append").parquet(path)
        give_back(df.sparkSession)
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(path)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            return
