"""Headline queries on one machine. Prints one JSON line: seconds by query, and their sum.

run_phases: what the published figures time (profile, match, check, cluster) over the fixture's ledger and warehouse, from
stored rows to collected clusters. The rows are read once first and the session is warm; the median of REPEAT runs counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

CPUS = os.environ.get("BENCH_CPUS", "8")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/tally-bench").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tally_spark import fixtures, queries
    from tally_spark.operators import attribution, breaks, checks, history, profile
    from tally_spark.plans.run import reconcile

    sides = fixtures.sides(spark, SF_DIR)
    ledger, warehouse = sides["ledger"], sides["warehouse"]
    n = ledger.count() + warehouse.count()

    def run_phases() -> None:
        for rows in (ledger, warehouse):
            profile.summary(rows).collect()
            profile.partitions(rows).collect()
            profile.status_histogram(rows).collect()
            profile.duplicate_keys(rows).collect()
        report = reconcile(ledger, warehouse)
        breaks.clusters(report.breaks).collect()
        attribution.summaries(report.breaks, report.effects).collect()

    # operators on stored input: what queries.py keeps of a query's result isn't timed
    context = queries._context(spark, SF_DIR)
    operators = {"break_ids": lambda: breaks.identified(checks.run_checks(context)), "stable_keys": lambda: history.stable_keys(queries._breaks(spark, SF_DIR), ledger, warehouse)}
    timed = {"run_phases": run_phases}
    for name in ("match_exact", "match_composite", "match_split", "check_control_totals", "check_values", "clusters_ranked", "attribution_components"):
        timed[name] = lambda f=queries.QUERIES[name]: f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    for name, make in operators.items():
        timed[name] = lambda f=make: f().write.format("noop").mode("overwrite").save()
    if os.environ.get("BENCH_LLM", "1") == "1":
        try:
            from tally_spark.llm.queries import QUERIES as documents
        except ModuleNotFoundError:
            documents = {}
        for name in ("op8_exact_dedup", "op10_debruijn_dedup"):
            if name in documents:
                timed[name] = lambda f=documents[name]: f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, f in timed.items():
        f()  # compiles code, makes what the queries start from
        took = []
        for _ in range(REPEAT if name == "run_phases" else 1):
            began = time.perf_counter()
            f()
            took.append(time.perf_counter() - began)
        seconds[name] = round(median(took), 3)
    print(json.dumps({"metric": "sum of query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR), "rows": n, "rows_per_second": round(n / seconds["run_phases"])}))


if __name__ == "__main__":
    main()
