"""Test data with known faults: a ledger, the warehouse's version of it, and the list of faults.

Every value is a hash of the seed, the row and what it is for, so that rows don't depend on partitions.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evaluate import SCORED
from .functions.money import money
from .plans.store import stored
from .sources.csv import REQUIRED

#: Default faults, in the order in which rows are given to them.
FAULTS = {"missing": 14, "duplicated": 9, "timing": 26, "rounding": 18, "material": 7, "status": 6, "orphan": 5, "split": 4, "composite_only": 120}
STATUSES, CURRENCIES = ["POSTED", "SETTLED", "PENDING"], ["USD", "USD", "USD", "EUR", "CAD"]
NOTES = {"split": "matched as one to several, no break", "composite_only": "matched without its identifier, no break"}
NEW_MISSING = 3


@dataclass(frozen=True)
class Plan:
    seed: int = 42
    rows: int = 2000
    accounts: int = 10
    days: int = 10
    start_date: str = "2026-01-05"
    faults: dict[str, int] = field(default_factory=lambda: dict(FAULTS))
    first_id: int = 1


@dataclass
class Data:
    ledger: DataFrame
    warehouse: DataFrame
    faults: DataFrame
    plan: Plan
    changes: dict | None = None


def _draw(plan: Plan, what: str, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(plan.seed), F.lit(what), F.col("i")), F.lit(n) if isinstance(n, int) else n)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def _cents(plan: Plan) -> Column:
    return (_draw(plan, "amount", 999_900) + 100) * F.when(_draw(plan, "sign", 10) < 4, -1).otherwise(1)


def _day(plan: Plan) -> Column:
    return F.date_add(F.lit(plan.start_date).cast("date"), _draw(plan, "day", plan.days).cast("int"))


def _account(plan: Plan) -> Column:
    return F.concat(F.lit("ACC-"), F.lpad((_draw(plan, "account", plan.accounts) + 1).cast("string"), 4, "0"))


def _ledger(spark: SparkSession, plan: Plan) -> DataFrame:
    """Rows with i and kind, the fault that a row is given: the first rows in the order of a hash, so many for each kind."""
    base = spark.range(plan.rows).withColumnRenamed("id", "i")
    rows = base.select(
        "i", F.concat(F.lit("TXN-"), F.lpad((F.col("i") + plan.first_id).cast("string"), 6, "0")).alias("txn_id"), _account(plan).alias("account_id"), _day(plan).alias("posted_date"), _cents(plan).alias("amount_cents"),
        _pick(CURRENCIES, _draw(plan, "currency", len(CURRENCIES))).alias("currency"), _pick(STATUSES, _draw(plan, "status", len(STATUSES))).alias("status"),
    )
    wanted = sum(n for k, n in plan.faults.items() if k != "orphan")
    # only as many rows as there are faults are ranked
    first = base.withColumn("_h", F.xxhash64(F.lit(plan.seed), F.lit("fault"), F.col("i"))).orderBy("_h", "i").limit(wanted)
    ranked = first.withColumn("_n", F.row_number().over(Window.orderBy("_h", "i")))
    kind, end = None, 0
    for name, n in plan.faults.items():
        if name != "orphan":
            end += n
            kind = F.when(F.col("_n") <= end, name) if kind is None else kind.when(F.col("_n") <= end, name)
    return rows.join(ranked.select("i", kind.alias("kind")), "i", "left")


def _legs(plan: Plan) -> Column:
    """Three distinct parts that add up to the amount."""
    size, sign = F.abs("amount_cents"), F.signum("amount_cents").cast("bigint")
    quarter = F.expr("abs(amount_cents) div 4")
    a, b = quarter + 1 + _draw(plan, "leg", 7), quarter - 1 - _draw(plan, "leg2", 7)
    return F.array(sign * a, sign * b, sign * (size - a - b))


def generate(spark: SparkSession, plan: Plan | None = None) -> Data:
    plan = plan or Plan()
    ledger = stored(_ledger(spark, plan), "generated")
    kind = F.col("kind")
    one = ledger.filter("kind IS NULL OR kind NOT IN ('missing', 'split')")
    changed = one.select(
        "i", F.lit(0).alias("leg"), F.when(kind == "composite_only", F.lit("")).otherwise(F.col("txn_id")).alias("txn_id"), "account_id", F.when(kind == "timing", F.date_add("posted_date", 1)).otherwise(F.col("posted_date")).alias("posted_date"),
        F.when(kind == "rounding", F.col("amount_cents") + F.signum("amount_cents").cast("bigint")).when(kind == "material", F.col("amount_cents") + 5000).otherwise(F.col("amount_cents")).alias("amount_cents"), "currency",
        F.when(kind == "status", F.when(F.col("status") == "POSTED", "SETTLED").otherwise("POSTED")).otherwise(F.col("status")).alias("status"),
    )
    same = ["account_id", "posted_date", "amount_cents", "currency", "status"]
    again = ledger.filter(kind == "duplicated").select("i", F.lit(1).alias("leg"), "txn_id", *same)
    legs = ledger.filter(kind == "split").select("i", F.posexplode(_legs(plan)).alias("leg", "_part"), F.lit("").alias("txn_id"), "account_id", "posted_date", F.col("_part").alias("amount_cents"), "currency", "status").drop("_part")
    extra = Plan(plan.seed + 7919, plan.faults.get("orphan", 0), plan.accounts, plan.days, plan.start_date)
    orphans = spark.range(extra.rows).withColumnRenamed("id", "i").select(
        "i", F.lit(9).alias("leg"), F.concat(F.lit("WHS-ORPHAN-"), F.lpad((F.col("i") + 1).cast("string"), 3, "0")).alias("txn_id"), _account(extra).alias("account_id"), _day(extra).alias("posted_date"), _cents(extra).alias("amount_cents"), F.lit("USD").alias("currency"), F.lit("POSTED").alias("status"),
    )
    rows = changed.unionByName(again).unionByName(legs).unionByName(orphans)
    shuffled = rows.orderBy(F.xxhash64(F.lit(plan.seed), F.lit("place"), "i", "leg"), "i", "leg").select("txn_id", *same)
    expected = {k: v[3] for k, v in SCORED.items()}
    named = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("kind")]
    bad = ledger.filter("kind IS NOT NULL").select("kind", "txn_id", *same).unionByName(orphans.select(F.lit("orphan").alias("kind"), "txn_id", *same))
    faults = bad.select("kind", "txn_id", "account_id", "posted_date", money(F.col("amount_cents")).alias("amount"), named(expected).alias("expected_classification"), named(NOTES).alias("note"))
    return Data(ledger.orderBy("i").select("txn_id", *same), shuffled, faults, plan)


def next_day(spark: SparkSession, plan: Plan | None = None) -> Data:
    """The day after: replays are gone, half of the missing rows have come, a day with NEW_MISSING new missing rows was added, and the warehouse has one more column."""
    plan = plan or Plan()
    first = generate(spark, plan)
    missing = [r.txn_id for r in first.faults.filter("kind = 'missing'").orderBy("txn_id").select("txn_id").collect()]  # as many as the plan says
    backfilled = missing[: len(missing) // 2]
    day = spark.range(1).select(F.date_add(F.lit(plan.start_date).cast("date"), plan.days).cast("string")).first()[0]
    fresh = generate(spark, Plan(plan.seed + 1, max(plan.rows // plan.days, NEW_MISSING + 1), plan.accounts, 1, day, dict.fromkeys(FAULTS, 0) | {"missing": NEW_MISSING}, plan.rows + 1))
    rows = first.warehouse.dropDuplicates().unionByName(first.ledger.filter(F.col("txn_id").isin(backfilled))).unionByName(fresh.warehouse)
    batch = f"WH-{day.replace('-', '')}"
    warehouse = rows.orderBy(F.xxhash64(F.lit(plan.seed + 1), *rows.columns), *rows.columns).withColumn("batch_id", F.lit(batch))
    changes = {
        "replays_removed": plan.faults.get("duplicated", 0), "backfilled": backfilled, "new_day": day, "new_rows": fresh.plan.rows, "new_missing": sorted(r.txn_id for r in fresh.faults.select("txn_id").collect()), "warehouse_columns_added": ["batch_id"],
    }
    return Data(first.ledger.unionByName(fresh.ledger), warehouse, fresh.faults, plan, changes)


def write(data: Data, path: str) -> dict:
    """ledger.csv, warehouse.csv (one file each, on this machine) and manifest.json."""
    os.makedirs(path, exist_ok=True)
    counts = {}
    for name, df in (("ledger", data.ledger), ("warehouse", data.warehouse)):
        text = df.withColumn("amount", money(F.col("amount_cents"))).drop("amount_cents")
        columns = REQUIRED + [c for c in text.columns if c not in REQUIRED]
        counts[name] = 0
        with open(f"{path}/{name}.csv", "w", encoding="utf-8", newline="") as f:
            import csv

            out = csv.writer(f)
            out.writerow(columns)
            for row in text.select(*columns).toLocalIterator():
                out.writerow(["" if v is None else str(v) for v in row])
                counts[name] += 1
    p = data.plan
    manifest: dict = {"generator": {"seed": p.seed, "ledger_rows": counts["ledger"], "warehouse_rows": counts["warehouse"], "accounts": p.accounts, "days": p.days, "start_date": p.start_date}}
    if data.changes:
        manifest["generator"]["next_day"] = True
        manifest["changes"] = data.changes
    else:
        faults = [{k: str(v) for k, v in r.asDict().items() if v is not None} for r in data.faults.orderBy("kind", "txn_id").collect()]
        for key, column in (("fault_counts", "kind"), ("expected_classifications", "expected_classification")):
            found = [f[column] for f in faults if column in f]
            manifest[key] = {k: found.count(k) for k in sorted(set(found))}
        manifest["faults"] = faults
    with open(f"{path}/manifest.json", "w", encoding="utf-8") as f:
        json.dump(manifest, f, indent=2)
    return manifest | {"paths": {"ledger": f"{path}/ledger.csv", "warehouse": f"{path}/warehouse.csv", "manifest": f"{path}/manifest.json"}}
