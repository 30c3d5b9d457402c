"""Pairing of ledger and warehouse rows in three passes; a pass sees only what the earlier ones left.

Every pass gives members: one row for each paired transaction, with match_id, strategy and leg_pos (its place among its
side's rows). A match is named by its single row, or by the ledger's where both sides have one.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from datetime import timedelta
from heapq import heappop, heappush, nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.keys import ROW, SCHEMA, keyed, sort_columns

MEMBER = ["match_id", "strategy", "leg_pos", *ROW]
MEMBER_SCHEMA = f"match_id string, strategy string, leg_pos int, {SCHEMA}"


def match_exact(ledger: DataFrame, warehouse: DataFrame) -> DataFrame:
    """Pass 1: the k-th row with an identifier in one file is paired with the k-th in the other. What one has more is left."""

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("txn_id").orderBy(*sort_columns()))
        return rows.filter(keyed()).withColumn("_nth", nth).select(F.col("txn_id").alias("_id"), "_nth", F.struct(*ROW).alias(name))

    # both sides are already spread by identifier for the window, so the join shuffles nothing more
    pairs = ranked(ledger, "l").join(ranked(warehouse, "w").hint("shuffle_merge"), ["_id", "_nth"])
    both = F.explode(F.array("l", "w")).alias("x")
    return pairs.select(F.concat(F.lit("l"), F.col("l.row_number").cast("string")).alias("match_id"), both).select("match_id", F.lit("exact_key").alias("strategy"), F.lit(0).alias("leg_pos"), "x.*")


def unmatched(rows: DataFrame, members: DataFrame, side: str) -> DataFrame:
    taken = members.filter(F.col("source") == side).select("row_number")
    return rows.join(taken, "row_number", "left_anti").select(*ROW)


def _probe(x: Column) -> Column:
    """0, 1, -1, 2, -2 as 0, 1, 2, 3, 4."""
    return F.when(x == 0, 0).when(x > 0, 2 * x - 1).otherwise(-2 * x)


def composite_edges(ledger: DataFrame, warehouse: DataFrame, settings: Settings) -> DataFrame:
    """Possible pairs of pass 2: same account and currency, near in days and cents. l and w are the rows, days and cents the order in which a warehouse row looks for its ledger row.

    Warehouse rows are repeated for each day of the window and for neighbouring steps of cents, so the join is on equal keys,
    and neither a long history of one account nor a busy day of it meets itself."""
    window = settings.timing_window_days
    # amounts within the tolerance lie in one step of tolerance + 1 cents or in neighbouring ones
    step = lambda cents: F.floor(cents / F.lit(settings.tolerance_cents + 1)).cast("long")
    w = warehouse.select(F.struct(*ROW).alias("w"), "account_id", "currency", F.explode(F.sequence(F.lit(-window), F.lit(window))).alias("_shift"))
    w = w.withColumn("_day", F.expr("date_add(w.posted_date, _shift)")).withColumn("_step", F.explode(F.sequence(step(F.col("w.amount_cents")) - 1, step(F.col("w.amount_cents")) + 1)))
    # nine times the rows at the usual settings, which Spark's estimate leaves out: never broadcast
    joined = ledger.select(F.struct(*ROW).alias("l"), "account_id", "currency", F.col("posted_date").alias("_day"), step(F.col("amount_cents")).alias("_step")).join(w.hint("shuffle_merge"), ["account_id", "currency", "_day", "_step"])
    apart = F.col("l.amount_cents") - F.col("w.amount_cents")
    return joined.filter(F.abs(apart) <= settings.tolerance_cents).select("account_id", "currency", "l", "w", _probe(F.col("_shift")).cast("int").alias("days"), _probe(apart).alias("cents"))


def _probes(n: int) -> list[int]:
    return [0, *(x for i in range(1, n + 1) for x in (i, -i))]


def _key(r: dict) -> tuple:
    return (r["posted_date"], r["account_id"], r["amount_cents"], r["txn_id"] or "", r["row_number"])


def _members(out: list[tuple[str, str, int, dict]], schema: pa.Schema) -> pa.RecordBatch:
    fields = [pa.field("match_id", pa.string()), pa.field("strategy", pa.string()), pa.field("leg_pos", pa.int32()), *(schema.field(c) for c in ROW)]
    rows = [{"match_id": name, "strategy": strategy, "leg_pos": pos, **{c: r[c] for c in ROW}} for name, strategy, pos, r in out]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def match_composite(ledger: DataFrame, warehouse: DataFrame, settings: Settings) -> DataFrame:
    """Pass 2. Warehouse rows choose one after another, each the first free ledger row in its order.

    Rows are sorted by account, currency and day within their partition, which may spill, and pass by; a task holds one
    account's rows of the days that a day's warehouse rows can reach. Ledger rows lie by day and cents, so a warehouse row
    looks at a few places however many rows it could be paired with: possible pairs are never listed."""
    window, tolerance = settings.timing_window_days, settings.tolerance_cents
    probes = [(d, c) for d in _probes(window) for c in _probes(tolerance)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free: dict[int, dict[int, list[tuple[tuple, dict]]]] = {}  # ledger rows by day and cents, each place a heap
        waiting: deque[tuple[int, list[dict]]] = deque()  # warehouse rows by day
        out: list[tuple[str, str, int, dict]] = []
        last = today = schema = None

        def choose(before: int | None) -> None:
            """For the days of which all ledger rows in reach are known: those that reach no further than before the given one."""
            while waiting and (before is None or waiting[0][0] + window < before):
                day, own = waiting.popleft()
                for w in sorted(own, key=_key):
                    places = (free.get(day + days, {}).get(w["amount_cents"] + cents) for days, cents in probes)
                    if place := next(filter(None, places), None):
                        _, l = heappop(place)
                        out.extend((f"l{l['row_number']}", "composite", 0, r) for r in (l, w))
            first = waiting[0][0] if waiting else before
            for day in [d for d in free if first is None or d < first - window]:
                del free[day]

        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                place, day = (r["account_id"], r["currency"]), r["posted_date"].toordinal()
                if place != last:
                    choose(None)
                elif day != today:
                    choose(day)
                last, today = place, day
                if r["source"] == "ledger":
                    heappush(free.setdefault(today, {}).setdefault(r["amount_cents"], []), (_key(r), r))
                elif waiting and waiting[-1][0] == today:
                    waiting[-1][1].append(r)
                else:
                    waiting.append((today, [r]))
                if len(out) >= 10_000:
                    yield _members(out, schema)
                    out.clear()
        choose(None)
        if out:
            yield _members(out, schema)

    rows = ledger.select(*ROW).unionByName(warehouse.select(*ROW)).filter("account_id IS NOT NULL AND currency IS NOT NULL AND posted_date IS NOT NULL AND amount_cents IS NOT NULL")
    return rows.repartition("account_id", "currency").sortWithinPartitions("account_id", "currency", "posted_date").mapInArrow(search, MEMBER_SCHEMA)


def find_legs(target: int, amounts: list[int], tolerance: int, max_legs: int) -> list[int] | None:
    """Places of the first amounts, in depth-first order, of which at least two sum to the target within the tolerance."""

    def below(start: int, path: tuple[int, ...], total: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """All admissible extensions of path, each before its own."""
        if len(path) == max_legs:
            return
        for i in range(start, len(amounts)):
            reached = total + amounts[i]
            if target > 0 and reached > target + tolerance or target < 0 and reached < target - tolerance:
                continue
            yield (*path, i), reached
            yield from below(i + 1, (*path, i), reached)

    return next((list(path) for path, total in below(0, (), 0) if len(path) >= 2 and abs(total - target) <= tolerance), None)


def _splits(rows: list[dict], settings: Settings) -> Iterator[tuple[str, list[dict]]]:
    """The splits among the rows of one account, currency, sign and run of days: name, and the one row before its legs."""
    for r in rows:
        r["key"] = _key(r)
    sides = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: r["key"]) for s in ("ledger", "warehouse")}
    days = {s: [r["posted_date"] for r in own] for s, own in sides.items()}
    window, used = timedelta(days=settings.timing_window_days), set()
    for side, other in (("ledger", "warehouse"), ("warehouse", "ledger")):
        for one in sides[side]:
            if (side, one["row_number"]) in used:
                continue
            target = one["amount_cents"]
            near = sides[other][bisect_left(days[other], one["posted_date"] - window) : bisect_right(days[other], one["posted_date"] + window)]
            free = (r for r in near if (other, r["row_number"]) not in used and abs(r["amount_cents"]) <= abs(target) + settings.tolerance_cents)
            pool = nsmallest(settings.max_split_candidates, free, key=lambda r: (-abs(r["amount_cents"]), r["key"]))
            legs = find_legs(target, [r["amount_cents"] for r in pool], settings.tolerance_cents, settings.max_split_legs)
            if legs is not None:
                chosen = [one, *(pool[i] for i in legs)]
                used.update((r["source"], r["row_number"]) for r in chosen)
                yield f"{side[0]}{one['row_number']}", chosen


def match_splits(ledger: DataFrame, warehouse: DataFrame, settings: Settings) -> DataFrame:
    """Pass 3: one row of a side against several of the other, first with the ledger's as the one.

    Only rows of one account, currency and sign can meet, and only within a run of days without a gap over the window. Rows
    are sorted by these within their partition, which may spill, and pass by; a task holds one run of days at a time."""
    window = settings.timing_window_days

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[dict] = []
        last, out = None, []

        def finish() -> None:
            sides = {r["source"] for r in run}
            if len(run) > 2 and len(sides) == 2:
                for name, chosen in _splits(run, settings):
                    out.extend((name, "split", max(k - 1, 0), r) for k, r in enumerate(chosen))
            run.clear()

        schema = None
        for batch in batches:
            schema = batch.schema
            for r in batch.to_pylist():
                place = (r["account_id"], r["currency"], r["_below"])
                if run and (place != last or (r["posted_date"] - run[-1]["posted_date"]).days > window):
                    finish()
                last = place
                run.append(r)
            if out:
                yield _members(out, schema)
                out.clear()
        finish()
        if out:
            yield _members(out, schema)

    rows = ledger.select(*ROW).unionByName(warehouse.select(*ROW)).withColumn("_below", F.col("amount_cents") < 0)
    return rows.repartition("account_id", "currency", "_below").sortWithinPartitions("account_id", "currency", "_below", "posted_date").mapInArrow(search, MEMBER_SCHEMA)


def match_rows(ledger: DataFrame, warehouse: DataFrame, settings: Settings, keep=lambda df, name: df.cache()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All members, and what is left of each side. keep stores a stage's result; both sides' leftovers are stored together."""

    def left(l: DataFrame, w: DataFrame, taken: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        both = l.select(*ROW).unionByName(w.select(*ROW)).join(taken.select("source", "row_number").hint("shuffle_merge"), ["source", "row_number"], "left_anti").select(*ROW)
        both = keep(both, name)
        return both.filter("source = 'ledger'"), both.filter("source = 'warehouse'")

    exact = keep(match_exact(ledger, warehouse), "exact")
    l1, w1 = left(ledger, warehouse, exact, "left-1")
    composite = keep(match_composite(l1, w1, settings), "composite")
    l2, w2 = left(l1, w1, composite, "left-2")
    split = keep(match_splits(l2, w2, settings), "split")
    return exact.unionByName(composite).unionByName(split), *left(l2, w2, split, "left-3")


def matches(members: DataFrame) -> DataFrame:
    """One row for each match: totals, days, statuses in order of legs, refs. Matches of two rows are a join; only splits are grouped."""
    row = F.struct("posted_date", "status", "amount_cents", F.concat_ws(":", "source", F.col("row_number").cast("string")).alias("ref"))
    pairs = members.filter("strategy <> 'split'")
    l = pairs.filter("source = 'ledger'").select("match_id", "strategy", "account_id", "currency", row.alias("l"))
    w = pairs.filter("source = 'warehouse'").select("match_id", row.alias("w"))
    two = l.join(w.hint("shuffle_merge"), "match_id").select(
        "match_id", "strategy", F.col("l.amount_cents").alias("ledger_cents"), F.col("w.amount_cents").alias("warehouse_cents"), F.col("w.posted_date").alias("_last"), F.col("l.posted_date").alias("partition_date"),
        F.array("l.status").alias("ledger_statuses"), F.array("w.status").alias("warehouse_statuses"), F.array("l.ref").alias("ledger_refs"), F.array("w.ref").alias("warehouse_refs"), F.struct("account_id", "currency").alias("_first"),
    )
    side = lambda s, c: F.when(F.col("source") == s, c)
    ordered = lambda s: F.transform(F.array_sort(F.collect_list(side(s, F.struct("leg_pos", "status")))), lambda x: x["status"])
    refs = lambda s: F.array_sort(F.collect_list(side(s, F.concat_ws(":", "source", F.col("row_number").cast("string")))))
    cents = lambda s: F.sum(side(s, F.col("amount_cents")))
    first = F.min_by(F.struct("account_id", "currency"), side("ledger", F.col("leg_pos")))
    several = members.filter("strategy = 'split'").groupBy("match_id", "strategy").agg(
        cents("ledger").alias("ledger_cents"), cents("warehouse").alias("warehouse_cents"), F.max(side("warehouse", F.col("posted_date"))).alias("_last"), F.min(side("ledger", F.col("posted_date"))).alias("partition_date"),
        ordered("ledger").alias("ledger_statuses"), ordered("warehouse").alias("warehouse_statuses"), refs("ledger").alias("ledger_refs"), refs("warehouse").alias("warehouse_refs"), first.alias("_first"),
    )
    return two.unionByName(several).select("*", (F.col("warehouse_cents") - F.col("ledger_cents")).alias("delta_cents"), F.datediff("_last", "partition_date").alias("delta_days"), "_first.*").drop("_last", "_first")


def summary(ledger: DataFrame, members: DataFrame, left_l: DataFrame, left_w: DataFrame) -> DataFrame:
    """Sets by strategy, unmatched rows and the share of ledger rows that are matched (1 of none)."""
    sets = members.agg(*[F.countDistinct(F.when(F.col("strategy") == s, F.col("match_id"))).alias(f"{s}_sets") for s in ("exact_key", "composite", "split")], F.count_if(F.col("source") == "ledger").alias("_matched"))
    counts = ledger.agg(F.count(F.lit(1)).alias("_rows")).crossJoin(left_l.agg(F.count(F.lit(1)).alias("unmatched_ledger"))).crossJoin(left_w.agg(F.count(F.lit(1)).alias("unmatched_warehouse")))
    rate = F.when(F.col("_rows") == 0, F.lit(1.0)).otherwise(F.round(F.col("_matched") / F.col("_rows"), 4))
    return sets.crossJoin(counts).withColumn("match_rate", rate).drop("_matched", "_rows")
