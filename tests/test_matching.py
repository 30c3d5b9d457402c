"""The three passes on hand-made cases, and against a sequential model on random ones."""

import datetime
import random

import model

from tally_spark.config import Settings
from tally_spark.functions.keys import SCHEMA
from tally_spark.operators import matching

DAY = datetime.date(2026, 1, 5)


def side(spark, name, rows):
    """rows: (id, days after DAY, cents, status?, account?, currency?)."""
    out = []
    for i, r in enumerate(rows, 1):
        txn, day, cents, status, account, currency = (*r, *("POSTED", "ACC-0001", "USD")[len(r) - 3 :])
        out.append((name, i, txn, account, DAY + datetime.timedelta(day), cents, currency, status))
    return spark.createDataFrame(out, SCHEMA)


def sets(spark, ledger, warehouse, **settings):
    members, left_l, left_w = matching.match_rows(side(spark, "ledger", ledger), side(spark, "warehouse", warehouse), Settings(**settings), lambda df, name: df)
    found = {}
    for m in members.collect():
        found.setdefault((m.strategy, m.match_id), ([], []))[m.source == "warehouse"].append(m.row_number)
    return sorted((s, sorted(a), sorted(b)) for (s, _), (a, b) in found.items()), sorted(r.row_number for r in left_l.collect()), sorted(r.row_number for r in left_w.collect())


CASES = {
    "greedy_steal": ([(None, 1, 100)], [(None, 0, 100), (None, 1, 100)], {}, ([("composite", [1], [1])], [], [2])),
    "probe_order_same_day_first": ([(None, -1, 100), (None, 1, 100), (None, 0, 99)], [(None, 0, 100)], {}, ([("composite", [3], [1])], [1, 2], [])),
    "probe_order_later_first": ([(None, -1, 100), (None, 1, 100)], [(None, 0, 100)], {}, ([("composite", [2], [1])], [1], [])),
    "cents_order": ([(None, 0, 99), (None, 0, 101)], [(None, 0, 100)], {}, ([("composite", [2], [1])], [1], [])),
    "bag_of_ids": ([("T", 0, 100), ("T", 0, 200)], [("T", 0, 200), ("T", 0, 100), ("T", 0, 300)], {}, ([("exact_key", [1], [2]), ("exact_key", [2], [1])], [], [3])),
    "different_ids": ([("A", 0, 100)], [("B", 0, 100)], {}, ([("composite", [1], [1])], [], [])),
    "consumed_by_pass_two": ([("T", 0, 50), (None, 0, 50)], [("T", 0, 50), ("T", 0, 50)], {}, ([("composite", [2], [2]), ("exact_key", [1], [1])], [], [])),
    "split_one_to_three": ([(None, 0, 300)], [(None, 0, 120), (None, 0, 100), (None, 0, 80)], {}, ([("split", [1], [1, 2, 3])], [], [])),
    "split_two_to_one": ([(None, 0, 70), (None, 1, 30)], [(None, 1, 100)], {}, ([("split", [1, 2], [1])], [], [])),
    "first_in_depth_first_order": ([(None, 0, 100)], [(None, 0, 60), (None, 0, 40), (None, 0, 30), (None, 0, 10)], {}, ([("split", [1], [1, 2])], [], [3, 4])),
    "leg_budget": ([(None, 0, 300)], [(None, 0, 100)] * 3, {"max_split_legs": 2}, ([], [1], [1, 2, 3])),
    "sign": ([(None, 0, 100)], [(None, 0, 150), (None, 0, -50)], {}, ([], [1], [1, 2])),
    "band_edges": ([(None, 0, 2500)], [(None, 0, 2502)], {}, ([], [1], [1])),
    "too_late": ([(None, 0, 2500)], [(None, 4, 2500)], {}, ([], [1], [1])),
    "other_account": ([(None, 0, 5, "P", "A")], [(None, 0, 5, "P", "B")], {}, ([], [1], [1])),
    "other_currency": ([(None, 0, 5, "P", "A", "USD")], [(None, 0, 5, "P", "A", "EUR")], {}, ([], [1], [1])),
    "empty": ([], [], {}, ([], [], [])),
}


def test_cases(spark):
    """All cases with default settings at once, each with accounts of its own; rows are told apart by their case."""
    plain = [n for n in CASES if not CASES[n][2]]
    sides = []
    for k in (0, 1):
        rows = []
        for n in plain:
            for r in CASES[n][k]:
                txn, day, cents, status, account, currency = (*r, *("POSTED", "ACC", "USD")[len(r) - 3 :])
                rows.append((txn and f"{n}-{txn}", day, cents, status, f"{n}-{account}", currency))
        sides.append(rows)
    before = [{n: sum(len(CASES[m][k]) for m in plain[: plain.index(n)]) for n in plain} for k in (0, 1)]
    place = lambda k, n, own: [i + before[k][n] for i in own]
    expected = ([], [], [])
    for n in plain:
        pairs, left_l, left_w = CASES[n][3]
        expected[0].extend((s, place(0, n, a), place(1, n, b)) for s, a, b in pairs)
        expected[1].extend(place(0, n, left_l))
        expected[2].extend(place(1, n, left_w))
    found = sets(spark, *sides)
    assert (found[0], found[1], found[2]) == (sorted(expected[0]), sorted(expected[1]), sorted(expected[2]))


def test_leg_budget(spark):
    ledger, warehouse, settings, expected = CASES["leg_budget"]
    assert sets(spark, ledger, warehouse, **settings) == expected


def test_empty(spark):
    assert sets(spark, [], []) == ([], [], [])


def test_contested_pairs_follow_the_sequential_choice(spark):
    r = random.Random(11)
    make = lambda n: [(None, r.randint(0, 6), r.randint(100, 106), "P", r.choice("AB"), "USD") for _ in range(n)]
    for tolerance, window in ((1, 1), (2, 2)):
        ledger, warehouse = make(40), make(40)
        found = matching.match_composite(side(spark, "ledger", ledger).repartition(3), side(spark, "warehouse", warehouse).repartition(5), Settings(tolerance_cents=tolerance, timing_window_days=window))
        pairs = {}
        for m in found.collect():
            pairs.setdefault(m.match_id, {})[m.source] = m.row_number
        rows = lambda own: [(i, x[0], x[4], DAY + datetime.timedelta(x[1]), x[2], x[5]) for i, x in enumerate(own, 1)]
        assert sorted((p["ledger"], p["warehouse"]) for p in pairs.values()) == model.composite(rows(ledger), rows(warehouse), tolerance, window)


def test_possible_pairs_are_not_listed(spark):
    """Rows of one day and amount could all be paired with each other; days with gaps, in several batches, follow the sequential choice."""
    ledger, warehouse = side(spark, "ledger", [(None, 0, 100)] * 600), side(spark, "warehouse", [(None, 0, 100)] * 500)
    found = matching.match_composite(ledger, warehouse, Settings())
    assert "Join" not in found._jdf.queryExecution().toString()
    pairs = {}
    for m in found.collect():
        pairs.setdefault(m.match_id, {})[m.source] = m.row_number
    assert sorted((p["ledger"], p["warehouse"]) for p in pairs.values()) == [(i, i) for i in range(1, 501)]

    r = random.Random(14)
    make = lambda n: [(r.choice([None, "T"]), r.choice([0, 1, 2, 9, 12, 13, 30]), r.randint(-3, 3), "P", r.choice("AB"), r.choice(["USD", "EUR"])) for _ in range(n)]
    ledger, warehouse = make(150), make(150)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = matching.match_composite(side(spark, "ledger", ledger).repartition(3), side(spark, "warehouse", warehouse).repartition(5), Settings(timing_window_days=3)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pairs = {}
    for m in found:
        pairs.setdefault(m.match_id, {})[m.source] = m.row_number
    rows = lambda own: [(i, x[0], x[4], DAY + datetime.timedelta(x[1]), x[2], x[5]) for i, x in enumerate(own, 1)]
    assert sorted((p["ledger"], p["warehouse"]) for p in pairs.values()) == model.composite(rows(ledger), rows(warehouse), 1, 3)


def test_legs_are_the_first_in_depth_first_order():
    r = random.Random(12)
    for _ in range(3000):
        sign = r.choice((1, -1))
        amounts = sorted((sign * r.randint(0, 12) for _ in range(r.randint(0, 7))), key=lambda x: -abs(x))
        target, most = sign * r.randint(0, 20), r.randint(2, 5)
        assert matching.find_legs(target, amounts, 1, most) == model.legs(target, amounts, 1, most)


def test_result_does_not_depend_on_partitions(spark):
    r = random.Random(13)
    ledger = [(r.choice([None, f"T{r.randint(0, 20)}"]), r.randint(0, 5), r.randint(95, 130)) for _ in range(60)]
    warehouse = [(r.choice([None, f"T{r.randint(0, 20)}"]), r.randint(0, 5), r.randint(95, 130)) for _ in range(60)]
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            seen.append(sets(spark, ledger, warehouse))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
