"""The history queries against a plain version."""

from collections import Counter

import pytest

from tally_spark import queries
from tally_spark.operators import history
from tally_spark.plans import store

AT = "/root/testdata/sf0.001"


def keyed(spark, day):
    """Breaks by a key that is made anew, from the breaks and the sides' rows."""
    c = queries._context(spark, AT, day)
    subject = {}
    for r in c.ledger.unionByName(c.warehouse).collect():
        name = f"txn:{r.txn_id}" if r.txn_id else f"composite:{r.account_id}:{r.currency}:{r.amount_cents}:{r.posted_date}"
        subject[f"{r.source}:{r.row_number}"] = name
    out, used = {}, Counter()
    for b in sorted(queries._breaks(spark, AT, day).collect(), key=lambda b: b.digest):
        if b.type in ("control_total_mismatch", "row_count_mismatch"):
            about = f"{b.date}|{b.currency}"
        elif b.type == "schema_drift":
            about = f"{b.details.kind}|{b.details.column}"
        elif b.type == "duplicate":
            about = f"{b.details.source}|{b.details.business_key}"
        else:
            about = "|".join(sorted(subject[r] for r in b.ledger_refs or b.warehouse_refs))
        base = f"{b.type}|{about}"
        used[base] += 1
        out[base if used[base] == 1 else f"{base}#{used[base]}"] = b
    return out


def test_history_of_all_types(spark):
    one, two = keyed(spark, ""), keyed(spark, "_2")
    types = {b.type for b in (*one.values(), *two.values())}
    assert {"missing_in_target", "orphan_in_target", "duplicate", "value_mismatch", "control_total_mismatch", "row_count_mismatch", "schema_drift"} == types
    diff = [(k, "still_open" if k in one else "new", b) for k, b in two.items()] + [(k, "resolved", b) for k, b in one.items() if k not in two]
    assert len({state for _, state, _ in diff}) == 3
    assert Counter(tuple(r) for r in queries.QUERIES["history_diff"](spark, AT).collect()) == Counter((k, s, b.type, b.magnitude_cents) for k, s, b in diff)

    # run 3 has day one's breaks again
    assert {tuple(r) for r in queries.QUERIES["history_streaks"](spark, AT).collect()} == {(k, 1 if k in two else 3) for k in one}

    ages = {}
    for k, b in two.items():
        new, carried = ages.get(b.cluster_id, (0, 0))
        ages[b.cluster_id] = (new + (k not in one), carried + (k in one))
    assert {(r.cluster_id, r.new, r.carried, r.since) for r in queries.QUERIES["history_age"](spark, AT).collect()} == {(c, n, o, 1 if o else None) for c, (n, o) in ages.items()}

    sections = {}
    for _, state, b in diff:
        n, cents = sections.get((state, b.type), (0, 0))
        sections[state, b.type] = (n + 1, cents + (abs(b.magnitude_cents or 0) if b.level == "row" else 0))
    assert {tuple(r) for r in queries.QUERIES["history_sections"](spark, AT).collect()} == {(*k, *v) for k, v in sections.items()}


def test_schema_drift_matches_no_rows(spark, monkeypatch):
    def never(*_):
        raise AssertionError("rows were matched")

    monkeypatch.setattr(queries, "_made", {})
    monkeypatch.setattr(queries.matching, "match_rows", never)
    assert [(r.d_kind, r.d_column, r.d_ledger_type, r.d_warehouse_type) for r in queries.QUERIES["check_schema_drift"](spark, AT).collect()] == [("column_added", "batch_id", None, "string")]


def broadcasts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def test_stable_keys_never_gather_breaks_on_the_driver(spark):
    """These tables are far below the size up to which Spark broadcasts by itself."""
    c = queries._context(spark, AT, "_2")
    assert not broadcasts(history.stable_keys(queries._breaks(spark, AT, "_2"), c.ledger, c.warehouse))


@pytest.mark.parametrize("name", ["history_diff", "history_streaks", "history_sections", "history_age"])
def test_history_never_gathers_keys_on_the_driver(spark, name):
    assert not broadcasts(queries.QUERIES[name](spark, AT))


@pytest.mark.parametrize("day", ["", "_2"])
def test_no_plan_of_the_driver_holds_all_checks(spark, monkeypatch, day):
    """One plan of all checks, planned anew after each stage, took most of the driver's memory in the history queries."""
    plans = spark._jsparkSession.sharedState().statusStore()
    c = queries._context(spark, AT, day)
    before = plans.executionsCount()
    monkeypatch.setattr(queries, "_made", {k: v for k, v in queries._made.items() if not k[0].startswith(("breaks", "keyed"))})
    found = queries._breaks(spark, AT, day)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    began = plans.executionsList(before, plans.executionsCount() - before)
    texts = [began.apply(i).physicalPlanDescription() for i in range(began.size())]
    kinds = ("missing_in_target", "duplicate AS type", "value_mismatch AS type", "control_total_mismatch AS type")
    held = [[k for k in kinds if k in text] for text in texts]
    assert {k for own in held for k in own} == set(kinds)
    assert max(map(len, held)) == 1
    whole = queries.breaks.identified(queries.checks.run_checks(c))
    assert found.columns == whole.columns
    assert Counter(map(str, found.collect())) == Counter(map(str, whole.collect()))


def test_history_age_gives_memory_back_after_each_stage(spark, monkeypatch):
    given = []
    monkeypatch.setattr(queries, "_made", {})
    monkeypatch.setattr(store, "give_back", lambda _: given.append(len(store._written)))
    before = len(store._written)
    ages = queries.QUERIES["history_age"](spark, AT)
    assert ages.count() > 0
    written = range(before + 1, len(store._written) + 1)
    assert len(written) > 10
    assert set(given) >= set(written)
