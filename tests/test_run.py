"""Checks, clusters, attribution, history, explanation and the command line on small inputs."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_matching import side

from tally_spark import cli, generate
from tally_spark.config import HistoryError, Settings
from tally_spark.explain import loop, providers
from tally_spark.explain.finding import Usage
from tally_spark.operators import attribution, breaks, checks, history
from tally_spark.plans.run import reconcile, record
from tally_spark.report import html, text
from tally_spark.report import json as document


def run(spark, ledger, warehouse, types=({}, {}), **settings):
    return reconcile(side(spark, "ledger", ledger), side(spark, "warehouse", warehouse), Settings(**settings), types=types)


def found(report):
    return sorted((r.type, r.magnitude_cents, r.details.band, ",".join(r.ledger_refs), ",".join(r.warehouse_refs)) for r in report.breaks.filter("level = 'row'").collect())


def test_bag_of_ids_gives_duplicates_and_no_orphan(spark):
    report = run(spark, [("T", 0, 100), ("T", 0, 200)], [("T", 0, 200), ("T", 0, 100), ("T", 0, 300)])
    assert found(report) == [("duplicate", 100, None, "ledger:1,ledger:2", ""), ("duplicate", 400, None, "", "warehouse:1,warehouse:2,warehouse:3")]


def test_all_copies_unmatched_leave_one_orphan(spark):
    assert found(run(spark, [], [("T", 0, 50), ("T", 0, 50)])) == [("duplicate", 50, None, "", "warehouse:1,warehouse:2"), ("orphan_in_target", 50, None, "", "warehouse:2")]


def test_phantom_effect_of_a_duplicate_that_pass_two_used(spark):
    report = run(spark, [("T", 0, 50), (None, 0, 50)], [("T", 0, 50), ("T", 0, 50)])
    assert report.breaks_by_type == {"duplicate": 1}
    assert [(r.cents, r.rows) for r in attribution.effects(report.effects).collect()] == [(50, 1)]


def test_split_over_two_days_is_shifted_and_status_order_counts(spark):
    assert [x[2] for x in found(run(spark, [(None, 0, 70), (None, 1, 30)], [(None, 1, 100)]))] == ["date_shifted"]
    assert [x[2] for x in found(run(spark, [(None, 0, 100, "POSTED")], [(None, 0, 60, "POSTED"), (None, 0, 40, "PENDING")]))] == ["status_only"]


def test_split_explains_the_row_count(spark):
    report = run(spark, [(None, 0, 300)], [(None, 0, 120), (None, 0, 100), (None, 0, 80)])
    assert report.breaks_by_type == {"row_count_mismatch": 1}
    assert report.clusters[0]["attribution"]["explained"] and [p["cause"] for p in report.clusters[0]["attribution"]["components"]] == ["split"]


def test_errors_that_offset_each_other_are_not_explained(spark):
    report = run(spark, [("A", 0, 100)], [("A", 0, 100)])
    days = spark.createDataFrame([("control_total_mismatch", "c", "d1", "2026-01-05", 500), ("control_total_mismatch", "c", "d2", "2026-01-06", -500)], "type string, cluster_id string, digest string, date string, magnitude_cents long")
    days = days.withColumn("date", F.to_date("date")).withColumn("currency", F.lit("USD")).withColumn("details", F.struct(F.lit("0").alias("delta")))
    r = attribution.summaries(days, report.effects).first()
    assert (r.gap, r.residual, r.unexplained, r.explained) == (0, 0, 2, False)


def test_equal_sides_are_clean(spark):
    report = run(spark, [("A", 0, 1), (None, 0, 2)], [(None, 0, 2), ("A", 0, 1)])
    assert report.breaks_by_type == {} and report.matching["match_rate"] == 1.0 and report.clusters == []


def test_drift():
    rows = checks.drift_rows({"amount": "decimal", "memo": "string", "batch": "string", "fx": "decimal"}, {"amount": "integer"})
    assert [r[0] for r in rows] == ["column_missing"] * 3 + ["type_changed"]
    assert checks.drift_rows({}, {"a": "string"}) == [] and checks.drift_rows({"a": "unknown"}, {"a": "string"}) == []


def test_fingerprint_and_ids_are_stable_and_settings_matter(spark):
    ledger, warehouse = [("A", 0, 100), ("B", 0, 5)], [("A", 0, 101)]
    one, two, strict = run(spark, ledger, warehouse), run(spark, ledger, warehouse), run(spark, ledger, warehouse, tolerance_cents=0)
    assert one.fingerprint == two.fingerprint != strict.fingerprint
    ids = lambda r: sorted(x.id for x in r.breaks.collect())
    assert ids(one) == ids(two) and all(x.startswith("brk_") and len(x) == 16 for x in ids(one))


def test_many_alike_breaks_are_one_cluster(spark):
    report = run(spark, [(f"T{i}", 0, 100 + i) for i in range(50)], [("X", 0, 7)])
    assert sorted((c["type"], c["break_count"]) for c in report.clusters if c["level"] == "row") == [("missing_in_target", 50), ("orphan_in_target", 1)]
    assert [c["rank"] for c in report.clusters] == list(range(1, len(report.clusters) + 1)) and len(report.clusters[0]["samples"]) == 3


def test_history(spark, tmp_path):
    db = f"file://{tmp_path}/h"
    bad, good = ([("A", 0, 100), ("B", 0, 200)], [("A", 0, 100)]), ([("A", 0, 100), ("B", 0, 200)], [("A", 0, 100), ("B", 0, 200)])
    first = record(run(spark, *bad), db)
    assert (first["run_number"], first["new"]["by_type"]["missing_in_target"], first["previous_run"]) == (1, 1, None)
    again = record(run(spark, *bad), db)
    assert again["rerun"] and again["run_number"] == 1
    fixed = record(run(spark, *good), db)
    assert (fixed["run_number"], fixed["resolved"]["by_type"]["missing_in_target"], fixed["new"]["breaks"]) == (2, 1, 0)
    back = record(run(spark, *bad, tolerance_cents=0), db)
    assert back["run_number"] == 3 and back["new"]["by_type"]["missing_in_target"] == 1 and back["settings_changed"] and back["oldest"] is None
    moved = record(run(spark, [("C", 0, 7), *bad[0]], [("C", 0, 8), *bad[1]], tolerance_cents=0), db)
    assert moved["still_open"]["by_type"]["missing_in_target"] == 1 and moved["oldest"]["first_seen"] == 3
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("x")
    with pytest.raises(HistoryError):
        history.History(spark, f"file://{tmp_path}/other")
    (tmp_path / "h" / "VERSION").unlink()
    (tmp_path / "h" / ".VERSION.crc").unlink(missing_ok=True)
    (tmp_path / "h" / "VERSION").write_text("99")
    with pytest.raises(HistoryError, match="newer"):
        history.History(spark, db)


def test_stable_keys_number_equal_subjects(spark):
    report = run(spark, [], [(None, 0, 50), (None, 3, 60)])
    rows = report.breaks.filter("type = 'orphan_in_target'")
    keyed = history.stable_keys(rows.unionByName(rows.withColumn("digest", F.concat("digest", F.lit("x")))), report.context.ledger, report.context.warehouse)
    assert sorted(r.break_key.rsplit("|", 1)[-1].split("#")[-1] for r in keyed.collect()).count("2") == 2


def test_schema_changes():
    before, now = {"ledger": {"a": "string", "b": "integer", "u": "unknown"}}, {"ledger": {"a": "integer", "c": "date", "u": "string"}}
    assert history.schema_changes(before, now) == [("ledger", "column_removed", "b", "integer", None), ("ledger", "column_added", "c", None, "date"), ("ledger", "type_changed", "a", "string", "integer")]


class Scripted:
    name, model = "scripted", "m"

    def __init__(self, *answers):
        self.answers, self.usage, self.seen = list(answers), Usage(), []

    def complete(self, system, transcript):
        self.seen.append(transcript[-1]["content"])
        self.usage += Usage(calls=1, input_tokens=10)
        answer = self.answers.pop(0) if self.answers else "no"
        if isinstance(answer, Exception):
            raise answer
        return answer if isinstance(answer, str) else json.dumps(answer)


DONE = {"action": "classify", "classification": "ROUNDING", "confidence": 0.9, "evidence": ["e"], "explanation": "x", "suggested_action": "y"}


@pytest.fixture(scope="module")
def report(spark):
    return run(spark, [("A", 0, 100), ("B", 0, 200), ("C", 2, 9)], [("A", 0, 101), ("D", 4, 7)])


def test_loop_uses_tools_and_repairs(report):
    tools = loop.Tools(report.context, report.breaks)
    cluster = report.clusters[0]
    model = Scripted({"action": "use_tool", "tool": "fetch_rows", "arguments": {"source": "ledger", "limit": 99}}, "not json", {"action": "use_tool", "tool": "fetch_rows", "arguments": {"source": "nowhere"}}, f"```json\n{json.dumps(DONE)}\n```")
    f = loop.explain_with(model, tools, cluster, 6)
    assert (f.classification, f.steps, f.tool_calls, f.degraded, f.usage.calls) == ("ROUNDING", 3, 2, False, 4)
    assert '"matched_rows": 3' in model.seen[1] and "error" in model.seen[3]


def test_loop_degrades(report):
    tools = loop.Tools(report.context, report.breaks)
    look = {"action": "use_tool", "tool": "get_schema", "arguments": {"source": "ledger"}}
    for model, said in ((Scripted(look, look), "within 2 steps"), (Scripted("x", "x", "x"), "invalid"), (Scripted(loop.ProviderError("down")), "down")):
        f = loop.explain_with(model, tools, report.clusters[0], 2)
        assert f.degraded and f.classification == "UNKNOWN" and said in f.explanation


@pytest.mark.parametrize("change", [{"classification": "X"}, {"confidence": 2}, {"confidence": True}, {"evidence": []}, {"explanation": " "}, {"action": "x"}])
def test_invalid_answers(change):
    assert loop.parse_step(json.dumps(DONE | change))[1]


def test_tools(report):
    tools = loop.Tools(report.context, report.breaks)
    assert "error" in tools.call("x", {}) and "error" in tools.call("summarize_cluster", {"break_ids": []}) and "error" in tools.call("check_adjacent_periods", {"date": "x"})
    near = tools.call("check_adjacent_periods", {"account_id": "ACC-0001", "date": "2026-01-06", "amount": "1.00", "currency": "usd"})
    assert (near["ledger_matches"], near["warehouse_matches"], near["candidate_matches_in_adjacent_period"]) == (1, 1, 2)
    ids = [s["id"] for s in report.clusters[0]["samples"]]
    assert tools.call("summarize_cluster", {"break_ids": [*ids, "brk_none"]})["unknown_ids"] == ["brk_none"]


def test_explanations_change_nothing_else(spark):
    ledger, warehouse = [("A", 0, 100), ("B", 0, 200)], [("A", 0, 101)]
    with_, without = run(spark, ledger, warehouse), run(spark, ledger, warehouse, explain=False)
    with_.findings = loop.investigate(with_)
    assert with_.findings and not loop.investigate(without) and with_.fingerprint == without.fingerprint
    broken = run(spark, ledger, warehouse, provider="nothing")
    assert all(f.degraded for f in loop.investigate(broken))


def answer(status, body, **headers):
    return status, headers, json.dumps(body)


def test_provider_retries_waits_and_stops(monkeypatch):
    ok = answer(200, {"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 7, "completion_tokens_details": {"reasoning_tokens": 3}}})
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    queue, slept = [answer(500, {}), answer(429, {}, **{"retry-after": "7"}), OSError("reset"), ok], []

    def send(url, headers, body, timeout):
        x = queue.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    p = providers.build("openai", "m", send, slept.append)
    assert p.complete("s", [{"role": "user", "content": "u"}]) == "hi" and slept[1] == 7 and len(slept) == 3
    assert (p.usage.calls, p.usage.output_tokens, p.usage.thinking_tokens) == (1, 4, 3)
    queue += [answer(429, {"error": {"code": "insufficient_quota", "message": "none left"}})]
    with pytest.raises(loop.QuotaExhausted):
        p.complete("s", [])
    with pytest.raises(loop.ProviderError, match="skipped, since an earlier call"):
        p.complete("s", [])
    p = providers.build("openai", "m", send, slept.append)
    queue += [answer(400, {"error": {"message": "bad"}})] * 3
    for _ in range(3):
        with pytest.raises(loop.ProviderError, match="bad"):
            p.complete("s", [])
    with pytest.raises(loop.ProviderError, match="skipped, since the last 3 calls"):
        p.complete("s", [])


@pytest.mark.parametrize(("name", "payload"), [("gemini", {"candidates": [{"content": {"parts": [{"text": "t"}]}}]}), ("anthropic", {"content": [{"text": "t"}]}), ("openai", {"choices": [{"message": {"content": "t"}}]}), ("ollama", {"message": {"content": "t"}})])
def test_provider_payloads(monkeypatch, name, payload):
    for key in ("GEMINI_API_KEY", "ANTHROPIC_API_KEY", "OPENAI_API_KEY"):
        monkeypatch.setenv(key, "k")
    sent = []
    p = providers.build(name, "m", lambda *a: (sent.append(json.loads(a[2])), answer(200, payload))[1], lambda s: None)
    assert p.complete("system text", [{"role": "user", "content": "hello"}]) == "t" and "hello" in json.dumps(sent[0]) and "system text" in json.dumps(sent[0])
    with pytest.raises(loop.ProviderError):
        providers.build(name, None)


def test_provider_needs_a_key(monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(loop.ProviderError, match="OPENAI_API_KEY"):
        providers.build("openai", "m")


def test_reports(report, tmp_path):
    d = document.document(report)
    assert json.loads(Path(document.write(report, str(tmp_path / "r.json"))).read_text()) == json.loads(json.dumps(d, default=str))
    assert d["schema_version"] == 1 and len(d["breaks"]) == d["summary"]["break_count"] and list(d)[:3] == ["schema_version", "engine_version", "run"]
    page = html.render(report)
    assert "<script" not in page and report.fingerprint in page
    plain = text.render(report, ascii_only=True)
    assert plain.isascii() and max(map(len, plain.splitlines())) <= 120


def test_generator(spark):
    plan = generate.Plan(rows=400)
    one, two = generate.generate(spark, plan), generate.generate(spark, plan)
    rows = lambda d: [tuple(r) for r in d.warehouse.collect()]
    assert rows(one) == rows(two) != rows(generate.generate(spark, generate.Plan(seed=1, rows=400)))
    kinds = {r.kind: r["count"] for r in one.faults.groupBy("kind").count().collect()}
    assert kinds == generate.FAULTS
    assert len(rows(one)) == 400 - 14 + 9 + 5 + 4 * 2
    day = generate.next_day(spark, plan)
    assert day.changes["backfilled"] and "batch_id" in day.warehouse.columns and len(day.changes["new_missing"]) == 3


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and cli.main(["nonsense"]) == 2
    assert cli.main(["run", "--ledger", str(tmp_path / "none"), "--warehouse", str(tmp_path / "none")]) == 2
    data, db = str(tmp_path / "data"), f"file://{tmp_path}/h"
    assert cli.main(["demo", "--dir", data, "--rows", "300", "--db", db, "--json", str(tmp_path / "r.json"), "--html", str(tmp_path / "r.html"), "--quiet"]) == 1
    r = json.loads((tmp_path / "r.json").read_text())
    manifest = json.loads((tmp_path / "data" / "manifest.json").read_text())
    types = r["summary"]["breaks_by_type"]
    assert types["missing_in_target"] == 14 and types["duplicate"] == 9 and types["orphan_in_target"] == 5 and types["value_mismatch"] == 26 + 18 + 7 + 6
    assert r["matching"]["split_sets"] == 4 and manifest["fault_counts"]["timing"] == 26
    assert all(c["attribution"]["explained"] for c in r["clusters"] if c["level"] == "aggregate")
    assert cli.main(["demo", "--dir", data, "--rows", "300", "--db", db, "--next-day"]) == 1
    said = capsys.readouterr().out
    assert "run 2" in said and "batch id" in said.replace("_", " ")
    assert cli.main(["run", "--ledger", f"{data}/ledger.csv", "--warehouse", f"{data}/ledger.csv", "--quiet"]) == 0


def test_streaming_totals(spark, tmp_path):
    from tally_spark.streaming.totals import running_totals

    rows = side(spark, "ledger", [("A", 0, 5), ("B", 0, 7), ("C", 10, 1)]).unionByName(side(spark, "warehouse", [("A", 0, 5)])).withColumn("arrived", F.current_timestamp())
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_totals(stream, "arrived").writeStream.outputMode("append").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.ledger_total, r.warehouse_total, r.ledger_rows, r.warehouse_rows) for r in spark.sql("select * from totals").collect()] == [(12, 5, 2, 1)]
