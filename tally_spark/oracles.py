"""DuckDB SQL for the queries, built from named common table expressions; a query gets those that it needs."""

from __future__ import annotations

import re

from .explain.offline import CONFIDENCE, UNSURE
from .fixtures import LEDGER, LEDGER_2, LEGS, LEGS_2, numbered_sql
from .operators.attribution import LABELS
from .operators.checks import DETAILS

_SORT = "posted_date, account_id, amount_cents, COALESCE(txn_id, ''), row_number"
_ROW = "source, row_number, txn_id, account_id, posted_date, amount_cents, currency, status"


def _money(x: str) -> str:
    return f"CONCAT(CASE WHEN {x} < 0 THEN '-' ELSE '' END, CAST(ABS({x}) // 100 AS VARCHAR), '.', LPAD(CAST(ABS({x}) % 100 AS VARCHAR), 2, '0'))"


def _key(sep: str) -> str:
    return f"CASE WHEN COALESCE(txn_id, '') <> '' THEN CONCAT('txn{sep}', txn_id) ELSE CONCAT('composite{sep}', account_id, '{sep}', currency, '{sep}', CAST(amount_cents AS VARCHAR), '{sep}', CAST(posted_date AS VARCHAR)) END"


def _break(kind: str, level: str, source: str, details: dict[str, str], date: str = "NULL", account: str = "NULL", currency: str = "NULL", cents: str = "0", l_refs: str = "[]", w_refs: str = "[]", where: str = "TRUE") -> str:
    own = ", ".join(f"CAST({details.get(k, 'NULL')} AS {'BIGINT' if t == 'bigint' else 'VARCHAR'}) AS d_{k}" for k, t in DETAILS.items())
    return f"SELECT '{kind}' AS type, '{level}' AS level, CAST({date} AS DATE) AS date, CAST({account} AS VARCHAR) AS account_id, CAST({currency} AS VARCHAR) AS currency, CAST({cents} AS BIGINT) AS magnitude_cents, CAST({l_refs} AS VARCHAR[]) AS l_refs, CAST({w_refs} AS VARCHAR[]) AS w_refs, {own} FROM {source} WHERE {where}"


def _text(x: str) -> str:
    return f"COALESCE('\"' || {x} || '\"', 'null')"


def _json_payload() -> str:
    details = " || ',' || ".join(f"'\"{k}\":' || " + (f"COALESCE(CAST(d_{k} AS VARCHAR), 'null')" if t == "bigint" else _text(f"d_{k}")) for k, t in DETAILS.items())
    refs = lambda c: f"CASE WHEN len({c}) = 0 THEN '[]' ELSE '[\"' || array_to_string({c}, '\",\"') || '\"]' END"
    return (
        f"'{{\"type\":\"' || type || '\",\"partition\":{{\"date\":' || {_text('CAST(date AS VARCHAR)')} || ',\"account_id\":' || {_text('account_id')} || ',\"currency\":' || {_text('currency')} || '}},\"magnitude_cents\":' || CAST(magnitude_cents AS VARCHAR) "
        f"|| ',\"ledger_refs\":' || {refs('l_refs')} || ',\"warehouse_refs\":' || {refs('w_refs')} || ',\"details\":{{' || {details} || '}}}}'"
    )


_SIGNATURE = (
    f"CASE WHEN type IN ('missing_in_target', 'orphan_in_target') THEN '{{\"date\":' || {_text('CAST(date AS VARCHAR)')} || ',\"currency\":' || {_text('currency')} || '}}' "
    f"WHEN type = 'value_mismatch' THEN '{{\"fields\":' || {_text('d_fields')} || ',\"band\":' || {_text('d_band')} || '}}' WHEN type = 'duplicate' THEN '{{\"source\":' || {_text('d_source')} || '}}' "
    f"WHEN type = 'schema_drift' THEN '{{\"kind\":' || {_text('d_kind')} || '}}' ELSE '{{\"currency\":' || {_text('currency')} || '}}' END"
)


def _cte(day: str = "") -> dict[str, str]:
    """The steps for one day; names of day two end in _2."""
    d = day
    refs = lambda s: f"list_sort(list(CONCAT(source, ':', row_number)) FILTER (WHERE source = '{s}'))"
    statuses = lambda s: f"list(status ORDER BY leg_pos) FILTER (WHERE source = '{s}')"
    member = lambda pairs, strategy: f"SELECT CONCAT('l', p.lr) AS match_id, '{strategy}' AS strategy, 0 AS leg_pos, {_ROW} FROM {pairs} p JOIN led{d} l ON l.row_number = p.lr UNION ALL SELECT CONCAT('l', p.lr), '{strategy}', 0, {_ROW} FROM {pairs} p JOIN wh{d} w ON w.row_number = p.wr"
    surplus = lambda left, full: f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY {_SORT}) AS nth FROM (SELECT *, {_key(':')} AS k FROM {left})) u JOIN (SELECT {_key(':')} AS k, COUNT(*) AS n FROM {full} GROUP BY 1) c USING (k) WHERE n = 1 OR nth = n"
    uniq = lambda x: f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({x}, lambda s: [s])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END)"
    joined = lambda x: f"array_to_string(list_sort(list_distinct({x})), ',')"
    return {
        f"led{d}": f"SELECT 'ledger' AS source, row_number, txn_id, account_id, posted_date, amount_cents, currency, status FROM {'ledger_2' if d else 'ledger'}",
        f"wh{d}": f"SELECT 'warehouse' AS source, row_number, txn_id, account_id, posted_date, amount_cents, currency, status FROM warehouse{d}",
        f"exact{d}": f"SELECT l.row_number AS lr, w.row_number AS wr FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY txn_id ORDER BY {_SORT}) AS n FROM led{d} WHERE COALESCE(txn_id, '') <> '') l JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY txn_id ORDER BY {_SORT}) AS n FROM wh{d} WHERE COALESCE(txn_id, '') <> '') w ON l.txn_id = w.txn_id AND l.n = w.n",
        f"l1{d}": f"SELECT * FROM led{d} WHERE row_number NOT IN (SELECT lr FROM exact{d})",
        f"w1{d}": f"SELECT * FROM wh{d} WHERE row_number NOT IN (SELECT wr FROM exact{d})",
        f"edges{d}": f"SELECT l.row_number AS lr, w.row_number AS wr, CAST(l.posted_date - w.posted_date AS BIGINT) AS dd, l.amount_cents - w.amount_cents AS dc FROM l1{d} l JOIN w1{d} w ON l.account_id = w.account_id AND l.currency = w.currency AND ABS(l.posted_date - w.posted_date) <= 1 AND ABS(l.amount_cents - w.amount_cents) <= 1",
        f"comp{d}": f"SELECT lr, wr FROM (SELECT *, COUNT(*) OVER (PARTITION BY lr) AS a, COUNT(*) OVER (PARTITION BY wr) AS b FROM edges{d}) WHERE a = 1 AND b = 1",
        f"l2{d}": f"SELECT * FROM l1{d} WHERE row_number NOT IN (SELECT lr FROM comp{d})",
        f"w2{d}": f"SELECT * FROM w1{d} WHERE row_number NOT IN (SELECT wr FROM comp{d})",
        f"near2{d}": f"SELECT l.row_number AS lr, l.amount_cents AS target, w.row_number AS wr, w.amount_cents AS part, ROW_NUMBER() OVER (PARTITION BY l.row_number ORDER BY -ABS(w.amount_cents), w.posted_date, w.account_id, w.amount_cents, COALESCE(w.txn_id, ''), w.row_number) AS pos FROM l2{d} l JOIN w2{d} w ON l.account_id = w.account_id AND l.currency = w.currency AND ABS(l.posted_date - w.posted_date) <= 1 AND (l.amount_cents < 0) = (w.amount_cents < 0) AND ABS(w.amount_cents) <= ABS(l.amount_cents) + 1",
        f"tri{d}": f"SELECT a.lr, a.wr AS w1, b.wr AS w2, c.wr AS w3 FROM near2{d} a JOIN near2{d} b ON a.lr = b.lr AND a.pos < b.pos JOIN near2{d} c ON a.lr = c.lr AND b.pos < c.pos WHERE ABS(a.part + b.part + c.part - a.target) <= 1",
        f"trileg{d}": f"SELECT lr, w1 AS wr, 0 AS pos FROM tri{d} UNION ALL SELECT lr, w2, 1 FROM tri{d} UNION ALL SELECT lr, w3, 2 FROM tri{d}",
        f"members{d}": f"{member(f'exact{d}', 'exact_key')} UNION ALL {member(f'comp{d}', 'composite')} UNION ALL SELECT CONCAT('l', p.lr), 'split', 0, {_ROW} FROM tri{d} p JOIN led{d} l ON l.row_number = p.lr UNION ALL SELECT CONCAT('l', p.lr), 'split', p.pos, {_ROW} FROM trileg{d} p JOIN wh{d} w ON w.row_number = p.wr",
        f"left_l{d}": f"SELECT * FROM l2{d} WHERE row_number NOT IN (SELECT lr FROM tri{d})",
        f"left_w{d}": f"SELECT * FROM w2{d} WHERE row_number NOT IN (SELECT wr FROM trileg{d})",
        f"matches{d}": f"SELECT match_id, strategy, CAST(SUM(amount_cents) FILTER (WHERE source = 'ledger') AS BIGINT) AS lc, CAST(SUM(amount_cents) FILTER (WHERE source = 'warehouse') AS BIGINT) AS wc, CAST(MAX(posted_date) FILTER (WHERE source = 'warehouse') - MIN(posted_date) FILTER (WHERE source = 'ledger') AS BIGINT) AS dd, MIN(posted_date) FILTER (WHERE source = 'ledger') AS pd, {statuses('ledger')} AS ls, {statuses('warehouse')} AS ws, {refs('ledger')} AS l_refs, {refs('warehouse')} AS w_refs, MIN(account_id) AS account_id, MIN(currency) AS currency FROM members{d} GROUP BY 1, 2",
        f"compared{d}": f"SELECT * FROM (SELECT *, array_to_string(list_filter([CASE WHEN wc <> lc THEN 'amount' END, CASE WHEN dd <> 0 THEN 'posted_date' END, CASE WHEN NOT ({uniq('ls')} = {uniq('ws')}) THEN 'status' END], lambda x: x IS NOT NULL), ',') AS fields, CASE WHEN wc <> lc AND ABS(wc - lc) <= 1 THEN 'sub_tolerance' WHEN wc <> lc THEN 'material' WHEN dd <> 0 THEN 'date_shifted' ELSE 'status_only' END AS band FROM matches{d}) WHERE fields <> ''",
        f"days{d}": f"SELECT posted_date, currency, CAST(COALESCE(SUM(amount_cents) FILTER (WHERE source = 'ledger'), 0) AS BIGINT) AS lt, CAST(COALESCE(SUM(amount_cents) FILTER (WHERE source = 'warehouse'), 0) AS BIGINT) AS wt, COUNT(*) FILTER (WHERE source = 'ledger') AS ln, COUNT(*) FILTER (WHERE source = 'warehouse') AS wn FROM (SELECT * FROM led{d} UNION ALL SELECT * FROM wh{d}) GROUP BY 1, 2",
        f"b_missing{d}": _break("missing_in_target", "row", f"({surplus(f'left_l{d}', f'led{d}')})", {"amount": _money("amount_cents"), "status": "status", "txn_id": "txn_id"}, "posted_date", "account_id", "currency", "amount_cents", "[CONCAT('ledger:', row_number)]"),
        f"b_orphan{d}": _break("orphan_in_target", "row", f"({surplus(f'left_w{d}', f'wh{d}')})", {"amount": _money("amount_cents"), "status": "status", "txn_id": "txn_id"}, "posted_date", "account_id", "currency", "amount_cents", "[]", "[CONCAT('warehouse:', row_number)]"),
        f"dup{d}": f"SELECT source, k, COUNT(*) AS n, list_sort(list(row_number)) AS rows, list_sort(list(CONCAT(source, ':', row_number))) AS refs, arg_min(posted_date, row_number) AS posted_date, arg_min(account_id, row_number) AS account_id, arg_min(currency, row_number) AS currency, arg_min(amount_cents, row_number) AS unit FROM (SELECT *, {_key('|')} AS k FROM (SELECT * FROM led{d} UNION ALL SELECT * FROM wh{d})) GROUP BY 1, 2 HAVING COUNT(*) > 1",
        f"b_dup{d}": _break("duplicate", "row", f"dup{d}", {"source": "source", "business_key": "k", "occurrences": "n", "row_numbers": "array_to_string(rows, ',')", "unit_amount": _money("unit")}, "posted_date", "account_id", "currency", "unit * (n - 1)", "CASE WHEN source = 'ledger' THEN refs ELSE [] END", "CASE WHEN source = 'warehouse' THEN refs ELSE [] END"),
        f"b_value{d}": _break("value_mismatch", "row", f"compared{d}", {"fields": "fields", "band": "band", "strategy": "strategy", "ledger_amount": _money("lc"), "warehouse_amount": _money("wc"), "amount_delta": _money("(wc - lc)"), "date_delta_days": "dd", "ledger_status": joined("ls"), "warehouse_status": joined("ws")}, "pd", "account_id", "currency", "wc - lc", "l_refs", "w_refs"),
        f"b_total{d}": _break("control_total_mismatch", "aggregate", f"days{d}", {"delta": _money("(wt - lt)"), "ledger_total": _money("lt"), "warehouse_total": _money("wt")}, "posted_date", "NULL", "currency", "wt - lt", where="wt <> lt"),
        f"b_count{d}": _break("row_count_mismatch", "aggregate", f"days{d}", {"delta": "CAST(wn - ln AS VARCHAR)", "ledger_rows": "ln", "warehouse_rows": "wn"}, "posted_date", "NULL", "currency", where="wn <> ln"),
        f"b_drift{d}": _break("schema_drift", "aggregate", "(SELECT 1)", {"kind": "'column_added'", "column": "'batch_id'", "warehouse_type": "'string'"}),
        f"b_all{d}": " UNION ALL ".join(f"SELECT * FROM b_{x}{d}" for x in ("missing", "orphan", "dup", "value", "total", "count", *["drift"] * bool(d))),
        f"brk{d}": f"SELECT 'brk_' || substr(digest, 1, 12) AS id, *, 'cls_' || substr(sha256(type || '|' || signature), 1, 10) AS cluster_id FROM (SELECT *, sha256({_json_payload()}) AS digest, {_SIGNATURE} AS signature FROM b_all{d})",
        f"subject{d}": f"SELECT digest, array_to_string(list_sort(list(k)), '|') AS subject FROM (SELECT digest, unnest(CASE WHEN len(l_refs) > 0 THEN l_refs ELSE w_refs END) AS r FROM brk{d} WHERE type IN ('missing_in_target', 'orphan_in_target', 'value_mismatch')) x JOIN (SELECT CONCAT(source, ':', row_number) AS r, {_key(':')} AS k FROM (SELECT * FROM led{d} UNION ALL SELECT * FROM wh{d})) y USING (r) GROUP BY 1",
        f"keyed{d}": f"SELECT *, CASE WHEN n = 1 THEN base ELSE base || '#' || n END AS break_key FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY base ORDER BY digest) AS n FROM (SELECT b.*, type || '|' || CASE WHEN type IN ('control_total_mismatch', 'row_count_mismatch') THEN CAST(date AS VARCHAR) || '|' || currency WHEN type = 'duplicate' THEN d_source || '|' || d_business_key WHEN type = 'schema_drift' THEN d_kind || '|' || d_column ELSE subject END AS base FROM brk{d} b LEFT JOIN subject{d} USING (digest)))",
    }


_ADJACENT = "SELECT key, CAST(COUNT(*) FILTER (WHERE source = 'ledger') AS BIGINT) AS ledger_matches, CAST(COUNT(*) FILTER (WHERE source = 'warehouse') AS BIGINT) AS warehouse_matches FROM {wanted} w LEFT JOIN (SELECT * FROM led UNION ALL SELECT * FROM wh) r ON r.account_id = w.account_id AND r.currency = w.currency AND ABS(r.posted_date - w.date) = 1 AND ABS(r.amount_cents - w.cents) <= 1 GROUP BY key"
_LABEL = "CASE cause " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE cause END"

CTES = {
    "ledger": LEDGER,
    "legs": LEGS,
    "warehouse": numbered_sql("legs"),
    "ledger_2": LEDGER_2,
    "legs_2": LEGS_2,
    "warehouse_2": numbered_sql("legs_2", "day2-"),
    "raw": "SELECT o_orderkey + 1 AS row_number, o_orderkey AS k, o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderstatus, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders",
    **_cte(),
    **_cte("_2"),
    "effrow": "SELECT date, currency, type AS cause, digest AS sid, CASE WHEN type = 'orphan_in_target' THEN magnitude_cents ELSE -magnitude_cents END AS cents, CASE WHEN type = 'orphan_in_target' THEN 1 ELSE -1 END AS n FROM brk WHERE type IN ('missing_in_target', 'orphan_in_target') "
    "UNION ALL SELECT date, currency, 'duplicate', digest, CASE WHEN d_source = 'warehouse' THEN 1 ELSE -1 END * magnitude_cents, CASE WHEN d_source = 'warehouse' THEN 1 ELSE -1 END * (d_occurrences - 1) FROM brk WHERE type = 'duplicate' "
    "UNION ALL SELECT m.posted_date, m.currency, COALESCE('value_mismatch:' || b.d_band, 'split'), COALESCE(b.digest, 'split:' || x.match_id), CASE WHEN m.source = 'warehouse' THEN 1 ELSE -1 END * m.amount_cents, CASE WHEN m.source = 'warehouse' THEN 1 ELSE -1 END FROM matches x LEFT JOIN (SELECT * FROM brk WHERE type = 'value_mismatch') b ON b.l_refs = x.l_refs AND b.w_refs = x.w_refs JOIN members m ON m.match_id = x.match_id WHERE b.digest IS NOT NULL OR x.strategy = 'split'",
    "targets": "SELECT cluster_id, digest, date, currency, CASE WHEN type = 'control_total_mismatch' THEN 'cents' ELSE 'rows' END AS measure, CASE WHEN type = 'control_total_mismatch' THEN magnitude_cents ELSE CAST(d_delta AS BIGINT) END AS gap FROM brk WHERE type IN ('control_total_mismatch', 'row_count_mismatch')",
    "met": "SELECT t.cluster_id, t.measure, t.date, t.currency, e.cause, e.sid, CASE WHEN t.measure = 'cents' THEN e.cents ELSE e.n END AS moved FROM targets t JOIN effrow e ON e.date = t.date AND e.currency = t.currency",
    "balance": "SELECT t.cluster_id, t.measure, CAST(SUM(gap) AS BIGINT) AS gap, CAST(SUM(gap) - SUM(COALESCE(moved, 0)) AS BIGINT) AS residual, COUNT(*) FILTER (WHERE gap <> COALESCE(moved, 0)) AS unexplained FROM targets t LEFT JOIN (SELECT measure, date, currency, SUM(moved) AS moved FROM met GROUP BY 1, 2, 3) m ON m.measure = t.measure AND m.date = t.date AND m.currency = t.currency GROUP BY 1, 2",
    "clusters": "SELECT *, ROW_NUMBER() OVER (ORDER BY CASE WHEN level = 'row' THEN 0 ELSE 1 END, -ABS(magnitude_cents), -break_count, cluster_id) AS rank FROM (SELECT cluster_id, type, level, signature, COUNT(*) AS break_count, CAST(SUM(magnitude_cents) AS BIGINT) AS magnitude_cents, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(DISTINCT date) AS days FROM brk GROUP BY 1, 2, 3, 4)",
    "sampled": "SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster_id ORDER BY digest) AS sample FROM brk",
    "probe": "SELECT cluster_id AS key, account_id, currency, date, CAST(replace(d_amount, '.', '') AS BIGINT) AS cents FROM sampled WHERE sample = 1 AND type IN ('missing_in_target', 'orphan_in_target')",
    "adjacent": _ADJACENT.format(wanted="probe"),
    "verdicts": "SELECT s.cluster_id, CASE WHEN type IN ('missing_in_target', 'orphan_in_target') AND ledger_matches + warehouse_matches > 0 THEN 'TIMING_DIFFERENCE' WHEN type = 'missing_in_target' THEN 'MISSING_IN_TARGET' WHEN type = 'orphan_in_target' THEN 'GENUINE_DISCREPANCY' WHEN type = 'duplicate' THEN 'DUPLICATE_IN_TARGET' WHEN type = 'value_mismatch' THEN CASE d_band WHEN 'sub_tolerance' THEN 'ROUNDING' WHEN 'date_shifted' THEN 'TIMING_DIFFERENCE' ELSE 'GENUINE_DISCREPANCY' END WHEN type = 'row_count_mismatch' THEN CASE WHEN CAST(d_delta AS BIGINT) < 0 THEN 'MISSING_IN_TARGET' ELSE 'DUPLICATE_IN_TARGET' END ELSE 'UNKNOWN' END AS classification FROM sampled s LEFT JOIN adjacent a ON a.key = s.cluster_id WHERE sample = 1",
    "chosen": "SELECT * FROM (SELECT * FROM open_clusters ORDER BY rank LIMIT 40) UNION SELECT * FROM (SELECT * FROM open_clusters ORDER BY break_count DESC, rank LIMIT 10)",
    "open_clusters": "SELECT * FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM balance WHERE unexplained = 0)",
    "outcomes": "SELECT CASE WHEN type = 'missing_in_target' THEN 'missing' WHEN type = 'orphan_in_target' AND d_txn_id LIKE 'WHS-ORPHAN-%' THEN 'orphan' WHEN type = 'duplicate' THEN 'duplicated' WHEN type = 'value_mismatch' THEN CASE d_band WHEN 'date_shifted' THEN 'timing' WHEN 'sub_tolerance' THEN 'rounding' WHEN 'material' THEN 'material' ELSE 'status' END END AS kind, CASE WHEN type = 'missing_in_target' THEN 'MISSING_IN_TARGET' WHEN type = 'orphan_in_target' THEN 'GENUINE_DISCREPANCY' WHEN type = 'duplicate' THEN 'DUPLICATE_IN_TARGET' WHEN d_band = 'date_shifted' THEN 'TIMING_DIFFERENCE' WHEN d_band = 'sub_tolerance' THEN 'ROUNDING' ELSE 'GENUINE_DISCREPANCY' END AS expected, classification AS actual FROM brk JOIN verdicts USING (cluster_id) WHERE level = 'row'",
    "runs_1_2": "SELECT b.break_key, b.type, b.cluster_id, CASE WHEN a.break_key IS NULL THEN 2 ELSE 1 END AS first_seen FROM keyed_2 b LEFT JOIN keyed a USING (break_key)",
}


def _flat(cte: str, *details: str) -> str:
    return f"SELECT type, level, date, account_id, currency, magnitude_cents, array_to_string(l_refs, ',') AS ledger_refs, array_to_string(w_refs, ',') AS warehouse_refs, {', '.join(f'd_{d}' for d in details)} FROM {cte}"


_AMOUNT = "CONCAT(CASE WHEN k % 5 = 0 THEN '+' ELSE '' END, CAST(cents // 100 AS VARCHAR), '.', LPAD(CAST(cents % 100 AS VARCHAR), 2, '0'), CAST(k % 10 AS VARCHAR))"
_CENTS = "cents + CASE WHEN k % 10 >= 5 THEN 1 ELSE 0 END"
_PAIRS = "SELECT match_id, strategy, source, CAST(leg_pos AS BIGINT) AS leg_pos, row_number FROM members WHERE strategy = '{}'"

_BODY = {
    "normalize_rows": f"SELECT row_number, CASE WHEN k % 8 = 0 THEN NULL ELSE CONCAT('TXN-', k) END AS txn_id, CONCAT('ACC-', o_custkey % 50) AS account_id, d AS posted_date, {_CENTS} AS amount_cents, CASE WHEN k % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN k % 6 = 0 THEN 'UNKNOWN' ELSE UPPER(o_orderstatus) END AS status FROM raw",
    "amount_to_cents": f"SELECT row_number, {_AMOUNT} AS amount, CAST(ROUND(CAST({_AMOUNT} AS DECIMAL(18, 3)) * 100) AS BIGINT) AS amount_cents FROM raw",
    "money_format": f"SELECT row_number, {_money('amount_cents')} AS money, CONCAT(CASE WHEN amount_cents < 0 THEN '-$' ELSE '$' END, format('{{:,}}', ABS(amount_cents) // 100), '.', LPAD(CAST(ABS(amount_cents) % 100 AS VARCHAR), 2, '0')) AS humane FROM ledger",
    "infer_column_types": "SELECT c AS \"column\", CAST(p AS BIGINT) AS position, t AS type FROM (VALUES ('txn_id', 0, 'string'), ('account_id', 1, 'string'), ('posted_date', 2, 'date'), ('amount', 3, 'string'), ('currency', 4, 'string'), ('status', 5, 'string')) v(c, p, t)",
    "first_bad_row": "SELECT row_number, CASE WHEN row_number % 450 = 0 THEN 'posted_date 2026-13-01 isn''t a date' ELSE 'amount 12.34.56 isn''t a number' END AS error FROM raw WHERE row_number % 450 = 0 OR row_number % 700 = 0 ORDER BY row_number LIMIT 1",
    "business_keys": f"SELECT row_number, {_key(':')} AS business_key, CONCAT('warehouse:', row_number) AS ref FROM warehouse",
    "profile_summary": "SELECT COUNT(*) AS row_count, COUNT(DISTINCT account_id) AS accounts, COUNT(DISTINCT currency) AS currencies, MIN(posted_date) AS min_date, MAX(posted_date) AS max_date, CAST(SUM(amount_cents) AS BIGINT) AS total_cents FROM warehouse",
    "profile_partitions": "SELECT posted_date, currency, CAST(SUM(amount_cents) AS BIGINT) AS total_cents, COUNT(*) AS row_count FROM warehouse GROUP BY 1, 2",
    "status_histogram": "SELECT status, COUNT(*) AS row_count FROM warehouse GROUP BY 1",
    "duplicate_keys": f"SELECT {_key(':')} AS business_key, COUNT(*) AS occurrences FROM warehouse GROUP BY 1 HAVING COUNT(*) > 1",
    "match_exact": _PAIRS.format("exact_key"),
    "unmatched_after_exact": "SELECT source, row_number FROM l1 UNION ALL SELECT source, row_number FROM w1",
    "composite_edges": "SELECT lr AS ledger_row, wr AS warehouse_row, CAST(CASE WHEN dd = 0 THEN 0 WHEN dd > 0 THEN 2 * dd - 1 ELSE -2 * dd END AS BIGINT) AS days, CAST(CASE WHEN dc = 0 THEN 0 WHEN dc > 0 THEN 2 * dc - 1 ELSE -2 * dc END AS BIGINT) AS cents FROM edges",
    "match_composite": _PAIRS.format("composite"),
    "match_split": _PAIRS.format("split"),
    "match_summary": "SELECT (SELECT COUNT(*) FROM exact) AS exact_key_sets, (SELECT COUNT(*) FROM comp) AS composite_sets, (SELECT COUNT(*) FROM tri) AS split_sets, (SELECT COUNT(*) FROM left_l) AS unmatched_ledger, (SELECT COUNT(*) FROM left_w) AS unmatched_warehouse, ROUND((SELECT COUNT(*) FROM members WHERE source = 'ledger') * 1.0 / (SELECT COUNT(*) FROM led), 4) AS match_rate",
    "unmatched_final": "SELECT source, row_number FROM left_l UNION ALL SELECT source, row_number FROM left_w",
    "check_missing": _flat("b_missing", "amount", "status", "txn_id"),
    "check_orphan": _flat("b_orphan", "amount", "status", "txn_id"),
    "check_control_totals": _flat("b_total", "delta", "ledger_total", "warehouse_total"),
    "check_row_counts": _flat("b_count", "delta", "ledger_rows", "warehouse_rows"),
    "check_duplicates": _flat("b_dup", "source", "business_key", "occurrences", "row_numbers", "unit_amount"),
    "check_values": _flat("b_value", "fields", "band", "strategy", "ledger_amount", "warehouse_amount", "amount_delta", "date_delta_days", "ledger_status", "warehouse_status"),
    "value_bands": "SELECT d_band AS band, COUNT(*) AS breaks, CAST(SUM(magnitude_cents) AS BIGINT) AS magnitude_cents FROM b_value GROUP BY 1",
    "check_schema_drift": "SELECT 'schema_drift' AS type, 'aggregate' AS level, CAST(NULL AS DATE) AS date, CAST(NULL AS VARCHAR) AS account_id, CAST(NULL AS VARCHAR) AS currency, CAST(0 AS BIGINT) AS magnitude_cents, '' AS ledger_refs, '' AS warehouse_refs, 'column_added' AS d_kind, 'batch_id' AS d_column, CAST(NULL AS VARCHAR) AS d_ledger_type, 'string' AS d_warehouse_type",
    "break_ids": "SELECT id, digest, type, signature, cluster_id FROM brk",
    "breaks_by_type": "SELECT type, COUNT(*) AS count FROM b_all GROUP BY 1",
    "row_level_impact": "SELECT CAST(COALESCE(SUM(ABS(magnitude_cents)), 0) AS BIGINT) AS impact_cents FROM b_all WHERE level = 'row'",
    "clusters_ranked": "SELECT * FROM clusters",
    "cluster_samples": "SELECT cluster_id, sample, id FROM sampled WHERE sample <= 3",
    "attribution_effects": "SELECT date, currency, cause, CAST(SUM(cents) AS BIGINT) AS cents, CAST(SUM(n) AS BIGINT) AS rows, COUNT(DISTINCT sid) AS breaks FROM effrow GROUP BY 1, 2, 3",
    "attribution_components": f"SELECT v.cluster_id, v.measure, v.cause, {_LABEL.replace('cause', 'v.cause')} AS label, breaks, value FROM (SELECT cluster_id, measure, cause, CAST(SUM(day) AS BIGINT) AS value, MAX(CASE WHEN day <> 0 THEN 1 ELSE 0 END) AS touched FROM (SELECT cluster_id, measure, cause, date, currency, SUM(moved) AS day FROM met GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3) v JOIN (SELECT cluster_id, cause, COUNT(DISTINCT sid) AS breaks FROM met GROUP BY 1, 2) i ON i.cluster_id = v.cluster_id AND i.cause = v.cause WHERE touched = 1",
    "attribution_summary": "SELECT *, unexplained = 0 AS explained FROM balance",
    "stable_keys": "SELECT break_key, id, type FROM keyed",
    "history_diff": "SELECT break_key, CASE WHEN first_seen = 2 THEN 'new' ELSE 'still_open' END AS state, r.type, magnitude_cents FROM runs_1_2 r JOIN keyed_2 USING (break_key) UNION ALL SELECT break_key, 'resolved', type, magnitude_cents FROM keyed WHERE break_key NOT IN (SELECT break_key FROM keyed_2)",
    "history_sections": "SELECT state, type, COUNT(*) AS breaks, CAST(COALESCE(SUM(CASE WHEN level = 'row' THEN ABS(magnitude_cents) END), 0) AS BIGINT) AS row_level_cents FROM (SELECT CASE WHEN first_seen = 2 THEN 'new' ELSE 'still_open' END AS state, r.type, level, magnitude_cents FROM runs_1_2 r JOIN keyed_2 USING (break_key) UNION ALL SELECT 'resolved', type, level, magnitude_cents FROM keyed WHERE break_key NOT IN (SELECT break_key FROM keyed_2)) GROUP BY 1, 2",
    "history_streaks": "SELECT a.break_key, CAST(CASE WHEN r.break_key IS NULL THEN 3 ELSE r.first_seen END AS BIGINT) AS first_seen FROM keyed a LEFT JOIN runs_1_2 r USING (break_key)",
    "history_age": "SELECT cluster_id, COUNT(*) FILTER (WHERE first_seen = 2) AS new, COUNT(*) FILTER (WHERE first_seen < 2) AS carried, CAST(MIN(first_seen) FILTER (WHERE first_seen < 2) AS BIGINT) AS since FROM runs_1_2 GROUP BY 1",
    "schema_changes": "SELECT 'warehouse' AS source, 'column_added' AS change, 'batch_id' AS \"column\", CAST(NULL AS VARCHAR) AS from_type, 'string' AS to_type",
    "investigation_targets": "SELECT cluster_id, type, break_count, magnitude_cents FROM chosen",
    "adjacent_periods": _ADJACENT.format(wanted="(SELECT CONCAT(source, ':', row_number) AS key, account_id, currency, posted_date AS date, amount_cents AS cents FROM (SELECT * FROM left_l UNION ALL SELECT * FROM left_w))"),
    "fetch_rows": f"SELECT {_ROW} FROM led WHERE account_id = 'ACC-0007' ORDER BY {_SORT} LIMIT 20",
    "offline_classification": f"SELECT cluster_id, classification, CAST(CASE WHEN classification = 'UNKNOWN' THEN {UNSURE} ELSE {CONFIDENCE} END AS DOUBLE) AS confidence FROM verdicts",
    "classification_summary": "SELECT COALESCE(v.classification, CASE WHEN b.unexplained = 0 THEN 'EXPLAINED' END, 'NOT_INVESTIGATED') AS classification, COUNT(*) AS clusters, CAST(SUM(c.break_count) AS BIGINT) AS breaks, CAST(SUM(ABS(c.magnitude_cents)) AS BIGINT) AS magnitude_cents FROM clusters c LEFT JOIN (SELECT * FROM verdicts WHERE cluster_id IN (SELECT cluster_id FROM chosen)) v USING (cluster_id) LEFT JOIN balance b USING (cluster_id) GROUP BY 1",
    "eval_recall": "SELECT kind, expected, COUNT(*) AS breaks, COUNT(*) FILTER (WHERE actual = expected) AS correct, ROUND(COUNT(*) FILTER (WHERE actual = expected) * 1.0 / COUNT(*), 3) AS recall FROM outcomes WHERE kind IS NOT NULL GROUP BY 1, 2",
    "eval_calibration": f"SELECT '0.7-0.9' AS band, COUNT(*) AS breaks, CAST({CONFIDENCE} AS DOUBLE) AS mean_confidence, ROUND(COUNT(*) FILTER (WHERE actual = expected) * 1.0 / COUNT(*), 3) AS accuracy FROM outcomes WHERE kind IS NOT NULL",
}

_BODY["csv_scan"] = f"SELECT txn_id, account_id, posted_date, amount_cents, currency, status FROM ({_BODY['normalize_rows']})"
_BODY["csv_row_numbers"] = "SELECT COUNT(*) AS row_count, CAST(1 AS BIGINT) AS first_number, COUNT(*) AS last_number, COUNT(*) AS numbers FROM raw"


def _needed(body: str) -> list[str]:
    """Names of the expressions that the text uses, each after those that it uses itself."""
    done: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in done and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in done:
                    done.append(name)

    visit(body)
    return done


def _sql(body: str) -> str:
    names = _needed(body)
    return (f"WITH {', '.join(f'{n} AS MATERIALIZED ({CTES[n]})' for n in names)} " if names else "") + body


ORACLES = {name: _sql(body) for name, body in _BODY.items()}
