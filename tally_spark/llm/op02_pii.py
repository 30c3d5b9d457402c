"""Personal data: weak supervision over span candidates, with DataFrame functions only.

Base spans are what fixed patterns and checks find; they always stay. Other candidates come from a wide pattern (spelled
out addresses, numbers without a country code, keys, account and identity numbers). Labelers vote on each candidate
(yes, no or silent): strict patterns, gazetteers, words before it, its shape. Expectation-maximisation (Dawid and Skene's
model, two classes) estimates each labeler's reliability and each kind's rate from the counts of vote patterns, and the
posterior of each pattern. These are the soft labels of the final span classifier, a naive Bayes model over features of
the span and its context, with additive smoothing. Candidates that it finds likelier than not, and that touch no base
span, are added.

The number of vote patterns and of feature combinations is fixed by the lists below, so what reaches the driver doesn't
grow with the input; all counts cover all documents. Each document stays one row, its matches an array; nothing but the
counts is shuffled.

Places are code points, end exclusive. A match's place is the length of all gaps and matches before it, so one pass of
split and one of extraction are enough. Patterns are possessive and start only where a run of their first class starts
(or where the last match ended), so matching costs time linear in the text and no deep recursion; the matches are the
same. Places are running sums in steps of doubled width, and candidates are held against base spans in one sorted list,
so n matches in a text cost n log n.

Defined results: null or empty text has no span. Repeated rows give a row each. A table without candidates trains no
classifier and adds nothing. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

#: Patterns of the base kinds, in the order in which spans are listed.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?(?:\[at\]|\(at\)|\{at\}) ?| at )[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot )[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
}
KINDS = ["email", "ip", "card", "phone", "iban", "identity", "secret"]
#: Gazetteers.
TOP_DOMAINS = "com|org|net|edu|gov|io|de|fr|es|uk|info|eu"
KEY_STARTS = "AKIA|ASIA|ghp_|gho_|sk-|pk_|xox|AIza|eyJ|glpat-"
COUNTRIES = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|SE"
CUES = {
    "email": "mail|contact|write|reach",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "identity": "ssn|social|security|identity|tax",
    "phone": "phone|call|tel|fax|mobile|contact",
    "secret": "token|key|secret|password|passwd|pwd|auth|bearer|credential",
}
AGAINST = "isbn|doi|commit|sha|md5|version|order|invoice|http|path|page|figure"
CONTEXT = 40
LABELERS = ["strict", "gazetteer", "cue", "against", "shape"]
FEATURES = ["kind", "length", "digits", "cased", *LABELERS]
ROUNDS = 60

#: Steps of the running sums and maxima below: 2 ** 31 places at most, which is what an array holds.
STEPS = ", ".join(f"{1 << k}L" for k in range(31))


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _matches(pattern: str, text: str, may: str = "true") -> tuple[str, str]:
    p = _quoted(pattern)
    return f"CASE WHEN {may} THEN regexp_extract_all({text}, {p}, 0) ELSE array() END", f"CASE WHEN {may} THEN split({text}, {p}, -1) ELSE array() END"


def _running(values: str, join: str) -> str:
    """The sum or maximum of each value of an array and all before it: in step k the value 2 ** k places before is joined, so n values take log2(n) passes."""
    return f"aggregate(array({STEPS}), {values}, (a, h) -> CASE WHEN h >= size(a) THEN a ELSE transform(a, (v, i) -> CASE WHEN i >= h THEN {join.format('v', 'a[cast(i - h as int)]')} ELSE v END) END)"


def _ends(m: str, g: str) -> str:
    """The end of each match in m, whose gaps are g; there is one more gap, and a null for it."""
    return _running(f"zip_with({g}, {m}, (y, x) -> cast(char_length(y) as bigint) + char_length(x))", "{} + {}")


_DIGITS = "regexp_replace({x}, '[^0-9]', '')"
_LUHN = (
    "aggregate(transform(split(reverse({d}), ''), (c, i) -> CASE WHEN c = '' THEN 0 WHEN i % 2 = 0 THEN cast(c as int) "
    "WHEN cast(c as int) > 4 THEN 2 * cast(c as int) - 9 ELSE 2 * cast(c as int) END), 0, (a, v) -> a + v) % 10 = 0"
)


def _valid(kind: str, x: str) -> str:
    d = _DIGITS.format(x=x)
    return {
        "email": "true",
        "ip": f"NOT exists(split({x}, '[.]'), p -> char_length(ltrim('0', p)) > 3 OR cast(concat('0', right(p, 3)) as int) > 255)",
        "card": f"CASE WHEN char_length({d}) BETWEEN 16 AND 19 THEN {_LUHN.format(d=d)} ELSE false END",
        "phone": f"char_length({d}) BETWEEN 8 AND 15",
    }[kind]


def _flag(test: str, otherwise: str = "-1") -> str:
    return f"CASE WHEN {test} THEN 1 ELSE {otherwise} END"


def _votes(v: str, b: str, k: str) -> dict[str, str]:
    """Each labeler's vote on the value v of kind k after the text b: 1, 0 or -1 (silent)."""
    cue = " ".join(f"WHEN {k} = '{kind}' THEN CASE WHEN {b} RLIKE '(?i)({words})[^A-Za-z]{{0,12}}$' THEN 1 ELSE -1 END" for kind, words in CUES.items())
    digits = f"regexp_count({v}, '[0-9]')"
    return {
        "strict": f"CASE WHEN {k} = 'secret' THEN {_flag(f"{v} RLIKE '^([0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}}|(AKIA|ASIA)[A-Z0-9]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}})$'")} "
        f"WHEN {k} = 'identity' THEN {_flag(f"{v} RLIKE '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$'", '0')} "
        f"WHEN {k} = 'phone' THEN {_flag(f"{v} RLIKE '^([(][0-9]{{3}}[)] ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}$'")} "
        f"WHEN {k} = 'email' THEN {_flag(f"{v} RLIKE r'[\\[({{]at[\\])}}]'")} ELSE {_flag(f"char_length(replace({v}, ' ', '')) BETWEEN 15 AND 34", '0')} END",
        "gazetteer": f"CASE WHEN {k} = 'email' THEN {_flag(f"{v} RLIKE '(?i)({TOP_DOMAINS})$'", '0')} WHEN {k} = 'secret' THEN {_flag(f"{v} RLIKE '^({KEY_STARTS})'")} "
        f"WHEN {k} = 'iban' THEN {_flag(f"{v} RLIKE '^({COUNTRIES})'", '0')} ELSE -1 END",
        "cue": f"CASE {cue} ELSE -1 END",
        "against": f"CASE WHEN {b} RLIKE '(?i)({AGAINST})[^A-Za-z]{{0,12}}$' THEN 0 ELSE -1 END",
        "shape": f"CASE WHEN {k} <> 'secret' THEN -1 WHEN {digits} >= 4 AND {v} RLIKE '[A-Za-z]' AND {v} RLIKE '[0-9][A-Za-z]+[0-9]' THEN 1 WHEN {digits} < 2 THEN 0 ELSE -1 END",
    }


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _base (array of kind, s, e; valid base spans in order) and _wide (array of kind, s, e, features and votes; those that touch no base span)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_t"))
    may = {"email": "contains(_t, '@')", "phone": "contains(_t, '+')"}
    every = BASE | {"wide": "|".join(WIDE.values())}
    found = rows.select("_id", *[F.expr(x).alias(f"_{part}_{kind}") for kind, p in every.items() for part, x in zip("mg", _matches(p, "_t", may.get(kind, "true")), strict=True)])
    placed = found.select("_id", *[f"_m_{k}" for k in every], "_g_wide", *[F.expr(_ends(f"_m_{k}", f"_g_{k}")).alias(f"_e_{k}") for k in every])
    # arrays are zipped: an array that a lambda's body took from outside might be made anew for each match
    span = "'s', e - char_length(x), 'e', e"
    base = ", ".join(f"filter(zip_with(_m_{k}, _e_{k}, (x, e) -> named_struct('kind', '{k}', {span}, 'ok', x IS NOT NULL AND {_valid(k, 'x')})), y -> y.ok)" for k in BASE)
    first = f"filter(zip_with(zip_with(_m_wide, _e_wide, (x, e) -> named_struct('kind', {_kind_of('x')}, {span}, 'v', x)), _g_wide, (x, g) -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'v', x.v, 'b', right(g, {CONTEXT}))), x -> x.v IS NOT NULL)"
    spans = placed.select("_id", F.expr(f"concat({base})").alias("_base"), F.expr(first).alias("_first"))
    # a candidate touches a base span if, of those that start before its end, the last end lies after its start
    own = "'x', named_struct('kind', {0}.kind, 's', {0}.s, 'e', {0}.e, 'v', {1}, 'b', {2})"
    events = f"array_sort(concat(transform(_base, y -> named_struct('p', y.s, 't', 1, 'e', y.e, {own.format('y', "''", "''")})), transform(_first, x -> named_struct('p', x.e, 't', 0, 'e', -1L, {own.format('x', 'x.v', 'x.b')}))))"
    spans = spans.select("_id", "_base", "_first", F.expr(f"CASE WHEN size(_first) > 0 AND size(_base) > 0 THEN {events} END").alias("_events"))
    free = f"transform(filter(zip_with(_events, {_running('transform(_events, y -> y.e)', 'greatest({}, {})')}, (y, last) -> named_struct('t', y.t, 'x', y.x, 'last', last)), y -> y.t = 0 AND y.last <= y.x.s), y -> y.x)"
    spans = spans.select("_id", "_base", F.expr(f"CASE WHEN size(_first) > 0 AND size(_base) > 0 THEN {free} ELSE _first END").alias("_apart"))
    votes = _votes("x.v", "x.b", "x.kind")
    length = "CASE WHEN char_length(x.v) < 16 THEN 0 WHEN char_length(x.v) < 24 THEN 1 WHEN char_length(x.v) < 36 THEN 2 WHEN char_length(x.v) < 48 THEN 3 WHEN char_length(x.v) < 80 THEN 4 ELSE 5 END"
    digits = "cast(floor(4.0 * regexp_count(x.v, '[0-9]') / char_length(x.v)) as int)"
    cased = "CASE WHEN x.v RLIKE '[a-z]' AND x.v RLIKE '[A-Z]' THEN 2 WHEN x.v RLIKE '[A-Z]' THEN 1 ELSE 0 END"
    fields = ", ".join(f"'{n}', {x}" for n, x in {"kind": "x.kind", "s": "x.s", "e": "x.e", "length": length, "digits": digits, "cased": cased, **votes}.items())
    return spans.select("_id", F.expr("transform(_base, y -> named_struct('kind', y.kind, 's', y.s, 'e', y.e))").alias("_base"), F.expr(f"transform(_apart, x -> named_struct({fields}))").alias("_wide"))


def _kind_of(x: str) -> str:
    """The kind of a match of the wide pattern; the alternatives in their order, without what must stand around them."""
    return (
        f"CASE WHEN {x} RLIKE r'( at |[\\[({{]at[\\])}}])' THEN 'email' WHEN {x} RLIKE '^[A-Z]{{2}}[0-9]{{2}}( ?[A-Z0-9]{{4}}){{3,7}}$' THEN 'iban' "
        f"WHEN {x} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'identity' WHEN {x} RLIKE '^[(]?[0-9]{{3}}[)]?[ .-]{{1,2}}[0-9]{{3}}[ .-][0-9]{{4}}$' THEN 'phone' ELSE 'secret' END"
    )


def estimate(patterns: dict[tuple, int]) -> dict[tuple, float]:
    """Posterior that a candidate is personal data, by (kind, votes): expectation-maximisation over the counts of patterns."""
    keys = sorted(patterns)
    posterior = {p: min(0.95, max(0.05, 0.5 + 0.3 * (sum(v == 1 for v in p[1:]) - sum(v == 0 for v in p[1:])) - 0.2 * all(v == -1 for v in p[1:]))) for p in keys}
    for _ in range(ROUNDS):
        rate, said = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: 0.0)
        for p in keys:
            for c, weight in ((1, posterior[p]), (0, 1 - posterior[p])):
                rate[p[0]][c] += patterns[p] * weight
                for j, v in enumerate(p[1:]):
                    said[j, c, v] += patterns[p] * weight
        log = {}
        for j in range(len(LABELERS)):
            for c in (0, 1):
                # a labeler that speaks is right more often than not; half of ten rows say so beforehand
                prior = {1: 4.0 if c else 1.0, 0: 1.0 if c else 4.0, -1: 5.0}
                total = sum(said[j, c, v] + prior[v] for v in prior)
                log |= {(j, c, v): math.log((said[j, c, v] + prior[v]) / total) for v in prior}
        for p in keys:
            odds = math.log(rate[p[0]][1] / rate[p[0]][0]) + sum(log[j, 1, v] - log[j, 0, v] for j, v in enumerate(p[1:]))
            posterior[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return posterior


def classifier(combos: dict[tuple, int]) -> str | None:
    """The final span classifier as an expression over x: the log odds of its features."""
    if not combos:
        return None
    at = FEATURES.index(LABELERS[0])
    patterns: dict[tuple, int] = defaultdict(int)
    for f, n in combos.items():
        patterns[f[0], *f[at:]] += n
    posterior = estimate(patterns)
    mass, of = [1.0, 1.0], [defaultdict(float) for _ in FEATURES]
    for f, n in sorted(combos.items()):
        yes = n * posterior[f[0], *f[at:]]
        for c, w in ((0, n - yes), (1, yes)):
            mass[c] += w
            for j, v in enumerate(f):
                of[j][c, v] += w
    terms = [f"({math.log(mass[1] / mass[0])!r}D)"]
    for j, name in enumerate(FEATURES):
        levels = sorted({v for _, v in of[j]})
        odds = {v: math.log((of[j][1, v] + 0.5) / (mass[1] + 0.5 * len(levels))) - math.log((of[j][0, v] + 0.5) / (mass[0] + 0.5 * len(levels))) for v in levels}
        terms.append("(CASE " + " ".join(f"WHEN x.{name} = {v!r} THEN {o!r}D" for v, o in odds.items()) + " ELSE 0D END)")
    return " + ".join(terms)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans (arrays of kind, s, e in the order of KINDS and start)."""
    found = saved(candidates(docs, id_col, text_col), "spans")
    rows = found.select(F.explode("_wide").alias("x")).groupBy(*[F.col(f"x.{n}").alias(n) for n in FEATURES]).count().collect()  # bounded by the features' levels
    odds = classifier({tuple(r[n] for n in FEATURES): r["count"] for r in rows})
    added = f"transform(filter(_wide, x -> {odds} > 0), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))" if odds else "filter(_base, y -> false)"
    order = ", ".join(f"filter(_all, y -> y.kind = '{k}')" for k in KINDS)
    ordered = "array_sort({0}, (a, b) -> CASE WHEN a.s < b.s THEN -1 WHEN a.s > b.s THEN 1 ELSE 0 END)"
    full = found.select(F.col("_id"), "_base", F.expr(f"concat(_base, {added})").alias("_all")).select("_id", "_base", F.expr(f"flatten(transform(array({order}), z -> {ordered.format('z')}))").alias("_spans"))
    return full.select(F.col("_id").alias(id_col), F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans joined as kind:start:end, with counts; the form in which results are compared."""
    joined = "array_join(transform({0}, y -> concat(y.kind, ':', y.s, ':', y.e)), ',')"
    counts = [F.expr(f"cast(size(filter(base, y -> y.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return find_pii(docs, id_col, text_col).select(id_col, *counts, F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
