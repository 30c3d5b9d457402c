"""Each operator against its plain version, on awkward rows: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from tally_spark.llm import op01_line_dedup, op02_pii, op03_lm_score, op04_quality, op05_packing, op06_decontaminate, op07_near_dedup, op08_exact_dedup, op09_warc, op10_substring_dedup
from tally_spark.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words long, hash string, chunk int, score double, bucket string, rep long, ids string, row string, body string, digest string, keep_id long, span string"


def corpus():
    r = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma,", "délta", "ÉTÉ", "the", "of", "x1", "don't", "&&&", "naïve"]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    unique = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n))
    shared = unique(60, "s")
    base = unique(120, "b")
    docs = [(i, sentence(r.randint(0, 60)).replace(" the ", "\n")) for i in range(10, 50)]
    docs += [(100 + i, f"{unique(15, i)} {shared} {unique(12, 100 + i)}") for i in range(6)]
    docs += [(200 + i, base if i < 4 else base.upper() if i == 4 else base.replace(f"wbx{i * 7}", f"new{i}")) for i in range(14)]
    block = "one line here\nsecond line there\nthird\nfourth of them\nfifth\nsixth line\nseventh\n" * 2
    docs += [(300 + i, f"intro {i}\n" * i + block + f"end {i}") for i in range(8)]
    docs += [(1, None), (2, ""), (3, "   \n\t "), (4, "one two"), (5, "one two"), (None, "a text without an identifier"), (6, "same"), (6, "same"), (7, "aaa " * 300), (8, "\n\n\n"), (9, unique(30_000, "long") + "\n" + "z" * 200_000)]
    docs += [(400, "mail a.b+c@x-y.example.com, or me@@b.c.d; 1.2.3.4 and 999.1.1.1.2; call +1 (212) 555-0100 é 4111 1111 1111 1111 or 4111111111111112"), (401, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" 555-12-3456 1.2.3.4.5.6.7.8 a@b.c_d@e.f +1-2-3-4-5-6-7-8-9"), (402, "ünïcode 😀 x@y.zz 😀 10.0.0.1")]
    return docs


DOCS = corpus()


def rows(spark, docs, schema=SCHEMA):
    extra = len(schema.split(",")) - 2
    return spark.createDataFrame([(i, t, *([None] * extra)) for i, t in docs], schema).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return rows(spark, [])


def key(row):
    return tuple((x is not None, str(type(x)), x) if x is not None else (False, "", 0) for x in row)


def same(found, expected):
    assert sorted((tuple(x) for x in found), key=key) == sorted((tuple(x) for x in expected), key=key)


def test_exact_dedup(docs, none):
    same(op08_exact_dedup.exact_groups(docs).collect(), brute.exact(DOCS))
    kept = op08_exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    same(((r.doc_id,) for r in kept.collect()), ((x[0],) for x in brute.exact(DOCS) if x[3]))
    assert op08_exact_dedup.exact_groups(none).count() == 0


def test_tree_merge_needs_no_particular_number_of_runs(spark, docs):
    expected = sorted({(x[4], x[2]) for x in brute.exact(DOCS)})
    for n, fan, range_rows in ((1, 8, 1000), (9, 2, 7), (17, 3, 40)):
        found = op08_exact_dedup.saved(op08_exact_dedup.digests(docs.repartition(n)).repartition(n), "digests")
        level = op08_exact_dedup.runs(found, "min")
        n_runs = level.agg({"_run": "max"}).first()[0] + 1
        for run in range(n_runs):
            own = [bytes(r._sha) for r in level.filter(f"_run = {run}").collect()]
            assert own == sorted(set(own))
        groups = op08_exact_dedup.tree_merge(level, n_runs, fan, "min", range_rows).collect()
        assert sorted((bytes(r._sha).hex(), r._rows) for r in groups) == expected


def test_merge_tells_entries_of_one_digest_apart():
    def run(*entries):
        sha, second, size, kept, rows = zip(*entries, strict=True)
        return np.array(sha, "S32"), np.array(second), np.array(size), np.array([k or 0 for k in kept]), np.array([k is None for k in kept]), np.array(rows)

    a, b = b"a" * 31 + b"\0", b"\xff" * 32
    parts = [run((a, 1, 5, 7, 1), (b, 1, 5, None, 2)), run((a, 1, 5, 3, 4), (a, 2, 5, 9, 1), (b, 1, 5, 2, 1)), run((a, 1, 6, 8, 1))]
    for keep, expected in (("max", [(a, 1, 5, 7, 5), (a, 1, 6, 8, 1), (a, 2, 5, 9, 1), (b, 1, 5, 2, 3)]), ("min", [(a, 1, 5, 3, 5), (a, 1, 6, 8, 1), (a, 2, 5, 9, 1), (b, 1, 5, None, 3)])):
        sha, second, size, kept, null, rows = op08_exact_dedup._merged(parts, keep)
        found = [(s.ljust(32, b"\0"), i, j, None if z else k, n) for s, i, j, k, z, n in zip(sha.tolist(), second.tolist(), size.tolist(), kept.tolist(), null.tolist(), rows.tolist(), strict=True)]
        assert sorted(found, key=lambda x: x[:3]) == expected


#: Names that operators use themselves, some in another spelling.
CLASHING = "doc_id long, text string, _mark string, _KEPT string, _bad string, _kept_id long, _own_sha string, _bad_id long, _id long, _text string, _sha string, __mark string"


def test_filtering_stages_keep_columns_of_any_name(spark):
    docs = rows(spark, [(1, "Same text"), (2, "same text"), (3, "item words here"), (None, "alone")], CLASHING)
    items = spark.createDataFrame([(1, "item words here")], "item_id long, text string")
    for found, ids in ((op08_exact_dedup.drop_copies(docs), {2, 3, None}), (op07_near_dedup.drop_near_copies(docs), {1, 3, None}), (op06_decontaminate.drop_contaminated(docs, items), {1, 2, None})):
        assert found.columns == docs.columns
        assert {r.doc_id for r in found.collect()} == ids


def test_pii(docs, none):
    found = op02_pii.redact(docs).collect()
    expected = []
    for i, t in DOCS:
        n, sha = brute.pii(t)
        expected.append((i, n["email"], n["ip"], n["card"], n["phone"], sha))
    same((tuple(r)[:6] for r in found), expected)
    spans = {r.doc_id: r.spans for r in found}
    assert "secret:" in spans[401] and spans[1] == "" and spans[402].startswith("email:")
    assert op02_pii.redact(none).count() == 0


def test_pii_long_runs_take_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 300_000, "+1" + "(" * 300_000, "a.b@" * 50_000, "- " * 100_000]
    docs = rows(spark, list(enumerate(texts)))
    same((tuple(r)[:6] for r in op02_pii.redact(docs).collect()), ((i, *n.values(), sha) for i, (n, sha) in enumerate(brute.pii(t) if i != 1 else ({"email": 0, "ip": 0, "card": 0, "phone": 0}, brute.sha("")) for i, t in enumerate(texts))))


def test_pii_of_very_many_matches_in_one_text(spark):
    n = 200_000
    text = "1.2.3.4 555-12-3456 " * n
    found = op02_pii.redact(rows(spark, [(1, text)])).collect()[0]
    assert found.n_ip == n and found.spans.count("identity:") == n and f"identity:{20 * n - 12}:{20 * n - 1}" in found.spans


def test_pii_spans_are_those_of_plain_votes(spark):
    """Added spans: the wide pattern's matches that touch no base span and that a plain chain of votes, estimate and naive Bayes finds likelier than not."""
    r = random.Random(9)
    word = lambda: r.choice(["order", "token", "call", "the", "ssn", "iban", "é", "sha"])
    token = lambda: "".join(r.choice("abcdefABCDEF0123456789") for _ in range(r.choice([20, 32, 40])))
    value = lambda: r.choice([token, lambda: "x" * 25, lambda: f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", lambda: f"({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", lambda: "jo at mail dot com", lambda: "DE44 5001 0517 5407 3249 31", lambda: "1.2.3.4", lambda: "a@b.co"])()
    docs = [(i, " ".join(x for _ in range(6) for x in (word(), word(), value()))) for i in range(200)]
    found = {d.doc_id: d for d in op02_pii.find_pii(rows(spark, docs)).collect()}
    combos, of = {}, {}
    for i, t in docs:
        base = [(x.kind, x.s, x.e) for x in found[i].base]
        of[i] = [c for c in brute.pii_candidates(t) if not any(a < c["e"] and c["s"] < z for _, a, z in base)]
        for c in of[i]:
            f = tuple(c[n] for n in op02_pii.FEATURES)
            combos[f] = combos.get(f, 0) + 1
    likelier = brute.naive_bayes(combos, op02_pii.estimate, len(op02_pii.LABELERS))
    added = 0
    for i, _ in docs:
        base = [(x.kind, x.s, x.e) for x in found[i].base]
        own = [(c["kind"], c["s"], c["e"]) for c in of[i] if likelier(tuple(c[n] for n in op02_pii.FEATURES))]
        added += len(own)
        expected = sorted(base + own, key=lambda x: (op02_pii.KINDS.index(x[0]), x[1]))
        assert [(x.kind, x.s, x.e) for x in found[i].spans] == expected
    assert 0 < added < sum(combos.values())


def test_pii_estimates():
    patterns = {("secret", 1, 1, 1, -1, 1): 40, ("secret", -1, -1, -1, -1, 0): 400, ("secret", 1, -1, 1, -1, 1): 30, ("secret", -1, -1, -1, 0, 0): 20}
    found = op02_pii.estimate(patterns)
    assert found["secret", 1, 1, 1, -1, 1] > 0.9 > 0.1 > found["secret", -1, -1, -1, -1, 0]
    assert op02_pii.classifier({}) is None


def test_lm_base_counts(docs, none):
    found = op03_lm_score.scores(docs).collect()
    expected = brute.unigram(DOCS)
    same((tuple(r)[:5] for r in found), (x[:5] for x in expected))
    assert sorted(round(r.base_score, 6) for r in found) == sorted(round(x[5], 6) for x in expected)
    assert all(r.score < 0 and np.isfinite(r.score) for r in found)
    assert op03_lm_score.scores(none).count() == 0


def test_lm_scores(docs):
    found = sorted(((brute.order(r.doc_id), r.score) for r in op03_lm_score.scores(docs).collect()))
    expected = sorted((brute.order(i), s) for i, s in brute.interpolated(DOCS))
    assert [i for i, _ in found] == [i for i, _ in expected]
    assert np.allclose([s for _, s in found], [s for _, s in expected], rtol=1e-6, atol=1e-6)


def test_lm_interpolation_is_a_distribution(spark):
    """The probabilities of all continuations of a context sum to one, unknown words being one more."""
    texts = ["a b a c", "b a b b", "c a a", "a b c a b", "b c"] * 8
    docs = [(i, t) for i, t in enumerate(texts)]
    train = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 7 != 2]
    found = {r.doc_id: r.score for r in op03_lm_score.scores(rows(spark, docs)).collect()}
    assert all(abs(found[i] - found[j]) < 1e-9 for i, a in docs for j, b in docs if a == b)
    assert len(train) < len(docs)
    total = 0.0
    for word in ("a", "b", "c", "", "never"):
        extra = [(1_000_000 + k, word) for k in range(40) if zlib.crc32(str(1_000_000 + k).encode()) % 7 == 2][:1]
        probe = {r.doc_id: r.score for r in op03_lm_score.scores(rows(spark, docs + extra)).collect()}[extra[0][0]]
        assert probe < 0
        total += 10**probe
    assert total < 1


def test_lm_weights():
    table = {(3 * 130 + 40) * 130 + 90: 100, (3 * 130 + 40) * 130 + 0: 5, (0 * 130 + 30) * 130 + 0: 50}
    w = op03_lm_score.learn_weights(table)
    assert np.allclose(w.sum(1), 1) and w[3, 2] > 0.8 and w[0, 2] < 1e-3


def test_quality_accuracy_on_held_out_rows(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    scored = op04_quality.scored(docs, labels).withColumnRenamed("_id", "doc_id").join(labels, "doc_id").filter(op04_quality.held_out("doc_id"))
    found = [(r.score >= 0.5, r.quality == 1) for r in scored.collect()]
    assert len(found) > 100 and sum(a == b for a, b in found) / len(found) > 0.95


def test_quality_on_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(10, 40)] + [(10, None, 0), (None, 1, 0), (999_999, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    found = op04_quality.scored(docs, labels).collect()
    assert len(found) == len(DOCS) and all(0 <= r.score <= 1 for r in found)
    empty = labels.limit(0)
    assert {r.score for r in op04_quality.scored(docs, empty).collect()} == {0.5}
    assert op04_quality.scored(none, labels).count() == 0
    assert op04_quality.keep_good(docs, labels).columns == docs.columns


def test_quality_log_odds_are_gaussian_log_densities():
    r = np.random.default_rng(1)
    x = r.normal(size=(5, op04_quality.D))
    a = r.normal(size=(op04_quality.D, op04_quality.D))
    cov = [a @ a.T + np.eye(op04_quality.D), 2 * np.eye(op04_quality.D)]
    mean = r.normal(size=(2, op04_quality.D))
    model = {"prior": 0.3, "mean": mean, "scale": np.ones(op04_quality.D), "inverse": [np.linalg.inv(np.linalg.cholesky(c)) for c in cov], "log_det": [np.linalg.slogdet(c)[1] for c in cov]}
    density = [-0.5 * (np.einsum("ij,jk,ik->i", x - mean[k], np.linalg.inv(cov[k]), x - mean[k]) + np.linalg.slogdet(cov[k])[1]) for k in (0, 1)]
    assert np.allclose(op04_quality.log_odds(x, model), density[1] - density[0] + np.log(0.3 / 0.7))


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_packing(docs, none):
    t = tokenizer()
    expected = []
    for i, text in DOCS:
        ids, start = t.encode(text or "", add_special_tokens=False).ids + [1], 0
        for size in op05_packing.piece_lengths(len(ids)):
            own = np.array(ids[start : start + size], dtype="<u4").tobytes()
            expected.append((i, start, size, zlib.crc32(own), len(ids), own))
            start += size
        assert start == len(ids)
    found = op05_packing.pieces(docs).collect()
    same(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in found), expected)
    assert len({r.sequence_id for r in found}) == len(found) and {r.offset for r in found} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 2048 for r in found)
    assert op05_packing.pieces(none).count() == 0


def test_packing_tokens_of_random_strings():
    r = random.Random(3)
    bits = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", "a", "s", "é", "1", "½", ",", ".", "!", "中", " ", "it", "re", "\x85", "<|endoftext|>", "\r\n", "Z", "_", "😀", "ª", "\x1c"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(4000)] + [None, ""]
    ids, at = op05_packing.encode(pa.array(texts))
    for i, e in enumerate(tokenizer().encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == [*e.ids, 1], texts[i]


def test_packing_long_texts_by_slices(monkeypatch):
    monkeypatch.setattr(op05_packing, "SLICE_BYTES", 40)
    r = random.Random(4)
    bits = ["'s", "'", " ", " ", "  ", "\n", "\t", "a", "words", "é", "12", ",", ".", "中", "\xa0", "it", "\x85", "\r\n", "😀"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 400))) for _ in range(300)] + ["x" * 500, " " * 500, "中" * 200, "", None]
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        cut = op05_packing.slices(data, 40)
        assert [*(a for a, _ in cut), len(data)] == [0, *(z for _, z in cut)]
        ids, at = op05_packing.encode_long(pa.array([text], pa.string()))
        assert ids.tolist() == [*tokenizer().encode(text or "", add_special_tokens=False).ids, 1] and at.tolist() == [0, len(ids)], text


def test_decontamination(spark, docs, none):
    text = dict(DOCS)
    items = [(1, " ".join(text[100].split()[20:50])), (2, "one two"), (2, "one two"), (3, None), (4, "!!"), (5, "words that occur nowhere at all in any of these documents here"), (None, "aaa aaa"), (11, " ".join(text[9].split()[500:515])), (12, text[20])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = op06_decontaminate.contamination(docs, benchmark)
    same((tuple(r)[:6] for r in found.collect()), brute.contaminated(DOCS, items))
    bad = {x[0] for x in brute.contaminated(DOCS, items) if x[5]}
    clean = op06_decontaminate.drop_contaminated(docs, benchmark)
    assert clean.columns == docs.columns
    same(((r.doc_id,) for r in clean.collect()), ((i,) for i, _ in DOCS if i not in bad))
    assert op06_decontaminate.contamination(none, benchmark).count() == 0
    assert op06_decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0


def test_decontamination_without_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(op06_decontaminate, "BROADCAST_BYTES", -1)
    items = [(1, " ".join(dict(DOCS)[100].split()[20:50])), (2, "one two")]
    found = op06_decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    same((tuple(r)[:6] for r in found.collect()), brute.contaminated(DOCS, items))


def test_near_dedup(docs, none):
    named = [(i, t) for i, t in DOCS if i is not None]
    expected = dict(zip((i for i, _ in named), brute.near_classes(named), strict=True))
    found = op07_near_dedup.near_groups(docs).collect()
    assert len(found) == len(DOCS)
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == expected
    kept = [r.doc_id for r in found if r.kept]
    assert sorted(x for x in kept if x is not None) == sorted(set(expected.values()))
    assert op07_near_dedup.near_groups(none).count() == 0
    assert op07_near_dedup.drop_near_copies(docs).columns == docs.columns


#: Null and repeated identifiers of different texts: 0-2 near copies, 3 and 4 alone; 5 and 6 near copies under one identifier; 7 a copy of 3.
_LONG = [f"u{i}" for i in range(80)]
UNNAMED = [
    (None, " ".join(_LONG)), (None, " ".join([*_LONG[:-1], "other"])), (None, " ".join(["first", *_LONG[1:]])), (None, "one text of its own without a name"), (None, "another text that has no name either"),
    (70, " ".join(w + "v" for w in _LONG)), (70, " ".join([w + "v" for w in _LONG[:-1]] + ["other"])), (None, "one text of its own without a name"), (70, "quite another text under the same number"), (71, " ".join([*_LONG[:40], "put", *_LONG[40:]])),
]


def test_near_dedup_of_a_line_repeated_many_times(spark):
    """The sets are close while the counted shingles aren't: probability Jaccard far below the threshold."""
    line = "over and over this line again"
    docs = []
    for k in range(6):
        base = " ".join(f"r{k}x{j}" for j in range(80))
        docs += [(2 * k, f"{base} {line}"), (2 * k + 1, base + f" {line}" * 60)]
    x, y = (op07_near_dedup.shingles(*W.text_view(pa.array([t])))[1:] for _, t in docs[:2])
    prob, jac = op07_near_dedup.similarity(x, y)
    assert jac >= 0.8 and prob < 0.3
    expected = brute.near_classes(docs)
    assert expected == [i - i % 2 for i, _ in docs]
    found = {r.doc_id: r.class_id for r in op07_near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [found[i] for i, _ in docs] == expected


def test_near_dedup_of_null_and_repeated_identifiers(spark):
    """One row is kept of each class that the plain version finds on numbered rows."""
    docs = rows(spark, UNNAMED)
    classes = {}
    for number, c in enumerate(brute.near_classes([(n, t) for n, (_, t) in enumerate(UNNAMED)])):
        classes.setdefault(c, []).append(UNNAMED[number])
    assert len(classes) == 5
    found = op07_near_dedup.near_groups(docs).collect()
    least = {d: min((i for i, _ in own), key=brute.order) for own in classes.values() for d in own}
    same(((r.doc_id, r.class_id) for r in found), ((i, least[i, t]) for i, t in UNNAMED))
    kept = [(r.doc_id, r.text) for r in op07_near_dedup.drop_near_copies(docs).collect()]
    assert len(kept) == sum(r.kept for r in found) == len(classes)
    for own in classes.values():
        assert [d[0] for d in kept if d in own] == [min((i for i, _ in own), key=brute.order)]


def test_decontamination_of_null_and_repeated_identifiers(spark):
    items = [(1, "one text of its own without a name"), (2, " ".join(w + "v" for w in _LONG[-10:]))]
    bad = [x[5] for x in brute.contaminated(UNNAMED, items)]
    clean = op06_decontaminate.drop_contaminated(rows(spark, UNNAMED), spark.createDataFrame(items, "item_id long, text string"))
    same(((r.doc_id, r.text) for r in clean.collect()), (d for d, b in zip(UNNAMED, bad, strict=True) if not b))


def test_near_dedup_of_chains(spark):
    """Texts each close to the next only."""
    words = [f"c{j}" for j in range(100)]
    docs = []
    for i in range(10):
        own = list(words)
        own[: 2 * i] = [f"n{j}" for j in range(2 * i)]
        docs.append((i * 17 % 101, " ".join(own)))
    expected = dict(zip((i for i, _ in docs), brute.near_classes(docs), strict=True))
    assert {r.doc_id: r.class_id for r in op07_near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == expected


def test_near_dedup_of_a_cloud_in_several_waves(spark, monkeypatch):
    """One large group whose members are within the threshold of some others only, beside texts that share a repeated line."""
    monkeypatch.setattr(op07_near_dedup, "GROWTH", 2)
    r = random.Random(4)
    base = [f"b{j}" for j in range(90)]
    docs = []
    for i in range(120):
        own = list(base)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        if i % 3 == 0:
            a = r.randrange(60)
            del own[a : a + r.randint(0, 30)]
        if i % 10 == 0:
            own += "and again the same six words".split() * r.randint(5, 60)
        docs.append((i * 37 % 1009, " ".join(own)))
    expected = dict(zip((i for i, _ in docs), brute.near_classes(docs), strict=True))
    assert 1 < len(set(expected.values())) < len(docs)
    assert {r.doc_id: r.class_id for r in op07_near_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == expected


def test_prob_minhash_estimates_similarity():
    a = " ".join(f"w{i}" for i in range(300))
    b = " ".join(f"w{i}" for i in range(60, 360))
    data, at = W.text_view(pa.array([a, b]))
    signature, some = op07_near_dedup.signatures(data, at, 2048)
    x, y = (op07_near_dedup.shingles(*W.text_view(pa.array([t])))[1:] for t in (a, b))
    prob, jac = op07_near_dedup.similarity(x, y)
    assert some.all() and abs(prob - jac) < 1e-12 and abs((signature[0] == signature[1]).mean() - prob) < 0.04


def test_probability_similarity_of_weights():
    x, y = (np.array([1, 2, 3], np.uint64), np.array([4, 1, 1])), (np.array([2, 3, 5], np.uint64), np.array([2, 1, 3]))
    p = {1: 4 / 6, 2: 1 / 6, 3: 1 / 6}
    q = {2: 2 / 6, 3: 1 / 6, 5: 3 / 6}
    direct = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in {*p, *q}) for i in p.keys() & q.keys())
    assert abs(op07_near_dedup.similarity(x, y)[0] - direct) < 1e-12


def test_substring_dedup(docs, none):
    same(op10_substring_dedup.remove_repeats(docs, with_text=False).collect(), brute.substrings(DOCS))
    assert op10_substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_random_repeats(spark):
    r = random.Random(5)
    for trial in range(3):
        letters = [f"t{i}" for i in range(2 + trial)]
        pieces = [[r.choice(letters) for _ in range(r.randint(1, 40))] for _ in range(6)]
        docs = [(i, " ".join(w for _ in range(r.randint(0, 6)) for w in r.choice(pieces))) for i in range(40)]
        same(op10_substring_dedup.remove_repeats(rows(spark, docs), with_text=False).collect(), brute.substrings(docs))


def test_line_dedup(docs, none):
    found = op01_line_dedup.remove_repeated_lines(docs, with_text=False).collect()
    same(found, brute.lines(DOCS))
    assert sum(r.n_removed for r in found) > 0
    assert op01_line_dedup.remove_repeated_lines(none).count() == 0


def test_line_chunks_are_those_of_the_plain_version():
    r = random.Random(2)
    texts = ["\n".join(f"l{r.randrange(30)}é" * r.randint(0, 3) for _ in range(r.randint(1, 60))) for _ in range(50)]
    for t in texts:
        assert [(a, a + n) for _, a, n, *_ in zip(*op01_line_dedup.line_chunks(*W.text_view(pa.array([t]))), strict=True)] == brute.line_chunks(t)


def test_line_dedup_of_shared_blocks(spark):
    """Of the lines of a block in four documents with other lines around, the share that goes from the later three."""
    r = random.Random(5)
    line = lambda: " ".join(r.choice("abcdefghij") * r.randint(1, 8) + str(r.randrange(10**6)) for _ in range(4))
    docs, of = [], {}
    for size in (10, 20, 50):
        for k in range(60):
            block = [line() for _ in range(size)]
            for c in range(4):
                of[len(docs)] = size, c
                docs.append((len(docs), "\n".join([*(line() for _ in range(r.randint(0, 15))), *block, *(line() for _ in range(r.randint(0, 15)))])))
    found = {x.doc_id: x.n_removed for x in op01_line_dedup.remove_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string"), with_text=False).collect()}
    assert all(found[i] <= (of[i][0] if of[i][1] else 0) for i in of)
    for size in (10, 20, 50):
        recall = sum(found[i] for i in of if of[i][0] == size and of[i][1]) / (60 * 3 * size)
        print(size, recall)
        assert recall >= 0.9


def test_line_dedup_removes_all_of_a_copy(spark):
    """Cuts that follow each other leave no single lines, which would stay in every copy."""
    docs = [(100 * c + i, "\n".join(f"text {i} line {k}" for k in range(40 + i))) for c in range(2) for i in range(10)]
    sizes = [n for _, t in docs for n in op01_line_dedup.line_chunks(*W.text_view(pa.array([t])))[2].tolist()]
    assert min(sizes) >= op01_line_dedup.MIN_LINES and sum(sizes) == sum(t.count("\n") + 1 for _, t in docs)
    found = {r.doc_id: (r.n_lines, r.n_removed) for r in op01_line_dedup.remove_repeated_lines(rows(spark, docs), with_text=False).collect()}
    assert found == {i: (t.count("\n") + 1, t.count("\n") + 1 if i >= 100 else 0) for i, t in docs}


def test_line_chunks_resist_shifts():
    lines = [f"line {i * i % 37} of text" for i in range(60)]
    cut = lambda own: {tuple(own[a : a + n]) for _, a, n, *_ in zip(*op01_line_dedup.line_chunks(*W.text_view(pa.array(["\n".join(own)]))), strict=True)}
    assert len(cut(lines) & cut(["new first line", *lines])) >= len(cut(lines)) - 2


def test_warc(spark, none):
    big = "<html>" + "é" * 700
    pages = [(1, "http://a/ b", big), (2, "http://a/2", big), (3, None, "small"), (4, "http://a/4", "small"), (5, "u", None), (None, "u", big), (2, "http://a/2", big), (6, "u\r\nX: y", "x" * 3_000_000), (7, "u", "WARC/1.1\r\n\r\n" * 100), (8, "u", "a" * 1000), (9, "u", "a" * 1000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, _sha int").repartition(2)
    found = [tuple(r) for r in op09_warc.round_trip(df, spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    import hashlib

    groups = {}
    for i, _, h in pages:
        groups.setdefault(h or "", []).append(i)
    expected = []
    for h, ids in groups.items():
        raw = h.encode()
        first, used = max(ids, key=brute.order), False
        for i in ids:
            response = len(raw) < 1000 or i == first and not used
            used = used or i == first and response
            expected.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if response else "revisit", None if response else first))
    same(found, expected)
    assert op09_warc.round_trip(df.limit(0), spark).count() == 0


def test_warc_ranges_of_any_size(spark, tmp_path):
    """Every record is read once, however the ranges cut the archive, and payloads come back whole."""
    r = random.Random(2)
    payloads = ["".join(chr(r.randint(32, 900)) for _ in range(r.randint(0, 3000))) for _ in range(30)]
    df = spark.createDataFrame([(i, f"u{i}", p) for i, p in enumerate(payloads)], "page_id long, url string, html string").coalesce(1)
    archives = op09_warc.write_archives(op09_warc.record_types(df), f"file://{tmp_path}/w")
    for size in (64, 1000, 1 << 20):
        found = {x.page_id: x for x in op09_warc.read_archives(archives, size).collect()}
        assert {i: bytes(x.payload).decode() for i, x in found.items()} == dict(enumerate(payloads))


def test_warc_damage_is_an_error():
    """Each single flipped byte and each place of truncation gives an error for some range, or all records."""
    import io

    members = [op09_warc.encode_record(i, f"http://x/{i}", bytes([65 + i]) * 3000 + str(i * i).encode() * 20, "response", None) for i in range(5)]
    raw = b"".join(members)
    ranges = [(a, min(a + 300, len(raw))) for a in range(0, len(raw), 300)]
    read = lambda data: [x for a, z in ranges for x in op09_warc.scan_range(io.BytesIO(data), a, z)]
    whole = read(raw)
    assert len(whole) == 5
    r = random.Random(1)
    failed = 0
    for k in r.sample(range(len(raw)), 150):
        bad = bytearray(raw)
        bad[k] ^= 1 << r.randrange(8)
        try:
            assert read(bytes(bad)) == whole  # a field of the gzip head that says nothing about the data
        except op09_warc.DamagedArchive:
            failed += 1
    assert failed > 100
    cuts = {0, *np.cumsum([len(m) for m in members]).tolist()}
    for k in r.sample(range(len(raw)), 100):
        if k not in cuts:
            with pytest.raises(op09_warc.DamagedArchive):
                read(raw[:k])
    with pytest.raises(op09_warc.DamagedArchive):
        read(members[0] + b"junk" + members[1])


def test_lm_counts_beyond_32_bits():
    keys = np.array([1, 2, 1, 3], np.uint64)
    columns = [np.array([0xFFFFFFFF, 5, 7, 1], np.uint32), np.array([0xFFFFFFFF, 0, 2, 1], np.uint32)]
    answers, sums = op03_lm_score._total(0, keys, columns, [0, 2, 4])
    raw = [len(a).to_bytes(4, "little") + pa.compress(a.tobytes(), codec="zstd", asbytes=True) for a in answers]
    assert [x.tolist() for x in op03_lm_score._split(raw[:1])] == [[0xFFFFFFFF + 7, 5], [0xFFFFFFFF + 2, 0]]
    assert [x.tolist() for x in op03_lm_score._split(raw)] == [[0xFFFFFFFF + 7, 5, 0xFFFFFFFF + 7, 1], [0xFFFFFFFF + 2, 0, 0xFFFFFFFF + 2, 1]]
    assert sums[1] == 0xFFFFFFFF + 13


def test_warc_archives_are_plain_gzip(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string")
    path = op09_warc.write_archives(op09_warc.record_types(df), f"file://{tmp_path}/w").first().path.removeprefix("file://")
    text = gzip.open(path).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"hello\r\n\r\n")
