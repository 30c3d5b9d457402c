"""The stages of the pipeline, one after another, against a chain of plain versions."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
from test_operators import key, tokenizer

import corpus_pipeline
from tally_spark.llm import op04_quality, op05_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "se") for b in ("rin", "den", "var", "sol", "pet", "gan", "mor")]
    prose = lambda n: " ".join(r.choice(vocabulary).capitalize() if k % 12 == 0 else r.choice(vocabulary) + (".\n" if k % 12 == 11 else "") for k in range(n))
    junk = lambda n: " ".join(r.choice(["###", "$$", "{}", "<<>>", "9931", "CLICK", "||", "=="]) for _ in range(n))
    docs = [(i, prose(r.randint(60, 90))) for i in range(40)] + [(100 + i, junk(r.randint(20, 80))) for i in range(20)]
    labels = [(i, 1) for i in range(30)] + [(100 + i, 0) for i in range(15)]
    docs += [(200 + i, docs[i][1]) for i in range(4)]  # exact copies
    docs += [(300 + i, docs[i][1] + " end") for i in range(3, 8)]  # near copies
    docs += [(None, docs[8][1] + " end"), (None, prose(70)), (None, prose(75)), (7, prose(80)), (7, prose(65))]  # null and repeated identifiers
    items = [(1, " ".join(docs[10][1].split()[20:32])), (2, " ".join(docs[-4][1].split()[5:17])), (3, "words that are in none")]
    return docs, labels, items


def plain(docs, labels, items):
    """The rows after each stage but the last."""
    good = brute.accepted(docs, labels, lambda texts: op04_quality.statistics(pa.array(texts)))
    kept = {(x[0], x[4]) for x in brute.exact(good) if x[3]}
    single = [d for d in good if (d[0], brute.sha(d[1].translate(brute.LOW))) in kept]
    classes = {}
    for n, c in enumerate(brute.near_classes([(n, t) for n, (_, t) in enumerate(single)])):
        classes.setdefault(c, []).append(single[n])
    near = [min(own, key=lambda d: (brute.order(d[0]), hashlib.sha256(d[1].encode()).digest())) for own in classes.values()]
    clean = [d for d, x in zip(near, brute.contaminated(near, items), strict=True) if not x[5]]
    return {"quality": good, "exact": single, "near": near, "clean": clean}


def test_stages(spark, tmp_path):
    docs, labels, items = fixture()
    spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in docs], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    expected = plain(docs, labels, items)
    sizes = [len(docs), *map(len, expected.values())]
    assert all(a > b > 0 for a, b in zip(sizes, sizes[1:], strict=False))

    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, own, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        own = spark.read.parquet(f"{tmp_path}/{name}")
        assert own.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        assert sorted(((r.doc_id, r.text) for r in own.collect()), key=key) == sorted(expected[name], key=key), name

    t, pieces = tokenizer(), []
    for i, text in expected["clean"]:
        ids, start = t.encode(text, add_special_tokens=False).ids + [1], 0
        for size in op05_packing.piece_lengths(len(ids)):
            raw = np.array(ids[start : start + size], dtype="<u4").tobytes()
            pieces.append((i, start, size, zlib.crc32(raw), len(ids), raw))
            start += size
    found = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(found, key=key) == sorted(pieces, key=key)
