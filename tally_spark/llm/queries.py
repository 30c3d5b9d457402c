"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_line_dedup, op02_pii, op03_lm_score, op04_quality, op05_packing, op06_decontaminate, op07_near_dedup, op08_exact_dedup, op09_warc, op10_substring_dedup
from .shared import table


def op1_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_line_dedup.remove_repeated_lines(table(spark, sf_dir, "documents"), with_text=False)


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_pii.redact(table(spark, sf_dir, "documents"))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_lm_score.scores(table(spark, sf_dir, "documents"))


def op4_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = op04_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("_id").alias("doc_id"), op04_quality.held_out("_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_packing.pieces(table(spark, sf_dir, "documents"), with_ids=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_warc.round_trip(table(spark, sf_dir, "pages"), spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {f.__name__: f for f in (op1_line_chunk_dedup, op2_pii_spans, op3_deleted_interpolation, op4_quality_qda, op5_packing, op6_decontaminate, op7_probminhash, op8_exact_dedup, op9_warc_round_trip, op10_debruijn_dedup)}

_TEXTS = "SELECT doc_id, COALESCE(text, '') AS text, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded FROM documents"

ORACLES = {
    "op10_debruijn_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
     later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
     cut AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)""",
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS s, least(len(w), 10) AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     ks AS (SELECT DISTINCT k FROM bw),
     dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
     hits AS (SELECT doc_id, item_id, dw.i, dw.k FROM dw JOIN bw ON dw.s = bw.s AND dw.k = bw.k),
     marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
     found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256(folded) AS text_sha256 FROM ({_TEXTS})),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)""",
    "op9_warc_round_trip": """
WITH p AS (SELECT page_id, sha1(COALESCE(html, '')) AS payload_digest, CAST(octet_length(encode(COALESCE(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
     g AS (SELECT payload_digest, max(page_id) AS first_id FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN g ON p.payload_digest = g.payload_digest""",
}
