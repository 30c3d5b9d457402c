"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each whole text gives a vector of statistics (shares of character classes, word and line repetition, compressibility),
transformed towards normal. Labelled training rows give, per class, the number of rows, the sum and the sum of outer
products, added up in Spark, so that training needs one small row per task and never the rows themselves. A class
covariance is shrunk twice, towards the pooled covariance and towards a scaled identity. The score is the logistic of
the log-density difference plus the log prior ratio; Mahalanobis terms use Cholesky factors that are computed once on
the driver and are of fixed size.

Defined results: null text is empty; an empty text has a score like any other. Label rows with a null quality, or whose
document is missing, are left out; a document with several label rows counts once for each. Without training rows of
both classes every score is the prior (0.5 without any). Repeated rows are scored each. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import words as W
from .shared import fresh, saved

FEATURES = [
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "punct", "symbol", "space", "non_ascii", "capitalised", "all_caps",
    "distinct_words", "top_word", "distinct_pairs", "distinct_lines", "mean_line", "symbol_ended", "deflate", "stopped",
]
D = len(FEATURES)
#: Weights of the pooled covariance and of the scaled identity.
TO_POOLED, TO_IDENTITY = 0.2, 0.05
#: The text that deflate sees at once; a long text is the mean over all its blocks.
BLOCK = 1 << 16

_SYMBOLS = W.byte_table((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x40, 0x40), (0x5C, 0x5C), (0x5E, 0x60), (0x7B, 0x7E))
_PUNCT = W.byte_table((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
_NEWLINE = W.byte_table((0x0A, 0x0A))


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags within each text."""
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _distinct(values: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and the count of its most frequent one."""
    if not len(values):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((values, text_of))
    v, t = values[order], text_of[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    runs = np.flatnonzero(new)
    length = np.diff(np.append(runs, len(v)))
    most = np.zeros(n)
    np.maximum.at(most, t[runs], length)
    return np.bincount(t[runs], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; all are finite."""
    data, at = W.text_view(texts)
    n = len(at) - 1
    size = np.diff(at).astype(float)
    per = np.maximum(size, 1)
    starts, ends, text_of = W.spans(data, at, W.WHITE)
    word_at = W.bounds(text_of, n)
    n_words = np.diff(word_at).astype(float)
    words = np.maximum(n_words, 1)
    long = (ends - starts).astype(float)
    hashed = W.word_hashes(data, starts, ends)
    line_start, line_end, line_of = W.spans(data, at, _NEWLINE)
    n_lines = np.bincount(line_of, minlength=n).astype(float)
    kinds = {k: _sums(t[data], at) / per for k, t in (("upper", W.byte_table((0x41, 0x5A))), ("digit", W.byte_table((0x30, 0x39))), ("punct", _PUNCT), ("symbol", _SYMBOLS), ("space", W.WHITE), ("non_ascii", W.byte_table((0x80, 0xFF))))}
    mean = _sums(long, word_at) / words
    first_upper = W.byte_table((0x41, 0x5A))[data[starts]]
    second = np.where(ends - starts > 1, data[np.minimum(starts + 1, max(len(data) - 1, 0))] if len(data) else 0, 0) if len(starts) else np.zeros(0, np.uint8)
    distinct, most = _distinct(hashed, text_of, n)
    pairs, inside = W.gram_hashes(hashed, 2), W.whole_grams(text_of, 2)
    distinct_pairs, _ = _distinct(pairs[inside], text_of[:-1][inside] if len(text_of) else text_of, n)
    distinct_lines, _ = _distinct(W.word_hashes(data, line_start, line_end), line_of, n)
    deflate = np.zeros(n)
    raw = data.tobytes()
    for i in range(n):
        a, b = int(at[i]), int(at[i + 1])
        deflate[i] = sum(len(zlib.compress(raw[x : min(x + BLOCK, b)], 1)) for x in range(a, b, BLOCK)) / max(b - a, 1)
    stop = W.byte_table((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))
    root = np.sqrt
    return np.column_stack(
        [
            np.log1p(size), np.log1p(n_words), np.log1p(mean), np.log1p(root(np.maximum(_sums(long**2, word_at) / words - mean**2, 0))),
            root(kinds["upper"]), root(kinds["digit"]), root(kinds["punct"]), root(kinds["symbol"]), root(kinds["space"]), root(kinds["non_ascii"]),
            root(_sums(first_upper, word_at) / words), root(_sums(first_upper & W.byte_table((0x41, 0x5A))[second], word_at) / words),
            distinct / words, root(most / words), distinct_pairs / np.maximum(n_words - 1, 1), distinct_lines / np.maximum(n_lines, 1),
            np.log1p(size / np.maximum(n_lines, 1)), root(_sums(_SYMBOLS[data[ends - 1]] if len(ends) else np.zeros(0), word_at) / words), np.minimum(deflate, 2),
            root(_sums(stop[data[line_end - 1]] if len(line_end) else np.zeros(0), W.bounds(line_of, n)) / np.maximum(n_lines, 1)),
        ]
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and x, the vector of statistics as little-endian doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, "_text"):
            x = statistics(b.column(1)).astype("<f8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["_id", "x"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return own.mapInArrow(run, "_id long, x binary")


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train(found: DataFrame, labels: DataFrame) -> dict | None:
    """Fit on every labelled row that isn't held out. found: features()."""
    usable = labels.select(F.col("doc_id").alias("_label_id"), F.col("quality").alias("_label")).filter("_label in (0, 1)").filter(~held_out("_label_id"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + D + D * D))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.frombuffer(b"".join(b.column(0).to_pylist()), "<f8").reshape(-1, D)
            y = b.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["k", "m"])

    joined = found.join(usable, F.col("_id") == F.col("_label_id")).select("x", F.col("_label").cast("int").alias("_label"))
    summed = joined.mapInArrow(moments, "k int, m array<double>").select("k", F.posexplode("m").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + D + D * D))
    for row in summed.collect():  # 2 * (1 + D + D * D) rows, whatever the input
        total[row.k, row.i] = row.v
    n = total[:, 0]
    if n.sum() == 0:
        return None
    prior = float(n[1] / n.sum())
    if min(n) < 2:
        return {"prior": min(max(prior, 1e-6), 1 - 1e-6)}
    mean = total[:, 1 : 1 + D] / n[:, None]
    scatter = [total[k, 1 + D :].reshape(D, D) - n[k] * np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    model = {"prior": prior, "mean": mean / scale, "scale": scale, "inverse": [], "log_det": []}
    for k in (0, 1):
        own = (1 - TO_POOLED) * scatter[k] / n[k] + TO_POOLED * pooled
        own = own / np.outer(scale, scale)
        own = (1 - TO_IDENTITY) * own + TO_IDENTITY * (np.trace(own) / D + 1e-6) * np.eye(D)
        factor = np.linalg.cholesky(own)
        model["inverse"].append(np.linalg.inv(factor))
        model["log_det"].append(2 * np.log(np.diag(factor)).sum())
    return model


def log_odds(x: np.ndarray, model: dict | None) -> np.ndarray:
    if model is None:
        return np.zeros(len(x))
    out = np.full(len(x), np.log(model["prior"] / (1 - model["prior"])))
    for k, sign in ((0, -1), (1, 1)) if "mean" in model else ():
        z = (x / model["scale"] - model["mean"][k]) @ model["inverse"][k].T
        out += sign * -0.5 * ((z * z).sum(1) + model["log_det"][k])
    return out


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and score for each row."""
    found = saved(features(docs, id_col, text_col), "quality")
    model = train(found, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column(1).to_pylist()), "<f8").reshape(-1, D)
                score = 1 / (1 + np.exp(-np.clip(log_odds(x, model), -700, 700)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["_id", "score"])

    return found.mapInArrow(run, "_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with a score of at least one half, with all their columns, whatever their names. A row's score
    depends on its text only, so null and repeated identifiers aren't mixed up. The rows are stored with their statistics,
    which are computed once. An empty table gives an empty result."""
    x = fresh(docs, "_x")
    names = docs.columns
    place = names.index(text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.pieces(batches, text_col):
            found = statistics(b.column(place)).astype("<f8")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in found], pa.binary())], [*names, x])

    stored = saved(docs.mapInArrow(measure, StructType([*docs.schema.fields, StructField(x, BinaryType())])), "measured")
    model = train(stored.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(x).alias("x")), labels)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = np.frombuffer(b"".join(b.column(len(names)).to_pylist()), "<f8").reshape(-1, D)
                yield b.select(list(range(len(names)))).filter(pa.array(log_odds(found, model) >= 0))

    return stored.mapInArrow(good, docs.schema)
