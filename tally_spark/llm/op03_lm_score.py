"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

Training documents are those whose crc32(id as text) mod 7 isn't HELD_OUT. Of them, those with remainder DELETED are set
aside while the mixture weights are learned: maximum-likelihood estimates come from the others' counts, contexts are put
in buckets by the logarithm of their count, and expectation-maximisation finds, for each bucket, the three weights that
make the deleted counts likeliest. The final model takes its counts from all training documents and the weights by bucket.

Counts are global: each chunk of documents sends its distinct words and word pairs with their counts through the exchange
of chunks.py and gets back the corpus' counts in the same order. Expectation-maximisation needs only how often each
combination of bucket and probability ratios occurs; ratios are put on a grid of half powers of two with fixed ends, so
that table is of bounded size whatever the corpus. Words and pairs are told apart by 64-bit hashes.

Defined results: null or empty text is the end token alone. A null identifier counts as training. Without training
documents, counts are 0 and all words equally likely. Repeated rows count and are scored each. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from . import words as W
from .shared import saved

MODULUS, HELD_OUT, DELETED = 7, 2, 3
END, START = np.uint64(0x5BD1E995A1B2C3D5), np.uint64(0x2545F4914F6CDD1D)
#: Buckets of context counts (powers of two), and the grid of log2 ratios to the uniform estimate: half steps from LOW on, 0 for none.
BUCKETS, LOW, LEVELS = 16, -12.0, 130
ROUNDS = 100
#: Rows of all buckets' weights that a bucket starts with, and the least weight.
PRIOR_ROWS, LEAST = 20.0, 1e-5
CHUNK_BYTES = 4 << 20


def remainder(doc_id: int | None) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % MODULUS


class _Tokens:
    """A chunk's tokens: hash, document, and the distinct tokens and pairs."""

    def __init__(self, chunk: C.Chunk) -> None:
        hashes, owner = [], []
        for first, data, at in chunk.slices():
            low = W.LOWERED[data]
            starts, ends, text_of = W.spans(low, at, W.WHITE)
            hashes.append(W.word_hashes(low, starts, ends))
            owner.append(text_of + first)
        word, text_of = np.concatenate(hashes), np.concatenate(owner)
        n = len(chunk)
        self.token = np.full(len(word) + n, END)
        self.token[np.arange(len(word)) + text_of] = word
        self.length = np.bincount(text_of, minlength=n) + 1
        self.at = np.concatenate([[0], np.cumsum(self.length)])
        self.doc = np.repeat(np.arange(n), self.length)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.at[:-1]] = START
        self.words, self.word = np.unique(self.token, return_inverse=True)
        self.pairs, self.pair = np.unique(W.mix(before * np.uint64(W.BASE) + self.token), return_inverse=True)
        # the word before; a text's first token follows what stands for all starts, of which there are as many as ends
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.at[:-1]] = np.searchsorted(self.words, END)
        self.part = np.array([remainder(x) for x in chunk.ids.to_pylist()], dtype=np.int64)

    def counts(self, which: np.ndarray, n: int) -> list[np.ndarray]:
        """Counts in training documents, and in those that aren't deleted."""
        part = self.part[self.doc]
        train = part != HELD_OUT
        return [np.bincount(which[x], minlength=n).astype(np.uint32) for x in (train, train & (part != DELETED))]


def _send(chunk: C.Chunk, got: dict) -> Iterator[C.Sent]:
    t = _Tokens(chunk)
    yield 0, t.words, t.counts(t.word, len(t.words))
    yield 1, t.pairs, t.counts(t.pair, len(t.pairs))


def _total(kind: int, keys: np.ndarray, columns: list[np.ndarray], bounds: list[int]):
    """Both counts of each key over all chunks, in one number; distinct and all words."""
    order, runs, run = C.sorted_groups(keys)
    train, kept = (np.add.reduceat(c[order].astype(np.uint64), runs) for c in columns)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)

    def told(x: np.ndarray) -> np.ndarray:
        out = np.empty(len(keys), np.uint64)
        out[order] = x[run]
        return out

    # the upper halves are made and sent only where there are any; the last number says so
    out = told((train & low) | ((kept & low) << half))
    more = told((train >> half) | ((kept >> half) << half)) if len(train) and train.max() > low else None
    one = np.ones(1, np.uint64)
    answers = [np.concatenate([out[a:b], more[a:b], one] if more is not None and more[a:b].any() else [out[a:b], one - one]) for a, b in zip(bounds, bounds[1:], strict=False)]
    return answers, {0: int((train > 0).sum()), 1: int(train.sum()), 2: int((kept > 0).sum()), 3: int(kept.sum())}


def _split(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both counts of each key, of the answers of all ranges."""
    train, kept = [np.zeros(0)], [np.zeros(0)]
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for one in raw:
        both = C.unpack_answers([one], "<u8")
        n = (len(both) - 1) // (2 if both[-1] else 1)
        high = both[n : 2 * n] if both[-1] else np.zeros(n, np.uint64)
        for out, x, y in ((train, both[:n] & low, high & low), (kept, both[:n] >> half, high >> half)):
            out.append((x | (y << half)).astype(np.float64))
    return np.concatenate(train), np.concatenate(kept)


def _estimates(t: _Tokens, words: np.ndarray, pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram and bigram estimates of each token, and its context's bucket."""
    context = words[t.context]
    two = np.divide(pairs[t.pair], context, out=np.zeros(len(context)), where=context > 0)
    return words[t.word] / max(n, 1), np.minimum(two, 1), np.minimum(np.log2(context + 1).astype(np.int64), BUCKETS - 1)


def _level(p: np.ndarray, uniform: float) -> np.ndarray:
    seen = p > 0
    return np.where(seen, np.clip(np.rint((np.log2(np.where(seen, p, 1) / uniform) - LOW) * 2), 0, LEVELS - 2) + 1, 0).astype(np.int64)


def learn_weights(table: dict[int, int]) -> np.ndarray:
    """Weights of uniform, unigram and bigram by bucket. table: counts of (bucket * LEVELS + unigram's level) * LEVELS + bigram's level."""
    codes = np.array(sorted(table), dtype=np.int64)
    count = np.array([table[c] for c in codes.tolist()], dtype=float)
    two, one, bucket = codes % LEVELS, codes // LEVELS % LEVELS, codes // LEVELS**2
    ratio = lambda x: np.where(x > 0, 2.0 ** ((x - 1) / 2 + LOW), 0.0)
    p = np.column_stack([np.ones(len(codes)), ratio(one), ratio(two)])

    def fit(own: np.ndarray, n: np.ndarray, start: np.ndarray, rows: float) -> np.ndarray:
        w = start.copy()
        for _ in range(ROUNDS if len(n) else 0):
            share = own * w
            share /= share.sum(1, keepdims=True)
            w = (n @ share + rows * start) / (n.sum() + rows)
        w = np.maximum(w, LEAST)
        return w / w.sum()

    overall = fit(p, count, np.full(3, 1 / 3), 1.0)
    # a context that was never seen has no bigram estimate
    return np.array([fit(p[bucket == b], count[bucket == b], overall if b else np.array([0.5, 0.5, 0.0]), PRIOR_ROWS) for b in range(BUCKETS)])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    chunks = C.chunk_table(docs, id_col, text_col, CHUNK_BYTES)
    n = C.n_ranges(chunks, 12)
    answers = C.exchange(chunks, _send, _total, {0: ["<u4", "<u4"], 1: ["<u4", "<u4"]}, n, "counts")
    sums = answers.filter("kind = 0 AND sums IS NOT NULL").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(4)]).first()
    distinct, total, distinct_kept, total_kept = (int(x or 0) for x in sums)
    counted = C.with_answers(chunks, answers)
    uniform_kept, uniform = 1 / (distinct_kept + 1), 1 / (distinct + 1)

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, got in C.each_chunk(batch):
                t = _Tokens(chunk)
                own = t.part[t.doc] == DELETED
                one, two, bucket = _estimates(t, _split(got[0])[1], _split(got[1])[1], total_kept)
                code = (bucket * LEVELS + _level(one, uniform_kept)) * LEVELS + _level(two, uniform_kept)
                codes, count = np.unique(code[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(count, pa.int64())], ["code", "n"])

    # at most BUCKETS * LEVELS ** 2 rows
    histogram = saved(counted.mapInArrow(deleted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "histogram")
    table = {r.code: r.n for r in histogram.collect()}
    weights = learn_weights(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, got in C.each_chunk(batch):
                t = _Tokens(chunk)
                words, pairs = _split(got[0])[0], _split(got[1])[0]
                one, two, bucket = _estimates(t, words, pairs, total)
                w = weights[bucket]
                logs = np.log10(w[:, 0] * uniform + w[:, 1] * one + w[:, 2] * two)
                count = words[t.word]
                base = np.log10((count + 1) / (total + distinct + 1))
                add = lambda x: np.add.reduceat(x, t.at[:-1])
                k = len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [chunk.ids, pa.array(t.part == HELD_OUT), pa.array(t.length, pa.int64()), pa.array(add((count > 0).astype(np.int64)), pa.int64()), pa.array(np.full(k, total), pa.int64()), pa.array(add(base)), pa.array(add(logs))],
                    [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return counted.mapInArrow(score, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
