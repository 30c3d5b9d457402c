"""Substring deduplication by De Bruijn compaction of repeated word sequences.

A window of SPAN consecutive words is an edge of the De Bruijn graph between its first and last SPAN - 1 words. An edge
that occurs once is of no interest. To keep those out of the shuffle, each window names an anchor, the least hash of the
shorter sequences in it (equal windows name the same); only windows whose anchor occurs twice go on. For those, the edges
are counted, and for each repeated edge it is found whether all of its occurrences have the same next and the same
previous edge. Repeated edges on a nonbranching path occur always together, so a chunk joins its runs of them, cut at
branchings, to compacted paths; a path is one row with its source coordinates, however long it is. Paths are compared by
a digest of their words (so that equal hashes of different words do no harm), and all but the first occurrence (smallest
document, then start) are removed. That is exactly: a word goes if it lies in a window that also starts earlier.

The counting and the degrees use the exchange of chunks.py: a hash that is frequent in the whole corpus is sent once by
each chunk. The next and previous edge are compared by 32 bits of their hashes; a branching would be overlooked, and so a
window kept that should go, with a chance of 2**-32 for each branching.

Defined results: null or empty text, or fewer than SPAN words: nothing is removed. Of rows with the same identifier one
counts as the earlier; a null identifier is smaller than any other. An empty table gives an empty result. Other columns
aren't read. Words keep their case; what is kept is joined by one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from . import words as W
from .shared import saved

SPAN = 20


def _sliding(x: np.ndarray, k: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each k consecutive values, in about log2(k) passes."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x = best(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


class _Words:
    """Word hashes of a slice of a chunk and what follows from them."""

    def __init__(self, data: np.ndarray, at: np.ndarray, span: int) -> None:
        self.data, self.span = data, span
        self.starts, self.ends, self.text_of = W.spans(data, at, W.WHITE)
        self.hashes = W.word_hashes(data, self.starts, self.ends)
        self.whole = W.whole_grams(self.text_of, span)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window its anchor's hash, and for each place of a shorter sequence whether some window names it."""
        short = self.span // 2
        grams = W.gram_hashes(self.hashes, short)
        cover = self.span - short + 1
        named = np.where(self.whole, _sliding(grams, cover, np.minimum), np.uint64(0))
        if not len(named):
            return named, np.zeros(0, np.uint64)
        padded = np.zeros(len(named) + 2 * (cover - 1), np.uint64)
        padded[cover - 1 : cover - 1 + len(named)] = named
        chosen = _sliding(padded, cover, np.maximum) == grams
        return named, grams[chosen]

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each window, and 32 bits of the next and the previous one's in the same text (0: none)."""
        e = W.gram_hashes(self.hashes, self.span)
        short = (e >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        short[~self.whole] = 0
        after, before = np.zeros(len(e), np.uint32), np.zeros(len(e), np.uint32)
        after[:-1], before[1:] = short[1:], short[:-1]
        # the neighbour of a text's last window lies across the border, and isn't whole
        return e, after, before


def _slices(chunk: C.Chunk, span: int) -> Iterator[tuple[int, _Words]]:
    for first, data, at in chunk.slices():
        yield first, _Words(data, at, span)


def _anchor_keys(chunk: C.Chunk, span: int) -> tuple[np.ndarray, np.ndarray]:
    found = [w.anchors()[1] for _, w in _slices(chunk, span)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _repeated(kind: int, keys: np.ndarray, columns: list[np.ndarray], bounds: list[int]):
    """For each key whether another chunk has it too, or its own chunk more than once."""
    order, runs, run = C.sorted_groups(keys)
    total = np.add.reduceat(columns[0][order].astype(np.int64), runs)
    out = np.empty(len(keys), bool)
    out[order] = total[run] > 1
    return [np.packbits(out[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], {}


def _degrees(kind: int, keys: np.ndarray, columns: list[np.ndarray], bounds: list[int]):
    """1: repeated, 2: the next edge differs, 4: the previous one does."""
    order, runs, run = C.sorted_groups(keys)
    flags = columns[0][order]
    bits = np.bitwise_or.reduceat(flags, runs)
    size = np.diff(np.append(runs, len(keys)))
    bits[size > 1] |= 1
    for column, bit in ((columns[1], 2), (columns[2], 4)):
        c = column[order]
        bits[np.minimum.reduceat(c, runs) != np.maximum.reduceat(c, runs)] |= bit
    out = np.empty(len(keys), np.uint8)
    out[order] = bits[run]
    return [out[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], {}


def _bits(raw: list[bytes], keys: np.ndarray, n: int) -> np.ndarray:
    """The answers of _repeated, whose bits are padded to bytes for each range."""
    parts = [np.unpackbits(C.unpack_answers([x], "u1")) for x in raw]
    sizes = [b - a for _, a, b in C.ranges(keys, n)]
    return np.concatenate([p[:s] for p, s in zip(parts, sizes, strict=True)]).astype(bool) if parts else np.zeros(0, bool)


def _candidates(chunk: C.Chunk, got: dict[int, list[bytes]], span: int, n: int) -> Iterator[tuple[int, _Words, np.ndarray]]:
    """Each slice with the windows whose anchor is repeated."""
    keys, _ = _anchor_keys(chunk, span)
    flags = _bits(got.get(0, []), keys, n)
    live = keys[flags]
    for first, w in _slices(chunk, span):
        named, _ = w.anchors()
        place = np.searchsorted(live, named)
        hit = np.zeros(len(named), bool)
        if len(live):
            hit = w.whole & (live[np.minimum(place, len(live) - 1)] == named)
        yield first, w, hit


def _edge_keys(chunk: C.Chunk, got: dict[int, list[bytes]], span: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    found: list[list[np.ndarray]] = [[], [], []]
    for _, w, hit in _candidates(chunk, got, span, n):
        for out, x in zip(found, w.edges(), strict=True):
            out.append(x[hit])
    e, after, before = (np.concatenate(x) for x in found)
    if not len(e):
        return e, [np.zeros(0, np.uint8), after, before]
    order, runs, _ = C.sorted_groups(e)
    flags = np.zeros(len(runs), np.uint8)
    flags[np.diff(np.append(runs, len(e))) > 1] |= 1
    columns = []
    for x, bit in ((after[order], 2), (before[order], 4)):
        flags[np.minimum.reduceat(x, runs) != np.maximum.reduceat(x, runs)] |= bit
        columns.append(x[runs])
    return e[order][runs], [flags, *columns]


PATHS = "digest binary, id long, chunk long, row int, start int, windows int"


def paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """The chunks, and each occurrence of a compacted path of repeated edges."""
    chunks = C.chunk_table(docs, id_col, text_col)
    n = C.n_ranges(chunks, 4)

    def send_anchors(chunk: C.Chunk, got: dict) -> Iterator[C.Sent]:
        keys, count = _anchor_keys(chunk, span)
        yield 0, keys, [np.minimum(count, 2).astype(np.uint8)]

    anchors = C.exchange(chunks, send_anchors, _repeated, {0: ["u1"]}, n, "anchors")

    def send_edges(chunk: C.Chunk, got: dict) -> Iterator[C.Sent]:
        keys, columns = _edge_keys(chunk, got, span, n)
        yield 1, keys, columns

    edges = C.exchange(C.with_answers(chunks, anchors), send_edges, _degrees, {1: ["u1", "<u4", "<u4"]}, n, "edges")

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        for batch in batches:
            for chunk, got in C.each_chunk(batch):
                if 1 not in got:
                    continue
                keys, _ = _edge_keys(chunk, got, span, n)
                bits = C.unpack_answers(got[1], "u1")
                own = chunk.ids.to_pylist()
                for first, w, hit in _candidates(chunk, got, span, n):
                    e = w.edges()[0]
                    state = np.zeros(len(e), np.uint8)
                    state[hit] = bits[np.searchsorted(keys, e[hit])]
                    live = (state & 1).astype(bool)
                    # a path goes on from one window to the next of the same text if neither edge branches there
                    on = live[:-1] & live[1:] & ((state[:-1] & 2) == 0) & ((state[1:] & 4) == 0)
                    begins, stops = live.copy(), live.copy()
                    begins[1:] &= ~on
                    stops[:-1] &= ~on
                    a, z = np.flatnonzero(begins), np.flatnonzero(stops)
                    if not len(a):
                        continue
                    raw = w.data.tobytes()
                    text_start = W.bounds(w.text_of, len(own) - first + 1)
                    rows = []
                    left, right = w.starts[a].tolist(), w.ends[z + span - 1].tolist()
                    for i, (x, y) in enumerate(zip(left, right, strict=True)):
                        t = int(w.text_of[a[i]])
                        digest = hashlib.blake2b(b" ".join(raw[x:y].split()), digest_size=16).digest()
                        rows.append((digest, own[first + t], chunk.number, first + t, int(a[i] - text_start[t]), int(z[i] - a[i] + 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PATHS.split(", ")])

    return chunks, saved(C.with_answers(chunks, anchors, edges).mapInArrow(compact, PATHS), "paths")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, with_text: bool = True) -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    chunks, found = paths(docs, id_col, text_col, span)
    place = F.struct("id", "chunk", "row", "start")
    first = found.groupBy("digest").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("digest").alias("_digest"), "_first")
    # stored, so that the join has a shuffle of its own on both sides, which adaptive execution can split where a passage is very frequent
    first = saved(first, "first")
    later = found.join(first, F.col("digest") == F.col("_digest")).filter(~place.eqNullSafe(F.col("_first")))
    gone = later.groupBy("chunk").agg(F.collect_list(F.struct("row", "start", "windows")).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (chunk, _) in enumerate(C.each_chunk(batch)):
                cut: dict[int, list[tuple[int, int]]] = {}
                if batch.column(5)[k].is_valid:
                    row, start, windows = (batch.column(5)[k].values.field(i).to_numpy(zero_copy_only=False).tolist() for i in range(3))
                    for r, s, w in zip(row, start, windows, strict=True):
                        cut.setdefault(r, []).append((s, s + w + span - 1))
                ids = chunk.ids
                for first_row, data, at in chunk.slices():
                    raw, n_words, n_removed, shas, texts = data.tobytes(), [], [], [], []
                    for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                        words = raw[a:z].split()
                        n_words.append(len(words))
                        if first_row + i in cut:
                            kept, done = [], 0
                            for s, e in sorted(cut[first_row + i]):
                                kept += words[done:s] if s > done else []
                                done = max(done, e)
                            words = kept + words[done:]
                        n_removed.append(n_words[-1] - len(words))
                        joined = b" ".join(words)
                        shas.append(hashlib.sha256(joined).hexdigest())
                        texts.append(joined.decode() if with_text else None)
                    columns = [ids[first_row : first_row + len(shas)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names)

    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    schema = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return chunks.join(gone, "chunk", "left").select(*chunks.columns, "gone").mapInArrow(keep, schema)
