"""Line deduplication over content-defined chunks of lines.

A document's lines are cut into chunks where a rolling hash over the last ROLL lines' hashes is divisible by DIVISOR and
no chunk under MIN_LINES is left. The cut depends on the lines near it only (and where cuts would follow each other
closely, on the first of these), so inserting or deleting lines moves no cut far from them. A chunk that occurs more than
once in the corpus is removed everywhere but at its first occurrence (smallest document, then place). A passage's first
and last lines lie in chunks that also hold lines around it, so a removed chunk is extended: lines next to it go, too, as
far as they are, byte for byte, those next to the first occurrence, up to the end of the neighbouring chunk. So a line
goes only if the same line stands at an earlier place, and of each text one copy stays.

Documents are stored once, compressed, many to a row. Chunks are looked for by a 64-bit hash with partial counts, without
their bytes; only those whose hash is repeated are carried on with their bytes and their neighbours', and what decides is
a grouping by the bytes themselves, so that chunks with one hash and different bytes aren't taken for one. A group's
occurrences are pre-aggregated to its first in each task, and the occurrences are joined to that, a join that adaptive
execution splits where a chunk is very frequent. The joins are asked to shuffle at any size: a small input's plan is a
large one's.

Defined results: lines end at a newline only; a null or empty text is one empty line and never removed. Of rows with the
same identifier one counts as the earlier; a null identifier is smaller than any other. An empty table gives an empty
result. Other columns aren't read, whatever their names. Single lines are never removed but beside a removed chunk,
however often they occur. Kept lines are joined by a newline.
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
from .shared import drop, saved

ROLL, DIVISOR, MIN_LINES = 2, 2, 2


def _long_enough(cut: np.ndarray, nth: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The cuts that leave MIN_LINES lines before them, since the last cut, and after them. lines: how many the line's text has."""
    place = np.flatnonzero(cut & (nth >= MIN_LINES - 1) & (lines - 1 - nth >= MIN_LINES))
    out = np.zeros(len(cut), bool)
    before = -MIN_LINES
    for k in place.tolist():
        if k - before >= MIN_LINES:
            out[k] = True
            before = k
    return out


def line_chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, first line, lines, start byte, end byte and hash of each chunk."""
    n = len(at) - 1
    newline = np.flatnonzero(data == 0x0A)
    # one line more than newlines in each text, empty ones too
    owner = np.searchsorted(at[1:], newline, side="right")
    begins = np.concatenate([at[:-1], newline + 1])
    ends = np.concatenate([newline, at[1:]])
    begins_of, ends_of = np.concatenate([np.arange(n), owner]), np.concatenate([owner, np.arange(n)])
    order, order_e = np.lexsort((begins, begins_of)), np.lexsort((ends, ends_of))
    starts, text_of, stops = begins[order], begins_of[order], ends[order_e]
    hashes = W.word_hashes(data, starts, stops)
    first_line = W.bounds(text_of, n)
    nth = np.arange(len(text_of)) - first_line[text_of]
    rolled = np.full(len(hashes), np.uint64(1))
    if len(hashes) >= ROLL:
        rolled[ROLL - 1 :] = W.gram_hashes(hashes, ROLL)
    cut = ((rolled % np.uint64(DIVISOR)) == 0) & (nth >= ROLL - 1)
    last = np.zeros(len(hashes), bool)
    last[first_line[1:] - 1] = True
    stop = np.flatnonzero(_long_enough(cut, nth, first_line[1:][text_of] - first_line[text_of]) | last)
    start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
    return text_of[start], nth[start], stop - start + 1, starts[start], stops[stop], W.word_hashes(data, starts[start], stops[stop])


def _found(chunk: C.Chunk) -> Iterator[tuple[int, bytes, tuple[np.ndarray, ...]]]:
    """For each slice of documents the first, the bytes, and line_chunks()."""
    for first, data, at in chunk.slices():
        yield first, data.tobytes(), line_chunks(data, at)


def places(chunks: DataFrame) -> DataFrame:
    """hash, chunk (of documents), row and line of each chunk of MIN_LINES lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _ in C.each_chunk(batch):
                for first, _, (text, line, lines, start, end, hashed) in _found(chunk):
                    keep = np.flatnonzero((lines >= MIN_LINES) & (end > start))
                    columns = [pa.array(hashed[keep].view(np.int64)), pa.array(np.full(len(keep), chunk.number)), pa.array(text[keep] + first, pa.int32()), pa.array(line[keep], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["hash", "chunk", "row", "line"])

    return chunks.mapInArrow(run, "hash long, chunk long, row int, line int")


def occurrences(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """hash, id, chunk, row, line, lines, body, before and after (the neighbours' bytes) of the wanted places (chunk, row, line)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["hash", "id", "chunk", "row", "line", "lines", "body", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (chunk, _) in enumerate(C.each_chunk(batch)):
                asked = batch.column(5)[k].values
                asked = asked.field(0).to_numpy().astype(np.int64) << 32 | asked.field(1).to_numpy()
                ids = chunk.ids.to_pylist()
                for first, raw, (text, line, lines, start, end, hashed) in _found(chunk):
                    hit = np.flatnonzero(np.isin((text + first) << 32 | line, asked))
                    same = np.append(text[1:] == text[:-1], False)
                    body = lambda i: raw[start[i] : end[i]]  # noqa: B023, E731
                    rows = [(int(hashed[i : i + 1].view(np.int64)[0]), ids[first + int(text[i])], chunk.number, first + int(text[i]), int(line[i]), int(lines[i]), body(i), body(i - 1) if i and same[i - 1] else None, body(i + 1) if same[i] else None) for i in hit.tolist()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    asked = wanted.groupBy("chunk").agg(F.collect_list(F.struct("row", "line")).alias("asked"))
    return chunks.join(asked.hint("shuffle_merge"), "chunk").select(*chunks.columns, "asked").mapInArrow(run, "hash long, id long, chunk long, row int, line int, lines int, body binary, before binary, after binary")


def _alike(a: list[bytes], b: list[bytes]) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, row, line and lines, of chunk, row, line, lines, before, after and the first occurrence's before and after."""
    for b in batches:
        line, lines = b.column(2).to_pylist(), b.column(3).to_pylist()
        for i, (before, after, its_before, its_after) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4, 8)), strict=True)):
            up = _alike(before.split(b"\n")[::-1], its_before.split(b"\n")[::-1]) if before is not None and its_before is not None else 0
            down = _alike(after.split(b"\n"), its_after.split(b"\n")) if after is not None and its_after is not None else 0
            line[i] -= up
            lines[i] += up + down
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(line, pa.int32()), pa.array(lines, pa.int32())], ["chunk", "row", "line", "lines"])


def removed_chunks(chunks: DataFrame) -> DataFrame:
    """chunk, row, line and lines of each occurrence that isn't its chunk's first, extended. chunks: C.chunk_table()."""
    every = saved(places(chunks), "places")
    # stored, here and below: a join with a shuffle of its own on both sides can be split where a chunk is very frequent
    frequent = saved(every.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("hash"), "frequent")
    again = saved(occurrences(chunks, every.join(frequent.hint("shuffle_merge"), "hash").select("chunk", "row", "line")), "lines")
    for x in (every, frequent):
        drop(x)
    place = F.struct("id", "chunk", "row", "line")
    first = again.groupBy("hash", "body").agg(F.min(F.struct("id", "chunk", "row", "line", "before", "after")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    first = saved(first.select("hash", "body", F.struct(*[F.col(f"_first.{c}").alias(c) for c in ("id", "chunk", "row", "line")]).alias("_first"), F.col("_first.before").alias("_before"), F.col("_first.after").alias("_after")), "first")
    later = again.join(first.hint("shuffle_merge"), ["hash", "body"]).filter(~place.eqNullSafe(F.col("_first")))
    gone = saved(later.select("chunk", "row", "line", "lines", "before", "after", "_before", "_after").mapInArrow(_extended, "chunk long, row int, line int, lines int"), "gone")
    for x in (again, first):
        drop(x)
    return gone


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each document: id, n_lines, n_removed (lines), kept_sha256, and kept_text if asked for."""
    chunks = C.chunk_table(docs, id_col, text_col)
    gone = removed_chunks(chunks).groupBy("chunk").agg(F.collect_list(F.struct("row", "line", "lines")).alias("gone"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (chunk, _) in enumerate(C.each_chunk(batch)):
                cut: dict[int, list[tuple[int, int]]] = {}
                if batch.column(5)[k].is_valid:
                    for row, line, lines in zip(*(batch.column(5)[k].values.field(i).to_pylist() for i in range(3)), strict=True):
                        cut.setdefault(row, []).append((line, line + lines))
                for first, data, at in chunk.slices():
                    raw, n_lines, n_removed, shas, texts = data.tobytes(), [], [], [], []
                    for i, (a, z) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                        own = raw[a:z]
                        n_lines.append(own.count(b"\n") + 1)
                        n_removed.append(0)
                        if first + i in cut:
                            lines, kept, done = own.split(b"\n"), [], 0
                            for s, e in sorted(cut[first + i]):
                                kept += lines[done:s] if s > done else []
                                done = max(done, e)
                            kept += lines[done:]
                            n_removed[-1] = len(lines) - len(kept)
                            own = b"\n".join(kept)
                        shas.append(hashlib.sha256(own).hexdigest())
                        texts.append(own.decode() if with_text else None)
                    columns = [chunk.ids[first : first + len(shas)], pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names)

    names = [id_col, "n_lines", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    schema = f"`{id_col}` long, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return chunks.join(gone.hint("shuffle_merge"), "chunk", "left").select(*chunks.columns, "gone").mapInArrow(keep, schema)
