"""Chunks of documents, and an exchange of hashed keys between them.

Some operators have to know, for each of very many hashes in a text (its word sequences), how often or where else the
hash occurs. One shuffled row for each occurrence would be many times the text. Here the corpus is stored once as chunks
of some megabytes, one row each. A chunk sends its distinct hashes, sorted, cut into key ranges, as one binary value for
each range; a range's task sees the values of all chunks and answers each with as many flags or counts, in the same
order, so that neither hashes nor positions have to be sent back. A hash that is frequent in the whole corpus is sent
once by each chunk, whatever its count, and a range's hashes are spread evenly since they are hashes: no key is hot.

Chunks are written before they are used, so that a repeated task sees the same chunk under the same number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import saved, shuffle_parts

#: Text bytes of a chunk. Larger chunks repeat fewer keys; numpy needs some tens of bytes for each word.
CHUNK_BYTES = 8 << 20
#: Key bytes of a range that are aimed at when there are many.
RANGE_BYTES = 64 << 20
SCHEMA = "chunk long, ids array<long>, sizes array<long>, words long, blob binary"


def chunk_table(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Whole documents in chunks of at least chunk_bytes of text where a task has that much. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, ids, sizes, texts, held, words = TaskContext.get().partitionId(), 0, [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            blob = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            sizes_ = np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 33) | nth], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(sizes_)], pa.int32()), pa.concat_arrays(ids)),
                    pa.ListArray.from_arrays(pa.array([0, len(sizes_)], pa.int32()), pa.array(sizes_)),
                    pa.array([words], pa.int64()),
                    pa.array([held.to_bytes(8, "little") + blob], pa.binary()),
                ],
                ["chunk", "ids", "sizes", "words", "blob"],
            )

        for b in W.pieces(batches, "_text"):
            data, at = W.text_view(b.column(1))
            ids.append(b.column(0))
            sizes.append(np.diff(at))
            texts.append(data.tobytes())
            held += len(data)
            words += W.count_words(data, at, W.WHITE)
            if held >= chunk_bytes:
                yield row()
                nth, ids, sizes, texts, held, words = nth + 1, [], [], [], 0, 0
        if sizes:
            yield row()

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return saved(own.mapInArrow(run, SCHEMA), "chunks")


class Chunk:
    """One row of chunk_table(): documents' ids (an Arrow array), data (bytes of all texts) and at (offsets into it)."""

    def __init__(self, number: int, ids: pa.Array, sizes: pa.Array, blob: bytes) -> None:
        self.number, self.ids = number, ids
        self.at = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))])
        size = int.from_bytes(blob[:8], "little")
        self.data = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", dtype=np.uint8)

    def __len__(self) -> int:
        return len(self.ids)

    def slices(self, limit: int = W.PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """First document, bytes and offsets of runs of documents with at most limit bytes, or one with more."""
        start, n = 0, len(self)
        while start < n:
            stop = max(start + 1, int(np.searchsorted(self.at, self.at[start] + limit, side="right")) - 1)
            yield start, self.data[self.at[start] : self.at[stop]], self.at[start : stop + 1] - self.at[start]
            start = stop


def each_chunk(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, dict[int, list[bytes]]]]:
    """The chunks of a batch, with the answers by kind in order of key range, if the batch has them."""
    names = batch.schema.names
    for i in range(batch.num_rows):
        got: dict[int, list[bytes]] = {}
        if "answers" in names and batch.column(names.index("answers"))[i].is_valid:
            answers = batch.column(names.index("answers"))[i].values
            kinds, parts = (answers.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for j in np.lexsort((parts, kinds)).tolist():
                got.setdefault(int(kinds[j]), []).append(answers.field(2)[j].as_py())
        yield Chunk(batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(2)[i].values, batch.column(4)[i].as_py()), got


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are nearly all zero and compress away."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def ranges(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(range, start, stop) of the sorted keys in each of n equal ranges of 64-bit values that has any."""
    limits = np.array([(i << 64) // n for i in range(1, n)], dtype=np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, limits, side="left"), [len(keys)]])
    return [(i, int(cuts[i]), int(cuts[i + 1])) for i in range(n) if cuts[i] < cuts[i + 1]]


def n_ranges(chunks: DataFrame, key_bytes: int) -> int:
    """Enough for RANGE_BYTES each if every word sent key_bytes, and four for each shuffle partition."""
    total = chunks.agg(F.sum("words")).first()[0] or 0
    return max(4 * shuffle_parts(chunks.sparkSession), -(-total * key_bytes // RANGE_BYTES))


#: What a chunk sends of one kind: sorted distinct keys, and arrays as long as them.
Sent = tuple[int, np.ndarray, list[np.ndarray]]


def exchange(
    chunks: DataFrame,
    send: Callable[[Chunk, dict[int, list[bytes]]], Iterator[Sent]],
    answer: Callable[[int, np.ndarray, list[np.ndarray], list[int]], tuple[list[np.ndarray], dict[int, int]]],
    types: dict[int, list[str]],
    n: int,
    name: str,
) -> DataFrame:
    """Stored answers: chunk, kind, part, answer (binary), sums (array of long, for kinds' statistics).

    types: numpy types of what goes with the keys, by kind. answer(kind, keys, columns, bounds) gets the keys of all
    chunks one after another, and where each chunk's begin; it returns an array for each chunk, and sums by number."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, got in each_chunk(batch):
                for kind, keys, columns in send(chunk, got):
                    rows = [(part, kind, chunk.number, pack_keys(keys[a:b]), b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)) for part, a, b in ranges(keys, n)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "kind", "chunk", "keys", "more"])

    def meet(table: pa.Table) -> pa.Table:
        kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
        numbers = table.column("chunk").to_pylist()
        keys = [unpack_keys(x.as_buffer()) for x in table.column("keys").combine_chunks()] if table.num_rows else []
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)
        columns = [np.empty(at[-1], dtype=t) for t in types[kind]]
        for i, raw in enumerate(table.column("more").to_pylist()):
            place = 0
            for c in columns:
                size = len(keys[i]) * c.itemsize
                c[at[i] : at[i + 1]] = np.frombuffer(raw[place : place + size], dtype=c.dtype)
                place += size
        answers, sums = answer(kind, np.concatenate(keys), columns, at.tolist())
        packed = [pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True) if len(a) else b"" for a in answers]
        rows = {"chunk": numbers, "kind": [kind] * len(numbers), "part": [part] * len(numbers), "answer": [len(a).to_bytes(4, "little") + p for a, p in zip(answers, packed, strict=True)], "sums": [[sums.get(i, 0) for i in range(4)]] + [None] * (len(numbers) - 1)}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)})

    sent = chunks.mapInArrow(out, "part int, kind int, chunk long, keys binary, more binary")
    met = sent.groupBy("part", "kind").applyInArrow(meet, "chunk long, kind int, part int, answer binary, sums array<long>")
    return saved(met, name)


def unpack_answers(raw: list[bytes], dtype: str) -> np.ndarray:
    """The answers of all ranges, one for each key that the chunk sent."""
    kind = np.dtype(dtype)
    found = [np.frombuffer(pa.decompress(x[4:], decompressed_size=int.from_bytes(x[:4], "little") * kind.itemsize, codec="zstd", asbytes=True), dtype=kind) for x in raw]
    return np.concatenate(found) if found else np.zeros(0, kind)


def with_answers(chunks: DataFrame, *answers: DataFrame) -> DataFrame:
    """chunks with an array of all their answers."""
    every = answers[0]
    for a in answers[1:]:
        every = every.unionByName(a)
    grouped = every.groupBy("chunk").agg(F.collect_list(F.struct("kind", "part", "answer")).alias("answers"))
    return chunks.join(grouped, "chunk", "left").select("chunk", "ids", "sizes", "words", "blob", "answers")


def sorted_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts keys, starts of equal runs in that order, and for each sorted place its run."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1
