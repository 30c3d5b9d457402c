"""Exact deduplication: a tree merge of sorted digest runs.

Each partition of the digests is sorted and reduced to a run: one entry for each distinct digest, with the identifier that
stays and the number of rows. Sorting is Spark's, within the partition, and may spill; nothing is shuffled for it. Then
runs are exchanged in rounds, as in a binomial tree with FAN children for two: in round k those whose numbers agree but
for their k-th digit to the base FAN meet, and a multiway merge makes one sorted run of them, in which a digest keeps its
winning identifier and the sum of its rows. After ceil(log_FAN(runs)) rounds one run is left. A run is never one task's: it
is cut into ranges of digests, of which there are enough that one holds about RANGE_ROWS entries of all runs at most, and
each range of a round is merged by itself. A digest enters a merge once for each run, so a group of copies of any size
costs at most FAN entries there.

Entries are equal when SHA-256, a second 64-bit digest and the length in bytes are all equal; this is verified at every
level, since all three are compared before entries are joined.

Defined results: null text counts as empty, and empty texts are copies of each other. A null identifier is smaller than
any other. Of repeated rows with the same identifier and text one is kept. An empty table gives an empty result. Other
columns of the input, whatever their names, aren't read, and drop_copies() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, lower_ascii, only, row_mark, saved

FAN, RANGE_ROWS = 8, 1 << 19
KEY = ["_sha", "_second", "_bytes"]
ENTRY = "_run int, _sha binary, _second long, _bytes long, _keep long, _rows long"
NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and the digest columns."""
    text = lower_ascii(F.col(f"`{text_col}`").cast("string"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_text")).select(
        "_id", F.unhex(F.sha2("_text", 256)).alias("_sha"), F.xxhash64("_text").alias("_second"), F.octet_length("_text").cast("long").alias("_bytes")
    )


def _merged(parts: list[tuple[np.ndarray, ...]], keep: str) -> tuple[np.ndarray, ...]:
    """One sorted run of several: arrays of digest (32 bytes), second, bytes, identifier, whether it is null, and rows."""
    sha, second, size, kept, null, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(sha):
        return sha, second, size, kept, null, rows
    # numpy's stable sort finds ascending runs and merges them
    order = np.argsort(sha, kind="stable")
    sha, second, size, kept, null, rows = (x[order] for x in (sha, second, size, kept, null, rows))
    new = np.ones(len(sha), bool)
    new[1:] = sha[1:] != sha[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    if (second != second[first][group]).any() or (size != size[first][group]).any():
        # one SHA-256 for different texts: told apart by the other two
        order = np.lexsort((size, second, group))
        sha, second, size, kept, null, rows = (x[order] for x in (sha, second, size, kept, null, rows))
        new[1:] = (sha[1:] != sha[:-1]) | (second[1:] != second[:-1]) | (size[1:] != size[:-1])
        first = np.flatnonzero(new)
    # null is smaller than any other
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    if keep == "max":
        best, none = np.maximum.reduceat(np.where(null, low, kept), first), np.logical_and.reduceat(null, first)
    else:
        best, none = np.minimum.reduceat(np.where(null, high, kept), first), np.logical_or.reduceat(null, first)
    return sha[first], second[first], size[first], np.where(none, 0, best), none, np.add.reduceat(rows, first)


def _arrays(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """_sha, _second, _bytes, _keep, whether that is null, _rows."""
    column = lambda name: (c.combine_chunks() if isinstance(c := table.column(table.schema.get_field_index(name)), pa.ChunkedArray) else c)
    sha = np.frombuffer(b"".join(column("_sha").to_pylist()), dtype="S32")
    kept = column("_keep")
    return sha, *(column(x).to_numpy(zero_copy_only=False) for x in ("_second", "_bytes")), kept.fill_null(0).to_numpy(zero_copy_only=False), kept.is_null().to_numpy(zero_copy_only=False), column("_rows").to_numpy(zero_copy_only=False)


def _entries(run: int, parts: tuple[np.ndarray, ...]) -> pa.Table:
    sha, second, size, kept, null, rows = parts
    # numpy drops trailing zero bytes of an S32 value
    raw = pa.array([x.ljust(32, b"\0") for x in sha.tolist()], pa.binary())
    return pa.table([pa.array(np.full(len(sha), run), pa.int32()), raw, pa.array(second, pa.int64()), pa.array(size, pa.int64()), pa.array(kept, pa.int64(), mask=null), pa.array(rows, pa.int64())], names=NAMES)


def runs(found: DataFrame, keep: str = "max") -> DataFrame:
    """The sorted run of each partition of digests(), numbered by partition; stored."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = None, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            one = pa.Table.from_batches([b]).append_column("_keep", b.column(0)).append_column("_rows", pa.array(np.ones(b.num_rows, np.int64)))
            held = _merged([*([held] if held else []), _arrays(one)], keep)
            # the last entry may go on in the next batch
            yield from _entries(number, tuple(x[:-1] for x in held)).to_batches()
            held = tuple(x[-1:] for x in held)
        if held:
            yield from _entries(number, held).to_batches()

    return saved(found.select("_id", *KEY).sortWithinPartitions(*KEY).mapInArrow(reduce, ENTRY), "runs")


def tree_merge(level: DataFrame, n_runs: int, fan: int = FAN, keep: str = "max", range_rows: int = RANGE_ROWS) -> DataFrame:
    """KEY, _keep and _rows: one row for each distinct digest. level: what runs() returns."""
    n_ranges = -(-level.count() // range_rows) or 1
    # SHA-256 is even, so ranges of equal width are of equal size
    part = (F.conv(F.hex(F.substring("_sha", 1, 4)), 16, 10).cast("long") * n_ranges / (1 << 32)).cast("int")

    def merge(table: pa.Table) -> pa.Table:
        numbers = table.column("_run").to_numpy()
        return _entries(int(numbers[0]) // fan, _merged([_arrays(table.filter(pa.array(numbers == k))) for k in np.unique(numbers).tolist()], keep))

    while n_runs > 1:
        n_runs = -(-n_runs // fan)
        meet = level.select("*", part.alias("_range"), (F.col("_run") / fan).cast("int").alias("_to")).groupBy("_range", "_to")
        level, before = saved(meet.applyInArrow(lambda key, table: merge(table.drop_columns(["_range", "_to"])), ENTRY), "runs"), level
        drop(before)
    return level.select(*KEY, "_keep", "_rows")


def _groups(docs: DataFrame, id_col: str, text_col: str, keep: str) -> tuple[DataFrame, DataFrame]:
    """digests(), and the groups."""
    found = saved(digests(docs, id_col, text_col), "digests")
    level = runs(found, keep)
    return found, tree_merge(level, (level.agg(F.max("_run")).first()[0] or 0) + 1, keep=keep)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256. Exactly one row of each group is kept."""
    found, groups = _groups(docs, id_col, text_col, keep)
    rows = found.groupBy(*KEY, "_id").agg(F.count(F.lit(1)).alias("_same"))
    return (
        rows.join(groups, KEY)
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_same").cast("int"))).alias("_nth"))
        .select(
            F.col("_id").alias(id_col),
            F.col("_keep").alias("keep_id"),
            F.col("_rows").alias("group_size"),
            (F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_nth") == 1)).alias("kept"),
            F.lower(F.hex("_sha")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all their columns."""
    _, groups = _groups(docs, id_col, text_col, "max")
    own = F.hex(F.unhex(F.sha2(lower_ascii(F.col(f"`{text_col}`").cast("string")), 256)))
    return only(docs, groups.select(row_mark(F.col("_keep"), F.hex("_sha")).alias("_kept")), row_mark(F.col(f"`{id_col}`").cast("long"), own))
