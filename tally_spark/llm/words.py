"""Words and their hashes, computed over Arrow's text buffers with numpy: no Python loop per word or document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LENGTH_SALT = np.uint64(0xD6E8FEB86659FD93)
#: Text bytes handled at once. numpy needs about forty bytes of memory for each.
PIECE_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit changes about half of the output's."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def powers(n: int, base: int = BASE) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if len(found) <= 4 * PIECE_BYTES:
            _powers[base] = found
    return found[:n]


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """For each byte whether it lies in one of the ranges, ends included."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Separators of the two kinds of words: white space, and all ASCII but letters and digits.
WHITE = byte_table((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z become a-z, other bytes stay. No byte of a longer UTF-8 character lies in A-Z.
LOWERED = np.where(byte_table((0x41, 0x5A)), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def text_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, places, data = texts.buffers()
    at = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    if data is None or at[0] == at[-1]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most limit bytes of text, or one row with more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_view(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def spans(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the text it lies in. Words end where texts do."""
    inside = ~separator[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = at[(at > 0) & (at < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(at[1:], starts, side="right")


def count_words(data: np.ndarray, at: np.ndarray, separator: np.ndarray) -> int:
    """How many words spans() finds."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[(at > 0) & (at < len(data))]
    first[edges] = inside[edges]
    return int(first.sum())


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(data) + 1, BASE_INVERSE)[starts] + (ends - starts).astype(np.uint64) * LENGTH_SALT)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive word hashes; the caller leaves out those that cross texts."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * powers(n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(n + 1, BASE_INVERSE)[: n - k + 1] + np.uint64(k * int(LENGTH_SALT) % (1 << 64)))


def whole_grams(text_of: np.ndarray, k: int) -> np.ndarray:
    """For each k consecutive words whether all lie in one text."""
    return text_of[k - 1 :] == text_of[: len(text_of) - k + 1] if len(text_of) >= k else np.zeros(0, bool)


def bounds(text_of: np.ndarray, n: int) -> np.ndarray:
    """n + 1 offsets of the texts in an array that is sorted by text."""
    return np.searchsorted(text_of, np.arange(n + 1), side="left")
