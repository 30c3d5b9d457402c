"""Packing: each document's tokens are cut into pieces of power-of-two length, and pieces of equal length share a bucket.

A document of L tokens gives L // max_len pieces of max_len and one piece for each set bit of the rest, from the largest
to the smallest. Each piece is a sequence by itself: a power of two, so it needs no padding, and no sequence crosses
documents. Sequence numbers rise by length (the bucket), so a bucket's sequences lie together.

Text is tokenized whole. The tokenizer's byte-level pattern splits text into short parts that it encodes one by one, so
the parts are found with numpy over a slice of texts, a sign that no such text has is put before each, and one call of a
byte-pair encoder takes the slice. Texts with characters outside the range for which the classes are certain go through
the tokenizer itself. A text of more than a slice is cut where white space follows another sign, which always is between
two parts, and its slices are encoded one by one: beyond a slice a worker holds a text and its ids.

Defined results: null or empty text is the end id alone, one piece of length 1. Repeated rows are packed each. An empty
table gives no pieces. The strings of special tokens are ordinary text. Other columns aren't read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import saved

MAX_LEN, END_ID = 2048, 1
#: Text bytes encoded at once.
SLICE_BYTES = 1 << 18
SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
LIMIT = 0x250
#: Put before each part. It is of no sure class, so no part has it.
MARK = 0x1E
#: ASCII that is seen: white space after it starts a part.
SEEN = W.byte_table((0x21, 0x7E))


def _classes() -> np.ndarray:
    out = np.full(LIMIT + 1, UNSURE, dtype=np.uint8)
    for c in (*range(0x20, 0x7F), 0x09, 0x0A, 0x0D, *range(0xA1, LIMIT)):
        kind = unicodedata.category(chr(c))
        out[c] = SPACE if c <= 0x20 else LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    return out


CLASSES = _classes()
_state: dict[str, tuple] = {}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if the tokenizer is a plain byte-level one whose ids rise with its merges; else None."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer"):
        return None
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return ranks if all(a < b for a, b in zip(merged, merged[1:], strict=False)) and all(bytes([b]) in ranks for b in range(256)) else None


def tokenizer_for(path: str | None):
    """The tokenizer, a function for marked parts (None if the file's rules aren't those of part_starts), and the mark's id; loaded once by each worker."""
    if path not in _state:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            file = public_tokenizers.path("byte_bpe_50k.json")
        else:
            file = path
        found = Tokenizer.from_file(file)
        found.encode_special_tokens = True
        with open(file, encoding="utf-8") as f:
            ranks = _ranks(json.load(f))
        marked = tiktoken.Encoding("parts", pat_str=f"[^\\x{MARK:02x}]+|\\x{MARK:02x}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary if ranks else None
        _state[path] = (found, marked, ranks and ranks[bytes([MARK])])
    return _state[path]


def part_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each character starts a part. first: whether it is its text's first. Characters are of sure classes.

    Runs of letters, numbers and other signs are parts, with one space before them if there is one. Of white space before
    such a run the last sign is left to it if it is a space, else it is a part by itself; what comes before is one part.
    An apostrophe that is a part's start and a run of length one takes the letters of a contraction.
    """
    n = len(chars)
    kind = CLASSES[chars]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = UNSURE, kind[:-1]
    before[first] = UNSURE
    run = (kind != before) | first
    out = run.copy()
    solid = kind != SPACE
    space_before = np.zeros(n, bool)
    space_before[1:] = (chars[:-1] == 0x20) & ~first[1:]
    led = run & solid & space_before
    out[led] = False
    last = np.flatnonzero(run & solid & (before == SPACE)) - 1
    out[last] = True
    marks = np.flatnonzero((chars == 0x27) & out)
    for i in marks.tolist():
        for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
            stop = i + 1 + len(tail)
            if stop <= n and not first[i + 1 : stop].any() and chars[i + 1 : stop].tobytes() == tail.encode("utf-32-le"):
                out[i + 1] = False
                if stop < n and not first[stop]:
                    out[stop] = out[stop] or (kind[stop] == LETTER)
                break
    return out


def encode(texts: pa.Array, path: str | None = None, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """All ids of all texts, each followed by end_id, and the n + 1 offsets of the texts."""
    tokenizer, marked, mark_id = tokenizer_for(path)
    data, at = W.text_view(texts)
    n = len(at) - 1
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    char_at = np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), at)
    unsure = np.concatenate([[0], np.cumsum(CLASSES[np.minimum(chars, LIMIT)] == UNSURE)])
    plain = (unsure[char_at[1:]] == unsure[char_at[:-1]]) & (marked is not None)
    length = np.zeros(n, np.int64)
    odd = {}
    for i in np.flatnonzero(~plain).tolist():
        odd[i] = np.array(tokenizer.encode(data[at[i] : at[i + 1]].tobytes().decode(), add_special_tokens=False).ids, dtype=np.uint32)
        length[i] = len(odd[i])
    stream = np.zeros(0, np.uint32)
    own, own_chars = data[np.repeat(plain, np.diff(at))], chars[np.repeat(plain, np.diff(char_at))]
    if len(own):
        first = np.zeros(len(own_chars), bool)
        sizes = np.diff(char_at) * plain
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        part = np.flatnonzero(part_starts(own_chars, first))
        starts = np.flatnonzero((own & 0xC0) != 0x80)[part]
        ids = np.array(marked(np.insert(own, starts, MARK).tobytes().decode()), dtype=np.uint32)
        marks = np.flatnonzero(ids == mark_id)
        count = np.diff(marks, append=len(ids)) - 1
        length += np.bincount(np.searchsorted(np.cumsum(sizes), part, side="right"), weights=count, minlength=n).astype(np.int64)
        stream = np.delete(ids, marks)
    id_at = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(id_at[-1], end_id, dtype=np.uint32)
    own_length = length * plain
    shift = id_at[:-1] - (np.cumsum(own_length) - own_length)
    out[np.arange(len(stream)) + np.repeat(shift, own_length)] = stream
    for i, ids in odd.items():
        out[id_at[i] : id_at[i] + len(ids)] = ids
    return out, id_at


def slices(text: np.ndarray, limit: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Start and end of slices of one text whose ids, put together, are the text's. Each is of limit bytes at least but for the last, and ends where white space follows a seen sign."""
    out, start = [], 0
    while start < len(text):
        stop = len(text)
        at = start + limit
        while at < len(text):
            near = text[at - 1 : at + limit]
            cuts = np.flatnonzero(SEEN[near[:-1]] & W.WHITE[near[1:]])
            if len(cuts):
                stop = at + int(cuts[0])
                break
            at += limit
        out.append((start, stop))
        start = stop
    return out


def encode_long(text: pa.Array, path: str | None = None, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """encode() of one text, slice by slice if the tokenizer's parts are known."""
    data, _ = W.text_view(text)
    if tokenizer_for(path)[1] is None or len(data) <= SLICE_BYTES:
        return encode(text, path, end_id)
    ids = [encode(pa.array([data[a:z].tobytes().decode()]), path, end_id)[0][:-1] for a, z in slices(data)]
    out = np.concatenate([*ids, np.array([end_id], dtype=np.uint32)])
    return out, np.array([0, len(out)])


def piece_lengths(length: int, max_len: int = MAX_LEN) -> list[int]:
    whole, rest = divmod(length, max_len)
    return [max_len] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_len: int = MAX_LEN, with_ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit) if asked for. tokenizer: a file's path; by default the byte-level one."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len has to be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for b in W.pieces(batches, "_text", SLICE_BYTES):
            stream, at = (encode_long if b.num_rows == 1 else encode)(b.column(1), tokenizer)
            raw = memoryview(stream.astype("<u4").tobytes())
            rows = []
            for doc, a, z in zip(b.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                start = a
                for size in piece_lengths(z - a, max_len):
                    own = raw[4 * start : 4 * (start + size)]
                    rows.append((doc, start - a, size, zlib.crc32(own), z - a, *([bytes(own)] if with_ids else [])))
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    cut = saved(own.mapInArrow(run, schema), "pieces")
    ordered = cut.repartitionByRange("length", "doc_id", "start").sortWithinPartitions("length", "doc_id", "start")
    return ordered.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
