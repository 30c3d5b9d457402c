"""WARC archives: a writer, and a splittable reader.

The writer stores each page as one gzip member that holds one WARC/1.1 record: the full response, or a revisit that
names the response with an equal payload. The reader cuts each archive into byte ranges of equal size, one row each. A
task looks for gzip's magic bytes in its range, takes a candidate as a member only if its start decodes to a WARC
header, and owns the records that start in its range; the last may end beyond it. After an owned member it goes on at
the member's end, where another has to start, else the archive is damaged and the task fails; the member after a task's
last is looked at for that, too. No index and no reading from the start of an archive is needed, so one large archive is read by as
many tasks as it has ranges.

Archives are opened by URI through pyarrow's file systems, in the folder that all executors share. A task writes under
an attempt's own name and renames at the end; a repeated task writes the same bytes.

Defined results: null html is empty; a null page_id is smaller than any other; of repeated rows with the same page_id
and payload one is the response. Payloads under MIN_REVISIT bytes are always responses. A null url gives a record
without a target URI. An empty table gives no archive and no records. Payloads of any length are decoded in blocks, one
record at a time.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, saved

MIN_REVISIT = 1000
#: Bytes of an archive after which a task begins another, of a reader's range, and of one read.
ARCHIVE_BYTES, RANGE_BYTES, READ_BYTES = 256 << 20, 4 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
CAPTURED = "2020-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame) -> DataFrame:
    """pages' page_id, url and html with record_type and refers_to.

    Groups of equal payloads meet as one row for each page identifier only; the html is joined by identifier and digest,
    so that no task holds the pages of a group.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select("*", F.sha1("html").alias("_sha"), F.octet_length("html").cast("long").alias("_bytes"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("_key"))
    slim = own.groupBy("_sha", "_bytes", "page_id", "_key").agg(F.count(F.lit(1)).alias("_same"))
    first = slim.groupBy("_sha", "_bytes").agg(F.max("page_id").alias("_first"))
    decided = slim.join(first, ["_sha", "_bytes"]).select("_sha", "_key", "_first")
    joined = own.join(decided, ["_sha", "_key"])
    # by the join's key: the html is shuffled once
    copy = F.row_number().over(Window.partitionBy("_sha", "_key").orderBy("url"))
    response = (F.col("_bytes") < MIN_REVISIT) | (F.col("page_id").eqNullSafe(F.col("_first")) & (F.col("_copy") == 1))
    return joined.withColumn("_copy", copy).select("page_id", "url", "html", F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("_first")).alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, record_type: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    block = HTTP % len(payload) + (payload if record_type == "response" else b"")
    head = {"WARC-Type": record_type, "WARC-Record-ID": _record_id(page_id), "WARC-Date": CAPTURED, "X-Page-Id": "" if page_id is None else str(page_id), "X-Payload-Bytes": str(len(payload))}
    if url is not None:
        head["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head["WARC-Payload-Digest"] = "sha1:" + b32encode(hashlib.sha1(payload).digest()).decode()
    if record_type == "revisit":
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": _record_id(refers_to), "X-Refers-To-Page": "" if refers_to is None else str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, uri: str) -> DataFrame:
    """Write the records of record_types() under uri. Returns path, bytes and records of each archive; it is stored, so the writing happens once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        out, done, nth, size, count, temp = None, [], 0, 0, 0, ""

        def finish() -> None:
            nonlocal out, nth, size, count
            out.close()
            name = f"{root}/part-{task.partitionId():06d}-{nth:04d}.warc.gz"
            store.move(temp, name)
            done.append((f"{uri}/{name.rsplit('/', 1)[1]}", size, count))
            out, nth, size, count = None, nth + 1, 0, 0

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, url, html, kind, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    temp = f"{root}/.writing-{task.taskAttemptId()}-{nth}"
                    out = store.open_output_stream(temp)
                member = encode_record(page_id, url, html.encode(), kind, refers_to)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= ARCHIVE_BYTES:
                    finish()
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "bytes", "records"])

    slim = records.select("page_id", "url", "html", "record_type", "refers_to")
    return saved(slim.mapInArrow(write, "path string, bytes long, records long"), "archives")


class _Window:
    """Bytes of a file from some place on, of which a reader drops what it is done with."""

    def __init__(self, file, start: int) -> None:
        self.file, self.start, self.data = file, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[: to - self.start]
        self.start = to


class DamagedArchive(ValueError):
    """A member breaks off or can't be decoded, or bytes that aren't a member follow one."""


def _member(window: _Window, at: int, whole: bool = True) -> tuple[bytes, int] | None:
    """The decoded member that starts at the byte and where it ends, or None if no WARC head is decoded there. With whole unset, only whether there is one."""
    unpack, out, pos, seen, known = zlib.decompressobj(31), [], at - window.start, b"", False
    while not unpack.eof:
        if pos >= len(window.data) and not window.more():
            if known:
                raise DamagedArchive(f"the member at byte {at} breaks off")
            return None
        block = window.data[pos : pos + (READ_BYTES if known else 512)]
        try:
            out.append(unpack.decompress(block))
        except zlib.error as error:
            if known:
                raise DamagedArchive(f"the member at byte {at} can't be decoded: {error}") from error
            return None
        pos += len(block)
        if not known:
            seen += out[-1]
            known = seen.startswith(b"WARC/1.")
            if not known and not b"WARC/1.".startswith(seen):
                return None
            if known and not whole:
                return b"", at
    return (b"".join(out), window.start + pos - len(unpack.unused_data)) if known else None


def scan_range(file, start: int, stop: int) -> Iterator[bytes]:
    """The decoded records whose members start in [start, stop). Members follow each other without a gap from byte 0 to the
    file's end; where one doesn't, whoever reads the member before it raises DamagedArchive."""
    window, at, exact = _Window(file, start), start, start == 0
    while True:
        if exact:
            # a member, or the end of the file, is due here
            if at - window.start >= len(window.data) and not window.more():
                return
            window.drop(at)
            if at >= stop:
                if _member(window, at, whole=False) is None:
                    raise DamagedArchive(f"no member at byte {at}, where the one before ends")
                return
        else:
            found = window.data.find(MAGIC, at - window.start)
            if found < 0:
                at = max(at, window.start + len(window.data) - len(MAGIC) + 1)
                window.drop(min(at, window.start + len(window.data)))
                if at >= stop or not window.more():
                    return
                continue
            at = window.start + found
            if at >= stop:
                return
            window.drop(at)
        member = _member(window, at)
        if member is None:
            if exact:
                raise DamagedArchive(f"no member at byte {at}, where one is due")
            at += 1
            continue
        yield member[0]
        at, exact = member[1], True


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload of the HTTP response within."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record's block is shorter than its Content-Length")
    return fields, block.partition(b"\r\n\r\n")[2]


RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(archives: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of archives (path, bytes). A response's length and digest are computed from its payload, and must agree with its header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                rows, held = [], 0
                with store.open_input_file(path) as file:
                    for raw in scan_range(file, row["start"], row["stop"]):
                        fields, payload = parse_record(raw)
                        stated = fields["warc-payload-digest"].removeprefix("sha1:")
                        number = lambda x: int(x) if x else None
                        if fields["warc-type"] == "response":
                            size, digest = len(payload), hashlib.sha1(payload)
                            if b32encode(digest.digest()).decode() != stated:
                                raise ValueError(f"payload digest of page {fields['x-page-id']} in {row['path']} doesn't agree with its record")
                            sha, payload = digest.hexdigest(), payload if with_payload else None
                        else:
                            from base64 import b32decode

                            size, sha, payload = int(fields["x-payload-bytes"]), b32decode(stated).hex(), None
                        rows.append((number(fields["x-page-id"]), fields.get("warc-target-uri"), fields["warc-type"], number(fields.get("x-refers-to-page")), size, sha, payload))
                        held += len(raw)
                        if held > READ_BYTES * 4:
                            yield out(rows)
                            rows, held = [], 0
                if rows:
                    yield out(rows)

    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = archives.filter("bytes > 0").select("path", first.alias("start")).withColumn("stop", F.col("start") + range_bytes)
    spread = ranges.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4))
    return spread.mapInArrow(read, RECORD)


def round_trip(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """The records of pages, written and read back; as many as were written, or an error."""
    archives = write_archives(record_types(pages), new_path(spark, "warc"))
    found = saved(read_archives(archives, with_payload=False), "records")
    written, read = archives.agg(F.sum("records")).first()[0] or 0, found.count()
    if written != read:
        raise DamagedArchive(f"{written} records were written and {read} read")
    return found
