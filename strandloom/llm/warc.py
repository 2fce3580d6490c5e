"""WARC archives: a writer with revisit records and a splittable reader of gzipped archives.

Writer. Every page becomes one record in a gzip member of its own. Pages with equal payloads of at least
``min_bytes`` share one ``response`` record, that with the largest page_id; the others become ``revisit``
records, which carry the HTTP header (with the payload's length) and refer to the response. Each task
writes archives of its own, under a temporary name that is renamed when complete, so a lost task leaves
nothing behind and its next attempt replaces what it wrote.

Reader. Archives are cut into byte ranges. A task looks in its range for gzip's magic, takes a candidate for
a member only if decoding its start gives a WARC header, and from there reads member after member. It owns
the records that start inside its range, whose last one it reads to its end beyond the range; so every
record is read once, whatever the cuts. What belongs to no readable record (flipped bits, an archive cut off, foreign bytes between
members) is a row of type ``damaged`` with its archive, offset, length (payload_bytes) and reason, so that nothing is lost without a word; ``whole`` makes it an error. Only one member is in memory at a time. Archives of others are read too: records of all types (a
record without an HTTP message gives its whole block as payload), several records in a member, header names in any case, folded lines,
missing or foreign digests. ``digest_ok`` says whether a SHA-1 payload digest of the header is that of the payload; it
is null where the header has none to compare. Ids that are no ``urn:page:`` of this writer give a null page_id and stay in ``record_id``.

Null html counts as empty, null url leaves out the target URI. Rows with a group's largest page_id are all
``response``; repeated rows are written each. A null page_id counts as smallest and is read back as null.
Empty tables give empty results. Archives are written and read through pyarrow's file systems, so the folder
must be one that these can reach (local or mounted, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, scratch_path

PAGE_ID = re.compile(r"<urn:page:(-?\d+)>")
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed when it has so many bytes; a reader's range.
ARCHIVE_BYTES, SPLIT_BYTES = 1 << 30, 16 << 20
#: Tasks that read, at most; beyond it a task reads several ranges.
READ_TASKS = 50_000
READ = 1 << 18
#: Bytes of records that a task holds before it hands them on.
HELD = 4 << 20
RECORD = "page_id long, record_type string, refers_to long, target_uri string, payload_digest string, payload_bytes long, payload binary, record_id string, digest_ok boolean, archive string, offset long, damage string"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    found = PAGE_ID.fullmatch((record_id or "").strip())
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A gzip member with one response record, or a revisit record if ``refers_to`` is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a folded line continues the one before, of repeated fields the first counts."""
    text = re.sub(r"\r?\n[ \t]+", " ", head.decode("utf-8", "replace"))
    fields: dict[str, str] = {}
    for line in re.split(r"\r?\n", text)[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


HEAD_END = re.compile(rb"\r?\n\r?\n")


def split_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a member; what is no whole record comes as the field ``damage`` (a reason) with its bytes."""
    low = 0
    while low < len(raw):
        end = HEAD_END.search(raw, low) if raw.startswith(b"WARC/", low) else None
        if not end:
            yield {"damage": "header without end" if raw.startswith(b"WARC/", low) else "no record"}, raw[low:]
            return
        fields = _fields(raw[low : end.start()])
        size = fields.get("content-length", "")
        high = end.end() + int(size) if size.isdigit() else len(raw)
        if high > len(raw):
            yield {"damage": "shorter than its Content-Length"}, raw[low:]
            return
        fields.pop("damage", None)
        yield fields, raw[end.end() : high]
        low = high
        while raw[low : low + 1] in (b"\r", b"\n"):
            low += 1


def parse_record(fields: dict[str, str], block: bytes) -> tuple:
    """The columns of RECORD; the payload's digest is computed anew where there is a payload."""
    kind, told = fields.get("warc-type", "").lower(), fields.get("warc-payload-digest")
    http, payload = {}, block
    if "application/http" in fields.get("content-type", "").lower() or kind == "revisit":
        end = HEAD_END.search(block)
        http, payload = _fields(block[: end.start()] if end else block), block[end.end() :] if end else b""
    stated = told.removeprefix("sha1:") if told and told.startswith("sha1:") else None
    if kind == "revisit":
        size = http.get("content-length", "")
        length, digest, payload, same = int(size) if size.isdigit() else None, stated or told, None, None
    else:
        length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same = None if stated is None else stated == digest
    return _page_of(fields.get("warc-record-id")), kind, _page_of(fields.get("warc-refers-to")), fields.get("warc-target-uri"), digest, length, payload, fields.get("warc-record-id"), same


def _writer(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, store, path = TaskContext.get(), *open_fs(folder)
        store.create_dir(path, recursive=True)
        out, size, count, number, done = None, 0, 0, 0, []

        def close():
            out.close()
            name = f"part-{context.partitionId():06d}-{number:04d}.warc.gz"
            store.move(temporary, f"{path}/{name}")
            done.append((f"{folder}/{name}", size, count))

        for b in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    temporary = f"{path}/_{uuid.uuid4().hex}"
                    out, size, count = store.open_output_stream(temporary), 0, 0
                raw = record(page_id, url, (html or "").encode(), refers_to, date)
                out.write(raw)
                size, count = size + len(raw), count + 1
                if size >= archive_bytes:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        cols = list(zip(*done)) if done else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the archives; a written table of them: path, bytes, records."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    digest = F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary")))
    groups = rows.select("page_id", digest.alias("digest")).filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null").drop("n")
    groups = materialise(groups.withColumnRenamed("digest", "of"), "payloads")
    rows = rows.withColumn("digest", digest).join(broadcast_if_small(groups), F.col("digest") == F.col("of"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return materialise(rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_writer(folder, date, archive_bytes), "path string, bytes long, records long"), "archives")


class _Window:
    """Random access to an archive with one read-ahead buffer."""

    def __init__(self, file, size: int):
        self.file, self.size, self.low, self.buffer = file, size, 0, b""

    def at(self, position: int, least: int) -> memoryview:
        """Bytes from a position on, at least so many unless the archive ends."""
        if not self.low <= position or position + least > self.low + len(self.buffer):
            self.file.seek(position)
            self.low, self.buffer = position, self.file.read(max(least, READ))
        return memoryview(self.buffer)[position - self.low :]


def _begins(window: _Window, position: int) -> bool:
    """Whether a gzip member that holds WARC records begins at a position, by decoding its start."""
    start = window.at(position, 4096)
    if start[: len(MAGIC)] != MAGIC:
        return False
    try:
        return zlib.decompressobj(31).decompress(start[:4096], 5) == b"WARC/"
    except zlib.error:
        return False


def _member(window: _Window, position: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a position and the member's end; None if it is damaged or cut off."""
    unpack, out = zlib.decompressobj(31), []
    try:
        while not unpack.eof:
            more = window.at(position, 1)
            if not more:
                return None
            out.append(unpack.decompress(more))
            position += len(more)
    except zlib.error:
        return None
    return b"".join(out), position - len(unpack.unused_data)


def _next(window: _Window, position: int) -> int:
    """The next candidate for a member after a position, or the archive's end."""
    position += 1
    while position < window.size:
        text = bytes(window.at(position, len(MAGIC)))
        found = text.find(MAGIC)
        if found >= 0:
            return position + found
        position += max(1, len(text) - len(MAGIC) + 1)
    return window.size


def records_in(file, size: int, low: int, high: int) -> Iterator[tuple[int, int, bytes | str]]:
    """(offset, length, content) of the members that begin in [low, high) and hold WARC records, and (offset, length, reason) of what is damaged.

    Before the first member of a range nothing is damaged: it belongs to a member of an earlier one. From there on, and at an archive's start, a
    member must follow the last one; where none begins, the bytes up to the next that does are damaged. A member of which only the start can be decoded is
    damaged, and its range says so. A range looks at the place after its last member even if that lies in the next range, so that every byte is
    covered by one of them.
    """
    window, position, follows = _Window(file, size), low, low == 0
    while position < size and (position < high or follows):
        begins = _begins(window, position)
        if begins and position >= high:
            return
        if begins and (found := _member(window, position)):
            yield position, found[1] - position, found[0]
            position, follows = found[1], True
        elif begins or follows:
            end = _next(window, position)
            while end < size and not _begins(window, end):
                end = _next(window, end)
            yield position, end - position, "damaged or cut off" if begins else "no member"
            position, follows = end, True
        else:
            position = _next(window, position)


_NAMES = ["page_id", "record_type", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload", "record_id", "digest_ok", "archive", "offset", "damage"]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], _NAMES)

    def damaged(uri: str, offset: int, size: int, reason: str) -> tuple:
        return None, "damaged", None, None, None, size, None, None, None, uri, offset, reason

    for b in batches:
        for uri, size, low, high in zip(*(c.to_pylist() for c in b.columns)):
            store, path = open_fs(uri)
            rows, held = [], 0
            with store.open_input_file(path) as file:
                for offset, length, content in records_in(file, size, low, high):
                    if isinstance(content, str):
                        rows.append(damaged(uri, offset, length, content))
                        continue
                    for fields, block in split_records(content):
                        rows.append(damaged(uri, offset, len(block), fields["damage"]) if "damage" in fields else (*parse_record(fields, block), uri, offset, None))
                    held += len(content)
                    if held > HELD:
                        yield batch(rows)
                        rows, held = [], 0
            yield batch(rows)


def whole(records: DataFrame) -> DataFrame:
    """``records`` of ``read_archives``, or an error where an archive is damaged."""
    said = F.concat_ws(" ", F.lit("damaged archive:"), "damage", F.lit("at byte"), F.col("offset").cast("string"), F.lit("of"), "archive")
    return records.withColumn("record_type", F.when(F.col("damage").isNotNull(), F.raise_error(said)).otherwise(F.col("record_type"))).drop("damage")


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per record, and per damaged stretch, of the archives (path, bytes), read in ranges of ``split_bytes``."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    ranges = archives.filter("bytes > 0").select("path", "bytes", starts.alias("low"))
    ranges = ranges.select("path", "bytes", "low", F.least(F.col("low") + split_bytes, F.col("bytes")).alias("high"))
    # A stated number of tasks: rows of ranges are tiny, so adaptive execution would read all archives in one task.
    tasks = max(1, min(READ_TASKS, ranges.count()))
    return ranges.repartition(tasks, "path", "low").mapInArrow(_reader, RECORD)
