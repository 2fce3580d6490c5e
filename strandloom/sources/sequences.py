"""FASTA and FASTQ scans and writers."""

from __future__ import annotations

import gzip
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import seq
from ..scratch import broadcast_if_small, materialise

READ = "path string, range_start long, nth long, offset long, identifier string, description string, sequence string, quality string"
BATCH = 4 << 20
#: Bytes of a file that one read request takes.
CHUNK = 1 << 20


def read_fasta(spark: SparkSession, path: str, mask_lowercase: bool = False) -> DataFrame:
    """identifier, description, sequence (normalised). Records are what lies between ``\\n>``, so plain files are split
    between tasks and compressed ones are read by Hadoop's codecs. A file must begin with ``>``; an empty header is an error."""
    text = spark.read.option("lineSep", "\n>").text(path).filter(F.trim("value") != "")
    text = text.select(F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "").alias("v"))
    header, body = F.split("v", "\n", 2)[0], F.coalesce(F.try_element_at(F.split("v", "\n", 2), F.lit(2)), F.lit(""))
    identifier = F.split(F.trim(header), r"\s+", 2)[0]
    checked = F.when(identifier == "", F.raise_error(F.lit("FASTA header without identifier"))).otherwise(identifier)
    return text.select(checked.alias("identifier"), F.trim(header).alias("description"), seq.normalise_sequence(body, mask_lowercase).alias("sequence"))


Line = tuple[int, str]


class Range:
    """Lines, with their offsets, of a file from ``start`` on, and where the range ends in the same offsets.

    Offsets count bytes from ``start``, for block-gzipped files decompressed bytes from the first block that begins at ``start`` or later. ``limit`` is
    the offset of the range's end (of the first block that begins there or later); it is None until the reader has come so far.
    """

    def __init__(self, uri: str, start: int, end: int) -> None:
        self.uri, self.start, self.end = uri, start, end
        self.store, self.path = pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
        self.kind = "plain"
        if self.path.endswith(".gz"):
            with self.store.open_input_file(self.path) as f:
                self.kind = "blocks" if block_size(f.read(CHUNK)) else "gzip"
        self.limit = end - start if self.kind == "plain" else None

    def _raw(self) -> Iterator[bytes]:
        with self.store.open_input_file(self.path) as f:
            f.seek(self.start)
            while data := f.read(CHUNK):
                yield data

    def _pieces(self) -> Iterator[bytes]:
        if self.kind == "plain":
            yield from self._raw()
        elif self.kind == "blocks":
            yield from self._blocks(self._raw())
        elif not self.start:  # other gzip files cannot be cut: their first range has all
            with self.store.open_input_stream(self.path, compression=None) as raw, gzip.open(raw, "rb") as f:
                while data := f.read(CHUNK):
                    yield data

    def _blocks(self, raw: Iterator[bytes]) -> Iterator[bytes]:
        """Decompressed blocks from the first one at or after ``start`` on."""
        data, at, done, out = b"", 0, False, 0

        def fill(n: int) -> bool:
            nonlocal data, at, done
            while len(data) - at < n and not done:
                more = next(raw, b"")
                done = not more
                data, at = data[at:] + more, 0
            return len(data) - at >= n

        place = self.start
        # The first place where a header begins whose block leads to another one or to the end of the file.
        while fill(1):
            fill(1 << 17)
            hit = data.find(b"\x1f\x8b\x08\x04", at)
            if hit < 0:
                move = max(1, len(data) - at - 3)
            else:
                move = hit - at
                size = block_size(data[hit : hit + (1 << 10)])
                # A block that the file's end cuts off counts, so that it is refused below.
                if size and (hit + size >= len(data) and done or block_size(data[hit + size : hit + size + (1 << 10)])):
                    at, place = hit, place + move
                    break
                move += 1
            at, place = at + move, place + move
        while fill(1):
            if self.limit is None and place >= self.end:
                self.limit = out
            fill(1 << 17)
            size = block_size(data[at : at + (1 << 10)])
            if not size or not fill(size):
                raise ValueError(f"damaged block at byte {place} of {self.uri}")
            try:
                text = zlib.decompress(data[at : at + size], 31)
            except zlib.error as e:
                raise ValueError(f"damaged block at byte {place} of {self.uri}: {e}") from e
            at, place, out = at + size, place + size, out + len(text)
            yield text

    def lines(self) -> Iterator[Line]:
        """(offset, line without its end)."""
        rest, at = b"", 0
        for piece in self._pieces():
            *whole, rest = (rest + piece).split(b"\n")
            for line in whole:
                yield at, line.rstrip(b"\r").decode()
                at += len(line) + 1
        if rest:
            yield at, rest.rstrip(b"\r").decode()
        if self.limit is None:
            self.limit = at + len(rest)


def block_size(header: bytes) -> int:
    """Length of the block whose header this is, by its BC subfield; 0 if it is none."""
    if len(header) < 18 or header[:4] != b"\x1f\x8b\x08\x04":
        return 0
    (extra,) = struct.unpack_from("<H", header, 10)
    field, end = 12, 12 + extra
    while field + 4 <= min(end, len(header)):
        name, length = header[field : field + 2], struct.unpack_from("<H", header, field + 2)[0]
        if name == b"BC" and length == 2 and field + 6 <= len(header):
            return struct.unpack_from("<H", header, field + 4)[0] + 1
        field += 4 + length
    return 0


def frame(lines: list[Line]) -> int | None:
    """Index of the first line that begins a record: ``@``, bases, ``+``. Bases begin with neither sign, so of a record's four lines only its
    header is followed by such lines, whatever its quality looks like. None if no record begins here."""
    for i in range(len(lines) - 2):
        if lines[i][1].startswith("@") and not lines[i + 1][1].startswith(("@", "+")) and lines[i + 2][1].startswith("+"):
            return i
    return None


class _Ahead:
    """Lines with a look ahead."""

    def __init__(self, lines: Iterator[Line]) -> None:
        self.lines, self.held = lines, deque()

    def peek(self, n: int) -> list[Line]:
        while len(self.held) < n and (line := next(self.lines, None)) is not None:
            self.held.append(line)
        return list(islice(self.held, n))

    def take(self, n: int) -> list[Line]:
        out = self.peek(n)
        for _ in out:
            self.held.popleft()
        return out

    def only_blank(self) -> bool:
        while line := self.take(1):
            if line[0][1]:
                return False
        return True


def fastq_records(part: Range) -> Iterator[tuple[int, str, str, str, str]]:
    """offset, identifier, description, sequence, quality of the records that begin after the range's first byte and up to, and with, its last offset; in
    a file's first range from the first byte on.

    A line that begins before is the previous range's; the first frame after it is the first record. Malformed and truncated records are errors, as are
    lines after a blank one where a header should be. Where a range stops, it checks that a frame, which the next range will
    find, begins there, so that no cut hides what an uncut reader would refuse.
    """
    where = f" of {part.uri}, in the range from byte {part.start}"
    lines = _Ahead(part.lines())
    if part.start:
        lines.take(1)
        skip = frame(lines.peek(7))  # at most three lines of a record that began before, and three of the next
        if skip is None:
            return
        lines.take(skip)
        if part.limit is not None and lines.peek(1)[0][0] > part.limit:
            return
    while header := lines.peek(1):
        offset, text = header[0]
        if not text:
            if not lines.only_blank():
                raise ValueError(f"blank line before a FASTQ record at offset {offset}{where}")
            return
        if part.limit is not None and offset > part.limit:
            if frame(lines.peek(3)) != 0:
                raise ValueError(f"malformed FASTQ record {text!r}{where}")
            return
        record = [x[1] for x in lines.take(4)]
        if len(record) < 4:
            raise ValueError(f"truncated FASTQ record {text!r}{where}")
        _, bases, plus, quality = record
        if text[0] != "@" or not plus.startswith("+") or bases.startswith(("@", "+")) or len(bases) != len(quality) or not text[1:].split():
            raise ValueError(f"malformed FASTQ record {text!r}{where}")
        yield offset, text[1:].split()[0], text[1:].strip(), bases, quality


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [f.split() for f in READ.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [f for f, _ in fields])

    for b in batches:
        for uri, start, end in zip(*(c.to_pylist() for c in b.columns)):
            rows, held = [], 0
            for i, (offset, *record) in enumerate(fastq_records(Range(uri, start, end))):
                rows.append((uri, start, i, offset, *record))
                held += 2 * len(record[2])
                if held > BATCH:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)


def read_fastq(spark: SparkSession, path: str, range_bytes: int | None = None, numbered: bool = True, across: bool = False) -> DataFrame:
    """path, record_index (in its file, or, ``across``, in all files in order of their paths; from 0), identifier, description, sequence (normalised), quality of FASTQ files.

    Files are read in ranges of ``range_bytes`` (as large as Spark's own splits if None). Neighbouring ranges share a task where there are more of them than four for each core and than Spark's
    own splits would be, as the driver keeps track of every task; plain files are cut anywhere, block-gzipped ones at
    blocks, other gzip files not at all. Indices need each range's number of records, which a second scan counts; without ``numbered`` there
    is none, and rows of one file are ordered by (range_start, nth) in either case.
    """
    split = int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    range_bytes = range_bytes or split
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), "length").filter("length > 0")
    many = F.ceil(F.col("length") / range_bytes).cast("long")
    first = F.coalesce(F.sum(many).over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a file
    ranges = files.select("path", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("i"), "length")
    ranges = ranges.select("path", (F.col("i") * range_bytes).alias("start"), F.least((F.col("i") + 1) * range_bytes, "length").alias("end"), (F.col("first") + F.col("i")).cast("int").alias("task"))
    total, size = files.agg(F.coalesce(F.sum(many), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(total, max(4 * spark.sparkContext.defaultParallelism, -(-size // split))))
    scan = ranges.repartitionById(tasks, F.floor(F.col("task").cast("long") * tasks / max(1, total)).cast("int")).select("path", "start", "end").mapInArrow(_scan, READ)
    rows = scan.withColumn("sequence", seq.normalise_sequence(F.col("sequence")))
    if not numbered:
        return rows
    order = Window.orderBy("path", "range_start") if across else Window.partitionBy("path").orderBy("range_start")  # one row a range
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scan.groupBy("path", "range_start").agg(F.count("*").alias("n")).select("path", "range_start", before.alias("before"))
    out = rows.join(broadcast_if_small(materialise(counts, "counts")), ["path", "range_start"])
    return out.select("path", (F.col("before") + F.col("nth")).alias("record_index"), "identifier", "description", "sequence", "quality", "range_start", "nth")


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    """identifier, description (after the identifier; blank: none), sequence, quality as FASTQ files, one per partition."""
    header = F.concat_ws(" ", "identifier", F.when(F.trim("description") != "", F.trim("description")))
    reads.select(F.concat(F.lit("@"), header, F.lit("\n"), "sequence", F.lit("\n+\n"), "quality")).write.mode("overwrite").option("compression", compression).text(path)


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    """identifier, description (after the identifier; blank: none), sequence as FASTA files with lines of ``width`` bases."""
    header = F.concat_ws(" ", "identifier", F.when(F.trim("description") != "", F.trim("description")))
    body = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), header, F.lit("\n"), body)).write.mode("overwrite").text(path)
