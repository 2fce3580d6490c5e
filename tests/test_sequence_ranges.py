"""FASTQ files cut into byte ranges give the rows, and the errors, of an uncut reader."""

import gzip
import random
import struct
import zlib

import pytest

from strandloom.sources import sequences
from strandloom.sources.sequences import Range, fastq_records


def blocks(data: bytes, size: int) -> bytes:
    """A block-gzipped file with blocks of ``size`` bytes and the empty block at its end."""
    out = b""
    for i in [*range(0, len(data), size), len(data)]:
        piece = data[i : i + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(piece) + z.flush()
        head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 12 + 6 + len(body) + 8 - 1)
        out += head + body + struct.pack("<II", zlib.crc32(piece), len(piece))
    return out


def read(path, cut=None):
    """(offset-free rows, or the word error) of all ranges of ``cut`` bytes."""
    size = path.stat().st_size
    cut = cut or size
    try:
        return [r[1:] for s in range(0, size, cut) for r in fastq_records(Range(f"file://{path}", s, min(s + cut, size)))]
    except ValueError:
        return "error"


def awkward(n, rng, end="\n"):
    """Records whose qualities look like headers and separators, with empty and long ones."""
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 2, 7, 30])
        seq = "".join(rng.choice("ACGTN") for _ in range(k))
        qual = "".join(rng.choice("@+I!") for _ in range(k))
        out += [f"@r{i}" + rng.choice(["", " more", " @x", "  two  "]), seq, rng.choice(["+", f"+r{i}", "+@"]), qual]
    return end.join(out) + end


@pytest.mark.parametrize("kind", ["plain", "crlf", "blocks", "gzip", "open end", "blank end"])
def test_all_cuts_give_the_same_rows(tmp_path, kind):
    rng = random.Random(len(kind))
    text = awkward(14, rng, "\r\n" if kind == "crlf" else "\n")
    text = text.rstrip("\n") + "x" * 0 if kind == "open end" else text + "\n\n" * (kind == "blank end")
    if kind == "open end":
        text = awkward(13, rng) + "@last\nACG\n+\n@+I"
    path = tmp_path / ("a.fastq" + ".gz" * (kind in ("blocks", "gzip")))
    path.write_bytes(blocks(text.encode(), 37) if kind == "blocks" else gzip.compress(text.encode()) if kind == "gzip" else text.encode())
    lines = text.replace("\r", "").split("\n")
    want = [(lines[i][1:].split()[0], lines[i][1:].strip(), lines[i + 1], lines[i + 3]) for i in range(0, 4 * 14, 4)]
    assert read(path) == want
    for cut in range(1, path.stat().st_size + 2):
        assert read(path, cut) == want, cut


def test_all_cuts_refuse_what_an_uncut_reader_refuses(tmp_path):
    rng = random.Random(3)
    path, refused = tmp_path / "b.fastq", 0
    for turn in range(120):
        lines = awkward(6, rng).split("\n")
        at = rng.randrange(len(lines) - 1)
        match turn % 5:
            case 0:
                del lines[at]
            case 1:
                lines.insert(at, rng.choice(["", "@", "+", "ACGT", "@r ACGT"]))
            case 2:
                lines[at] = lines[at] + "A"
            case 3:
                lines = lines[: at + 1]
            case 4:
                lines[at] = rng.choice(["", "@", "+", "ACGT"])
        path.write_text("\n".join(lines))
        want = read(path) if path.stat().st_size else []
        refused += want == "error"
        for cut in (*range(1, 24), 31, 50, 77, 100):
            assert read(path, cut) == want, (turn, cut, lines)
    assert refused > 60


def test_damaged_blocks_are_errors(tmp_path):
    data = bytearray(blocks(awkward(40, random.Random(1)).encode(), 200))
    path = tmp_path / "c.fastq.gz"
    path.write_bytes(data)
    assert len(read(path, 300)) == 40
    data[len(data) // 2] ^= 255
    path.write_bytes(data)
    assert read(path, 300) == read(path) == "error"
    path.write_bytes(data[:150])
    assert read(path) == "error"


@pytest.mark.parametrize("cut", [37, 1000, None])
def test_scan(spark, tmp_path, cut):
    text = awkward(50, random.Random(9))
    (tmp_path / "f").mkdir()
    for name, data in (("a.fastq", text.encode()), ("b.fastq.gz", blocks(text.encode(), 100)), ("c.fastq.gz", gzip.compress(text.encode())), ("d.fastq", b"")):
        (tmp_path / "f" / name).write_bytes(data)
    rows = sequences.read_fastq(spark, str(tmp_path / "f"), cut).collect()
    by = {}
    for r in rows:
        by.setdefault(r.path.split("/")[-1], []).append((r.record_index, r.identifier, r.sequence, r.quality))
    lines = text.split("\n")
    want = [(i // 4, lines[i][1:].split()[0], lines[i + 1], lines[i + 3]) for i in range(0, 200, 4)]
    assert {k: sorted(v) for k, v in by.items()} == dict.fromkeys(("a.fastq", "b.fastq.gz", "c.fastq.gz"), want)
    assert sequences.read_fastq(spark, str(tmp_path / "f" / "d.fastq")).count() == 0


def test_written_files_come_back(spark, tmp_path):
    reads = spark.createDataFrame([(f"r{i}", "" if i % 2 else f"d {i}", "ACGTN" * i, "@+I!~" * i) for i in range(30)], "identifier string, description string, sequence string, quality string")
    for compression in ("none", "gzip"):
        sequences.write_fastq(reads.repartition(3), str(tmp_path / compression), compression)
        got = sequences.read_fastq(spark, str(tmp_path / compression), 200, numbered=False)
        assert sorted((r.identifier, r.description, r.sequence, r.quality) for r in got.collect()) == sorted((r[0], f"{r[0]} {r[1]}".strip(), r[2], r[3]) for r in reads.collect())
    sequences.write_fasta(reads.filter("sequence <> ''"), str(tmp_path / "fa"), 7)
    assert sorted((r.identifier, r.sequence) for r in sequences.read_fasta(spark, str(tmp_path / "fa")).collect()) == sorted((r[0], r[2]) for r in reads.collect() if r[2])
    assert max(map(len, "".join(p.read_text() for p in (tmp_path / "fa").glob("part*")).replace("\n>", "\n").split("\n"))) <= 9
