"""Vector code compression: product codes whose nearest entries are found by partial-distance search.

Vectors become integers (see ``vectors``) and are cut into ``parts`` equal consecutive parts. Each part position has a codebook of
``entries`` integer entries; it starts as that part of the vectors with the smallest ids. Rounds assign every part to its
nearest entry and replace each entry by the floored mean of its parts, for which tasks send sums per entry; entries without parts stay.

Partial-distance search: a part's dimensions are processed in descending variance of the codebook. The distance to the entry that is
nearest in the first of them is completed and is the best so far; then entries gain one dimension at a time, in blocks of
``BLOCK``, and a mask drops those whose accumulated integer distance strictly exceeds the best complete distance. A block's complete
distances lower the best for the blocks after it. Ties go to the lower index, which is why only strictly larger sums are dropped. All arithmetic is
in integers; where 64 bits may not hold it, Python's take their place.

Nulls and lengths: as in ``vectors``; a dimension that ``parts`` does not divide raises a ValueError. Null ids come after all others when
the first entries are taken, and repeated ids in the order of their vectors. Fewer vectors than entries give a codebook of as many
entries. Null labels are one label. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise
from .vectors import EXACT, exact, integer_vectors, matrix

BLOCK = 16


def order_of_dimensions(book: np.ndarray) -> np.ndarray:
    """Dimensions of a codebook (entries x dimensions) in descending variance of its entries; ties: the first dimension first."""
    wide = book.astype(object)
    n = len(book)
    spread = [int(n * (wide[:, j] ** 2).sum() - wide[:, j].sum() ** 2) for j in range(book.shape[1])]
    return np.array(sorted(range(book.shape[1]), key=lambda j: (-spread[j], j)), np.int64)


def nearest(x: np.ndarray, book: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x its nearest entry of ``book`` (the lower index in ties), the squared distance, and how many
    single-dimension terms were computed (a full search needs rows * entries * dimensions)."""
    order = order_of_dimensions(book) if order is None else order
    n, k = len(x), len(book)
    both = exact(np.concatenate((x, book)), 4 * max(1, x.shape[1]))
    x, book = both[:n, order], both[n:, order]
    first = (x[:, :1] - book[None, :, 0]) ** 2
    at = first.argmin(1).astype(np.int64)
    best = ((x - book[at]) ** 2).sum(1)
    work = n * k + n * (len(order) - 1)
    for low in range(0, k, BLOCK):
        row, entry = np.nonzero(first[:, low : low + BLOCK] <= best[:, None])
        entry += low
        sofar = first[row, entry]
        for j in range(1, len(order)):
            work += len(row)
            sofar = sofar + (x[row, j] - book[entry, j]) ** 2
            stay = np.asarray(sofar <= best[row], bool)
            row, entry, sofar = row[stay], entry[stay], sofar[stay]
        # Of a row's complete entries the nearest, then the lowest, comes first.
        rank = np.lexsort((entry, sofar.astype(object) if sofar.dtype == object else sofar, row))
        row, entry, sofar = row[rank], entry[rank], sofar[rank]
        head = np.ones(len(row), bool)
        head[1:] = row[1:] != row[:-1]
        row, entry, sofar = row[head], entry[head], sofar[head]
        better = np.asarray((sofar < best[row]) | ((sofar == best[row]) & (entry < at[row])), bool)
        best[row[better]], at[row[better]] = sofar[better], entry[better]
    return at, best, work


def _codes(x: np.ndarray, books: list[np.ndarray], orders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part of each row, and distances summed over parts."""
    parts = np.split(x, len(books), axis=1)
    found = [nearest(p, book, order) for p, book, order in zip(parts, books, orders)]
    return np.stack([f[0] for f in found], 1), sum((f[1].astype(object) if f[1].dtype == object else f[1] for f in found), np.zeros(len(x), np.int64))


def train(rows: DataFrame, d: int, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """Codebooks of ``rows`` (vec_id, x array<long> of length d; a written table): one integer array (entries x dimensions) for each part."""
    if d % parts:
        raise ValueError(f"vectors of {d} dimensions cannot be cut into {parts} equal parts")
    seeds = np.array([r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()], np.int64)  # at most ``entries`` rows
    books = np.split(seeds, parts, axis=1)
    width = d // parts
    for _ in range(rounds):
        orders = [order_of_dimensions(b) for b in books]

        def part(batches: Iterator[pa.RecordBatch], books=books, orders=orders) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column(0), d)
                at, _ = _codes(x, books, orders)
                wide = x if int(np.abs(x).max()) * len(x) < EXACT else x.astype(object)
                for p in range(parts):
                    used, where = np.unique(at[:, p], return_inverse=True)
                    total = np.zeros((len(used), width), wide.dtype)
                    np.add.at(total, where, wide[:, p * width : (p + 1) * width])
                    count = np.bincount(where)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(total.size, p)), pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array([int(v) for v in total.ravel()], pa.decimal128(38, 0)), pa.array(np.repeat(count, width))],
                        ["part", "entry", "place", "total", "n"],
                    )

        sums = rows.select("x").mapInArrow(part, "part long, entry long, place long, total decimal(38,0), n long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for r in sums.collect():  # parts * entries * width rows at most
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error, codebooks_sha256; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256, as a code has two hex digits a part")
    rows, d = integer_vectors(df, {"vec_id": id_col, "label": label_col}, vector_col, scale)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    if not d:
        return df.sparkSession.createDataFrame([], f"vec_id {kind['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    books = train(rows, d, parts, entries, rounds)
    orders = [order_of_dimensions(b) for b in books]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, error = _codes(matrix(b.column(2), d), books, orders)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in at.astype(np.uint8)]), pa.array([int(e) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    coded = materialise(rows.select("vec_id", "label", "x").mapInArrow(encode, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "codes")
    of = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "labels")
    out = coded.join(broadcast_if_small(of), F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
