"""Vector tables as integers: what the operators on embeddings share.

Usable vectors: not null, without null or non-finite entries, and of the table's dimension, which is the most frequent
length among such vectors (the longer one in a tie; empty vectors have none). All others are left out. Entries become
``floor(scale * entry) + shift`` as 64-bit integers; an entry for which that is beyond 2^62 raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Entries and sums below this bound are exact in 64-bit integers without a look at each.
EXACT = 2**62


def _integer(scale: int, shift: int):
    def convert(x: Column) -> Column:
        y = x.cast("double") * float(scale)
        return F.when(F.abs(y) < float(EXACT), F.floor(y) + shift).otherwise(F.raise_error(F.lit("a vector's entry is too large for 64-bit integers")).cast("long"))

    return convert


def integer_vectors(df: DataFrame, keep: dict[str, str], vector_col: str, scale: int, shift: int = 0) -> tuple[DataFrame, int]:
    """A written table of the columns ``keep`` (name in the result: name in ``df``) and ``x`` array<long>; and its dimension, 0 for none."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = df.select(*(F.col(c).alias(n) for n, c in keep.items()), F.col(vector_col).alias("x")).filter("x is not null and size(x) > 0").filter(F.forall("x", finite))
    rows = rows.withColumn("x", F.transform("x", _integer(scale, shift)))
    rows = materialise(rows, "vectors")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size("x") == most["d"]), most["d"]) if most else (rows, 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column without nulls, all of length ``d``."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact(x: np.ndarray, terms: int, factor: int = 1) -> np.ndarray:
    """``x`` as Python integers where ``terms`` squares of ``factor`` times its entries may leave 64 bits, else as it is."""
    most = max(abs(int(x.max())), abs(int(x.min()))) * factor if x.size else 0
    return x if most * most * terms < EXACT else x.astype(object)
