"""Whitening of embeddings by randomised principal components.

Vectors become integers (see ``vectors``), all usable rows are the fit list. A randomised range finder multiplies the
covariance, as one pass over all centred rows, with a seeded Gaussian matrix of ``components + OVERSAMPLE`` columns;
``PASSES`` more power passes follow, each on an orthonormal basis of what the last gave. Rayleigh-Ritz on the basis gives
eigenpairs and, from the same pass, their residuals. Where a residual is above ``RESIDUAL`` of the largest eigenvalue, the
basis is expanded to the full dimension, on which Rayleigh-Ritz is exact. Only dimension x basis sums leave a task; their number
does not depend on the rows.

Result: one row per vector and component. ``deviation`` is exact (an error is raised where it exceeds a long). Components
whose eigenvalue is not above rounding (1e-13 of the trace) have no whitened form and are left out, so equal vectors
or a single one give no rows. The sign makes a component's largest entry positive. Repeated rows and repeated or null ids count as rows of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import EXACT, exact, integer_vectors, matrix

OVERSAMPLE, PASSES, RESIDUAL, SEED = 10, 4, 1e-13, 20240317


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` integer vectors: exact sums, unit components (columns) and their eigenvalues, and the covariance's trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    expanded: bool

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: Python integers where 64 bits may not hold them or the sum of their squares."""
        large = max(self.n * int(np.abs(x).max(initial=0)), int(np.abs(self.sums).max(initial=0)))
        return self.n * (x if large < 2**61 else x.astype(object)) - self.sums

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.eigenvalues)


def _reduce(rows: DataFrame, d: int, shape: tuple[int, int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of the matrices that ``of`` gives for blocks of rows; each task sends one matrix."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += of(matrix(b.column(0), d))
        i, j = np.indices(shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    out = np.zeros(shape)
    for r in rows.select("x").mapInArrow(part, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # shape's entries
        out[r["i"], r["j"]] = r["v"]
    return out


def _sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0), d)
                s = (x if len(x) * int(np.abs(x).max()) < EXACT else x.astype(object)).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([int(v) for v in s], pa.int64()), pa.array(np.full(d, len(x)))], ["i", "s", "n"])

    got = rows.select("x").mapInArrow(part, "i long, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # one row a dimension
    return (got[0]["n"], np.array([r["s"] for r in got], np.int64)) if got else (0, np.zeros(d, np.int64))


def fit(rows: DataFrame, d: int, components: int = 32, passes: int = PASSES, residual: float = RESIDUAL) -> Whitening | None:
    """Rayleigh-Ritz components of the covariance of ``rows`` (x array<long> of length d, a written table); None without rows."""
    n, sums = _sums(rows, d)
    if not n:
        return None
    base = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, False)

    def times(q: np.ndarray) -> tuple[np.ndarray, float]:
        """Covariance times q, and the covariance's trace."""

        def block(x: np.ndarray) -> np.ndarray:
            c = base.centred(x)
            return np.column_stack((c.T @ (c @ q), (c * c).sum(0)))

        v = _reduce(rows, d, (d, q.shape[1] + 1), block) / n
        return v[:, :-1], float(v[:, -1].sum())

    k = min(components, d)
    width = min(d, k + OVERSAMPLE)
    q = np.eye(d) if width == d else np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    for turn in range(passes + 2):
        z, trace = times(q)
        b = q.T @ z
        e, w = np.linalg.eigh((b + b.T) / 2)
        e, w = e[::-1][:k], w[:, ::-1][:, :k]
        u = q @ w
        off = np.linalg.norm(z @ w - u * e, axis=0).max(initial=0.0)
        if q.shape[1] == d or (turn and off <= residual * max(float(e[0]), 0.0)):
            break
        q = np.eye(d) if turn == passes else np.linalg.qr(z)[0]
    keep = e > 1e-13 * trace
    u, e = u[:, keep], e[keep]
    u = u / np.linalg.norm(u, axis=0)
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, u, e, trace, q.shape[1] == d and width < d)


def identity_error(rows: DataFrame, d: int, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    mean = _reduce(rows, d, (1, k), lambda x: model.apply(x).sum(0, keepdims=True)) / model.n

    def block(x: np.ndarray) -> np.ndarray:
        y = model.apply(x) - mean
        return y.T @ y

    return float(np.abs(_reduce(rows, d, (k, k), block) / model.n - np.eye(k)).max())


def whiten(df: DataFrame, components: int = 32, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error; see the module's text."""
    rows, d = integer_vectors(df, {"vec_id": id_col}, vector_col, scale, shift)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, d, components) if d else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, d, model), len(model.eigenvalues)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m or not k:
                continue
            x = matrix(b.column(1), d)
            off = exact(model.deviations(x), d)
            deviation = pa.array([int(v) for v in (off * off).sum(1)], pa.int64())
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), deviation.take(at),
                    pa.array(model.apply(x).ravel()), pa.array(np.tile(model.eigenvalues / model.trace, m)), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(apply, schema)
