"""Operator 13: whitening of vectors by shifted CholeskyQR.

The centred rows ``A`` are never gathered.  Each pass sends every row through the triangular
solves of the factors found so far, adds up the Gram matrix of the result in the tasks and
over the cluster, and takes its Cholesky factor on the driver (``d x d`` numbers).  The first
factor, of a shifted matrix, always exists and makes the rows well conditioned; the next ones
make them orthogonal to double precision.  ``A = Q R`` with ``R`` the product of all factors,
and the singular values and right vectors of ``R`` are those of ``A``.  So the covariance,
whose condition number is the square of ``A``'s, is never factored itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio.llm.common import column
from opinio.llm.vectors import matrix, scaled_floor, usable

#: ``x = floor(SCALE * c) + OFFSET``.
SCALE, OFFSET = 1024.0, 100_000
#: Entries beyond this size count as this size (so that sums of them are exact).
MOST = 1 << 40
#: A pass ends the loop when its rows' Gram matrix is so near the identity.
ORTHOGONAL, PASSES = 1e-6, 6
#: Components whose singular value is this share of the largest have no variance.
NO_VARIANCE = 1e-12
UNIT = 2.0 ** -53


class Centred:
    """Exact integers and centred doubles of a batch's vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.width = n, len(sums)
        self.quotient = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def integers(self, batch: pa.RecordBatch) -> np.ndarray:
        x = scaled_floor(matrix(batch.column("vector"), self.width), SCALE, MOST) + OFFSET
        return x - self.quotient

    def rows(self, whole: np.ndarray) -> np.ndarray:
        """``x - S / n``: the whole part is taken off as integers, so nothing cancels."""
        return whole.astype(np.float64) - self.rest / self.n

    def deviations(self, whole: np.ndarray) -> list[int | None]:
        """``sum((n * x - S) ** 2)``, exact; null beyond a long."""
        most = self.n * (int(np.abs(whole).max(initial=0)) + 1)
        if most * most * max(1, self.width) < 1 << 63:
            exact = self.n * whole - self.rest
            return (exact * exact).sum(axis=1).tolist()
        exact = self.n * whole.astype(object) - self.rest.astype(object)
        sums = (exact * exact).sum(axis=1).tolist()
        return [s if s < 1 << 63 else None for s in sums]


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Rows ``y`` with ``y R = a`` for an upper triangular ``R``, column by column."""
    y = np.empty_like(a)
    for j in range(len(r)):
        y[:, j] = (a[:, j] - y[:, :j] @ r[:j, j]) / r[j, j]
    return y


class Sums:
    """One row per component and task: the exact sum of its integers."""

    def __init__(self, width: int):
        self.width = width

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * self.width
        for b in batches:
            x = scaled_floor(matrix(b.column("vector"), self.width), SCALE, MOST) + OFFSET
            total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        # Decimal: the sum over a large corpus may leave a long.
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(self.width), pa.int32()),
                                          "v": pa.array([str(t) for t in total], pa.string())})


class Gram:
    """Upper triangle of the Gram matrix of ``image(rows)``, one row per entry and task."""

    def __init__(self, centred: Centred, image):
        self.centred, self.image = centred, image

    def __call__(self, batches):
        total = None
        for b in batches:
            y = self.image(self.centred.rows(self.centred.integers(b)))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i * len(total) + j, pa.int32()), "v": pa.array(total[i, j])})


class Through:
    """Rows through the triangular solves of all factors so far."""

    def __init__(self, factors: list[np.ndarray]):
        self.factors = factors

    def __call__(self, a: np.ndarray) -> np.ndarray:
        for r in self.factors:
            a = solved(a, r)
        return a


class Project:
    """Rows on the components, over the standard deviation along each; with a column of ones."""

    def __init__(self, vectors: np.ndarray, deviation: np.ndarray, ones: bool):
        self.w, self.ones = vectors / np.where(deviation > 0, deviation, np.nan), ones

    def __call__(self, a: np.ndarray) -> np.ndarray:
        y = a @ self.w
        return np.column_stack([np.ones(len(y)), y]) if self.ones else y


def _gram(rows: DataFrame, centred: Centred, image, width: int) -> np.ndarray:
    parts = rows.mapInArrow(Gram(centred, image), "i int, v double")
    out = np.zeros(width * width)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # at most width * width rows
        out[r.i] = r.v
    upper = out.reshape(width, width)
    return upper + np.triu(upper, 1).T


def triangular(rows: DataFrame, centred: Centred) -> np.ndarray:
    """``R`` of the centred rows, by passes of shifted CholeskyQR."""
    d, factors = centred.width, []
    for _ in range(PASSES):
        g = _gram(rows, centred, Through(factors), d)
        size = np.trace(g)
        if not size:
            return np.zeros((d, d))
        shift = 11 * (centred.n * d + d * (d + 1)) * UNIT * size
        near = bool(factors) and np.abs(g - np.eye(d)).max() <= ORTHOGONAL
        try:
            if not factors:
                raise np.linalg.LinAlgError("the first factor is shifted")
            factors.append(np.linalg.cholesky(g).T)
        except np.linalg.LinAlgError:
            factors.append(np.linalg.cholesky(g + shift * np.eye(d)).T)
        if near:
            break
    r = np.eye(d)
    for f in factors:
        r = f @ r
    return r


class Whitened:
    """Rows to one row per component."""

    def __init__(self, centred: Centred, image: Project, explained: list[float | None], error: float | None):
        self.centred, self.image, self.explained, self.error = centred, image, explained, error

    def __call__(self, batches):
        k = len(self.explained)
        for b in batches:
            whole = self.centred.integers(b)
            n, y = len(whole), self.image(self.centred.rows(whole))
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(n), k)))
            flat = y.ravel()
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, self.centred.n), pa.int64()),
                pa.array(self.centred.deviations(whole), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(flat, pa.float64(), mask=np.isnan(flat)), pa.array(self.explained * n, pa.float64()),
                pa.array([self.error] * (n * k), pa.float64())],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per usable
    row and each of the first ``components`` components.

    Rows whose vector is null or holds a null or non-finite entry are dropped; a null or
    repeated id and repeated rows are rows like others.  Vectors shorter than the longest
    count as filled up with zeros; entries beyond 2**40 count as 2**40.  A component without
    variance has null ``whitened`` and is left out of ``identity_error``; without any
    variance ``explained`` and ``identity_error`` are null.  ``deviation`` is null where it
    exceeds a long.  No usable row, or only empty vectors, give no rows.
    """
    vector = column(vectors, vector_col)
    rows = vectors.select(column(vectors, id_col).alias("vec_id"), vector.alias("vector")).where(usable(F.col("vector")))
    whole = [(c, T.LongType()) for c in ("n", "deviation")]
    real = [(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    out = T.StructType([rows.schema["vec_id"], *[T.StructField(*f) for f in [("component", T.IntegerType()), *whole, *real]]])
    n, d = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n or not d:
        return vectors.sparkSession.createDataFrame([], out)
    summed = rows.mapInArrow(Sums(d), "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums = {r.i: int(r.v) for r in summed.collect()}
    centred = Centred(n, [sums[i] for i in range(d)])
    _, singular, axes = np.linalg.svd(triangular(rows, centred))
    axes *= np.where(axes[np.arange(d), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]
    total, k = float((singular ** 2).sum()), min(components, d)
    kept = np.where(singular > NO_VARIANCE * singular[0], singular, 0)[:k]
    image = axes[:k].T, kept / np.sqrt(n)
    explained = [float(s * s / total) if total else None for s in kept]
    error = None
    if kept.any():
        live = int((kept > 0).sum())
        g = _gram(rows, centred, Project(image[0][:, :live], image[1][:live], ones=True), live + 1) / n
        error = float(np.abs(g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) - np.eye(live)).max())
    return rows.mapInArrow(Whitened(centred, Project(*image, ones=False), explained, error), out)
