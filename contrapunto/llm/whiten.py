"""Whitening of embeddings by shifted CholeskyQR.

Each vector becomes whole numbers, ``floor(SCALE * c) + OFFSET`` per entry.  The model is fitted on every
different vector once (``n`` of them, with sums ``S``), so a vector that fills a third of the rows counts
once.  Rows of the fit list are centred before anything is multiplied.

One pass makes the Gram matrix G of the rows as they are at that time, each task over its own blocks; the
partial matrices are summed by Spark, entry by entry.  R = cholesky(G + shift) then turns the rows into
Q = X R^-1 by a triangular solve in the next pass.  The shift makes the first factor exist however badly the
dimensions are scaled; passes are repeated until the Gram matrix of the rows is near the identity on the
space that they span; the root of that last matrix is the last factor.  The factors compose to one d x d matrix R, and its singular value decomposition gives the
components: right vectors, and singular values sqrt(n * e).  Dimensions that depend on others (constant or
repeated ones) keep a Gram entry of nothing, and their components, below ``RANK`` of the greatest singular
value, are left out: a direction without variance cannot be whitened.

Only d x d matrices and the sums reach the driver, never rows.  They do not grow with the rows.

Null vectors, vectors with a null, NaN or infinite entry, and vectors with an entry past 2**62 once scaled
are dropped.  So are empty ones.  All others need one length; another length is an error.  Rows with equal
ids and equal vectors all stay.  With fewer than two different vectors no direction has variance and no row
comes out; so do empty tables.  Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import durable, wanted

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
ROWS = 4096          # vectors a block holds
PASSES = 12
NEAR = 0.1           # how far the last Gram matrix may be from the identity; it is well conditioned then
SHIFT = 1e-3         # greatest shift, of the greatest eigenvalue
RANK = 1e-13         # of the greatest singular value; less is rounding
LONG = 1 << 62


def whole(flat: np.ndarray) -> np.ndarray:
    """Entries as whole numbers; ``LONG`` where an entry has none."""
    x = np.floor(flat.astype(np.float64) * SCALE)
    with np.errstate(invalid="ignore"):
        fits = np.abs(x) < LONG - OFFSET
    return np.where(fits, np.where(fits, x, 0).astype(np.int64) + OFFSET, LONG)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their whole-number vectors) of the usable rows of a batch (id, vector), by length."""
    for at in range(0, batch.num_rows, ROWS):
        lists = batch.column(1).slice(at, ROWS)
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        flat = lists.flatten()
        x = whole(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes)
        for d in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == d)
            v = x[(ends[rows] - d)[:, None] + np.arange(d)] if len(rows) < len(sizes) else x.reshape(-1, d)
            good = (v != LONG).all(axis=1)
            yield rows[good] + at, v[good]


def _quiet(fn: Callable) -> Callable:
    """``fn`` as a task's function; null rows of a batch never raise a warning."""
    def run(batches):
        with np.errstate(invalid="ignore", over="ignore"):
            yield from fn(batches)

    return run


def fit_list(vectors: DataFrame) -> DataFrame:
    """Every different whole-number vector once, as ``x``: eight bytes an entry."""
    def run(batches):
        for b in batches:
            for _, v in _blocks(b):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in v], pa.binary())], names=["x"])

    return wanted(vectors, "vec_id", "embedding").mapInArrow(_quiet(run), "x binary").distinct()


def _matrix(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    for at in range(0, batch.num_rows, ROWS):
        yield np.frombuffer(b"".join(batch.column(0).slice(at, ROWS).to_pylist()), dtype=np.int64).reshape(-1, d)


def sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""
    def run(batches):
        count, total = 0, None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                cells = b.column(0).slice(at, ROWS).to_pylist()
                if len({len(c) for c in cells} | ({8 * len(total)} if total else set())) > 1:
                    raise ValueError("embeddings of different lengths")
                x = np.frombuffer(b"".join(cells), dtype=np.int64).reshape(len(cells), -1)
                # 31 bits at a time, so that no sum of a block leaves 64 bits
                high, low = (x >> 31).sum(axis=0).tolist(), (x & 0x7FFFFFFF).sum(axis=0).tolist()
                own = [(h << 31) + w for h, w in zip(high, low)]
                total = own if total is None else [a + c for a, c in zip(total, own)]
                count += len(x)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([str(v) for v in [count, *total]])], names=["dim", "part"])

    parts = fit.mapInArrow(run, "dim int, part string").groupBy("dim").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    got = {r["dim"]: int(r["total"]) for r in parts.collect()}
    d = max(got, default=-1) + 1
    return got.get(-1, 0), [got[i] for i in range(d)]


@dataclass(frozen=True)
class Centre:
    """Exact deviations from the mean: (n * x - S), in 64 bits where they fit, else as Python integers."""

    n: int
    total: list[int]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        near = [s // self.n for s in self.total]
        rest = [s - self.n * m for s, m in zip(self.total, near)]
        if max(map(abs, near), default=0) < LONG:
            gap = x - np.array(near, dtype=np.int64)  # both below 2**62
            if len(gap) and int(np.abs(gap).max()) < LONG // self.n - 1:
                return gap * self.n - np.array(rest, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.total, dtype=object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.scaled(x) / self.n).astype(np.float64)

    def spread(self, x: np.ndarray) -> list[int]:
        """The sum over the dimensions of (n * x - S)**2, exactly."""
        y = self.scaled(x)
        if y.dtype != object and (not len(y) or int(np.abs(y).max()) < (LONG // max(1, y.shape[1])) ** 0.5 - 1):
            return (y * y).sum(axis=1).tolist()
        return [sum(int(v) * int(v) for v in r) for r in y]


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x R^-1 for an upper triangular R, column by column."""
    q = np.empty(x.shape, order="F")
    for j in range(r.shape[0]):
        q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def gram(fit: DataFrame, d: int, rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of the outer products of ``rows(x)``; one partial matrix a task, summed by Spark."""
    def run(batches):
        g = None
        for b in batches:
            for x in _matrix(b, d):
                y = rows(x)
                g = y.T @ y if g is None else g + y.T @ y
        if g is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(g)), len(g)), pa.int32()), pa.array(np.tile(np.arange(len(g)), len(g)), pa.int32()), pa.array(g.ravel())], names=["i", "j", "v"])

    cells = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j = (cells.column(c).to_numpy() for c in (0, 1))
    out = np.zeros((int(i.max()) + 1,) * 2)
    out[i, j] = cells.column(2).to_numpy()
    return (out + out.T) / 2


@dataclass(frozen=True)
class Whitening:
    """Mean, components (d x k, by falling eigenvalue), their eigenvalues and the trace of the covariance."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def white(self, x: np.ndarray) -> np.ndarray:
        return (self.centre.rows(x) @ self.components) / np.sqrt(self.eigenvalues)


def fitted(fit: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of a fit list; None where no direction has variance."""
    n, total = sums(fit)
    d, centre = len(total), None
    if n < 2:
        return None
    centre, factors, whole_r = Centre(n, total), [], np.eye(d)

    def rows(x):
        y = centre.rows(x)
        for r in factors:
            y = solved(y, r)
        return y

    for _ in range(PASSES):
        g = gram(fit, d, rows)
        values, vectors = np.linalg.eigh(g)
        # G = U diag(v) U': X'X = (diag(sqrt v) U' R)' (diag(sqrt v) U' R)
        _, sigma, right = np.linalg.svd(np.sqrt(np.maximum(values, 0))[:, None] * vectors.T @ whole_r)
        kept = sigma > RANK * sigma[0]
        if not sigma[0]:
            return None
        # done when the rows are nearly orthonormal on the space that counts: the last G carries what is left
        if factors and np.abs(values[d - kept.sum():] - 1).max() < NEAR:
            break
        shift = min(11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2, SHIFT) * values[-1]
        r = np.linalg.cholesky(g + shift * np.eye(d)).T
        factors.append(r)
        whole_r = r @ whole_r
    k = int(min(most, kept.sum()))
    return Whitening(centre, right[:k].T.copy(), sigma[:k] ** 2 / n, float((sigma ** 2).sum() / n))


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component; see the columns below.

    ``deviation`` is exact, and null where it is past a long; ``identity_error`` is the greatest entry of the
    covariance of the whitened fit list less the identity, from a pass of its own.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = durable(fit_list(vectors))
    model = fitted(fit, most)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, d, k = model.centre.n, len(model.centre.total), len(model.eigenvalues)
    error = float(np.abs(gram(fit, d, model.white) / n - np.eye(k)).max())
    share = model.eigenvalues / model.trace

    def run(batches):
        for b in batches:
            ids = b.column(0)
            for rows, x in _blocks(b):
                if not len(rows):
                    continue
                spread = [v if v < 1 << 63 else None for v in model.centre.spread(x)]
                each = lambda column: column.take(pa.array(np.repeat(np.arange(len(rows)), k)))
                yield pa.RecordBatch.from_arrays(
                    [each(ids.take(pa.array(rows))), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(len(rows) * k, n)), each(pa.array(spread, pa.int64())),
                     pa.array(model.white(x).ravel()), pa.array(np.tile(share, len(rows))), pa.array(np.full(len(rows) * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_quiet(run), schema)
