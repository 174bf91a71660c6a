"""Whitening of embeddings by FEAST: contour integration for the leading eigenvectors of a covariance.

Entries become whole numbers x = floor(256 * c).  The fit list is each different x vector once; its sums are
exact, its covariance a sum of small matrices, one a task.  The eigenproblem has the size of a vector, not of the
table, and is solved by the driver:

* an interval [low, high] with the wanted eigenvalues comes from inertia counts: by Sylvester's law, V - s*I has as
  many positive pivots as V has eigenvalues above s;
* the spectral projector of the interval is a contour integral of (z*I - V)^-1 around it; Gauss-Legendre nodes on the
  half ellipse give complex shifted solves, whose weighted sum projects a block of vectors (``feast``);
* Rayleigh-Ritz in the projected space gives eigenpairs; rounds go on until residuals are at rounding level;
* the number of eigenpairs found is held against the inertia counts, so that none is missed.

Rows are then projected by one pass over the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

SCALE = 256
COMPONENTS = 4
#: nodes on the half contour
NODES = 12
#: a whole number up to this size and its squares' sums fit 64 bits in a numpy step
SMALL = 1 << 24

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


class Inertia:
    """Counts of eigenvalues of a symmetric matrix above a shift, by the signs of the pivots of the shifted matrix.

    The matrix is brought to tridiagonal form once, by reflections, which leave its eigenvalues; each count is then one
    elimination along the diagonal.
    """

    def __init__(self, v: np.ndarray):
        a = np.array(v, float)
        d = len(a)
        for k in range(d - 2):
            u = a[k + 1 :, k].copy()
            length = np.linalg.norm(u)
            if length == 0:
                continue
            u[0] += length if u[0] >= 0 else -length
            u /= np.linalg.norm(u)
            a[k + 1 :, k:] -= 2 * np.outer(u, u @ a[k + 1 :, k:])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
        self.diagonal, self.beside = np.diag(a).tolist(), np.diag(a, 1).tolist()
        #: all eigenvalues lie between -reach and reach
        self.reach = float(np.abs(np.asarray(v, float)).sum(1).max(initial=0.0)) * (1 + 1e-6) + 1e-300

    def above(self, shift: float) -> int:
        found, pivot, tiny = 0, 1.0, self.reach * 1e-30
        for a, b in zip(self.diagonal, [0.0, *self.beside], strict=True):
            pivot = a - shift - b * (b / pivot)
            if abs(pivot) < tiny:
                pivot = -tiny
            found += pivot > 0
        return found

    def nth(self, n: int) -> float:
        """The n-th largest eigenvalue, to about 1e-12 of the largest, by halving."""
        low, high = -self.reach, self.reach
        while high - low > 1e-12 * self.reach:
            mid = (low + high) / 2
            low, high = (mid, high) if self.above(mid) >= n else (low, mid)
        return (low + high) / 2

    def interval(self, wanted: int) -> tuple[float, float, int]:
        """(low, high, eigenvalues between): the first ``wanted``, and those that agree with the last of them to rounding."""
        d = len(self.diagonal)
        while wanted < d:
            last, after = self.nth(wanted), self.nth(wanted + 1)
            if last - after > 1e-10 * self.reach:
                return (last + after) / 2, self.reach, wanted
            wanted += 1
        return -self.reach, self.reach, d


def feast(v: np.ndarray, low: float, high: float, count: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of ``v`` in (low, high], of which inertia counts say there are ``count``.

    Raises if the pairs found are not as many, or have not settled.
    """
    d = len(v)
    block = min(d, count + max(4, count // 2))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angle = -np.pi / 2 * (nodes - 1)
    shifts = centre + radius * (np.cos(angle) + 1j * np.sin(angle))
    turn = radius * (np.cos(angle) + 1j * np.sin(angle))
    norm, eye = max(float(np.abs(v).sum(1).max()), 1e-300), np.eye(d)
    y = np.random.default_rng(11).standard_normal((d, block))
    for _ in range(rounds):
        # half the contour is enough: the other half is its conjugate
        q = sum(w / 2 * np.real(t * np.linalg.solve(z * eye - v, y)) for w, t, z in zip(weights, turn, shifts, strict=True))
        q, _ = np.linalg.qr(q)
        values, small = np.linalg.eigh(q.T @ v @ q)
        y = q @ small
        inside = (values > low) & (values <= high)
        rest = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0)
        if inside.sum() == count and (rest <= 1e-14 * norm * np.sqrt(d)).all():
            order = np.argsort(-values[inside], kind="stable")
            return values[inside][order], y[:, inside][:, order]
    raise RuntimeError(f"eigenpairs have not settled: {int(inside.sum())} of {count} found, residuals {rest.max(initial=0.0):g}")


def components_of(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The first ``wanted`` eigenvalues above rounding level and their vectors, eigenvalues falling."""
    floor = len(v) * np.finfo(float).eps * max(float(np.trace(v)), 0.0)
    inertia = Inertia(v)
    wanted = min(wanted, inertia.above(floor) if floor > 0 else 0)
    if not wanted:
        return np.zeros(0), np.zeros((len(v), 0))
    values, vectors = feast(v, *inertia.interval(wanted))
    return values[:wanted], vectors[:, :wanted]


def _whole(embedding: str) -> Column:
    """x of each entry; beyond 64 bits the nearest long."""
    return F.transform(F.col(embedding), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    c = F.col("embedding")
    odd = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    rows = vectors.where(c.isNotNull() & ~F.exists(c, odd)).select(F.col("vec_id").cast("long").alias("vec_id"), _whole("embedding").alias("x"))
    # vectors of the commonest length take part (of equally common ones the longest)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.col("rows").desc(), F.col("d").desc()).first()
    return rows.where(F.size("x") == (lengths.d if lengths else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column("x")
    return x.flatten().to_numpy().reshape(len(x), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, sum of entry i as text, rows) of a task: exact at any size."""
    n, total = 0, None
    for batch in batches:
        if len(batch):
            x = _matrix(batch)
            part = (x if np.abs(x).max(initial=0) < SMALL and len(x) < SMALL else x.astype(object)).sum(0).astype(object)
            n, total = n + len(x), part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "total": [str(int(t)) for t in total], "n": pa.array([n] * len(total), pa.int64())})


def _products(centre: np.ndarray, weights: np.ndarray | None):
    """(i, row i of the sum of outer products) of a task, of centred vectors or of their projections."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(batch):
                x = _matrix(batch).astype(float) - centre
                x = x if weights is None else x @ weights
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    return work


def covariance(fit: DataFrame, n: int, centre: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Covariance (divisor n) of the fit list, or of its whitened components; as large as a vector, squared."""
    d = len(centre) if weights is None else weights.shape[1]
    cells = fit.mapInArrow(_products(centre, weights), "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for c in cells.collect():
        out[c.i, c.j] = c.v
    return (out + out.T) / 2 / n


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of ``vectors`` (vec_id, embedding).

    Left out: null vectors, vectors with null, NaN or infinite entries, and vectors of another length than the commonest.
    Equal vectors count once in the fit and are all returned, also where ids repeat or are null.  Components whose eigenvalue
    is zero to rounding have no whitened value and are not returned (one vector, or equal ones, give no rows), nor are more
    components than entries.  ``deviation`` is null where it does not fit 64 bits; ``deviation_exact`` always holds it, up to
    38 digits.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = frames.materialise(usable(vectors), "whole-vectors")
    fit = frames.materialise(rows.select("x").distinct(), "fit-list")
    totals = fit.mapInArrow(_sums, "i int, total string, n long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    sums = [int(t.total) for t in sorted(totals, key=lambda t: t.i)]
    n = totals[0].n if totals else 0
    centre = np.array([s / n for s in sums], float)
    v = covariance(fit, n, centre) if n else np.zeros((0, 0))
    values, axes = components_of(v, components)
    weights = axes / np.sqrt(values)
    error = float(np.abs(covariance(fit, n, centre, weights) - np.eye(len(values))).max()) if len(values) else 0.0
    explained = (values / np.trace(v)).tolist() if len(values) else []
    return rows.mapInArrow(_projected(n, sums, centre, weights, explained, error), WHITENED)


def _projected(n: int, sums: list[int], centre: np.ndarray, weights: np.ndarray, explained: list[float], error: float):
    squares, k = sum(s * s for s in sums), len(explained)
    total = np.array(sums, object)

    def deviations(x: np.ndarray) -> list[int]:
        """Sum of (n * x - S)^2 of each row, in whole numbers."""
        small = np.abs(x).max(initial=0) < SMALL
        own = (x * x).sum(1).tolist() if small else (x.astype(object) ** 2).sum(1).tolist()
        cross = (x.astype(object) @ total).tolist()
        return [n * n * a - 2 * n * b + squares for a, b in zip(own, cross, strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not k:
                continue
            x = _matrix(batch)
            far = deviations(x)
            exact = pa.array([f if f < 10**38 else None for f in far], pa.decimal128(38, 0))
            far = pa.array([f if f < 1 << 63 else None for f in far], pa.int64())
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), "n": pa.array(np.full(len(each), n), pa.int64()),
                    "deviation": far.take(pa.array(each)), "whitened": ((x.astype(float) - centre) @ weights).ravel(), "explained": np.tile(explained, len(x)),
                    "identity_error": np.full(len(each), error), "deviation_exact": exact.take(pa.array(each)),
                }
            )

    return work
