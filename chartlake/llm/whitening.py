"""Embedding whitening by QDWH spectral divide and conquer.

Vectors are put on an integer grid. The covariance of the distinct grid vectors comes from partial sums: each task
centres its rows and adds up one dimension-by-dimension matrix, and Spark adds those. The matrix is small (its side is
the dimension, not the row count), so it is split on the driver: the polar factor of the covariance shifted by a
number is the matrix sign, half of sign plus identity projects on the eigenvectors above the shift, a basis of that
space and of its complement makes the matrix block diagonal, and both blocks are split again until they are diagonal.
The polar factor itself comes from the dynamically weighted Halley iteration (QR steps while a step's weight is
large, Cholesky steps after). The components then go to all tasks as one small matrix that whitens rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import stored
from chartlake.llm.vectors import matrix

#: Components below this share of the largest variance count as constant directions, which cannot be whitened.
FLAT = 1e-10
_EPS = np.finfo(float).eps
_LONG = 2**63


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the QR-based dynamically weighted Halley iteration."""
    n, scale = len(a), np.linalg.norm(a)
    if not scale:
        return np.eye(n)
    x, low = a / scale, _EPS / 16  # a lower bound of all singular values that count; a smaller one only costs a step
    for _ in range(30):
        sq = low * low
        d = (4 * (1 - sq) / (sq * sq)) ** (1 / 3) if low < 1 else 0.0
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - sq) / (sq * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))[0]
            y = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            z = np.linalg.cholesky(np.eye(n) + wc * x.T @ x)
            y = wb / wc * x + (wa - wb / wc) * np.linalg.solve(z.T, np.linalg.solve(z, x.T)).T
        y = (y + y.T) / 2
        low = min(1.0, low * (wa + wb * sq) / (1 + wc * sq))
        moved, x = np.linalg.norm(y - x), y
        if low > 1 - 1e-14 and moved < 1e-13 * n:
            break
    return x


def _split(a: np.ndarray, rng: np.random.RandomState) -> tuple[np.ndarray, int] | None:
    """(orthonormal basis, k): the first k columns span the eigenvectors above some shift, the others the rest."""
    n, mean = len(a), np.trace(a) / len(a)
    wide = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    shifts = [float(np.median(np.diag(a))), mean] + [mean + s * wide for s in (0.01, -0.01, 0.03, -0.03, 0.1, -0.1, 0.3, -0.3)]
    for shift in shifts:
        p = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(p)))
        # an eigenvalue at the shift itself belongs to neither side: another shift
        if 0 < k < n and np.linalg.norm(p @ p - p) < 1e-9:
            q = np.linalg.qr(p @ rng.standard_normal((n, k)))[0]
            return np.linalg.qr(p @ q, mode="complete")[0], k
    return None


def spectral_components(v: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix by spectral divide and conquer."""
    v = (v + v.T) / 2
    size, rng = np.linalg.norm(v), np.random.RandomState(seed)
    todo, done = [(v, np.eye(len(v)))], []
    while todo:
        a, basis = todo.pop()
        rest = np.linalg.norm(a - np.diag(np.diag(a)))
        halves = _split(a, rng) if rest > _EPS * size and len(a) > 1 else None
        if halves is None:
            if rest > 1e-9 * size:
                raise ArithmeticError("no shift divides the spectrum")
            done.append(basis)
            continue
        q, k = halves
        for part in (q[:, :k], q[:, k:]):
            b = part.T @ a @ part
            todo.append(((b + b.T) / 2, basis @ part))
    vectors = np.hstack(done)
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(v))])
    return values[order], vectors * sign


def grid_vectors(rows: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """vec_id, x (array of long) = floor(scale * component); rows whose vector is null or holds null or non-finite entries go."""
    inf = float("inf")
    v = F.transform(F.col(embedding), lambda c: c.cast("double"))
    ok = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf))
    return (rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull())
            .filter(F.coalesce(ok, F.lit(False))).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x")))


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(number of fit vectors, exact sum of each dimension)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for b in batches:
            x = matrix(b.column("x"), dim, np.int64)
            if not len(x):
                continue
            wide = int(max(-int(x.min()), int(x.max()))) * len(x) >= _LONG
            n += len(x)
            total = [t + int(s) for t, s in zip(total, (x.astype(object) if wide else x).sum(0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dim), pa.int32()), pa.array([Decimal(s) for s in [n, *total]], pa.decimal128(38, 0))], ["i", "s"])

    got = fit.select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    of = {r.i: int(r.s) for r in got}
    return of.get(-1, 0), [of.get(i, 0) for i in range(dim)]


def _products(fit: DataFrame, dim: int, centre: np.ndarray, basis: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the centred fit vectors, projected on ``basis`` if given. One matrix a task."""
    side = dim if basis is None else basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = np.zeros(side), np.zeros((side, side))
        for b in batches:
            y = matrix(b.column("x"), dim) - centre
            y = y if basis is None else y @ basis
            total += y.sum(0)
            both += y.T @ y
        i, j = np.triu_indices(side)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(side, -1), i]).astype(np.int32)), pa.array(np.concatenate([np.arange(side), j]).astype(np.int32)),
             pa.array(np.concatenate([total, both[i, j]]))], ["i", "j", "s"])

    got = fit.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total, both = np.zeros(side), np.zeros((side, side))
    for r in got:
        if r.i < 0:
            total[r.j] = r.s
        else:
            both[r.i, r.j] = both[r.j, r.i] = r.s
    return total, both


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)^2; None beyond the largest long."""
    most = max([abs(int(x.min())), abs(int(x.max()))]) * n + max(abs(s) for s in sums)
    if most < _LONG:
        t = n * x - np.array(sums, np.int64)
        wrapped = (t.view(np.uint64) * t.view(np.uint64)).sum(1, dtype=np.uint64)  # exact modulo 2^64
        near = (t.astype(float) ** 2).sum(1)
        out: list[int | None] = wrapped.tolist()
        unsure = np.flatnonzero(near > 0.999 * _LONG)
    else:
        out, unsure = [None] * len(x), np.arange(len(x))
    for k in unsure:
        d = sum((n * int(a) - s) ** 2 for a, s in zip(x[k], sums))
        out[k] = d if d < _LONG else None
    return out


def whiten(rows: DataFrame, components: int = 4, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable row and each of the leading
    ``components`` (all other columns are left out, whatever their names).

    Rows whose vector is null or holds null or non-finite entries go. The fit list is every distinct grid vector once, so
    repeated rows do not weigh more, yet each of them is whitened. Null and repeated ids are kept. Vectors shorter than
    the longest are filled with zeros. Components are numbered by falling eigenvalue; equal eigenvalues share their
    space in an order fixed by the matrix; the largest entry of each is positive. Directions without variance (below
    ``FLAT`` of the largest) are no components, so a table of one distinct vector, of empty vectors, or an empty table gives
    no rows. ``deviation`` is null where it does not fit a long (about n > 10^7 at 64 dimensions).

    One shuffle finds the distinct vectors. Sums, products and the check of the result are partial sums of at most
    dimension^2 numbers a task; the driver holds a few matrices of that size.
    """
    spark = rows.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    grid = grid_vectors(rows, vec_id, embedding, scale)
    least, dim = grid.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if not dim:
        return spark.createDataFrame([], schema)
    if least < dim:
        grid = grid.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("x"))))
    fit = stored(grid.select("x").distinct())
    n, sums = _sums(fit, dim)
    centre = np.array([s / n for s in sums])
    cov = _products(fit, dim, centre)[1] / n
    values, vectors = spectral_components(cov)
    k = int((values[:components] > FLAT * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    if not k:
        return spark.createDataFrame([], schema)
    basis = vectors[:, :k] / np.sqrt(values[:k])
    mean, both = _products(fit, dim, centre, basis)
    error = float(np.abs(both / n - np.outer(mean, mean) / n / n - np.eye(k)).max())
    explained = values[:k] / np.trace(cov)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"), dim, np.int64)
            at = pa.array(np.repeat(np.arange(len(x)), k))
            w = (x.astype(float) - centre) @ basis
            yield pa.RecordBatch.from_arrays([
                b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(at), n, np.int64)), pa.array(_deviations(x, n, sums), pa.int64()).take(at),
                pa.array(w.reshape(-1)), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(at), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(run, schema)
