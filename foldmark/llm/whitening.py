"""Whitening of embeddings by the eigenvectors of their covariance.

Entries become integers first, floor(scale * c) + OFFSET, so sums are exact. One scan gives the number of vectors and the sums per
dimension, a second the scatter of the centred vectors: every task adds up one matrix of its rows, and Spark adds those up by
cell. The matrix, whose size depends on the dimension only, goes to the driver: pivoted Cholesky takes the covariance
apart into G G', one-sided Jacobi turns the columns of the triangular factor until they are orthogonal, and then their squared
lengths are the eigenvalues and their directions the components. The scatter of the whitened vectors is measured in
two more scans, its difference from the identity is reported with each row.

Vectors that are null or hold null or non-finite entries are left out. Shorter vectors end in zeros, so that none is lost.
A direction whose eigenvalue is below ``RANK`` of the largest has no component, since nothing but rounding could be
whitened there; equal vectors alone, a single vector and an empty table therefore give no rows. deviation is null
where the exact number does not fit a long. Repeated rows count and come back as often as they stand; a null vec_id
is kept; other columns are ignored. Entries may be up to 1e150, the dimension up to ``DIMENSIONS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
DIMENSIONS = 2_048  # the matrix on the driver has this many rows at most
RANK = 1e-11
SWEEPS = 60
SAFE = 2.0**62
LIMB = 10**18


def vectors(column: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are whole, and their entries as a matrix, shorter rows ending in zeros."""
    rows = np.nonzero(column.is_valid().to_numpy(zero_copy_only=False))[0]
    column = column.take(pa.array(rows))
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    ends = np.cumsum(size)
    whole = bad[ends] == bad[ends - size]
    width = max(width, int(size[whole].max(initial=0)))
    matrix = np.zeros((int(whole.sum()), width))
    matrix[np.arange(width) < size[whole, None]] = flat[np.repeat(whole, size)]
    return rows[whole], matrix


def scaled(matrix: np.ndarray, times: int = 1) -> np.ndarray:
    """floor(SCALE * entry), as long as ``times`` its size fits a long, else as Python numbers."""
    if np.abs(matrix).max(initial=0.0) * SCALE * times < SAFE:
        return np.floor(matrix * SCALE).astype(np.int64)
    whole = [int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in matrix.ravel().tolist()]
    return np.array(whole, object).reshape(matrix.shape)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums per dimension of a task's rows, in limbs of eighteen digits; dimension -1 has the number of rows."""
    n, total = 0, np.zeros(0, object)
    for batch in batches:
        _, matrix = vectors(batch.column("v"))
        n += len(matrix)
        found = scaled(matrix, len(matrix) + 1).sum(axis=0).astype(object)
        if len(found) > len(total):
            total = np.append(total, np.zeros(len(found) - len(total), object))
        total[: len(found)] += found
    limbs = []
    for i, s in enumerate((n, *total.tolist()), -1):
        sign, s = (1, s) if s >= 0 else (-1, -s)
        limbs.append((i, 0, sign * (s % LIMB)))
        while s := s // LIMB:
            limbs.append((i, limbs[-1][1] + 1, sign * (s % LIMB)))
    i, place, v = zip(*limbs)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(place, pa.int32()), pa.array(v, pa.int64())], ["i", "place", "v"])


def _centred(matrix: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * entry - sum, exact."""
    wide = scaled(matrix, 2 * n)
    if wide.dtype == object or max(map(abs, sums), default=0) >= SAFE / 2:
        return wide.astype(object) * n - np.array(sums, object)
    return wide * n - np.array(sums, np.int64)


def _scatter(shared):
    """Sums of products (i, j, v) of a task's centred rows, or of its whitened rows less ``mean``; without a mean, their sums (i, -1, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, basis, mean = shared.value
        total = 0.0
        for batch in batches:
            _, matrix = vectors(batch.column("v"), len(sums))
            z = _centred(matrix, n, sums).astype(np.float64) / n
            if basis is not None:
                z = z @ basis
            if mean is None:
                total = total + z.sum(axis=0)[:, None]
            else:
                z -= mean
                total = total + z.T @ z
        if np.ndim(total):
            i, j = np.indices(total.shape).astype(np.int32)
            j = j if mean is not None else j - 1
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def _added(rows: DataFrame, model: tuple, size: int) -> np.ndarray:
    """The matrix of the sums over all tasks; (size, 1) for sums of rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    cells = rows.mapInArrow(_scatter(shared), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # size squared rows
    out = np.zeros((size, size if model[3] is not None else 1))
    j = cells.column("j").to_numpy()
    out[cells.column("i").to_numpy(), np.maximum(j, 0)] = cells.column("v").to_numpy()
    return out


def pivoted_cholesky(matrix: np.ndarray, rank: float = RANK) -> np.ndarray:
    """G with G G' = matrix, triangular up to the order of its rows, with as many columns as pivots above ``rank`` of the first."""
    n = len(matrix)
    rest = np.diag(matrix).copy()
    order = np.arange(n)
    factor = np.zeros((n, n))
    limit = rank * rest.max(initial=0.0) / max(n, 1)
    for k in range(n):
        at = k + int(np.argmax(rest[order[k:]]))
        if not rest[order[at]] > limit:
            return factor[:, :k]
        order[[k, at]] = order[[at, k]]
        p, below = order[k], order[k + 1 :]
        factor[p, k] = np.sqrt(rest[p])
        factor[below, k] = (matrix[below, p] - factor[below, :k] @ factor[p, :k]) / factor[p, k]
        rest[below] -= factor[below, k] ** 2
    return factor


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of factor factor', by rotating pairs of columns until all are orthogonal.

    The pairs of a round share no column and turn at once; a sweep has every pair once.
    """
    g = factor.copy()
    r = g.shape[1]
    seats = np.arange(r + r % 2)  # an odd number sits one out
    tiny = np.finfo(float).eps * max(len(g), 1)
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(max(len(seats) - 1, 0)):
            p, q = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            a, b = g[:, p], g[:, q]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            size = np.sqrt(alpha * beta)
            worst = max(worst, float((np.abs(gamma) / np.where(size > 0, size, 1.0)).max(initial=0.0)))
            turn = gamma != 0
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(turn, np.copysign(1.0, zeta) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1.0 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * a - c * t * b, c * t * a + c * b
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if worst <= tiny:
            break
    e = (g * g).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > RANK * e.max(initial=0.0)]
    return e[order], g[:, order] / np.sqrt(e[order])


def _whiten(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, basis = shared.value
        for batch in batches:
            rows, matrix = vectors(batch.column("v"), len(sums))
            wide = _centred(matrix, n, sums)
            if wide.dtype != object and np.abs(wide).max(initial=0) ** 2.0 * len(sums) < SAFE:
                deviation = (wide * wide).sum(axis=1).tolist()
            else:
                deviation = [s if s < 1 << 63 else None for s in (sum(v * v for v in row) for row in wide.tolist())]
            z = (wide.astype(np.float64) / n) @ basis
            offsets = pa.array(np.arange(len(rows) + 1) * z.shape[1], pa.int32())
            columns = [batch.column("vec_id").take(pa.array(rows)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "w"])

    return run


def whitened(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error per whole vector and component."""
    rows = table.select("vec_id", F.col(vector).alias("v"))
    only = rows.select("v")
    found = only.mapInArrow(_sums, "i int, place int, v long").groupBy("i", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = found.filter(F.col("i") <= DIMENSIONS).collect()  # a few rows per dimension
    n = sum(int(r["v"]) for r in found if r["i"] < 0)
    width = 1 + max((r["i"] for r in found), default=-1)
    if width > DIMENSIONS:
        raise ValueError(f"vectors of more than {DIMENSIONS} entries")
    sums = [sum(int(r["v"]) * LIMB ** r["place"] for r in found if r["i"] == i) for i in range(width)]
    values, vectors_ = np.zeros(0), np.zeros((width, 0))
    trace = 0.0
    if n:
        covariance = _added(only, (n, sums, None, np.zeros(width)), width) / n
        trace = float(np.trace(covariance))
        values, vectors_ = jacobi(pivoted_cholesky(covariance))
    values, vectors_ = values[:components], vectors_[:, :components]
    basis = vectors_ / np.sqrt(values)
    error = 0.0
    if len(values):
        mean = _added(only, (n, sums, basis, None), len(values))[:, 0] / n
        error = float(np.abs(_added(only, (n, sums, basis, mean), len(values)) / n - np.eye(len(values))).max())
    shared = rows.sparkSession.sparkContext.broadcast((n, sums, basis))
    out = rows.mapInArrow(_whiten(shared), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, w array<double>")
    shares = F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
