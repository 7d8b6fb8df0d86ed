"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on the factor."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screentime.llm.common import arrow_map, batch, broadcast

#: Fixed point of an entry: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries from this size on leave the float64 products for Python integers.
FLOAT_EXACT = 1 << 22
#: Largest scaled entry; with the offset it still is a long.
LARGEST = float(1 << 62)
#: Digits of a decimal column: sums of products are carried in it.
SUM_TYPE = "decimal(38,0)"


class Fit(NamedTuple):
    """What the corpus tells: row count, integer sums, components as columns and their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite and small enough for the fixed point."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < F.lit(LARGEST), F.lit(False))), F.lit(False)
    )


def fixed_point(column: pa.ListArray, dims: int) -> np.ndarray:
    """floor(64 * c) of a list column as an integer matrix; the offset cancels in everything centred."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dims)


def exact_scatter(x: np.ndarray) -> np.ndarray:
    """``x.T @ x`` without rounding, as Python integers.

    Blocks whose sums stay below 2^53 are exact in float64; rows with larger entries
    are multiplied as Python integers.
    """
    dims = x.shape[1]
    total = np.zeros((dims, dims), object)
    size = np.abs(x).max(axis=1, initial=0)
    small, large = x[size < FLOAT_EXACT], x[size >= FLOAT_EXACT].astype(object)
    if len(small):
        rows = max(1, (1 << 53) // max(1, int(np.abs(small).max()) ** 2))
        for at in range(0, len(small), rows):
            part = small[at : at + rows].astype(np.float64)
            total = total + (part.T @ part).astype(np.int64).astype(object)
    if len(large):
        total = total + large.T @ large
    return total


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factor and pivot order with ``matrix[order][:, order] = L @ L.T``; stops at the numerical rank."""
    left = np.array(matrix, np.longdouble)
    dims = len(left)
    order = np.arange(dims)
    factor = np.zeros((dims, dims), np.longdouble)
    least = dims * np.finfo(np.longdouble).eps * max(left.diagonal().max(initial=0), 0)
    for k in range(dims):
        at = k + int(np.argmax(left.diagonal()[k:]))
        if not left[at, at] > least:
            return factor[:, :k], order
        swap = [at, k]
        for a in (left, factor, order):
            a[[k, at]] = a[swap]
        left[:, [k, at]] = left[:, swap]
        factor[k, k] = np.sqrt(left[k, k])
        factor[k + 1 :, k] = left[k + 1 :, k] / factor[k, k]
        left[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Columns of ``factor`` rotated in pairs until all are orthogonal.

    A sweep meets every pair once, in rounds of disjoint pairs (circle method), so a
    round is one array operation.
    """
    a = np.array(factor, np.longdouble)
    count = a.shape[1]
    seats = np.arange(count + count % 2)
    done = 4 * np.finfo(np.longdouble).eps * max(1, count)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            real = (p < count) & (q < count)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            scale = np.sqrt(xx) * np.sqrt(yy)
            worst = max(worst, float((np.abs(xy) / np.where(scale > 0, scale, 1)).max(initial=0)))
            turn = np.where(xy == 0, 1, xy)
            zeta = (yy - xx) / (2 * turn)
            t = np.where(xy == 0, 0, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)))
            c = 1 / np.sqrt(1 + t * t)
            s = c * t
            a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))
        if worst <= done:
            break
    return a


def principal_axes(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, up to the rank of ``scatter``."""
    factor, order = pivoted_cholesky(scatter)
    rotated = jacobi_columns(factor)
    norms = np.sqrt((rotated * rotated).sum(0))
    falling = np.argsort(-norms, kind="stable")
    axes = np.empty_like(rotated)
    axes[order] = rotated[:, falling] / norms[falling]
    return norms[falling] ** 2, axes


def _sum_cells(df: DataFrame, fn, kind: str) -> np.ndarray:
    """Sums of numbered cells that each task of ``fn`` tells once, as one driver array; cells depend on the width only."""
    found = arrow_map(df, fn, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(found.num_rows, object)
    out[found.column("cell").to_numpy()] = found.column("value").to_pylist()
    return out


def fit_whitening(crops: DataFrame, dims: int, vector_col: str = "embedding", components: int = 32) -> Fit | None:
    """Principal axes of the fixed-point vectors of all ``crops`` (usable, ``dims`` wide); None without rows.

    Each task adds its products up exactly and sends one row per cell of the
    triangle; the sums, ``dims * (dims + 3) / 2`` numbers at any row count, reach the
    driver. The scatter ``n * sum(x x') - S S'`` is formed in integers, so centring
    loses nothing.
    """
    upper = np.triu_indices(dims)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for b in batches:
            x = fixed_point(b.column(0), dims)
            n += len(x)
            sums = sums + (x.astype(object).sum(0) if len(x) and int(np.abs(x).max()) >= FLOAT_EXACT else x.sum(0).astype(object))
            products = products + exact_scatter(x)
        if n:
            values = [Decimal(int(v)) for v in (n, *sums, *products[upper])]
            yield batch(["cell", "value"], pa.array(range(len(values)), pa.int32()), pa.array(values, pa.decimal128(38, 0)))

    cells = _sum_cells(crops.select(vector_col), add, SUM_TYPE)
    if not len(cells):
        return None
    n, sums = int(cells[0]), [int(v) for v in cells[1 : dims + 1]]
    scatter = np.zeros((dims, dims), object)
    scatter[upper] = [n * int(v) - sums[i] * sums[j] for v, i, j in zip(cells[dims + 1 :], *upper)]
    scatter = scatter + np.triu(scatter, 1).T
    # n * n divides exactly formed integers: covariance, rounded once per entry
    covariance = np.array(scatter, np.longdouble) / (np.longdouble(n) * n)
    eigenvalues, axes = principal_axes(covariance)
    trace = covariance.diagonal().sum()
    kept = min(components, len(eigenvalues))
    return Fit(n, sums, axes[:, :kept].astype(np.float64), eigenvalues[:kept].astype(np.float64), (eigenvalues[:kept] / trace).astype(np.float64))


def centred(x: np.ndarray, fit: Fit) -> np.ndarray:
    """``n * x - S`` exactly: int64 where everything fits, else Python integers."""
    bound = fit.n * int(np.abs(x).max(initial=0)) + max(map(abs, fit.sums))
    if bound < 1 << 62:
        return fit.n * x - np.array(fit.sums, np.int64)
    return x.astype(object) * fit.n - np.array(fit.sums, object)


def projected(away: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened coordinates of centred rows."""
    return away.astype(np.float64) @ (fit.axes / np.sqrt(fit.eigenvalues) / fit.n)


def deviations(away: np.ndarray) -> list[int | None]:
    """Squared lengths of the integer rows, exact; None beyond a long."""
    if away.dtype != object and (not away.size or int(np.abs(away).max()) ** 2 * away.shape[1] < 1 << 63):
        return (away * away).sum(1).tolist()
    exact = (away.astype(object) ** 2).sum(1)
    return [v if v < 1 << 63 else None for v in map(int, exact)]


def whiten(crops: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """Whitened principal coordinates of the embeddings of player crops (vec_id, embedding).

    A crop counts if its vector is not empty and holds finite numbers only (no nulls,
    and ``64 * c`` below 2^62); of several widths the most frequent one counts, the
    smaller on a tie. Entries become integers ``floor(64 * c) + 1000000``. All counting
    crops are fitted: their exact integer scatter is factored by a diagonally pivoted
    Cholesky decomposition and the factor's columns are rotated by one-sided Jacobi; the
    norms give the eigenvalues, the normalised columns the components.

    Returns id_col, component (from 1, by falling eigenvalue), n, deviation (squared
    length of ``n * x - S``, exact, null beyond a long), whitened, explained (share of
    the variance) and identity_error (one value: the largest absolute entry of the
    whitened coordinates' covariance, taken over the rows, minus the identity).
    Directions without any variance have no component: equal vectors, one vector or an
    empty table give no rows. Repeated rows count and are returned as often as they
    stand; null ids are kept; other columns are ignored.
    """
    rows = crops.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")))
    widths = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = widths["dims"] if widths else 1
    rows = rows.where(F.size("v") == dims)
    fit = fit_whitening(rows, dims, "v", components)
    kind = rows.schema["id"].dataType.simpleString()
    if fit is None or not len(fit.eigenvalues):
        empty = rows.limit(0).select(
            "id", *(F.lit(None).cast(t).alias(c) for c, t in (
                ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")))
        )
        return empty.withColumnRenamed("id", id_col)
    known = broadcast(crops.sparkSession, fit)
    kept = len(fit.eigenvalues)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, n = np.zeros(kept), np.zeros((kept, kept)), 0
        for b in batches:
            y = projected(centred(fixed_point(b.column(0), dims), known.value), known.value)
            sums, products, n = sums + y.sum(0), products + y.T @ y, n + len(y)
        if n:
            values = np.concatenate((sums, products.ravel()))
            yield batch(["cell", "value"], np.arange(len(values), dtype=np.int32), values)

    cells = _sum_cells(rows.select("v"), moments, "double").astype(np.float64) / fit.n
    covariance = cells[kept:].reshape(kept, kept) - np.outer(cells[:kept], cells[:kept])
    error = float(np.abs(covariance - np.eye(kept)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = centred(fixed_point(b.column(1), dims), known.value)
            y = projected(away, known.value)
            lists = pa.ListArray.from_arrays(np.arange(0, y.size + 1, kept, dtype=np.int32), pa.array(y.ravel()))
            yield batch(["id", "deviation", "y"], b.column(0), pa.array(deviations(away), pa.int64()), lists)

    told = arrow_map(rows, project, f"id {kind}, deviation bigint, y array<double>")
    shares = F.array(*(F.lit(float(e)) for e in fit.explained))
    out = told.select("id", "deviation", F.posexplode(F.arrays_zip(F.col("y").alias("y"), shares.alias("e"))).alias("at", "c"))
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation",
        F.col("c.y").alias("whitened"), F.col("c.e").alias("explained"), F.lit(error).alias("identity_error"),
    )
