"""Whitening of embeddings, with leading eigenvectors by spectrum slicing.

Rows stay where they are: three passes over the table each return sums of the size of the covariance, and a last pass
projects the rows.

1. Exact sums per dimension; the covariance of the vectors, centred before multiplying; and, after the fit, the
   covariance of the whitened vectors, as a measure of what was reached. A task adds up its own rows, so what meets is
   one matrix row per task and dimension, added up by dimension.
2. Spectrum slicing, on the covariance alone (its size is that of a vector squared, whatever the number of rows).
   Of V - s*I = L D L' the number of positive pivots is the number of eigenvalues above s (V is made tridiagonal
   first, which leaves it and bounds the pivots). Bisection by these counts
   isolates each leading eigenvalue, Rayleigh quotient iteration runs inside the bracket, and the counts on both
   sides of what it reached certify its number. Eigenvalues that no shift can tell apart are one cluster: its
   vectors are taken by inverse iteration, each orthogonal to those before.
3. (x - mean) projected on the components, over the root of the eigenvalue.

Components x of the vectors are whole numbers, ``floor(scale * c) + offset``. Components whose eigenvalue is zero to
working precision cannot be whitened; they are left out, so there may be fewer than ``most``.

Defined cases: vectors that are null, or hold a null, NaN or infinite entry, take no part; shorter vectors count as
filled up with zeros; keys may be null, repeated and of any type; other columns are left out, so no name can clash; an
empty table, one row, or equal rows have no variance and give an empty result. Entries beyond 2**53 / scale are refused."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Fit:
    """n vectors of ``len(sums)`` dimensions; ``vectors`` are rows, ``values`` falls."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


# --- the spectrum of a symmetric matrix ---

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, squares beside it) of T = Q' V Q, by reflections. V - s*I and T - s*I have the same numbers of
    positive and negative pivots, and those of T cannot grow, so one reduction serves all counts."""
    work = matrix.copy()
    for k in range(len(work) - 2):
        mirror = work[k + 1:, k].copy()
        length = np.copysign(np.linalg.norm(mirror), -mirror[0])
        mirror[0] -= length
        if not (norm := np.linalg.norm(mirror)):
            continue
        mirror /= norm
        rest = work[k + 1:, k + 1:]
        w = rest @ mirror
        w = 2 * (w - (mirror @ w) * mirror)
        rest -= np.outer(mirror, w) + np.outer(w, mirror)
        work[k + 1, k] = length
    return np.diagonal(work).copy(), np.diagonal(work, -1) ** 2


def count_above(diagonal: np.ndarray, squares: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: the positive pivots of LDL' of the shifted matrix."""
    tiny = np.finfo(float).tiny * max(1.0, float(squares.max(initial=0.0)))
    count, pivot = 0, 1.0
    for a, b in zip((diagonal - shift).tolist(), [0.0, *squares.tolist()], strict=True):
        pivot = a - b / pivot
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def slices(diagonal: np.ndarray, squares: np.ndarray, most: int, width: float) -> list[tuple[int, int, float, float]]:
    """Brackets (first, past, low, high) of the eigenvalues numbered first..past - 1 by falling size, together the ``most``
    largest: of one eigenvalue each, or no wider than ``width``."""
    beside = np.sqrt(squares)
    reach = np.append(beside, 0.0)[:len(diagonal)] + np.append(0.0, beside)
    done, rest = [], [(0, len(diagonal), float((diagonal - reach).min()) - width, float((diagonal + reach).max()) + width)]  # Gershgorin
    while rest:
        first, past, low, high = rest.pop()
        if first >= min(past, most):
            continue
        if past - first == 1 or high - low <= width:
            done.append((first, past, low, high))
            continue
        middle = (low + high) / 2
        count = count_above(diagonal, squares, middle)
        rest += [(first, count, middle, high), (count, past, low, middle)]
    return sorted(done)


def _solve(matrix: np.ndarray, shift: float, vector: np.ndarray) -> np.ndarray:
    scale = np.abs(matrix).max(initial=0.0) * np.finfo(float).eps
    for i in range(4):  # an exact eigenvalue as shift is singular: go a rounding error away
        try:
            found = np.linalg.solve(matrix - (shift + i * scale) * np.eye(len(matrix)), vector)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all() and (largest := np.abs(found).max()):
            return found / largest
    return vector


def _rayleigh(matrix: np.ndarray, low: float, high: float, before: np.ndarray, seed: int) -> tuple[float, np.ndarray, float]:
    """(eigenvalue, vector, residual) of a bracket, the vector orthogonal to those ``before``."""
    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(3):
            v = v - before.T @ (before @ v)
            v = v / np.linalg.norm(v)
        return v

    vector = apart(np.random.default_rng(seed).standard_normal(len(matrix)))
    value = (low + high) / 2
    best = (value, vector, np.inf)
    for i in range(40):
        vector = apart(_solve(matrix, value, vector))
        quotient = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - quotient * vector))
        inside = low <= quotient <= high
        if inside and residual < best[2]:
            best = (quotient, vector, residual)
        elif inside and np.isfinite(best[2]) and i > 3:
            break  # rounding errors are reached
        # Outside the bracket the quotient belongs to another eigenvalue: inverse iteration from the middle goes on.
        value = quotient if inside and i > 1 else (low + high) / 2
    return best


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit vectors as rows; certified by counts."""
    eps = np.finfo(float).eps * max(float(np.linalg.norm(matrix)), np.finfo(float).tiny) * max(4, len(matrix))
    diagonal, squares = tridiagonal(matrix)
    values, vectors = [], np.empty((0, len(matrix)))
    for first, past, low, high in slices(diagonal, squares, most, 4 * eps):
        for number in range(first, min(past, most)):
            while True:
                value, vector, residual = _rayleigh(matrix, low, high, vectors, number)
                # An eigenvalue lies within the residual of the quotient; the counts on both sides say that it is the wanted one.
                slack = 8 * residual + 4 * eps
                certain = (residual <= 64 * eps and count_above(diagonal, squares, value + slack) <= number
                           < count_above(diagonal, squares, value - slack))
                if certain or high - low <= 4 * eps:
                    break
                middle = (low + high) / 2
                low, high = (middle, high) if count_above(diagonal, squares, middle) > number else (low, middle)
            values.append(value)
            vectors = np.vstack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[order]


# --- passes over the rows ---

def usable(vector: Column) -> Column:
    wide = vector.cast("array<double>")
    return wide.isNotNull() & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def _matrix(column: pa.Array, width: int, scale: int, offset: int) -> np.ndarray:
    """Whole numbers of a batch of vectors, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    scaled = np.floor(scale * out)
    if np.abs(scaled).max(initial=0.0) >= 2.0**53:
        raise ValueError(f"entries beyond 2**53 / {scale}")
    return scaled.astype(np.int64) + offset


def _added(rows: DataFrame, make, dim_type: str) -> DataFrame:
    """Each task's (dim, values) from ``make(batches)``, added up by dimension and place."""
    parts = rows.mapInArrow(make, f"dim int, held array<{dim_type}>")
    return parts.select("dim", F.posexplode("held").alias("place", "value")).groupBy("dim", "place").agg(F.sum("value").alias("value"))


def _square(found: DataFrame, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for row in found.collect():
        out[row.dim, row.place] = row.value
    return (out + out.T) / 2


def _rows_of(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(list(sums))], ["dim", "held"])


def fit(df: DataFrame, most: int = 32, vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> Fit:
    """Mean, trace of the covariance, and its leading components, over all rows that take part."""
    if most < 1 or scale < 1:
        raise ValueError("most and scale are 1 or more")
    rows = df.where(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if n == 0 or width == 0:
        return Fit(n, (0,) * width, 0.0, np.empty(0), np.empty((0, width)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            here = _matrix(batch.column(0), width, scale, offset).sum(axis=0)
            total = here if total is None else total + here
        if total is not None:
            yield _rows_of(total[:, None])

    sums = [0] * width
    for row in _added(rows, add, "bigint").collect():
        sums[row.dim] = int(row.value)
    mean = _mean(sums, n)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            centred = mean(_matrix(batch.column(0), width, scale, offset))
            total += centred.T @ centred
        yield _rows_of(total)

    covariance = _square(_added(rows, multiply, "double"), width) / n
    values, vectors = leading(covariance, min(most, width))
    keep = values > width * np.finfo(float).eps * max(float(values.max(initial=0.0)), 0.0) * 16
    return Fit(n, tuple(sums), float(np.trace(covariance)), values[keep], vectors[keep])


def _mean(sums: Iterable[int], n: int):
    """x - S/n: the whole part is taken off first, as whole numbers, so nothing is rounded but the result."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole).astype(float) - part


def _whitener(model: Fit):
    mean, turn = _mean(model.sums, model.n), (model.vectors / np.sqrt(model.values)[:, None]).T
    return lambda x: mean(x) @ turn


def identity_error(df: DataFrame, model: Fit, vector: str = "embedding", scale: int = 64, offset: int = 1_000_000) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    size, width = len(model.values), len(model.sums)
    if not size:
        return 0.0
    rows = df.where(usable(F.col(vector))).select(F.col(vector).cast("array<double>").alias("v"))
    white = _whitener(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += white(_matrix(batch.column(0), width, scale, offset)).sum(axis=0)
        yield _rows_of(total[:, None])

    middle = np.zeros(size)
    for row in _added(rows, add, "double").collect():
        middle[row.dim] = row.value / model.n

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            centred = white(_matrix(batch.column(0), width, scale, offset)) - middle
            total += centred.T @ centred
        yield _rows_of(total)

    return float(np.abs(_square(_added(rows, multiply, "double"), size) / model.n - np.eye(size)).max())


def transform(df: DataFrame, model: Fit, vector: str = "embedding", key: str = "vec_id", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """key, ``deviation`` (the sum over dimensions of (n*x - S)**2, exact, decimal(38,0)) and ``whitened`` (one number per
    component) of each row that takes part; none if there is no component."""
    n, width, sums = model.n, len(model.sums), model.sums
    white = _whitener(model) if len(model.values) else None

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or white is None:
                continue
            x = _matrix(batch.column(1), width, scale, offset)
            flat = white(x)
            places = np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(_deviations(x, n, sums), pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(pa.array(places), pa.array(flat.ravel()))], ["key", "deviation", "whitened"])

    rows = df.where(usable(F.col(vector))).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    done = rows.mapInArrow(project, f"key {rows.schema['key'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
    return done.withColumnRenamed("key", key)


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """In machine integers where they suffice, else in Python's."""
    whole, part = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    near = x - whole
    peak = (float(np.abs(near).max(initial=0)) + 1) * n
    if peak * peak * len(sums) < 2.0**62:
        each = n * near - part
        return (each * each).sum(axis=1).tolist()
    return [sum((n * a - b) ** 2 for a, b in zip(row, part.tolist(), strict=True)) for row in near.tolist()]


def whiten(df: DataFrame, most: int = 32, vector: str = "embedding", key: str = "vec_id", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """For each row that takes part and each component: key, component (from 1), n, deviation, whitened, explained (the share
    of the variance) and identity_error."""
    model = fit(df, most, vector, scale, offset)
    error = identity_error(df, model, vector, scale, offset)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    return transform(df, model, vector, key, scale, offset).select(
        key, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
