"""Embedding whitening by spectral divide and conquer on QDWH polar factors.

Fit. Every entry becomes a whole number, ``floor(steps * c) + shift``. One pass sums the
rows and their entries, a second one the products of the entries less a whole number
next to their mean, which is exact as long as the sums stay below 2**53; both leave one
small block a task, summed by Spark. What reaches the driver is the covariance, a matrix
of dimension by dimension, whatever the number of rows.

Components. The polar factor U of (covariance - shift * I) has the signs of its
eigenvalues, so (U + I) / 2 projects on the subspace of the eigenvalues above the shift.
U comes from the QR form of the dynamically weighted Halley iteration. An orthonormal
basis of that subspace and of its complement turns the matrix into two smaller ones, which
are split in the same way down to single components. A shift that meets an eigenvalue
gives no projector; the next shift is tried.

Transform. Components over the roots of their eigenvalues, at most ``limit`` columns, go to
every task; rows are whitened where they lie, without a shuffle.

Choices: a vector that is null, empty, or holds a null or an entry that is not finite is left
out, as is one whose length is not the most common one (of ties the longer). Components
without variance (eigenvalue below 1e-12 of the largest) have no scale and are left out.
Repeated rows and null ids are rows like others. A table without vectors gives no rows. A
deviation beyond 64 bits is null. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauframe.llm.storage import bound_batches

STEPS = 64
SHIFT = 1_000_000
LEAST_SHARE = 1e-12


def polar_factor(a: np.ndarray, tolerance: float = 1e-15) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QR-based weighted Halley steps."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # Any lower bound of the smallest singular value keeps the steps right; a low one adds few.
    low = 1e-17
    eye = np.eye(n)
    for _ in range(40):
        root = np.cbrt(4 * (1 - low**2) / low**4)
        alpha = np.sqrt(1 + root) + 0.5 * np.sqrt(
            max(0.0, 8 - 4 * root + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + root))))
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(gamma) * x, eye)))
        step = beta / gamma * x + (alpha - beta / gamma) / np.sqrt(gamma) * q[:n] @ q[n:].T
        step = (step + step.T) / 2
        low = min(1.0, low * (alpha + beta * low**2) / (1 + gamma * low**2))
        change = np.linalg.norm(step - x)
        x = step
        if abs(1 - low) < 10 * tolerance and change < np.cbrt(tolerance):
            break
    return x


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """(orthonormal basis, k): the first k columns span the eigenvalues above a shift."""
    n, scale = len(a), np.linalg.norm(a)
    center = np.trace(a) / n
    spread = np.linalg.norm(a - center * np.eye(n)) / np.sqrt(n)
    for shift in (0.0, 0.31, -0.31, 0.67, -0.67, 0.13, -0.13, 0.05, -0.05, 0.9, -0.9):
        u = polar_factor(a - (center + shift * spread) * np.eye(n))
        projector = (u + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        # Two rounds of orthogonal iteration from a random start span the range.
        q = rng.standard_normal((n, n))
        for _ in range(2):
            start = np.hstack((projector @ q[:, :k], q[:, k:] - projector @ q[:, k:]))
            q, _ = np.linalg.qr(start)
        if np.linalg.norm(q[:, k:].T @ a @ q[:, :k]) <= 1e-13 * max(scale, 1e-300) * n:
            return q, k
    raise ArithmeticError("no shift separates the eigenvalues")


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix."""
    n = len(a)
    whole = (a + a.T) / 2
    size = np.linalg.norm(whole)
    rng = np.random.default_rng(11)
    values, vectors, open_ = [], [], [(np.eye(n), whole)]
    while open_:
        basis, part = open_.pop()
        rest = part - np.trace(part) / len(part) * np.eye(len(part))
        if len(part) == 1 or np.linalg.norm(rest) <= 1e-15 * size:
            # Within rounding a multiple of the identity: any basis is one of eigenvectors.
            values.extend(np.diag(part))
            vectors.append(basis)
            continue
        q, k = _split(part, rng)
        for side in (q[:, :k], q[:, k:]):
            inner = side.T @ part @ side
            open_.append((basis @ side, (inner + inner.T) / 2))
    if not values:
        return np.zeros(0), np.zeros((0, 0))
    columns = np.hstack(vectors)
    columns /= np.linalg.norm(columns, axis=0)
    # The quotient on the whole matrix is exact to the square of the vector's error.
    values = np.einsum("ij,ij->j", columns, whole @ columns)
    order = np.argsort(-values, kind="stable")
    return values[order], columns[:, order]


@dataclass
class Whitening:
    """What the fit found; its size depends on the dimension only."""

    n: int
    dims: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray

    def scaled(self) -> np.ndarray:
        """Columns that whiten centred entries."""
        return self.vectors / np.sqrt(self.values)


def _matrix(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable vectors, their entries), of length ``dims`` or any one length."""
    length = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0), dtype=np.int64)
    at = np.flatnonzero(length == dims) if dims is not None else np.flatnonzero(length > 0)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    entries = np.asarray(pa.compute.fill_null(flat, np.nan), dtype=np.float64)
    if dims is None:
        return at, entries
    table = entries.reshape(-1, dims)
    good = np.isfinite(table).all(axis=1)
    return at[good], table[good]


def _whole(table: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.floor(STEPS * table).astype(np.int64) + SHIFT


def _column_sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(rows, dims, sums) of the usable vectors of the most common length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            column = batch.column("embedding")
            lengths = pa.compute.unique(pa.compute.fill_null(pa.compute.list_value_length(column), 0))
            for dims in lengths.to_pylist():
                if not dims:
                    continue
                _, table = _matrix(column, dims)
                known = found.setdefault(dims, [0, np.zeros(dims, np.int64)])
                known[0] += len(table)
                known[1] += _whole(table).sum(axis=0)
        # One row a dimension, so that no row grows with it.
        for dims, (n, total) in found.items():
            yield pa.RecordBatch.from_pydict({
                "dims": pa.array([dims] * dims, pa.int32()), "i": pa.array(range(dims), pa.int32()),
                "n": pa.array([n] * dims, pa.int64()), "s": pa.array(total, pa.int64())})

    sums = vectors.select("embedding").mapInArrow(add, "dims int, i int, n long, s long").groupBy("dims", "i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"))
    # Of each length its number of rows first; then the sums of one length only.
    most = sums.filter("i = 0 AND n > 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return 0, 0, []
    rows = sums.filter(F.col("dims") == most["dims"]).orderBy("i").collect()
    return most["n"], most["dims"], [r["s"] for r in rows]


def _products(vectors: DataFrame, dims: int, columns) -> np.ndarray:
    """Sum over rows of z z' for z = columns(x), one block of rows of it a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            _, table = _matrix(batch.column("embedding"), dims)
            z = columns(_whole(table))
            total = z.T @ z + (0 if total is None else total)
        if total is not None:
            width = total.shape[1]
            flat = pa.array(np.ascontiguousarray(total).ravel())
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(len(total)), pa.int32()),
                "z": pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1) * width, pa.int32()), flat)})

    blocks = vectors.select("embedding").mapInArrow(add, "i int, z array<double>")
    cells = blocks.select("i", F.posexplode("z").alias("j", "z")).groupBy("i", "j").agg(F.sum("z").alias("z"))
    rows = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "z"))).alias("z")).orderBy("i").select(
        F.col("z.z").alias("z")).collect()
    return np.array([r["z"] for r in rows])


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Whitening:
    """The whitening of all usable vectors of ``vectors``."""
    bound_batches(vectors.sparkSession)
    vectors = vectors.select(F.col(vector_col).alias("embedding"))
    n, dims, sums = _column_sums(vectors)
    if not n:
        return Whitening(0, 0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    near = np.array([round(s / n) for s in sums], dtype=np.int64)
    left = np.array([(s - n * int(m)) / n for s, m in zip(sums, near, strict=True)])
    products = _products(vectors, dims, lambda x: (x - near).astype(np.float64))
    covariance = products / n - np.outer(left, left)
    values, columns = spectral_components(covariance)
    keep = values > LEAST_SHARE * max(values.max(initial=0.0), 0.0)
    return Whitening(n, dims, sums, float(np.trace(covariance)), values[keep], columns[:, keep])


def _centred(model: Whitening):
    """A function from whole entries to entries less their mean, rounded once."""
    near = np.array([round(s / model.n) for s in model.sums], dtype=np.int64)
    left = np.array([(s - model.n * int(m)) / model.n for s, m in zip(model.sums, near, strict=True)])
    return lambda x: (x - near).astype(np.float64) - left


def identity_error(vectors: DataFrame, model: Whitening, limit: int, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened covariance minus the identity."""
    columns, centred = model.scaled()[:, :limit], _centred(model)
    if not columns.size:
        return 0.0
    got = _products(vectors.select(F.col(vector_col).alias("embedding")), model.dims, lambda x: centred(x) @ columns)
    return float(np.abs(got / model.n - np.eye(columns.shape[1])).max())


def transform(
    vectors: DataFrame, model: Whitening, limit: int = 32, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per usable vector: vec_id, deviation and the list ``whitened`` of up to ``limit`` entries."""
    bound_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not model.n:
        return rows.filter("false").selectExpr(
            "vec_id", "cast(0 AS bigint) AS deviation", "cast(array() AS array<double>) AS whitened")
    columns, centred = model.scaled()[:, :limit], _centred(model)
    sums, n = np.array(model.sums, dtype=np.int64), model.n

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, table = _matrix(batch.column("embedding"), model.dims)
            x = _whole(table)
            z = centred(x) @ columns
            apart = n * x - sums
            deviation = (apart * apart).sum(axis=1)
            fits = (apart.astype(np.float64) ** 2).sum(axis=1) < 2.0**63
            yield pa.RecordBatch.from_pydict({
                "vec_id": batch.column("vec_id").take(pa.array(at)),
                "deviation": pa.array(deviation, pa.int64(), mask=~fits),
                "whitened": pa.ListArray.from_arrays(
                    pa.array(np.arange(len(z) + 1) * columns.shape[1], pa.int32()), pa.array(z.ravel()))})

    return rows.mapInArrow(whiten, f"vec_id {kind}, deviation long, whitened array<double>")


def whitened_components(
    vectors: DataFrame, limit: int = 32, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per usable vector and component, with the figures of the fit."""
    model = fit(vectors, vector_col)
    error = identity_error(vectors, model, limit, vector_col)
    explained = (model.values[:limit] / model.trace).tolist() if model.n and model.trace else []
    shares = F.lit(explained).cast("array<double>") if explained else F.expr("cast(array() AS array<double>)")
    long = transform(vectors, model, limit, id_col, vector_col).select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
