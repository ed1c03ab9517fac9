"""Embedding whitening: pivoted Cholesky of the scatter, then one-sided Jacobi.

Entries become whole numbers, ``floor(SCALE * c) + SHIFT``. The model is fitted on each
distinct vector once. Tasks add up exact sums, then the scatter of the centred vectors,
one partial matrix per task; partial matrices meet row by row. The d x d scatter A is small
and is decomposed on the driver: ``P'AP = LL'`` with the largest remaining diagonal entry as
pivot, which ends at the numerical rank, then plane rotations of pairs of columns of L until
all are orthogonal. Their squared norms are the eigenvalues of A, the columns scaled to 1
its eigenvectors. A third pass over the fitted vectors measures the covariance of the result.

Defined results: a vector that is null, or holds a null, a NaN, an infinity or a number of
2**55 or more (its whole number would not fit 64 bits) has no rows. If vectors differ in
length, those of the length that most distinct vectors have are used, the longer one on a
tie; the others have no rows, and neither have empty ones. Repeated rows are fitted once and
returned as often as they occur, null ids too. There are as many components as the scatter
has rank, ``COMPONENTS`` at most: none, and so no rows, for a single distinct vector or an
empty table. Equal eigenvalues keep the order in which they are found; the largest entry of a
component is positive. A deviation over 64 bits is null. Columns are picked by name at the
start, so others don't matter, whatever their names. The driver holds one d x d matrix.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import by_value, table
from corpusloom.session import stage

by_value(__name__)

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(2**55)  # entries from here on don't become 64-bit numbers
SLICE = 1 << 17  # entries that a task centres at once
_LONG = 2**63


@dataclass(frozen=True)
class Whitening:
    """``n`` fitted vectors with exact ``sums``; ``components`` (unit rows) by falling
    ``eigenvalues`` of their covariance with its ``trace``; ``identity_error`` is the largest
    absolute entry of the whitened vectors' covariance minus the identity."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)


def _usable(vector: Column) -> Column:
    # A NaN is larger than any number here.
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < LARGEST))


def _vectors(embeddings: DataFrame, column: str, *keys: Column) -> DataFrame:
    """``keys`` and the whole numbers ``x`` of the usable vectors."""
    rows = embeddings.select(*keys, F.col(column).cast("array<double>").alias("vector"))
    usable = rows.filter(_usable(F.col("vector")))
    return usable.withColumn("x", whole_numbers(F.col("vector"))).drop("vector")


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their last column as a matrix of ``d`` columns."""
    rows = max(1, SLICE // max(d, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _shifted(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """y and r so that n*x - sums = n*y - r with 0 <= r < n. y is small where x is near its mean."""
    floor = [s // n for s in sums]
    y = x - np.array(floor, dtype=np.int64)
    return y, np.array([s - n * f for s, f in zip(sums, floor)], dtype=np.int64)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - sums / n, rounded once where n*x - sums is exact as a double."""
    y, r = _shifted(x, n, sums)
    if np.abs(y).max(initial=0) < 2**52 // n:
        return (n * y - r) / n
    return y - r / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n*x - sums)**2 of each row, exact; None over 64 bits."""
    y, r = _shifted(x, n, sums)
    largest = n * (int(np.abs(y).max(initial=0)) + 1)
    if largest * largest * max(x.shape[1], 1) >= _LONG:
        y, r = y.astype(object), r.astype(object)
    off = n * y - r
    return [int(s) if s < _LONG else None for s in (off * off).sum(axis=1).tolist()]


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, ...]:
    """Sum of each dimension."""

    def run(batches):
        high, low = np.zeros(d, np.int64), np.zeros(d, np.int64)
        totals = [0] * d
        for _, x in _matrices(batches, d):
            # Halves can't overflow within a slice.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            totals = [t + (int(a) << 32) + int(b) for t, a, b in zip(totals, high, low)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in totals], pa.decimal128(38, 0))], names=["dim", "total"]
        )

    parts = vectors.select("x").mapInArrow(run, "dim int, total decimal(38,0)")
    return tuple(int(row["total"]) for row in parts.groupBy("dim").agg(F.sum("total").alias("total")).orderBy("dim").collect())


def scatter(vectors: DataFrame, d: int, width: int, value: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the rows of ``value(x)`` (``width`` columns), and sum of their outer products.

    A task keeps one matrix, the last row of which is the plain sum. Rows of the matrices
    are dealt out by number and added as they arrive."""

    def partial(batches):
        total = np.zeros((width + 1, width))
        for _, x in _matrices(batches, d):
            z = value(x)
            total[:width] += z.T @ z
            total[width] += z.sum(axis=0)
        yield _rows(range(width + 1), total)

    def added(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows[i] = rows.get(i, 0) + row.values.to_numpy()
        if rows:
            yield _rows(rows, np.array(list(rows.values())))

    parts = vectors.select("x").mapInArrow(partial, "i int, row array<double>")
    whole = parts.repartition(min(width + 1, 64), "i").mapInArrow(added, "i int, row array<double>")
    out = np.zeros((width + 1, width))
    for i, row in whole.collect():
        out[i] = row
    return out[width], out[:width]


def _rows(numbers, matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(numbers), pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))], names=["i", "row"]
    )


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L (d x rank) with L L' = a and its rows in the order of ``a``; each column has its
    pivot's diagonal entry as the largest that was left."""
    d = len(a)
    left = np.diag(a).astype(float).copy()
    least = d * np.finfo(float).eps * left.max(initial=0)
    columns: list[np.ndarray] = []
    done = np.zeros(d, dtype=bool)
    while len(columns) < d:
        pivot = int(np.where(done, -1, left).argmax())
        if done[pivot] or left[pivot] <= least:
            break
        made = np.array(columns).reshape(len(columns), d)
        column = (a[:, pivot] - made.T @ made[:, pivot]) / np.sqrt(left[pivot])
        column[done] = 0
        column[pivot] = np.sqrt(left[pivot])
        done[pivot] = True
        left = left - column**2
        columns.append(column)
    return np.array(columns).reshape(len(columns), d).T


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns in rounds of disjoint pairs."""
    ring = list(range(n + n % 2))
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], ring[:half - 1:-1]) if a < n and b < n]
        if pairs:
            p, q = np.array(pairs).T
            yield np.minimum(p, q), np.maximum(p, q)
        ring.insert(1, ring.pop())


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """``factor`` with its columns rotated until all pairs are orthogonal to rounding."""
    g = factor.copy()
    least = np.finfo(float).eps * np.sqrt(len(g))
    for _ in range(sweeps):
        turned = False
        for p, q in _rounds(g.shape[1]):
            gp, gq = g[:, p], g[:, q]
            alpha, beta, gamma = (gp * gp).sum(axis=0), (gq * gq).sum(axis=0), (gp * gq).sum(axis=0)
            far = np.abs(gamma) > least * np.sqrt(alpha * beta)
            if not far.any():
                continue
            turned = True
            zeta = (beta - alpha) / (2 * np.where(far, gamma, 1))
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(far, t, 0)
            c = 1 / np.hypot(1, t)
            g[:, p], g[:, q] = c * gp - c * t * gq, c * t * gp + c * gq
        if not turned:
            break
    return g


def decomposed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a scatter and its unit eigenvectors as rows."""
    columns = one_sided_jacobi(pivoted_cholesky(a)).T
    norms = np.sqrt((columns**2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    norms, units = norms[order], columns[order] / norms[order][:, None]
    if len(units):
        sign = np.sign(units[np.arange(len(units)), np.abs(units).argmax(axis=1)])
        units = units * sign[:, None]
    return norms**2, units


def fit(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors; None if there is no component."""
    vectors = _vectors(embeddings, column).select("x").distinct()
    fitted = stage(vectors.select(F.size("x").alias("size"), "x"))
    sizes = fitted.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes or not sizes[0]["size"]:
        return None
    d, n = sizes[0]["size"], sizes[0]["count"]
    fitted = fitted.filter(F.col("size") == d).select("x")
    sums = exact_sums(fitted, d)
    _, products = scatter(fitted, d, d, lambda x: centred(x, n, sums))
    values, units = decomposed(products)
    if not len(values):
        return None
    model = Whitening(n, sums, values[:components] / n, units[:components], float(np.trace(products)) / n)
    total, products = scatter(fitted, d, len(model.components), model.whitened)
    covariance = products / n - np.outer(total / n, total / n)
    return replace(model, identity_error=float(np.abs(covariance - np.eye(len(covariance))).max()))


_WHITENED = "key bigint, component int, deviation bigint, whitened double, explained double"


def whiten(embeddings: DataFrame, model: Whitening, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, deviation, whitened, explained): a row for each usable vector and
    component. ``explained`` is the component's share of the variance."""
    d, width = len(model.sums), len(model.components)
    explained = model.eigenvalues / model.trace

    def run(batches):
        for batch, x in _matrices(batches, d):
            rows = batch.num_rows
            again = np.repeat(np.arange(rows), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(again)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(again)),
                    pa.array(model.whitened(x).reshape(-1)),
                    pa.array(np.tile(explained, rows)),
                ],
                names=["key", "component", "deviation", "whitened", "explained"],
            )

    vectors = _vectors(embeddings, column, F.col(key).cast("bigint").alias("key")).filter(F.size("x") == d)
    return vectors.mapInArrow(run, _WHITENED).withColumnRenamed("key", key)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    model = fit(embeddings)
    if model is None:
        rows = spark.createDataFrame([], _WHITENED).withColumnRenamed("key", "vec_id")
        n, error = 0, 0.0
    else:
        rows, n, error = whiten(embeddings, model), model.n, model.identity_error
    return rows.select(
        "vec_id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"),
    )
