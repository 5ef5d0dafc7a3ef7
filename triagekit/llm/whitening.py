"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Vectors become integers on a fixed grid, so the fit list's sums and scatter matrix are
exact whatever the order and number of tasks: each task sums outer products of its rows and
Spark adds the tasks' sums.  Only the scatter matrix, bounded by the dimension, meets the
driver.  Its characteristic polynomial (:mod:`.charpoly`) is computed by tasks, each
modulo some primes; roots and eigenvectors follow on the driver, at a cost that depends on
the dimension alone (about its fourth power; meant for up to a few hundred dimensions).
The projection reads the vectors once more, in place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .charpoly import coefficient_bits, combine, eigenvectors, largest_roots, polynomials_mod, primes_below
from .common import bound_batches, shared_table

#: Grid steps in a unit.  Where the grid's zero stands changes no result (all of them are
#: centred), so it stands at zero.
STEPS = 64
COMPONENTS = 16
#: Entries farther from zero count as this far, in grid steps.
FAR = 1 << 40
#: Primes that one task works modulo at once.
PRIMES_A_TASK = 16
_SUM = "k long, v decimal(38,0)"


@dataclass
class Whitening:
    """A fit: n vectors of sum ``total`` (grid steps from zero), components as rows with
    their eigenvalues, falling, of the covariance, and the shares of its trace."""

    n: int
    total: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def grid(vector: Column) -> Column:
    """Integer entries, in grid steps; null for a vector that is null or holds a
    null or non-finite entry."""
    bad = F.exists(vector, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    far = float(FAR)
    steps = F.transform(vector, lambda e: F.floor(F.least(F.greatest(e.cast("double") * STEPS, F.lit(-far)), F.lit(far))))
    return F.when(~bad, steps.cast("array<long>"))


def _rows(batch: pa.RecordBatch, column: str, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, exact: floats below 2**53 when the sums stay there."""
    big = int(np.abs(x).max(initial=0))
    out = np.zeros((x.shape[1], x.shape[1]), object)
    step = (1 << 52) // max(big * big, 1)
    if step >= 64:
        for i in range(0, len(x), min(step, 4096)):
            y = x[i:i + min(step, 4096)].astype(np.float64)
            out = out + (y.T @ y).astype(np.int64).astype(object)
        return out
    for row in x.astype(object):
        out = out + np.outer(row, row)
    return out


def _moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            x = _rows(batch, "x", size)
            n += len(x)
            total = total + x.astype(object).sum(0) if len(x) else total
            square = square + _products(x)
        if n:
            upper = square[np.triu_indices(size)]
            values = [n, *total.tolist(), *upper.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values))), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))],
                ["k", "v"])
    return run


def _residues(matrix: np.ndarray, primes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("id").to_pylist()
            for i in range(0, len(at), PRIMES_A_TASK):
                own = [primes[k] for k in at[i:i + PRIMES_A_TASK]]
                poly = polynomials_mod(matrix, np.array(own, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(poly.tolist(), pa.list_(pa.int64()))],
                                                 ["prime", "poly"])
    return run


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Of a positive semidefinite integer matrix, lowest power first; primes go to tasks."""
    size = len(matrix)
    bits = coefficient_bits(int(sum(matrix[i, i] for i in range(size))), size)
    count = bits // 30 + 1  # the largest primes below 2**31 have 31 bits
    primes = primes_below(1 << 31, count)
    tasks = -(-count // PRIMES_A_TASK)
    found = spark.range(0, count, 1, tasks).mapInArrow(_residues(matrix, primes), "prime long, poly array<long>")
    return combine({r.prime: r.poly for r in found.collect()})


def _whitened(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """Coordinates of grid rows; their centring is exact as long as n x stays a long."""
    big = max(int(np.abs(x).max(initial=0)) * fit.n, *(abs(t) for t in fit.total), 0) if fit.total else 0
    total = np.array(fit.total, object)
    t = (x * fit.n - total.astype(np.int64)).astype(np.float64) if big < 1 << 61 else (
        x.astype(object) * fit.n - total).astype(np.float64)
    return (t / fit.n) @ (fit.components / np.sqrt(fit.values)[:, None]).T


def _deviations(x: np.ndarray, fit: Whitening) -> pa.Array:
    """Sum of (n x - S)**2 per row, exact; null where that is no long."""
    big = 2 * max(int(np.abs(x).max(initial=0)) * fit.n, *(abs(t) for t in fit.total), 0) if fit.total else 0
    total = np.array(fit.total, object)
    if big * big * max(x.shape[1], 1) < 1 << 63:
        t = x * fit.n - total.astype(np.int64)
        return pa.array((t * t).sum(1))
    t = x.astype(object) * fit.n - total
    return pa.array([v if v < 1 << 63 else None for v in (t * t).sum(1).tolist()], pa.int64())


def _second_moments(fit: Whitening):
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = _whitened(_rows(batch, "x", len(fit.total)), fit)
            first += z.sum(0)
            second += z.T @ z
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "v"])
    return run


def fit_whitening(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on each distinct grid vector once; None if there is no usable vector.

    Vectors of a length that is not the most frequent one (the longest of several) are
    left out, as are null vectors and those with null or non-finite entries.  Only
    components with a positive eigenvalue are kept: one distinct vector has none.
    """
    spark = vectors.sparkSession
    bound_batches(spark, 4000)
    x = vectors.select(grid(F.col(f"`{vector_col}`")).alias("x")).where("x is not null and size(x) > 0")
    fit = shared_table(x.distinct(), "grid")
    lengths = {r.s: r.n for r in x.groupBy(F.size("x").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not lengths:
        return None
    size = max(lengths, key=lambda s: (lengths[s], s))
    fit = fit.where(F.size("x") == size)
    sums = {r.k: int(r.v) for r in fit.mapInArrow(_moments(size), _SUM).groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n, total = sums[0], [sums[1 + i] for i in range(size)]
    square = np.zeros((size, size), object)
    square[np.triu_indices(size)] = [sums[1 + size + i] for i in range(size * (size + 1) // 2)]
    s = np.array(total, object)
    scatter = n * (square + np.triu(square, 1).T) - np.outer(s, s)  # n**2 times the covariance
    shared = math.gcd(*[int(v) for v in scatter.ravel()]) or 1
    reduced = scatter // shared
    roots = largest_roots(characteristic_polynomial(spark, reduced), min(components, size))
    vectors_of = [eigenvectors(reduced, r) for r in roots]
    parts = np.concatenate(vectors_of)[:components] if roots else np.zeros((0, size))
    unit = Decimal(shared) / Decimal(n) ** 2
    values = [float(Decimal(v) / Decimal(1 << bits) * unit) for v, bits, m in roots for _ in range(m)][:components]
    trace = float(Decimal(int(scatter.trace())) / Decimal(n) ** 2)
    out = Whitening(n, total, parts, np.array(values), np.array(values) / (trace or 1.0), 0.0)
    if values:
        found = fit.mapInArrow(_second_moments(out), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(len(found))
        for r in found:
            v[r.k] = r.v / n
        k = len(values)
        mean = v[:k]
        out.identity_error = float(np.abs(v[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    return out


def _project(fit: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, "x", len(fit.total))
            z = _whitened(x, fit)
            offsets = np.arange(0, z.size + 1, max(z.shape[1], 1), dtype=np.int32) if z.shape[1] else np.zeros(
                len(x) + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), _deviations(x, fit), pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))],
                ["row", "deviation", "whitened"])
    return run


def whiten(vectors: DataFrame, fit: Whitening | None, vector_col: str = "embedding") -> DataFrame:
    """All columns of the rows with a usable vector of the fit's length, plus ``deviation``
    (sum of (n x - S)**2, exact; null beyond a long) and ``whitened`` (coordinates).

    Repeated rows and null ids each get their own result; without a fit or rows the
    result is empty.  Columns of the input called ``deviation`` or ``whitened`` are
    replaced; others may have any name.
    """
    own = [c for c in vectors.columns if c not in ("deviation", "whitened")]
    d = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"),
                       grid(F.col(f"`{vector_col}`")).alias("x"))
    d = d.where(F.size("x") == len(fit.total)) if fit else d.where(F.lit(False))
    schema = T.StructType([d.schema["row"], T.StructField("deviation", T.LongType()),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    d = d.mapInArrow(_project(fit or Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0)), schema)
    return d.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "deviation", "whitened")


def whitening_digest(vectors: DataFrame) -> DataFrame:
    """One row per usable vector and component; edge cases as in :func:`fit_whitening`."""
    fit = fit_whitening(vectors)
    d = whiten(vectors.select("vec_id", "embedding"), fit)
    shares = F.array(*[F.lit(float(v)) for v in fit.explained]) if fit is not None and len(fit.explained) else F.array(F.lit(0.0))
    return (d.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
            .select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"),
                    "deviation", "whitened", F.get(shares, F.col("i")).alias("explained"),
                    F.lit(fit.identity_error if fit else 0.0).alias("identity_error")))
