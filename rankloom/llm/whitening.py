"""Whitening of embeddings: principal components of the distributed covariance, to double precision, and scores of unit variance.

1. Entries become integers (``floor(64 c) + 1000000``), so sums per dimension are exact whatever the order of adding.
2. Vectors are centred (the integer part exactly), multiplied in the tasks and added in a tree; the driver gets one
   width x width matrix, which depends on the number of dimensions and not on the number of rows.
3. Eigenvectors of that matrix are found in float32 and corrected by Ogita-Aishima iterations: with the residuals
   R = I - X'X and S = X'AX every pair of columns is turned towards diagonal S, by matrix products in extended precision
   alone, and errors are squared by each round. Pairs whose eigenvalues lie closer together than the present error bound
   cannot be told apart by that formula; such a cluster is turned by the solution of its own small problem, whose matrix is
   shifted by the cluster's mean, so that its error is relative to the spread of the cluster.
4. Every vector is projected; a last pass over the scores measures their covariance.

Defined cases: rows whose vector is null or empty, holds null or non-finite entries, or has another length than the most
frequent one (the longer one of equals) are left out; a null vec_id stays null; equal rows and ids are rows of their own;
directions without variance (fewer rows than dimensions, constant entries) have null scores, and `identity_error` is over the
others; `explained` is null where all vectors are equal; fewer components come back where the vectors are shorter; an empty
table gives no rows; other columns are not read. Entries must lie below 2^40, and a deviation that does not fit a long is an
error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.matrices import lists, matrix, summed
from .common import stored

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
# Rounds of the correction, and whether clusters are solved after a round. Errors of 1e-7 are squared in each round; the
# bound is small enough to see real clusters after two, and two more follow each solution.
ROUNDS = (False, True, False, True, False, False)

Batches = Iterator[pa.RecordBatch]


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Ogita-Aishima step: better eigenvectors, eigenvalues, and the bound below which eigenvalues are not told apart."""
    r, s = x.T @ x, x.T @ (a @ x)
    # Exactly symmetric, since what close eigenvalues magnify must stay a rotation.
    r, s = np.eye(len(a), dtype=a.dtype) - (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    # Frobenius norms are upper bounds of the spectral ones.
    bound = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    gap = values[None, :] - values[:, None]
    near = np.abs(gap) <= bound
    turn = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
    return x + x @ turn, values, bound


def solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, bound: float) -> np.ndarray:
    """Columns whose eigenvalues lie within ``bound`` of the next one are turned by their own shifted problem."""
    order = np.argsort(-values, kind="stable")
    edges = np.flatnonzero(-np.diff(values[order]) > bound) + 1
    for group in np.split(order, edges):
        if len(group) < 2:
            continue
        own = x[:, group]
        shift = values[group].mean()
        block = own.T @ (a @ own) - shift * (own.T @ own)
        size = np.abs(block).max()
        if size > 0:
            x[:, group] = own @ np.linalg.eigh(((block + block.T) / (2 * size)).astype(np.float64))[1][:, ::-1]
    return x


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix of extended precision."""
    a = np.asarray(a, np.longdouble)
    scale = np.abs(a).max(initial=0)
    if scale == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    for solve in ROUNDS:
        x, values, bound = corrected(a, x)
        if solve:
            x = solve_clusters(a, x, values, bound)
    values = np.diag(x.T @ (a @ x)) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(axis=0))[order]
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, c) with entries as doubles, of the vectors that can take part."""
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("c"))
    return rows.where(F.forall("c", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & (F.size("c") > 0))


def _steps(column: pa.Array, width: int) -> np.ndarray:
    """The integers of a batch without their common offset."""
    c = np.floor(STEPS * matrix(column, width))
    if np.abs(c).max(initial=0) >= STEPS * 2.0**40:
        raise ValueError("an entry of 2^40 or more")
    return c.astype(np.int64)


def _totals(width: int):
    """Exact sums per dimension of a task."""

    def run(batches: Batches) -> Batches:
        total = [0] * width
        for batch in batches:
            total = [a + b for a, b in zip(total, _steps(batch.column(1), width).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total, pa.int64())], names=["at", "total"])

    return run


class Centre:
    """Exact sums of the integers per dimension, and vectors less their mean."""

    def __init__(self, n: int, totals: list[int]):
        self.n, self.totals, self.width = n, totals, len(totals)
        self.middle = np.array([(2 * t + n) // (2 * n) for t in totals], np.int64)
        # Less than half a step is left over, so it is right to the last digit.
        self.rest = np.array([t - n * int(m) for t, m in zip(totals, self.middle)], np.int64)

    def centred(self, column: pa.Array) -> np.ndarray:
        return (_steps(column, self.width) - self.middle) - self.rest / self.n

    def deviations(self, column: pa.Array) -> list[int]:
        """Sum over dimensions of (n x - S)^2 of each row, exactly."""
        y = _steps(column, self.width) - self.middle
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * self.width < 1 << 62:
            z = self.n * y - self.rest
            return (z * z).sum(axis=1).tolist()
        return [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest)) for row in y]


def _scored(centre: Centre, turn: np.ndarray):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = centre.centred(batch.column(1)) @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(centre.deviations(batch.column(1)), pa.int64()), lists(out)], names=["vec_id", "deviation", "w"]
            )

    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark, rows = vectors.sparkSession, usable(vectors, vec_id, vector)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("c").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        return spark.createDataFrame([], result)
    width, n = lengths["width"], lengths["count"]
    rows = rows.where(F.size("c") == width)
    totals = rows.mapInArrow(_totals(width), "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()
    centre = Centre(n, [r["total"] for r in totals])

    def products(batch: pa.RecordBatch) -> np.ndarray:
        d = centre.centred(batch.column(1))
        return d.T @ d

    values, axes = eigen(summed(rows, products, width * width).reshape(width, width) / n)
    k = min(components, width)
    trace, live = float(values.sum()), values[:k] > max(values[0], 0.0) * width * np.finfo(np.float64).eps
    turn = axes[:, :k] * np.where(live, 1 / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    scores = stored(rows.mapInArrow(_scored(centre, turn), f"vec_id {id_type}, deviation long, w array<double>"), "whitened")
    mean = (summed(scores, lambda b: matrix(b.column(2), k).sum(axis=0), k) / n).astype(np.float64)

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        d = matrix(batch.column(2), k) - mean
        return d.T @ d

    covariance = (summed(scores, spread, k * k).reshape(k, k) / n)[np.ix_(live, live)]
    error = float(np.abs(covariance - np.eye(len(covariance))).max()) if live.any() else None
    facts = [F.struct(F.lit(bool(on)).alias("live"), F.lit(float(v) / trace if trace > 0 else None).cast("double").alias("explained")) for on, v in zip(live, values)]
    each = scores.select("vec_id", "deviation", F.posexplode(F.arrays_zip(F.col("w"), F.array(*facts).alias("f"))).alias("at", "e"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(_of("e", "f", "live"), _of("e", "w")).alias("whitened"),
        _of("e", "f", "explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def _of(column: str, *path: str) -> Column:
    out = F.col(column)
    for name in path:
        out = out.getField(name)
    return out
