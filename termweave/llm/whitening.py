"""Whitening of vectors: rotated onto the eigenvectors of their covariance and scaled to unit variance.

Components are whole numbers, floor(64 c) + 1000000, so their count and sums are exact. The scatter is centred at the rounded mean
inside each task and summed over the tasks; what rounding the mean left is taken off exactly. The driver turns that d x d
matrix by Jacobi's rotations, cycle after cycle, until what stands off the diagonal vanishes; that keeps small eigenvalues accurate.
The chosen eigenvectors (at most d x 32 numbers) go to all tasks, and the result's own covariance is measured in one more pass.

Rows whose vector is null or holds a null or non-finite component go. Shorter vectors count as followed by zeros up to the longest
one. Components beyond 2**27 after scaling are held there. Repeated ids are rows of their own. Directions without
variance (less than 1e-12 of the largest) are left out, as nothing can be divided by it: equal vectors and a single one give no
component, and an empty table no row. Columns other than the two named ones are not looked at.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import fixed_point, matrix, pieces, summed, totals, width

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: The matrix is held by the driver, and each component by every task.
MOST_DIMENSIONS = 2048
FLAT = 1e-12


class Whitening(NamedTuple):
    """n rows with sums (without OFFSET) by dimension; variances fall; vectors has a row for each component."""

    n: int
    sums: np.ndarray
    variances: np.ndarray
    vectors: np.ndarray
    trace: float


def jacobi(a: np.ndarray, most_cycles: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors as rows of a symmetric matrix, by cyclic rotations."""
    a, d = a.astype(np.float64).copy(), len(a)
    v = np.eye(d)
    for _ in range(most_cycles):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                # Vanished: no larger than what the two diagonal entries can't tell from nothing.
                if abs(a[p, q]) <= 1e-17 * np.sqrt(abs(a[p, p] * a[q, q])) or a[p, q] == 0:
                    continue
                turned = True
                t = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                turn = np.array([[c, -s], [s, c]])
                a[[p, q]] = turn @ a[[p, q]]
                a[:, [p, q]] = a[:, [p, q]] @ turn.T
                a[p, q] = a[q, p] = 0.0
                v[[p, q]] = turn @ v[[p, q]]
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], v[order]


def _kept(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    return fixed_point(df.select(df[vec_id].alias("vec_id"), df[vector].alias("v")), "v", SCALE).select("vec_id", "x")


def fit(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of all rows: two passes, each of one partial sum a task."""
    kept = _kept(df, vec_id, vector)
    d = width(kept)
    if d > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    first = summed(kept, d, lambda x: np.concatenate([[len(x)], x.sum(0)]), d + 1)
    n, sums = int(first[0]), first[1:]
    if not n or not d:
        return Whitening(n, sums, np.zeros(0), np.zeros((0, d)), 0.0)
    centre = np.round(sums / n).astype(np.int64)

    def scatter(x: np.ndarray) -> np.ndarray:
        y = (x - centre).astype(np.float64)
        return (y.T @ y).ravel()

    left = (sums - n * centre) / n
    covariance = summed(kept, d, scatter, d * d, np.float64).reshape(d, d) / n - np.outer(left, left)
    values, vectors = jacobi((covariance + covariance.T) / 2)
    chosen = np.flatnonzero(values > FLAT * max(values[0], 0.0))[:components]
    return Whitening(n, sums, values[chosen], vectors[chosen], float(np.trace(covariance)))


def apply(df: DataFrame, w: Whitening, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, deviation (sum over dimensions of (n x - S)^2, exact; null where it doesn't fit a long) and whitened (a double for each
    component) of all rows."""
    kept = _kept(df, vec_id, vector)
    n, d = w.n, len(w.sums)
    centre = np.round(w.sums / max(n, 1)).astype(np.int64)
    left = w.sums - n * centre
    rotation = w.vectors.T / np.sqrt(w.variances) if len(w.variances) else np.zeros((d, 0))

    def run(batches):
        for batch in pieces(batches):
            y = matrix(batch.column(1), d) - centre
            far = n * y - left if n < 1 << 34 else n * y.astype(object) - left
            if not d or float(np.abs(far).max(initial=0)) ** 2 * d < 2.0**62:
                deviation = (far**2).sum(1).tolist()
            else:
                deviation = [v if v < 1 << 63 else None for v in (far.astype(object) ** 2).sum(1)]
            white = ((y - left / n) @ rotation).astype(np.float64)
            k = white.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * k, pa.int32()), pa.array(white.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"vec_id {kind}, deviation bigint, whitened array<double>")


def identity_error(whitened: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of `whitened` minus the identity, measured over all rows."""
    k, n = len(w.variances), w.n
    if not k:
        return 0.0

    def run(batches):
        total = np.zeros(k + k * k)
        for batch in pieces(batches):
            z = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, k)
            total += np.concatenate([z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    found = totals(whitened.select("whitened").mapInArrow(run, "v array<double>"), "v", k + k * k, np.float64)
    mean = found[:k] / n
    return float(np.abs(found[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def components(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    w = fit(df, vec_id, vector)
    rows = apply(df, w, vec_id, vector)
    error = identity_error(rows, w)
    explained = F.array(*[F.lit(float(e / w.trace)) for e in w.variances]) if len(w.variances) else F.array().cast("array<double>")
    long = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
