"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

1. One pass takes the number of rows and the exact sums of every dimension.
2. A second pass takes the scatter about the sums' rounded mean: whole numbers, multiplied in blocks
   and added up exactly over tasks, then groups of tasks (``vectors.gathered``). What rounding the
   mean left is taken off in whole numbers too, so the covariance is exact until it is divided.
3. The driver holds one matrix of dimension by dimension. Cholesky with complete pivoting writes it
   as L L', with as many columns as it has rank, and one-sided Jacobi turns the columns of L until
   they are at right angles. No product is formed again: the squared lengths of the turned columns
   are the eigenvalues, and the columns over their lengths are the components.
4. A third pass whitens all rows and adds up their covariance (means and co-moments are merged), for
   the largest difference from the identity; a last one writes the rows.

Memory is one Arrow batch and some matrices of the dimension in a task; rows are never shuffled.

Edge cases: rows whose vector is null or holds a null or non-finite component are dropped; so are
components beyond 2**53 after scaling, which no double tells apart. Vectors of other lengths are
filled up with zeros. Rows that repeat an id, or have none, are rows of their own. Components whose
variance is zero to working precision (a constant dimension, copies of one dimension, a single row)
cannot be divided by and are left out, so there may be fewer than asked for, or none; an empty table
gives no rows. Equal eigenvalues give any basis of their space. A deviation beyond a long is NULL.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votecount.llm.common import importable
from votecount.llm.vectors import floors, gathered, matrix, product

SCALE, SHIFT, KEPT = 64, 1_000_000, 32
_COLUMNS = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
_LONG = 1 << 63


def pivoted_cholesky(v: np.ndarray, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """(L, p) with v[p][:, p] = L L'; columns end where no pivot above ``tolerance`` of the first is left."""
    a, d = v.astype(np.float64).copy(), len(v)
    p = np.arange(d)
    lower = np.zeros((d, d))
    floor = tolerance * max(float(np.diag(a).max(initial=0.0)), 0.0) * d
    for j in range(d):
        best = j + int(np.diag(a)[j:].argmax())
        if a[best, best] <= floor:
            return lower[:, :j], p
        for x in (a, lower):
            x[[j, best]] = x[[best, j]]
        a[:, [j, best]] = a[:, [best, j]]
        p[[j, best]] = p[[best, j]]
        lower[j, j] = math.sqrt(a[j, j])
        lower[j + 1 :, j] = a[j + 1 :, j] / lower[j, j]
        a[j + 1 :, j + 1 :] -= np.outer(lower[j + 1 :, j], lower[j + 1 :, j])
    return lower, p


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, as rounds of pairs without a common column (a tournament)."""
    seats = list(range(n + n % 2))
    out = []
    for _ in range(len(seats) - 1):
        pairs = [sorted(x) for x in zip(seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1], strict=True)]
        pairs = [x for x in pairs if x[1] < n]
        out.append((np.array([x[0] for x in pairs], int), np.array([x[1] for x in pairs], int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def one_sided_jacobi(lower: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns turned in pairs, all pairs of a round at once, until every pair is at right angles."""
    g = lower.copy()
    rounds = _rounds(g.shape[1])
    for _ in range(sweeps):
        turned = False
        for i, j in rounds:
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            need = np.abs(c) > 1e-15 * np.sqrt(a * b)
            if not need.any():
                continue
            turned = True
            with np.errstate(divide="ignore", invalid="ignore"):
                zeta = (b - a) / (2 * c)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            t = np.where(need & np.isfinite(t), t, 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            g[:, i], g[:, j] = cos * x - sin * y, sin * x + cos * y
        if not turned:
            break
    return g


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a covariance; zero ones left out."""
    lower, p = pivoted_cholesky(v)
    turned = np.empty_like(lower)
    turned[p] = one_sided_jacobi(lower)
    e = (turned**2).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    return e[order], turned[:, order] / np.sqrt(e[order])


def _added(texts: list[str]) -> str:
    """Whole numbers of the same layout added up exactly; Python's numbers have no bound."""
    total = None
    for t in texts:
        one = np.array(json.loads(t), dtype=object)
        total = one if total is None else total + one
    return json.dumps(total.tolist())


def _merged(texts: list[str]) -> str:
    """(n, mean, co-moments) of all rows out of those of parts."""
    n, mean, m = 0, 0.0, 0.0
    for t in texts:
        k, other, s = (np.array(x) for x in json.loads(t))
        step = other - mean
        m = m + s + np.outer(step, step) * (n * k / (n + k))
        mean = mean + step * (k / (n + k))
        n = n + int(k)
    return json.dumps([n, mean.tolist(), m.tolist()])


def whiten(rows: DataFrame, kept: int = KEPT, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: the whitened coordinate and what it is derived from."""
    spark = rows.sparkSession
    importable(spark)
    # The shift keeps numbers positive and changes no difference; deviations are the same without it.
    x = F.transform(floors(F.col(vector), SCALE), lambda c: c + SHIFT)
    plain = rows.select(F.col(id_).cast("bigint").alias("vec_id"), x.alias("v")).where(F.col("v").isNotNull())
    n, dims = plain.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not dims:
        return spark.createDataFrame([], _COLUMNS)

    def values(batch: pa.RecordBatch) -> np.ndarray:
        v = matrix(batch.column("v"), dims)
        short = batch.column("v").value_lengths().to_numpy(zero_copy_only=False) < dims
        if short.any():  # a missing component is a zero, which the shift moves too
            lengths = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            v[np.arange(dims) >= lengths[:, None]] = SHIFT
        return v

    def sums(batches: Iterator[pa.RecordBatch]) -> list[str]:
        total = np.zeros(dims, object)
        for batch in batches:
            total = total + values(batch).astype(object).sum(axis=0) if _large(batch, dims) else total + values(batch).sum(axis=0)
        return [json.dumps([int(t) for t in total])]

    S = json.loads(gathered(plain.select("v"), sums, _added))
    middle = [(2 * s + n) // (2 * n) for s in S]
    left = [s - n * m for s, m in zip(S, middle, strict=True)]  # at most half a unit a row
    middle_, rest = np.array(middle, np.int64), np.array(left, object)
    mean_off = np.array([r / n for r in left])

    def scatter(batches: Iterator[pa.RecordBatch]) -> list[str]:
        total = np.zeros((dims, dims), object)
        for batch in batches:
            d = values(batch) - middle_
            for a in range(0, len(d), 1024):
                total = total + product(d[a : a + 1024].T, d[a : a + 1024])
        return [json.dumps([[int(t) for t in row] for row in total])]

    about = np.array(json.loads(gathered(plain.select("v"), scatter, _added)), dtype=object)
    exact = n * about - np.outer(rest, rest)  # n**2 times the covariance
    v = np.array([[x / (n * n) for x in row] for row in exact])
    e, u = eigen(v)
    trace = sum(exact[i, i] for i in range(dims)) / (n * n)
    e, u = e[:kept], u[:, :kept]
    if not len(e):
        return spark.createDataFrame([], _COLUMNS)
    scaled, share = u / np.sqrt(e), e / trace

    def whitened(d: np.ndarray) -> np.ndarray:
        return (d.astype(np.float64) - mean_off) @ scaled

    def moments(batches: Iterator[pa.RecordBatch]) -> list[str]:
        parts = []
        for batch in batches:
            if batch.num_rows:
                w = whitened(values(batch) - middle_)
                mean = w.mean(axis=0)
                own = json.dumps([len(w), mean.tolist(), ((w - mean).T @ (w - mean)).tolist()])
                parts = [_merged([*parts, own])]
        return parts

    _, _, m = json.loads(gathered(plain.select("v"), moments, _merged))
    error = float(np.abs(np.array(m) / n - np.eye(len(e))).max())

    def deviation(d: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S)**2; NULL where that is more than a long holds."""
        largest = n * (float(np.abs(d).max(initial=0)) + 1)
        if dims * largest * largest < _LONG / 2:
            return pa.array(((n * d - rest.astype(np.int64)) ** 2).sum(axis=1))
        off = n * d.astype(object) - rest
        total = (off * off).sum(axis=1).tolist()
        return pa.array([t if t < _LONG else None for t in total], pa.int64())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                d = values(part) - middle_
                rows_ = part.num_rows
                again = pa.array(np.repeat(np.arange(rows_), k))
                yield pa.RecordBatch.from_pydict(
                    {
                        "vec_id": part.column("vec_id").take(again),
                        "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows_),
                        "n": np.full(rows_ * k, n),
                        "deviation": deviation(d).take(again),
                        "whitened": whitened(d).ravel(),
                        "explained": np.tile(share, rows_),
                        "identity_error": np.full(rows_ * k, error),
                    }
                )

    return plain.mapInArrow(out, _COLUMNS)


def _large(batch: pa.RecordBatch, dims: int) -> bool:
    """Whether plain sums of the batch might leave a long."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return float(np.abs(flat).max(initial=0)) * max(1, batch.num_rows) >= _LONG / 2
