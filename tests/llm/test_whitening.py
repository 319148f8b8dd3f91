import numpy as np
import pytest

from tests.llm.helpers import SF, odd_columns
from votecount.llm import whitening

EMB = "vec_id long, embedding array<double>, label int"


def told_plainly(vectors):
    """x, its sums, and the eigenvalues and vectors of its covariance by another algorithm."""
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    n = len(x)
    centred = x - x.mean(axis=0)
    e, u = np.linalg.eigh(centred.T @ centred / n)
    return x, centred, e[::-1], u[:, ::-1]


def agrees(rows, x, centred, e, u, kept=32):
    n, k = len(x), min(kept, len(e))
    assert len(rows) == n * k
    w = np.array([r.whitened for r in rows]).reshape(n, k)
    wanted = centred @ u[:, :k] / np.sqrt(e[:k])
    signs = np.sign((w * wanted).sum(axis=0))
    assert np.abs(w * signs - wanted).max() < 1e-8
    assert [r.component for r in rows[:k]] == list(range(1, k + 1))
    np.testing.assert_allclose([r.explained for r in rows[:k]], e[:k] / e.sum(), rtol=1e-9)
    whole = x.astype(np.int64)
    deviation = ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    assert [r.deviation for r in rows[::k]] == deviation.tolist()
    assert {r.n for r in rows} == {n}
    (error,) = {r.identity_error for r in rows}
    assert error == pytest.approx(np.abs((w - w.mean(axis=0)).T @ (w - w.mean(axis=0)) / n - np.eye(k)).max(), abs=1e-12)
    assert error < 1e-8


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = whitening.whiten(table).orderBy("vec_id", "component").collect()
    agrees(rows, *told_plainly([r.embedding for r in table.orderBy("vec_id").collect()]))


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=5).tolist()) for i in range(30)]
    good += [(30 + i, good[3][1]) for i in range(20)] + [(50, [0.5, 1.5]), (51, [])]
    bad = [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0]), (62, [float("nan")] * 5), (63, [float("-inf")] * 5)]
    df = odd_columns(spark.createDataFrame([(i, v, 0) for i, v in good + bad], EMB), "n", "v", "component", "slot", "a.b")
    rows = whitening.whiten(df).orderBy("vec_id", "component").collect()
    full = [v + [0.0] * (5 - len(v)) for _, v in good]
    agrees(rows, *told_plainly(full))


def test_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (1, [0.0], 0), (None, [3.0], 0)], EMB)
    rows = whitening.whiten(df).collect()
    assert sorted((str(r.vec_id), r.deviation) for r in rows) == [("1", 192**2), ("1", 192**2), ("None", 384**2)]


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.5, 0.25], 0)], [(1, [2.0], 0), (2, [2.0], 0)], [(1, [], 0)]])
def test_no_variance(spark, rows):
    df = whitening.whiten(spark.createDataFrame(rows, EMB))
    assert df.collect() == []
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_copied_and_constant_dimensions(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 50)).tolist()
    df = spark.createDataFrame([(i, [a[i], b[i], a[i], 7.0], 0) for i in range(50)], EMB)
    rows = whitening.whiten(df).collect()
    assert {r.component for r in rows} == {1, 2}
    assert rows[0].identity_error < 1e-9
    assert sum({r.component: r.explained for r in rows}.values()) == pytest.approx(1)


def test_large_numbers(spark):
    """Exact where plain longs would run over; a deviation that no long holds is NULL."""
    big = float(2**45)
    df = spark.createDataFrame([(1, [big], 0), (2, [-big], 0), (3, [big - 1], 0)], EMB)
    rows = whitening.whiten(df).collect()
    assert [r.deviation for r in rows] == [None] * 3
    assert rows[0].identity_error < 1e-9


@pytest.mark.parametrize("d", [1, 2, 7, 30])
def test_eigen_of_graded_matrices(d):
    """Small eigenvalues keep their digits beside large ones."""
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    wanted = 10.0 ** -np.linspace(0, 8, d)
    e, u = whitening.eigen(q @ np.diag(wanted) @ q.T)
    np.testing.assert_allclose(e, wanted, rtol=1e-6)
    np.testing.assert_allclose(u.T @ u, np.eye(d), atol=1e-12)


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(12, 5))
    v = a @ a.T
    lower, p = whitening.pivoted_cholesky(v)
    assert lower.shape[1] == 5
    np.testing.assert_allclose(lower @ lower.T, v[p][:, p], atol=1e-12)
    turned = whitening.one_sided_jacobi(lower)
    gram = turned.T @ turned
    np.testing.assert_allclose(gram, np.diag(np.diag(gram)), atol=1e-12)
    np.testing.assert_allclose(turned @ turned.T, lower @ lower.T, atol=1e-12)
