"""Norms, leading pairs and factor forms without n x n arrays, against dense linear algebra."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import covariance as CV
from foldwise.operators import folds as FD
from foldwise.operators import kernels as K
from foldwise.operators import moments as M

DESIGN = FD.two_segment(20, 5)


def centred(t, n, seed, factor=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(t, n)) + factor * rng.normal(size=(t, 1)) * rng.normal(size=(1, n))
    return (x - x.mean(axis=0)) / np.sqrt(t - 1)


def dense_norm(xc):
    c = xc.T @ xc
    np.fill_diagonal(c, 0.0)
    return np.abs(np.linalg.eigvalsh(c)).max()


@pytest.mark.parametrize("t,n", [(5, 1), (5, 2), (40, 3), (12, 60), (60, 12), (30, 30), (20, 300), (250, 200)])
@pytest.mark.parametrize("factor", [0.0, 0.3, 5.0])
def test_norm_equals_dense_eigenvalues(t, n, factor):
    xc = centred(t, n, t * n, factor)
    assert K.offdiagonal_norm(xc) == pytest.approx(dense_norm(xc), rel=1e-9, abs=1e-13)


def test_norm_where_the_negative_end_is_the_larger_one():
    # one series against the sum of others: x and -x in turn give eigenvalues of both signs
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 1)) @ np.array([[1.0, -1.0]]) + 0.01 * rng.normal(size=(50, 2))
    xc = (x - x.mean(axis=0)) / 7
    assert K.offdiagonal_norm(xc) == pytest.approx(dense_norm(xc), rel=1e-9)
    y = np.linalg.qr(rng.normal(size=(4, 4)))[0][:, :3] @ np.array([[1, -0.5, -0.5], [0, 0.75**0.5, -(0.75**0.5)], [0, 0, 0]])
    assert np.linalg.eigvalsh(y.T @ y - np.diag((y * y).sum(axis=0)))[0] == pytest.approx(-1)
    assert K.offdiagonal_norm(y) == pytest.approx(1, rel=1e-9)


def test_norm_of_constant_repeated_and_tied_series():
    xc = centred(20, 4, 1)
    assert K.offdiagonal_norm(np.zeros((20, 4))) == 0.0
    assert K.offdiagonal_norm(np.column_stack([xc, np.zeros(20)])) == pytest.approx(dense_norm(xc), rel=1e-9)
    same = np.repeat(xc[:, :1], 6, axis=1)
    assert K.offdiagonal_norm(same) == pytest.approx(dense_norm(same), rel=1e-9)
    blocks = np.kron(np.eye(3), xc[:, :2])  # three equal blocks: every eigenvalue occurs three times
    assert K.offdiagonal_norm(blocks) == pytest.approx(dense_norm(blocks), rel=1e-9)
    assert K.offdiagonal_norm(np.linalg.qr(xc)[0]) == pytest.approx(0, abs=1e-12)


def test_wide_window_needs_no_square_array():
    xc = centred(30, 5000, 9, 1.0)
    tracemalloc.start()
    norm = K.offdiagonal_norm(xc)
    lam, q = K.leading_pairs(xc, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5000 * 5000 * 8 / 10
    # the same norm from the eigenvector's equation
    own = (xc * xc).sum(axis=0)
    v = q[:, 0]
    for _ in range(200):
        v = xc.T @ (xc @ v) - own * v
        v /= np.linalg.norm(v)
    assert norm == pytest.approx(v @ (xc.T @ (xc @ v) - own * v), rel=1e-8)
    assert q.T @ q == pytest.approx(np.eye(3), abs=1e-10) and (np.diff(lam) < 0).all()


@pytest.mark.parametrize("t,n", [(10, 40), (40, 10), (3, 3)])
def test_leading_pairs_equal_the_covariance_eigenpairs(t, n):
    x = np.random.default_rng(t + n).normal(size=(t, n))
    c = np.cov(x, rowvar=False)
    lam, q = K.leading_pairs(x, 50)
    rank = min(t - 1, n)
    assert len(lam) == rank and lam == pytest.approx(np.linalg.eigvalsh(c)[::-1][:rank])
    assert (q * lam) @ q.T == pytest.approx(c, abs=1e-10)
    assert len(K.leading_pairs(np.ones((5, 4)), 2)[0]) == 0


@pytest.fixture(scope="module")
def windows(panel):
    """Rows of the training windows, their factor counts and the arrays by fold."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(32, 7)) + rng.normal(size=(32, 2)) @ rng.normal(size=(2, 7))
    rows = FD.assign_folds(M.indexed(panel({f"s{c}": x[:, c] for c in range(7)})), DESIGN, {"training": ["training"]})
    return rows, rows.select(*M.KEYS).distinct().withColumn("k", F.lit(2)), x


def matrix_by_fold(cells):
    return {f: K.dense(g) for f, g in cells.toPandas().groupby("fold_id")}


def test_factor_form_equals_the_dense_form(windows):
    rows, k, x = windows
    form = CV.factor_form(rows, k)
    got = matrix_by_fold(CV.form_cells(form))
    starts = {r.fold_id: r.p for r in rows.groupBy("fold_id").agg(F.min("pos").alias("p")).collect()}
    assert len(got) > 1 and got.keys() == starts.keys()
    weights = {r.fold_id: {} for r in k.collect()}
    solved = CV.form_minimum_variance(form)
    for r in solved.collect():
        weights[r.fold_id][r.idx] = r.w
    predicted = {r.fold_id: r.predicted for r in CV.form_variance(form, solved).collect()}
    for fold, m in got.items():
        s = np.cov(x[starts[fold]:starts[fold] + 20], rowvar=False)
        want = K.leading_plus_diagonal(s, K.spectrum(s), 2)
        assert m == pytest.approx(want, abs=1e-10)
        w = np.array([weights[fold][i] for i in range(7)])
        assert w == pytest.approx(K.unconstrained_weights(want)) and predicted[fold] == pytest.approx(w @ want @ w)


def test_window_vectors_span_the_same_space(windows):
    rows, k, _ = windows
    cov = M.fold_covariance(rows.drop("design", "fold_id", "segment").distinct(), DESIGN)
    overlap = CV.subspace_overlap(CV.window_vectors(rows, k), CV.leading_vectors(cov, k)).collect()
    assert overlap and all(r.overlap == pytest.approx(1) and r.k == 2 for r in overlap)


def test_factor_form_edges(panel):
    t = np.arange(25.0)
    two = FD.assign_folds(M.indexed(panel({"a": np.sin(t), "b": 0 * t})), DESIGN, {"training": ["training"]})
    k = two.select(*M.KEYS).distinct().withColumn("k", F.lit(9))
    form = CV.factor_form(two, k)
    rows = {r.idx: r for r in form.collect()}
    assert len(rows[0].load) == 1 and rows[1].rest == 0 and rows[1].load[0] == pytest.approx(0)
    with pytest.raises(Exception, match="without variance of its own"):
        CV.form_minimum_variance(form).collect()
    flat = FD.assign_folds(M.indexed(panel({"a": 0 * t, "b": 0 * t})), DESIGN, {"training": ["training"]})
    still = CV.factor_form(flat, k).collect()
    assert [(r.load, r.rest) for r in still] == [([], 0.0)] * len(still) and len(still) == 2
    assert CV.factor_form(flat.limit(0), k).count() == 0
    assert {r.v for r in CV.form_cells(CV.factor_form(flat, k)).collect()} == {0.0}
