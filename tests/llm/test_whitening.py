"""Whitening against exact arithmetic and against matrices with known eigenvectors."""

import math
from fractions import Fraction

import numpy as np

from foldwise.llm import whitening as W

LD = np.longdouble


def orthogonal(n, seed):
    """An orthogonal matrix in extended precision."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0].astype(LD)
    for _ in range(4):
        q = q @ (LD(3) * np.eye(n, dtype=LD) - q.T @ q) / LD(2)
    return q


def check_eigen(values, tight):
    n = len(values)
    q = orthogonal(n, n)
    lam = np.array(sorted(values, reverse=True), dtype=LD)
    v = (q * lam) @ q.T
    v = (v + v.T) / 2
    got, x, log = W.refined_eigen(v)
    assert np.abs(got - lam).max() < 1e-17 * np.abs(lam).max() * n
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-17 * n
    residual = v @ x - x * got
    assert np.abs(residual).max() < 1e-17 * np.abs(lam).max() * n
    if tight is not None:
        assert np.abs(np.abs(np.einsum("ij,ij->j", q, x)) - 1).max() < tight
    return log


def test_separate_eigenvalues():
    log = check_eigen(np.linspace(1, 40, 40) ** 2, 1e-16)
    assert log[0][0] == "float64" and log[-1][0] == np.dtype(np.longdouble).name and log[0][1] > 1e-9 and log[-1][1] < 1e-16
    check_eigen([5.0, 3.0, 1e-6, 1e-9], 1e-12)
    check_eigen([7.0], 1e-18)
    check_eigen([2e30, 1e25, 3e20], 1e-15)


def test_clustered_eigenvalues_are_told_apart():
    """Gaps far below float32: without the sub-solves the vectors would stay mixed."""
    rng = np.random.default_rng(2)
    values = [9.0, *(4 + 1e-9 * np.arange(6)), *(1 + 1e-11 * np.arange(5)), *rng.uniform(0.1, 0.5, 8)]
    log = check_eigen(values, 1e-12)
    assert any(held > 0 for _, _, held in log)


def test_equal_eigenvalues_keep_their_space():
    check_eigen([3.0] * 5 + [1.0] * 4 + [0.5], None)
    check_eigen([2.0] * 6, None)
    values, x, log = W.refined_eigen(np.zeros((4, 4), dtype=LD))
    assert not values.any() and (x == np.eye(4)).all()


def test_exact_products():
    rng = np.random.default_rng(3)
    for top in (5, 10**6, 10**9, 2**45, 2**61):
        z = rng.integers(-top, top, size=(300, 4))
        want = z.astype(object).T @ z.astype(object)
        assert (W.exact_products(z) == want).all()
    assert (W.exact_products(np.zeros((0, 3), np.int64)) == 0).all()
    assert (W.exact_products(np.full((5, 2), -(2**50))) == 5 * 2**100).all()


def expected(rows, components=16):
    """Exact sums and covariance in fractions, eigenpairs by the double solver; rows: (vec_id, vector)."""
    good = [
        (k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = [[Fraction(n * x[i] - sums[i], n) for i in range(d)] for x in fit]
    v = np.array([[float(sum(a[i] * a[j] for a in centred) / n) for j in range(d)] for i in range(d)])
    values, q = np.linalg.eigh(v)
    return good, n, sums, v, values[::-1][:components], q[:, ::-1][:, :components]


def compare(got, rows, components=16):
    good, n, sums, v, values, q = expected(rows, components)
    keep = int((values > values[0] * 1e-12).sum())
    assert len(got) == len(good) * keep
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r)
    dev = {}
    for k, x in good:
        dev.setdefault(k, []).append(sum((n * a - s) ** 2 for a, s in zip(x, sums)))
    for c in range(keep):
        own = by[c + 1]
        y = {k: [float(Fraction(n * x[i] - sums[i], n)) for i in range(len(sums))] for k, x in good}
        w = {k: np.dot(y[k], q[:, c]) / math.sqrt(values[c]) for k in y}
        k0 = max(w, key=lambda k: abs(w[k]))
        sign = np.sign(w[k0] * own[k0][0]["whitened"])
        for k, rs in own.items():
            for r in rs:
                assert abs(sign * r["whitened"] - w[k]) < 1e-7 and r["n"] == n
                assert abs(r["explained"] / (values[c] / np.trace(v)) - 1) < 1e-9 and r["identity_error"] < 1e-10
            assert sorted(r["deviation"] for r in rs) == sorted(dev[k])


def run(spark, rows, tmp_path, kind="float"):
    from foldwise.llm.queries import QUERIES

    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return QUERIES["op13_embedding_whitening"](spark, str(tmp_path)).collect()


def test_query_against_exact_arithmetic(spark):
    from foldwise.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(QUERIES["op13_embedding_whitening"](spark, sf).collect(), rows)


def test_edge_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=5).astype(np.float32).tolist(), 1) for k in range(60)]
    rows += [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0], 1), (102, [float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (103, [float("inf")] + [0.0] * 4, 1)]
    rows += [(None, rows[0][1], None), (3, rows[3][1], 2)] + [(200 + k, rows[5][1], 3) for k in range(300)]
    compare(run(spark, rows, tmp_path / "a"), [r[:2] for r in rows])
    # other lengths and entries beyond a long are dropped
    odd = [*rows, (300, [1.0] * 4, 1), (301, [], 1), (302, [1e30] + [0.0] * 4, 1)]
    compare(run(spark, odd, tmp_path / "b", "double"), [r[:2] for r in rows])
    # a constant dimension and fewer vectors than dimensions: only components that vary
    flat = [(k, [float(k), 1.0, float(k * k), 2.0, 0.5 * k], 1) for k in range(3)]
    got = run(spark, flat, tmp_path / "c", "double")
    assert {r["component"] for r in got} == {1, 2}
    compare(got, [r[:2] for r in flat])
    assert run(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], tmp_path / "d") == []
    assert run(spark, [], tmp_path / "e") == []
    # entries of very different size, where doubles alone would lose the products
    wide = [(k, [1e5 * rng.normal(), rng.normal(), 1e-2 * k], 1) for k in range(40)]
    got = run(spark, wide, tmp_path / "f", "double")
    good, n, sums, v, values, q = expected([r[:2] for r in wide])
    assert max(r["identity_error"] for r in got) < 1e-6 and {r["component"] for r in got} == {1, 2, 3}
    assert all(abs(r["explained"] / (values[r["component"] - 1] / np.trace(v)) - 1) < 1e-4 for r in got if r["component"] == 1)


def test_large_counts_stay_exact():
    model = W.Whitening(3, 10**11, (W.SHIFT,) * 3, (5, -7, 10**12), np.ones(1), np.ones((3, 1)), 1.0)
    x = np.array([[W.SHIFT + 100, W.SHIFT - 100, W.SHIFT]] * 2)
    want = (10**13 - 5) ** 2 + (-(10**13) + 7) ** 2 + 10**24
    assert W.exact_deviation(x, model) == [want, want]


def test_other_columns_and_partitionings(spark):
    rng = np.random.default_rng(9)
    rows = [(k, rng.normal(size=4).tolist(), "x") for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string").selectExpr("*", "1 AS w", "2 AS d", "3 AS c0", "map(1, 2) AS i", "'v' AS v")
    a, model, error = W.whiten(df.repartition(7), components=3)
    b, _, _ = W.whiten(df.coalesce(1), components=3)
    assert a.columns == ["vec_id", "w", "d", "c0", "i", "v", "whitened", "whitened_deviation"] and len(model.values) == 3 and error < 1e-12
    one, other = ({r["vec_id"]: tuple(r["whitened"]) for r in f.collect()} for f in (a, b))
    assert one == other and len(one) == 200
