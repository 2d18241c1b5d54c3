"""Selection, screening, covariance and portfolios against brute force on small panels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day
from foldwise.operators import covariance as CV
from foldwise.operators import folds as FD
from foldwise.operators import kernels as K
from foldwise.operators import moments as M
from foldwise.operators import portfolio as PF
from foldwise.operators import selection as S
from foldwise.plans import backtest as B
from foldwise.plans import screening as SC


def ols(yt, xt, yo, xo):
    a = np.column_stack([np.ones(len(xt)), xt])
    return yo - np.column_stack([np.ones(len(xo)), xo]) @ np.linalg.lstsq(a, yt, rcond=None)[0]


def score(e):
    r = np.corrcoef(e, rowvar=False)
    return np.sqrt((r[np.triu_indices(len(r), 1)] ** 2).mean())


def brute(y, x, penalty, limit, backward=False):
    def objective(s):
        return round(score(ols(y, x[:, list(s)], y, x[:, list(s)]) if s else y) + penalty * len(s), 12)

    chosen, now, path = (), objective(()), []
    while len(chosen) < limit:
        best = min((objective(chosen + (c,)), c) for c in range(x.shape[1]) if c not in chosen)
        if best[0] >= now - 1e-12:
            break
        now, chosen = best[0], chosen + (best[1],)
        path.append(("ADD", best[1]))
    while backward and chosen:
        best = min((objective(tuple(c for c in chosen if c != d)), d) for d in chosen)
        if best[0] >= now - 1e-12:
            break
        now, chosen = best[0], tuple(c for c in chosen if c != best[1])
        path.append(("DELETE", best[1]))
    return chosen, path


def panels(panel, y, x):
    return panel({f"a{j}": y[:, j] for j in range(y.shape[1])}), panel({f"d{j}": x[:, j] for j in range(x.shape[1])})


def test_planted_drivers_are_found(panel, planted):
    y, x = planted
    r, chosen = SC.evaluate_representation(*panels(panel, y, x), train=60, test=20, penalty=0.006, spectrum=False)
    rows = r.orderBy("fold_id").collect()
    assert len(rows) == 3
    assert all("d0" in row["selected_drivers"].split(" | ") and row["delta_s_f"] < 0 for row in rows)


@pytest.mark.parametrize("tile", [2, 256])
def test_forward_and_backward_equal_brute_force(panel, tile):
    """Tiles of two assets and one tile for all give the choices of full refits."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(90, 3))
    x = np.column_stack([base.sum(axis=1) + 0.3 * rng.normal(size=90), base, rng.normal(size=90)])
    y = base @ rng.normal(size=(3, 5)) + 0.5 * rng.normal(size=(90, 5))
    d = FD.Design("x", [("training", 50), ("test", 20)], step=20)
    rows, index = SC.prepare(*panels(panel, y, x))
    for penalty in (0.0, 0.002, 0.02):
        state = S.greedy_select(M.fold_tiles(rows, d, tile=tile), index, penalty=penalty, max_drivers=5, backward=True)
        for r in state.collect():
            lo = (r["fold_id"] - 1) * 20
            chosen, path = brute(y[lo:lo + 50], x[lo:lo + 50], penalty, 5, True)
            assert tuple(c - 5 for c in r["chosen"]) == chosen
            assert [(p["operation"], p["driver"] - 5) for p in r["path"]] == path


def test_tiled_scores_equal_direct_ones():
    """Partial sums of tile pairs against residual correlations, with a constant asset, a floor and a driver that is spent."""
    rng = np.random.default_rng(21)
    z = rng.normal(size=(60, 9))
    z[:, 3] = 1.0
    z[:, 8] = z[:, 7] * 2
    m = np.cov(z, rowvar=False)
    total, floor = np.diag(m).copy(), np.diag(m) * 1e-12
    left = S._without(m, [7], {k: k for k in range(9)}, floor)
    for head, mat in (((), m), ((7,), left)):
        for vf in (None, 1e-3):
            a, b, drivers = np.arange(3), np.arange(3, 6), np.arange(6, 9)
            for x, y in ((a, b), (a, a), (b, b)):
                got = S._added(mat, total, x, y, drivers, floor, vf)
                for k, q in enumerate(drivers):
                    after = S._without(mat, [q], {k: k for k in range(9)}, floor)
                    assert got[k] == pytest.approx(S._plain(after, total, x, y, vf), abs=1e-11)


def test_screening_with_state_equals_brute_force(panel, planted):
    y, x = planted
    rng = np.random.default_rng(8)
    level = rng.normal(size=120)
    state = panel({"vol": level})
    r, _ = SC.evaluate_representation(*panels(panel, y, x), train=60, test=20, max_drivers=2, penalty=0.001, state=state)
    for row in r.collect():
        lo = row["fold_id"] * 20
        a, b = slice(lo, lo + 60), slice(lo + 60, lo + 80)
        chosen, _ = brute(y[a], x[a], 0.001, 2)
        sel = list(chosen)
        assert sel
        assert row["selected_drivers"] == " | ".join(f"d{c}" for c in chosen)
        e = ols(y[a], x[a][:, sel], y[b], x[b][:, sel])
        assert row["baseline_s_f"] == pytest.approx(score(y[b]))
        assert row["selected_s_f"] == pytest.approx(score(e))
        cut = np.median(level[a])
        f = lambda s: np.column_stack([x[s][:, sel], level[s] > cut, x[s][:, sel] * (level[s] > cut)[:, None]])  # noqa: E731, B023
        assert row["state_threshold"] == pytest.approx(cut)
        assert row["state_s_f"] == pytest.approx(score(ols(y[a], f(a), y[b], f(b))))
        lam = np.linalg.eigvalsh(np.cov(e, rowvar=False))
        share = lam / lam.sum()
        assert row["selected_effective_rank"] == pytest.approx(np.exp(-(share * np.log(share)).sum()))


def test_certification_run_with_components_equals_brute_force(panel, planted):
    y, x = planted
    out = SC.screen_certify_test(
        *panels(panel, y, x), selection_len=40, certification_len=20, test_len=20, penalty=0.01, max_drivers=3, observable=["d2", "absent"]
    )
    got = {(r["fold_id"], r["stage"]): r for r in out["results"].collect()}
    assert len(got) == 3 * 9
    for k in range(3):
        lo = k * 20
        sel, dev, tst = slice(lo, lo + 40), slice(lo, lo + 60), slice(lo + 60, lo + 80)
        chosen = list(brute(y[sel], x[sel], 0.01, 3, True)[0])
        m, s = x[dev].mean(axis=0), x[dev].std(axis=0, ddof=1)
        v = np.linalg.svd((x[dev] - m) / s, full_matrices=False)[2]
        pc = lambda part, n: ((x[part] - m) / s) @ v[:n].T  # noqa: E731, B023
        n = max(len(chosen), 1)
        want = {
            "test_no_conditioning": y[tst], "test_selected_frozen": ols(y[dev], x[dev][:, chosen], y[tst], x[tst][:, chosen]),
            "certification_selected_frozen": ols(y[sel], x[sel][:, chosen], y[lo + 40:lo + 60], x[lo + 40:lo + 60][:, chosen]),
            "test_pca_matched": ols(y[dev], pc(dev, n), y[tst], pc(tst, n)),
            "test_pca_plus_two": ols(y[dev], pc(dev, n + 2), y[tst], pc(tst, n + 2)),
            "test_observable_set": ols(y[dev], x[dev][:, [2]], y[tst], x[tst][:, [2]]),
        }
        for stage, e in want.items():
            row = got[k + 1, stage]
            assert row["s_f"] == pytest.approx(score(e)), stage
            c = np.cov(e, rowvar=False)
            np.fill_diagonal(c, 0)
            assert row["cov_offdiag_spectral"] == pytest.approx(np.linalg.norm(c, 2)), stage


def test_asset_subset_keeps_ends_and_rounds_half_to_even(spark):
    index = spark.createDataFrame([("p", "asset", f"s{k:02d}", k, 12, 12) for k in range(12)], "panel_id string, role string, series string, idx int, n_series int, n_assets int")
    got = sorted(r["idx"] for r in S.even_subset(index, 5).collect())
    assert got == sorted(set(np.linspace(0, 11, 5).round().astype(int)))
    assert S.even_subset(index, 12).count() == 12


def test_two_asset_minimum_variance():
    w = K.unconstrained_weights(np.array([[2.0, 0.2], [0.2, 1.0]]))
    assert w == pytest.approx([0.8 / 2.6, 1.8 / 2.6])


def test_long_only_meets_the_optimality_conditions():
    rng = np.random.default_rng(2)
    for n in (2, 5, 30):
        a = rng.normal(size=(n + 3, n)) + rng.normal(size=(n + 3, 1))
        m = a.T @ a / (n + 3) + 1e-3 * np.eye(n)
        w = K.long_only_weights(m)
        pull, level = m @ w, w @ m @ w
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
        assert (pull >= level * (1 - 1e-8)).all()
        assert pull[w > 0] == pytest.approx(np.full((w > 0).sum(), level))


@pytest.mark.parametrize("t,p", [(80, 20), (25, 60)])
def test_quadratic_inverse_keeps_the_trace_and_is_positive(t, p):
    x = np.random.default_rng(3).normal(size=(t, p))
    s = np.cov(x, rowvar=False)
    q = K.quadratic_inverse(K.spectrum(s), t)
    assert np.trace(q) == pytest.approx(np.trace(s))
    assert np.linalg.eigvalsh(q).min() > 0


def test_factor_threshold_estimator_keeps_the_population_diagonal():
    x = np.random.default_rng(4).normal(size=(60, 12))
    assert np.diag(K.thresholded_factors(x, 3)) == pytest.approx(x.var(axis=0))


def test_floor_reports_activation():
    low = np.diag([1.0, 1e-12])
    m, hit = K.floored(low, 1e-6)
    assert hit and np.linalg.eigvalsh(m).min() == pytest.approx(5e-7, rel=1e-3)
    assert not K.floored(np.eye(2), 1e-6)[1]


def fold_matrices(r, z, k):
    """The eleven estimators written out one by one."""
    t, n = r.shape
    s = np.cov(r, rowvar=False)
    s0, rc = s * (t - 1) / t, r - r.mean(axis=0)
    mu = np.trace(s0) / n
    delta = ((s0 - mu * np.eye(n)) ** 2).sum() / n
    spread = np.mean([((np.outer(v, v) - s0) ** 2).sum() for v in rc]) / t / n
    lw = min(spread, delta) / delta
    a = (s0 * s0).mean()
    oas = min(1.0, (a + mu * mu) / ((t + 1) * (a - mu * mu / n)))
    e = ols(r, z, r, z)
    q0 = s - np.cov(e, rowvar=False)
    np.fill_diagonal(q0, np.diag(s))
    lam, q = np.linalg.eigh(s)

    def pca(j):
        low = (q[:, -j:] * lam[-j:]) @ q[:, -j:].T
        return low + np.diag(np.maximum(np.diag(s) - np.diag(low), 0))

    return s, q0, {
        "equal_weight": s, "sample_covariance": s, "ridge_10pct": 0.9 * s + 0.1 * np.trace(s) / n * np.eye(n),
        "ledoit_wolf": (1 - lw) * s0 + lw * mu * np.eye(n), "oas_shrinkage": (1 - oas) * s0 + oas * mu * np.eye(n),
        "nonlinear_shrinkage_qis": K.quadratic_inverse((lam, q), t), "pca_matched": pca(min(k, n - 1)), "pca_plus_two": pca(min(k + 2, n - 1)),
        "poet_soft_c0_5": K.thresholded_factors(r, k), "structured_q0": q0,
    }


def test_backtest_equals_brute_force(spark, panel, planted):
    """Every method, two designs and both constraints against matrices written out one by one."""
    y, x = planted
    y = y * 0.01
    ledger = spark.createDataFrame([("p", 1, day(20), ["d0", "d1"])], "panel_id string, source_fold long, certification_end date, selected array<string>")
    out = B.covariance_backtest(*panels(panel, y, x), ledger, training=(28, 40), test=20, constraints=("unconstrained", "long_only"))
    got = {(r["portfolio_constraint"], r["design"], r["method"], r["fold_id"]): r for r in out["fold_results"].collect()}
    trials = {(r["design"], r["fold_id"], r["alpha"]): r["validation_variance"] for r in out["alpha_tuning"].collect()}
    assert len(got) == 2 * 11 * 4 + 2 * 11 * 4 and len(trials) == 2 * 4 * len(B.ALPHAS)
    r = np.expm1(y)
    for train in (28, 40):
        before = {}
        for k in range(1, 5):
            lo = (k - 1) * 20
            own, z, test = r[lo:lo + train], x[lo:lo + train, :2], r[lo + train:lo + train + 20]
            fit = int(0.75 * train)
            sf, qf, _ = fold_matrices(own[:fit], z[:fit], 2)
            tuned = {a: (own[fit:] @ K.unconstrained_weights(K.floored((1 - a) * qf + a * sf, 1e-6)[0])).var(ddof=1) for a in B.ALPHAS}
            for a, v in tuned.items():
                assert trials[str(train), k, a] == pytest.approx(v, rel=1e-7)
            alpha = min((v, a) for a, v in tuned.items())[1]
            s, q0, made = fold_matrices(own, z, 2)
            made["residual_aware_qr"] = (1 - alpha) * q0 + alpha * s
            for name, m in made.items():
                m, hit = K.floored(m, 1e-6)
                for constraint, solve in (("unconstrained", K.unconstrained_weights), ("long_only", K.long_only_weights)):
                    w = np.full(6, 1 / 6) if name == "equal_weight" else solve(m)
                    row = got[constraint, str(train), name, k]
                    real = (test @ w).var(ddof=1)
                    assert row["realized_variance"] == pytest.approx(real, rel=1e-6)
                    assert row["predicted_variance"] == pytest.approx(w @ m @ w, rel=1e-6)
                    assert row["qlike"] == pytest.approx(np.log(w @ m @ w) + real / (w @ m @ w), rel=1e-6)
                    assert row["gross_exposure"] == pytest.approx(np.abs(w).sum(), rel=1e-6) and row["eigen_floor_activated"] == hit
                    old = before.get((constraint, name))
                    assert row["turnover"] == pytest.approx(np.abs(w).sum() if old is None else np.abs(w - old).sum(), rel=1e-5, abs=1e-7)
                    assert row["initial_formation"] == (old is None)
                    assert row["chosen_alpha"] == (alpha if name == "residual_aware_qr" else None)
                    grown = w * (1 + test).prod(axis=0)
                    before[constraint, name] = grown / grown.sum()
    summary = B.fold_summary(out["fold_results"], out["daily_pnl"]).collect()
    assert len(summary) == 2 * 2 * 11 and all(row["eigen_floor_activation_fraction"] == 0 for row in summary)
    assert all((row["median_chosen_alpha"] is not None) == (row["method"] == "residual_aware_qr") for row in summary)


def test_missing_selection_stops_the_job(spark):
    f = spark.createDataFrame([("p", "40", 1, day(5))], "panel_id string, design string, fold_id long, training_end date")
    led = spark.createDataFrame([("p", 1, day(9), ["d0"])], "panel_id string, source_fold long, certification_end date, selected array<string>")
    with pytest.raises(Exception, match="no usable selection"):
        PF.asof_selection(f, led).collect()
