"""Queries: moments, regression, scores, driver selection, covariance estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.alignment import type_returns
from catalog.construction import brand_assets
from catalog.inputs import CTE, cte, with_
from catalog.registry import query, sql
from foldwise.operators import align as A
from foldwise.operators import calendar as C
from foldwise.operators import covariance as CV
from foldwise.operators import drivers as D
from foldwise.operators import folds as FD
from foldwise.operators import moments as M
from foldwise.operators import regress as RG
from foldwise.operators import selection as S
from foldwise.plans import screening as SC
from foldwise.session import materialize

SCREEN = FD.two_segment(104, 26)
EMB = FD.two_segment(240, 60)
OBSERVABLE = ["1-URGENT", "BUILDING"]

# ---------------------------------------------------------------- the aligned panel


def plain_ledger(levels):
    return D.classify_labels(levels.select("panel_id", F.col("series").alias("source_label")).distinct()).withColumnRenamed(
        "transformation", "approved_transformation"
    )


@I.staged("aligned_panels")
def aligned_panels(spark, sf):
    """Repaired brand returns and driver innovations on common complete weeks."""
    y = materialize(brand_assets(spark, sf))
    lv = I.drv_w(spark, sf)
    x = materialize(D.driver_innovations(lv, plain_ledger(lv), C.calendar(y), lag=0))
    return tuple(materialize(p) for p in A.intersect_complete(y, x))


@I.staged("aligned_rows")
def aligned_rows(spark, sf):
    """Assets and drivers stacked, numbered and positioned; and their index."""
    return SC.prepare(*aligned_panels(spark, sf))


cte(
    "dcar", "drv_w assets",
    "SELECT u.dt, s.series, last_value(l.value IGNORE NULLS) OVER (PARTITION BY s.series ORDER BY u.dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value "
    "FROM (SELECT dt FROM drv_w UNION SELECT dt FROM assets) u CROSS JOIN (SELECT DISTINCT series FROM drv_w) s "
    "LEFT JOIN drv_w l ON l.dt = u.dt AND l.series = s.series QUALIFY u.dt IN (SELECT dt FROM assets)",
)
cte(
    "dinn", "dcar",
    "SELECT dt, series, CASE WHEN value > 0 AND prior > 0 THEN ln(value / prior) END AS value FROM (SELECT dt, series, value, "
    "lag(value) OVER (PARTITION BY series ORDER BY dt) AS prior FROM dcar) q",
)
cte(
    "both_dt", "dinn",
    "SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS pos, count(*) OVER () AS n_dates FROM (SELECT dt FROM dinn GROUP BY dt HAVING count(value) = count(*)) q",
)
cte(
    "al", "both_dt",
    "SELECT r.*, b.pos, b.n_dates, i.idx, i.n_assets FROM (SELECT 'asset' AS role, dt, series, value FROM assets UNION ALL SELECT 'driver', dt, series, value FROM dinn) r "
    "JOIN both_dt b ON b.dt = r.dt JOIN (SELECT role, series, row_number() OVER (ORDER BY role, series) - 1 AS idx, count(*) FILTER (role = 'asset') OVER () AS n_assets "
    "FROM (SELECT DISTINCT 'asset' AS role, series FROM assets UNION SELECT DISTINCT 'driver', series FROM drv_w) s) i ON i.role = r.role AND i.series = r.series",
)


def fold_rows(name, source, train, test, step):
    """SQL pieces <name>tr and <name>te: training and test rows by fold."""
    cte(f"{name}k", source, f"SELECT unnest(range(0, (max(n_dates) - {train + test}) // {step} + 1)) AS k FROM {source}")
    cte(f"{name}tr", f"{name}k", f"SELECT k + 1 AS fold_id, r.* FROM {source} r JOIN {name}k ON pos BETWEEN k * {step} AND k * {step} + {train - 1}")
    cte(
        f"{name}te", f"{name}k",
        f"SELECT k + 1 AS fold_id, r.* FROM {source} r JOIN {name}k ON pos BETWEEN k * {step} + {train} AND k * {step} + {train + test - 1}",
    )
    for seg in ("tr", "te"):
        cte(
            f"{name}{seg}cov", f"{name}{seg}",
            "SELECT a.fold_id, a.idx AS i, b.idx AS j, count(*) AS n, avg(a.value) AS mi, avg(b.value) AS mj, covar_samp(a.value, b.value) AS v "
            f"FROM {name}{seg} a JOIN {name}{seg} b ON a.fold_id = b.fold_id AND a.pos = b.pos AND a.idx <= b.idx GROUP BY 1, 2, 3",
        )


fold_rows("s", "al", 104, 26, 26)


@I.staged("emb_rows")
def emb_rows(spark, sf):
    return materialize(M.indexed(I.emb(spark, sf)))


cte(
    "embal", "emb emb_pos",
    "SELECT e.dt, e.series, e.value, p.pos, p.n_dates, CAST(e.series AS INTEGER) AS idx, 64 AS n_assets, 'asset' AS role FROM emb e JOIN emb_pos p ON p.dt = e.dt",
)
fold_rows("e", "embal", 240, 60, 60)

# ---------------------------------------------------------------- moments


@query(
    "sample_covariance",
    sql(with_("etrcov"), "SELECT fold_id, i, j, n, v FROM etrcov", "", "fold_id i j n", "v"),
)
def sample_covariance(spark, sf):
    return M.fold_covariance(emb_rows(spark, sf), EMB).select("fold_id", "i", "j", "n", "v")


@query(
    "cross_products",
    sql(with_("strcov"), "SELECT fold_id, i, j, v * (n - 1) AS cross_product FROM strcov", "", "fold_id i j", "cross_product"),
)
def cross_products(spark, sf):
    rows, _ = aligned_rows(spark, sf)
    cov = M.fold_covariance(rows, SCREEN)
    return cov.select("fold_id", "i", "j", (F.col("v") * (F.col("n") - 1)).alias("cross_product"))


@query(
    "pair_moments_join",
    sql(
        with_("al"),
        "SELECT a.pos // 26 AS block, a.idx AS i, b.idx AS j, count(*) AS n, avg(a.value) AS mi, avg(b.value) AS mj, covar_pop(a.value, b.value) * count(*) AS c "
        "FROM al a JOIN al b ON a.pos = b.pos AND a.idx <= b.idx GROUP BY 1, 2, 3",
        "", "block i j n", "mi mj c",
    ),
)
def pair_moments_join(spark, sf):
    rows, _ = aligned_rows(spark, sf)
    blocks = rows.withColumn("block", F.floor(F.col("pos") / 26))
    return M.co_moments(blocks, ["panel_id", "block"]).select("block", "i", "j", "n", "mi", "mj", "c")


@query(
    "standardize",
    sql(
        with_("str", "ste"),
        "SELECT e.fold_id, e.series, e.dt, (e.value - m) / CASE WHEN s > 1e-12 THEN s ELSE 1.0 END AS value FROM ste e JOIN (SELECT fold_id, idx, avg(value) AS m, "
        "stddev_samp(value) AS s FROM str GROUP BY 1, 2) p ON p.fold_id = e.fold_id AND p.idx = e.idx WHERE e.role = 'driver'",
        "series dt", "fold_id", "value",
    ),
)
def standardize(spark, sf):
    rows, _ = aligned_rows(spark, sf)
    z = FD.assign_folds(rows.filter("role = 'driver'"), SCREEN)
    return RG.standardize(z, "training", "test").select("fold_id", "series", "dt", "value")


@query(
    "baseline_residuals",
    sql(
        with_("str", "ste"),
        "SELECT e.fold_id, e.series, e.dt, e.value - m AS value FROM ste e JOIN (SELECT fold_id, idx, avg(value) AS m FROM str GROUP BY 1, 2) p "
        "ON p.fold_id = e.fold_id AND p.idx = e.idx WHERE e.role = 'asset'",
        "series dt", "fold_id", "value",
    ),
)
def baseline_residuals(spark, sf):
    rows, _ = aligned_rows(spark, sf)
    y = FD.assign_folds(rows.filter("role = 'asset'"), SCREEN)
    return RG.baseline_residuals(y, "training", "test").select("fold_id", "series", "dt", "value")


# ---------------------------------------------------------------- scores

cte("tal", "tw tw_pos", "SELECT t.dt, t.series, t.value, p.pos, p.n_dates, dense_rank() OVER (ORDER BY t.series) - 1 AS idx, 'asset' AS role FROM tw t JOIN tw_pos p ON p.dt = t.dt")
fold_rows("t", "tal", 52, 13, 13)


def score_sql(cov, extra=""):
    """s_f, s_inf and cov_offdiag_f from a covariance piece with columns keys.., i, j, v."""
    keys = "fold_id" + extra
    on = " AND ".join(f"{{a}}.{k} = c.{k}" for k in keys.replace(",", " ").split())
    return (
        f"SELECT {', '.join('c.' + k for k in keys.replace(',', ' ').split())}, sqrt(sum(r * r) / count(*)) AS s_f, max(abs(r)) AS s_inf, sqrt(sum(c.v * c.v) / count(*)) AS cov_offdiag_f "
        f"FROM (SELECT c.*, CASE WHEN a.v * b.v > 0 THEN c.v / sqrt(a.v * b.v) ELSE 0 END AS r FROM {cov} c "
        f"JOIN {cov} a ON {on.format(a='a')} AND a.i = c.i AND a.j = c.i JOIN {cov} b ON {on.format(a='b')} AND b.i = c.j AND b.j = c.j WHERE c.i < c.j) c "
        f"GROUP BY {', '.join('c.' + k for k in keys.replace(',', ' ').split())}"
    )


@query(
    "score_s_f",
    sql(
        with_("ttrcov", "ttecov"),
        f"SELECT 'training' AS segment, fold_id, s_f FROM ({score_sql('ttrcov')}) a UNION ALL SELECT 'test', fold_id, s_f FROM ({score_sql('ttecov')}) b",
        "segment", "fold_id", "s_f",
    ),
)
def score_s_f(spark, sf):
    rows = FD.assign_folds(M.indexed(materialize(type_returns(spark, sf))), FD.two_segment(52, 13))
    return M.offdiag_scores(rows, [*M.KEYS, "segment"]).select("segment", "fold_id", "s_f")


def asset_scores(spark, sf, floor=None):
    rows, _ = aligned_rows(spark, sf)
    test = FD.assign_folds(rows.filter("role = 'asset'").withColumn("n_series", F.col("n_assets")), SCREEN)
    return M.offdiag_scores(test.filter("segment = 'test'"), M.KEYS, floor)


cte("stecova", "stecov", "SELECT * FROM stecov WHERE i < (SELECT max(n_assets) FROM al) AND j < (SELECT max(n_assets) FROM al)")
cte("strcova", "strcov", "SELECT * FROM strcov WHERE i < (SELECT max(n_assets) FROM al) AND j < (SELECT max(n_assets) FROM al)")


@query("score_s_inf", sql(with_("stecova"), score_sql("stecova"), "", "fold_id", "s_inf"))
def score_s_inf(spark, sf):
    return asset_scores(spark, sf).select("fold_id", "s_inf")


@query("cov_offdiag_fro", sql(with_("stecova"), score_sql("stecova"), "", "fold_id", "cov_offdiag_f"))
def cov_offdiag_fro(spark, sf):
    return asset_scores(spark, sf, 1e-18).select("fold_id", "cov_offdiag_f")


def spectra(spark, sf):
    rows = FD.assign_folds(emb_rows(spark, sf), EMB).filter("segment = 'test'")
    return M.window_spectrum(rows, M.KEYS)


@query(
    "cov_offdiag_spectral",
    sql(
        with_("etecov"),
        "SELECT fold_id, 2 * sum(v) AS offdiag_sum, sqrt(2 * sum(v * v)) AS offdiag_norm, true AS above_mean_pull, true AS within_norm FROM etecov WHERE i < j GROUP BY 1",
        "above_mean_pull within_norm", "fold_id", "offdiag_sum offdiag_norm",
    ),
)
def cov_offdiag_spectral(spark, sf):
    """Certificate: the norm lies between |1'C1|/n and the Frobenius norm, both recomputed in SQL."""
    s = F.col("cov_offdiag_spectral")
    return spectra(spark, sf).select(
        "fold_id", "offdiag_sum", F.sqrt("offdiag_sq").alias("offdiag_norm"),
        (s >= F.abs(F.col("offdiag_sum")) / F.col("n_series") * (1 - 1e-9)).alias("above_mean_pull"),
        (s <= F.sqrt("offdiag_sq") * (1 + 1e-9)).alias("within_norm"),
    )


@query(
    "effective_rank",
    sql(
        with_("etecov"),
        "SELECT fold_id, count(DISTINCT i) AS n_series, 1.0 AS share_total, true AS in_range, true AS above_participation FROM etecov GROUP BY 1",
        "in_range above_participation", "fold_id n_series", "share_total",
    ),
)
def effective_rank(spark, sf):
    """Certificate: eigenvalue shares sum to one, 1 <= rank <= n."""
    e = F.col("effective_rank")
    return spectra(spark, sf).select(
        "fold_id", "n_series", "share_total", ((e >= 1) & (e <= F.col("n_series"))).alias("in_range"),
        (e > 1).alias("above_participation"),
    )


# ---------------------------------------------------------------- regression


def assigned(spark, sf, design=SCREEN, segments=None):
    rows, index = aligned_rows(spark, sf)
    f = FD.assign_folds(rows, design, segments)
    y = f.filter("role = 'asset'").withColumn("n_series", F.col("n_assets"))
    return y, f.filter("role = 'driver'"), rows, index


def observable_features(y, x):
    return RG.selected_features(x, S.fixed_selection(y.select(*M.KEYS).distinct(), OBSERVABLE))


# moments of the two named drivers and each asset, and the closed-form coefficients
cte(
    "obs2", "str",
    "SELECT y.fold_id, y.idx, avg(y.value) AS my, avg(a.value) AS ma, avg(b.value) AS mb, covar_samp(y.value, a.value) AS ya, covar_samp(y.value, b.value) AS yb, "
    "var_samp(a.value) AS aa, var_samp(b.value) AS bb, covar_samp(a.value, b.value) AS ab FROM str y JOIN str a ON a.fold_id = y.fold_id AND a.pos = y.pos AND a.series = '1-URGENT' "
    "JOIN str b ON b.fold_id = y.fold_id AND b.pos = y.pos AND b.series = 'BUILDING' WHERE y.role = 'asset' GROUP BY 1, 2",
)
cte("obsb", "obs2", "SELECT *, (bb * ya - ab * yb) / (aa * bb - ab * ab) AS b0, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS b1 FROM obs2")
cte(
    "obsres", "obsb ste",
    "SELECT y.fold_id, y.dt, y.pos, y.series, y.idx, y.value - (my + b0 * (a.value - ma) + b1 * (b.value - mb)) AS value FROM ste y JOIN obsb p ON p.fold_id = y.fold_id AND p.idx = y.idx "
    "JOIN ste a ON a.fold_id = y.fold_id AND a.pos = y.pos AND a.series = '1-URGENT' JOIN ste b ON b.fold_id = y.fold_id AND b.pos = y.pos AND b.series = 'BUILDING' WHERE y.role = 'asset'",
)


@query("ols_sweep", sql(with_("obsb"), "SELECT fold_id, idx, my AS y_mean, b0, b1 FROM obsb", "", "fold_id idx", "y_mean b0 b1"))
def ols_sweep(spark, sf):
    y, x, _, _ = assigned(spark, sf)
    z = RG.feature_columns(observable_features(y, x), 2).filter("segment = 'training'").drop("segment")
    b = RG.fit_betas(y.filter("segment = 'training'"), z, 2)
    return b.select("fold_id", "idx", "y_mean", F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("b1"))


@query("frozen_residuals", sql(with_("obsres"), "SELECT * FROM obsres", "series dt", "fold_id", "value"))
def frozen_residuals(spark, sf):
    y, x, _, _ = assigned(spark, sf)
    return RG.frozen_residuals(y, observable_features(y, x), 2, "training", "test").select("fold_id", "series", "dt", "value")


cte(
    "obscov", "obsres",
    "SELECT a.fold_id, a.idx AS i, b.idx AS j, covar_samp(a.value, b.value) AS v FROM obsres a JOIN obsres b ON a.fold_id = b.fold_id AND a.pos = b.pos AND a.idx <= b.idx GROUP BY 1, 2, 3",
)


@query("fixed_observable_set", sql(with_("obscov"), score_sql("obscov"), "", "fold_id", "s_f s_inf cov_offdiag_f"))
def fixed_observable_set(spark, sf):
    y, x, _, _ = assigned(spark, sf)
    e = RG.frozen_residuals(y, observable_features(y, x), 2, "training", "test")
    return M.offdiag_scores(e, M.KEYS).select("fold_id", "s_f", "s_inf", "cov_offdiag_f")


# ---------------------------------------------------------------- selection


def sweep_rounds(name, cov, rounds, penalty):
    """SQL pieces of ``rounds`` forward rounds: <name>best<r> per fold with the improvement flag."""
    cte(
        f"{name}d0", f"{cov} al",
        f"SELECT fold_id, i, j, v FROM {cov} UNION ALL SELECT fold_id, j, i, v FROM {cov} WHERE i <> j",
    )
    cte(
        f"{name}best0", f"{name}d0",
        "SELECT c.fold_id, CAST(NULL AS BIGINT) AS q, sqrt(avg(c.v * c.v / (a.v * b.v))) AS score, sqrt(avg(c.v * c.v / (a.v * b.v))) AS objective, true AS better "
        f"FROM {name}d0 c JOIN {name}d0 a ON a.fold_id = c.fold_id AND a.i = c.i AND a.j = c.i JOIN {name}d0 b ON b.fold_id = c.fold_id AND b.i = c.j AND b.j = c.j "
        "WHERE c.i < c.j AND c.j < (SELECT max(n_assets) FROM al) GROUP BY 1",
    )
    for r in range(1, rounds + 1):
        d, used = f"{name}d{r - 1}", " UNION ALL ".join(f"SELECT fold_id, q FROM {name}best{k}" for k in range(1, r)) or "SELECT -1 AS fold_id, -1 AS q"
        # squared residual correlation of each asset pair given candidate q
        cte(
            f"{name}try{r}", f"{d} {name}best{r - 1}",
            "SELECT c.fold_id, q.i AS q, sqrt(avg(pow(c.v - ci.v * cj.v / q.v, 2) / ((a.v - ci.v * ci.v / q.v) * (b.v - cj.v * cj.v / q.v)))) AS score "
            f"FROM {d} c JOIN {d} a ON a.fold_id = c.fold_id AND a.i = c.i AND a.j = c.i JOIN {d} b ON b.fold_id = c.fold_id AND b.i = c.j AND b.j = c.j "
            f"JOIN {d} q ON q.fold_id = c.fold_id AND q.i = q.j AND q.i >= (SELECT max(n_assets) FROM al) JOIN {d} ci ON ci.fold_id = c.fold_id AND ci.i = q.i AND ci.j = c.i "
            f"JOIN {d} cj ON cj.fold_id = c.fold_id AND cj.i = q.i AND cj.j = c.j WHERE c.i < c.j AND c.j < (SELECT max(n_assets) FROM al) "
            f"AND (c.fold_id, q.i) NOT IN ({used}) GROUP BY 1, 2",
        )
        cte(
            f"{name}best{r}", f"{name}try{r} {name}best{r - 1}",
            f"SELECT t.fold_id, t.b.q AS q, t.b.score AS score, t.b.objective AS objective, p.better AND t.b.objective < p.objective - 1e-12 AS better FROM "
            f"(SELECT fold_id, min(struct_pack(objective := round(score + {penalty!r} * {r}, 12), q := q, score := score)) AS b FROM {name}try{r} GROUP BY 1) t "
            f"JOIN {name}best{r - 1} p ON p.fold_id = t.fold_id",
        )
        cte(
            f"{name}d{r}", f"{d} {name}best{r}",
            f"SELECT c.fold_id, c.i, c.j, c.v - x.v * y.v / q.v AS v FROM {d} c JOIN {name}best{r} b ON b.fold_id = c.fold_id "
            f"JOIN {d} q ON q.fold_id = c.fold_id AND q.i = b.q AND q.j = b.q JOIN {d} x ON x.fold_id = c.fold_id AND x.i = b.q AND x.j = c.i "
            f"JOIN {d} y ON y.fold_id = c.fold_id AND y.i = b.q AND y.j = c.j WHERE c.i <> b.q AND c.j <> b.q",
        )


GREEDY_PENALTY, GREEDY_ROUNDS = 0.0005, 6
sweep_rounds("g", "strcov", GREEDY_ROUNDS, GREEDY_PENALTY)


def greedy_state(spark, sf, rounds=GREEDY_ROUNDS, penalty=GREEDY_PENALTY, backward=False):
    rows, index = aligned_rows(spark, sf)
    return S.greedy_select(M.fold_tiles(rows, SCREEN), index, penalty=penalty, max_drivers=rounds, backward=backward), index


PATH_SQL = " UNION ALL ".join(
    f"SELECT fold_id, {r} AS step, 'ADD' AS operation, (SELECT DISTINCT series FROM al WHERE idx = q) AS driver, {r} AS model_size, score AS s_f, objective FROM gbest{r} WHERE better"
    for r in range(1, GREEDY_ROUNDS + 1)
)


@query("selection_path", sql(with_(f"gbest{GREEDY_ROUNDS}"), PATH_SQL, "operation driver", "fold_id step model_size", "s_f objective"))
def selection_path(spark, sf):
    state, index = greedy_state(spark, sf)
    return S.selection_path(state, index).select("fold_id", "step", "operation", "driver", "model_size", "s_f", "objective")


@query(
    "greedy_forward",
    sql(
        with_(f"gbest{GREEDY_ROUNDS}", path=PATH_SQL),
        "SELECT b.fold_id, b.score AS base_score, coalesce(p.final, b.score) AS final_score, coalesce(p.n, 0) AS selected_count, coalesce(p.names, '') AS selected_drivers FROM gbest0 b LEFT JOIN "
        "(SELECT fold_id, max_by(s_f, step) AS final, count(*) AS n, string_agg(driver, ' | ' ORDER BY step) AS names FROM path GROUP BY 1) p ON p.fold_id = b.fold_id",
        "selected_drivers", "fold_id selected_count", "base_score final_score",
    ),
)
def greedy_forward(spark, sf):
    state, index = greedy_state(spark, sf)
    names = S.named_selection(state, index).groupBy(*M.KEYS).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "series"))), lambda s: s["series"]), " | ").alias("selected_drivers")
    )
    return state.join(names, M.KEYS, "left").select(
        "fold_id", "base_score", F.col("score").alias("final_score"), F.size("chosen").alias("selected_count"),
        F.coalesce("selected_drivers", F.lit("")).alias("selected_drivers"),
    )


@query("backward_delete")
def backward_delete(spark, sf):
    """Forward and backward with the development settings; checked by brute force in the tests."""
    state, index = greedy_state(spark, sf, rounds=8, penalty=0.0001, backward=True)
    return S.selection_path(state, index).select("fold_id", "step", "operation", "driver", "model_size", "s_f", "objective")


@query(
    "argmin_stable",
    sql(
        with_("gtry1"), "SELECT fold_id, b.score, b.q AS idx FROM (SELECT fold_id, min(struct_pack(score := round(score, 12), q := q)) AS b FROM gtry1 GROUP BY 1) t",
        "", "fold_id idx", "score",
    ),
)
def argmin_stable(spark, sf):
    """First-round scores of all candidates, lowest first by number: one driver, no penalty."""
    rows, index = aligned_rows(spark, sf)
    trials = S.candidate_scores(M.fold_tiles(rows, SCREEN), index)
    return S.argmin_stable(trials, ["fold_id"], "score", "idx")


@query(
    "asset_subset_linspace",
    sql(
        with_("px_brand_w"),
        "SELECT DISTINCT s.series, s.idx FROM (SELECT series, row_number() OVER (ORDER BY series) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT series FROM px_brand_w) q) s "
        "JOIN (SELECT unnest(range(0, 10)) AS k) g ON s.idx = round_even(k * ((n - 1) / 9.0::DOUBLE), 0)",
        "series", "idx",
    ),
)
def asset_subset_linspace(spark, sf):
    return S.even_subset(M.series_index(I.px_brand_w(spark, sf)), 10).select("series", "idx")


# ---------------------------------------------------------------- covariance estimators

CELL = "fold_id i j"
cte(
    "estat", "etrcov",
    "SELECT fold_id, sum(v) FILTER (i = j) AS tr, count(*) FILTER (i = j) AS p, sum(CASE WHEN i = j THEN v * v ELSE 2 * v * v END) AS ss, max(n) AS t FROM etrcov GROUP BY 1",
)
cte("epop", "estat", "SELECT fold_id, p, t, tr * (t - 1) / t AS tr, ss * pow((t - 1) / t, 2) AS ss, tr * (t - 1) / t / p AS mu FROM estat")


@query(
    "ridge_cov",
    sql(with_("estat"), "SELECT c.fold_id, i, j, 0.9 * v + CASE WHEN i = j THEN 0.1 * tr / p ELSE 0 END AS v FROM etrcov c JOIN estat s ON s.fold_id = c.fold_id", "", CELL, "v"),
)
def ridge_cov(spark, sf):
    return CV.ridge(materialize(M.fold_covariance(emb_rows(spark, sf), EMB))).select("fold_id", "i", "j", "v")


SHRUNK = (
    "SELECT c.fold_id, c.i, c.j, (1 - w) * c.v * (p.t - 1) / p.t + CASE WHEN c.i = c.j THEN w * p.mu ELSE 0 END AS v "
    "FROM etrcov c JOIN epop p ON p.fold_id = c.fold_id JOIN W w ON w.fold_id = c.fold_id"
)
LW_W = (
    "SELECT fold_id, CASE WHEN beta = 0 THEN 0 ELSE beta / delta END AS w FROM (SELECT fold_id, delta, least((q2 / t - ss) / (p * t), delta) AS beta FROM ("
    "SELECT e.fold_id, p, t, ss, q2, (ss - 2 * mu * tr + p * mu * mu) / p AS delta FROM epop e JOIN (SELECT fold_id, sum(q * q) AS q2 FROM (SELECT r.fold_id, pos, "
    "sum(pow(value - m, 2)) AS q FROM etr r JOIN (SELECT fold_id, idx, avg(value) AS m FROM etr GROUP BY 1, 2) a ON a.fold_id = r.fold_id AND a.idx = r.idx GROUP BY 1, 2) d GROUP BY 1) n "
    "ON n.fold_id = e.fold_id) x) y"
)
OAS_W = (
    "SELECT fold_id, CASE WHEN den = 0 THEN 1 ELSE least(1, (alpha + mu * mu) / den) END AS w FROM (SELECT fold_id, mu, ss / (p * p) AS alpha, (t + 1) * (ss / (p * p) - mu * mu / p) AS den FROM epop) x"
)


@query("ledoit_wolf_cov", sql(with_("epop", lw=LW_W), SHRUNK.replace("W w", "lw w"), "", CELL, "v"))
def ledoit_wolf_cov(spark, sf):
    rows = emb_rows(spark, sf)
    cov = materialize(M.fold_covariance(rows, EMB))
    train = FD.assign_folds(rows, EMB, {"training": ["training"]})
    return CV.shrink_to_identity(cov, CV.ledoit_wolf_weights(cov, train)).select("fold_id", "i", "j", "v")


@query("oas_cov", sql(with_("epop", oas=OAS_W), SHRUNK.replace("W w", "oas w"), "", CELL, "v"))
def oas_cov(spark, sf):
    cov = materialize(M.fold_covariance(emb_rows(spark, sf), EMB))
    return CV.shrink_to_identity(cov, CV.oas_weights(cov)).select("fold_id", "i", "j", "v")


def emb_cov(spark, sf):
    return materialize(M.fold_covariance(emb_rows(spark, sf), EMB))


def eigen_range(m):
    """Per fold: trace and whether all eigenvalues are positive (from the floor kernel)."""
    return CV.eigen_floor(m, 0.0, 0.0)


@query(
    "qis_cov",
    sql(with_("estat"), "SELECT fold_id, tr AS trace, p * (p + 1) // 2 AS cells, true AS shrinks_spread, false AS below_zero FROM estat", "shrinks_spread below_zero", "fold_id cells", "trace"),
)
def qis_cov(spark, sf):
    """Certificate: the trace is that of the sample matrix, the spread of eigenvalues shrinks, none is negative."""
    cov = emb_cov(spark, sf)
    q = materialize(CV.quadratic_inverse(cov))
    sq = lambda m, name: m.groupBy("fold_id").agg(
        F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("v") * F.col("v")).alias(name)
    )
    low = CV.eigen_floor(q).groupBy("fold_id").agg(F.bool_or("activated").alias("below_zero"))
    return (
        q.groupBy("fold_id").agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("trace"), F.count("*").alias("cells"))
        .join(sq(q, "a"), "fold_id").join(sq(cov, "b"), "fold_id").join(low, "fold_id")
        .select("fold_id", "trace", "cells", (F.col("a") <= F.col("b") * (1 + 1e-12)).alias("shrinks_spread"), "below_zero")
    )


@query(
    "pca_diag_cov",
    sql(with_("etrcov"), "SELECT fold_id, i, v FROM etrcov WHERE i = j", "", "fold_id i", "v"),
)
def pca_diag_cov(spark, sf):
    """Certificate: the diagonal is that of the sample covariance."""
    cov = emb_cov(spark, sf)
    k = cov.select(*M.KEYS).distinct().withColumn("k", F.lit(5))
    return CV.leading_plus_diagonal(cov, k).filter("i = j").select("fold_id", "i", "v")


@query(
    "poet_cov",
    sql(with_("etrcov"), "SELECT fold_id, i, v * (n - 1) / n AS v FROM etrcov WHERE i = j", "", "fold_id i", "v"),
)
def poet_cov(spark, sf):
    """Certificate: the diagonal is the population variance."""
    train = FD.assign_folds(emb_rows(spark, sf), EMB, {"training": ["training"]})
    k = train.select(*M.KEYS).distinct().withColumn("k", F.lit(5))
    return CV.thresholded_factors(train, k).filter("i = j").select("fold_id", "i", "v")


@query(
    "eigen_floor",
    sql(with_("etrcov"), "SELECT fold_id, i, j, v, false AS activated FROM etrcov", "activated", CELL, "v"),
)
def eigen_floor(spark, sf):
    """Certificate: a matrix with all eigenvalues above the floor comes back unchanged."""
    return CV.eigen_floor(emb_cov(spark, sf)).select("fold_id", "i", "j", "v", "activated")


def observable_betas(y, x):
    z = RG.feature_columns(observable_features(y, x), 2).filter("segment = 'training'").drop("segment")
    return RG.fit_betas(y.filter("segment = 'training'"), z, 2)


def structured_pair(spark, sf):
    y, x, rows, index = assigned(spark, sf)
    cov = CV.assets_only(M.fold_covariance(rows, SCREEN), index)
    return CV.structured(cov, observable_betas(y, x), 2)


Q0_SQL = (
    "SELECT c.fold_id, c.i, c.j, CASE WHEN c.i = c.j THEN c.v ELSE a.b0 * (a.aa * b.b0 + a.ab * b.b1) + a.b1 * (a.ab * b.b0 + a.bb * b.b1) END AS v, c.v AS full_v "
    "FROM strcova c JOIN obsb a ON a.fold_id = c.fold_id AND a.idx = c.i JOIN obsb b ON b.fold_id = c.fold_id AND b.idx = c.j"
)


@query("structured_q0", sql(with_("strcova", "obsb"), Q0_SQL, "", CELL, "v"))
def structured_q0(spark, sf):
    return structured_pair(spark, sf).select("fold_id", "i", "j", "v")


@query(
    "structured_qfull",
    sql(
        with_("strcova", "obsb"),
        # residual covariance rebuilt from the regression itself
        "SELECT c.fold_id, c.i, c.j, (a.b0 * (a.aa * b.b0 + a.ab * b.b1) + a.b1 * (a.ab * b.b0 + a.bb * b.b1)) + (c.v - a.b0 * b.ya - a.b1 * b.yb) AS v "
        "FROM strcova c JOIN obsb a ON a.fold_id = c.fold_id AND a.idx = c.i JOIN obsb b ON b.fold_id = c.fold_id AND b.idx = c.j",
        "", CELL, "v",
    ),
)
def structured_qfull(spark, sf):
    return structured_pair(spark, sf).select("fold_id", "i", "j", F.col("full").alias("v"))


@query(
    "residual_aware_cov",
    sql(with_("strcova", "obsb", q=Q0_SQL), "SELECT fold_id, i, j, 0.75 * v + 0.25 * full_v AS v FROM q", "", CELL, "v"),
)
def residual_aware_cov(spark, sf):
    pair = structured_pair(spark, sf)
    alpha = pair.select(*M.KEYS).distinct().withColumn("alpha", F.lit(0.25))
    return CV.blend(pair, alpha).select("fold_id", "i", "j", "v")


@query(
    "equal_weight_cov",
    sql(
        with_("strcova"),
        "SELECT fold_id, count(*) FILTER (i = j) AS n, sum(CASE WHEN i = j THEN v ELSE 2 * v END) / pow(count(*) FILTER (i = j), 2) AS predicted FROM strcova GROUP BY 1",
        "", "fold_id n", "predicted",
    ),
)
def equal_weight_cov(spark, sf):
    rows, index = aligned_rows(spark, sf)
    cov = CV.assets_only(M.fold_covariance(rows, SCREEN), index)
    d = F.count_if(F.col("i") == F.col("j"))
    total = F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("v"))
    return cov.groupBy("fold_id").agg(d.alias("n"), (total / (d * d)).alias("predicted"))


@query(
    "subspace_overlap",
    sql(with_("etrcov"), "SELECT DISTINCT fold_id, 5 AS k, 1.0 AS same, true AS in_range FROM etrcov", "in_range", "fold_id k", "same"),
)
def subspace_overlap(spark, sf):
    """Certificate: a space overlaps itself fully; training against test lies in [0, 1]."""
    rows = emb_rows(spark, sf)
    k = FD.fold_spans(C.positions(C.calendar(rows)), EMB).select(*M.KEYS).distinct().withColumn("k", F.lit(5))
    a, b = (materialize(CV.window_vectors(FD.assign_folds(rows, EMB, {s: [s]}), k)) for s in ("training", "test"))
    same = CV.subspace_overlap(a, a).select(*M.KEYS, "k", F.col("overlap").alias("same"))
    cross = CV.subspace_overlap(a, b).select(*M.KEYS, "overlap")
    o = F.col("overlap")
    return same.join(cross, M.KEYS).select("fold_id", "k", "same", ((o >= 0) & (o <= 1 + 1e-9)).alias("in_range"))


# ---------------------------------------------------------------- two series a panel: closed forms

FINE = 11  # digits: variances here are about 0.01

def pair_rows(spark, sf):
    """Neighbouring series as panels of their own, so that every spectrum has a closed form."""
    pair = F.floor(F.col("series").cast("int") / 2).cast("string")
    return materialize(M.indexed(I.emb(spark, sf).withColumn("panel_id", pair)))


def pair_window(rows, segment):
    window = FD.assign_folds(rows, EMB, {segment: [segment]})
    return window, window.select(*M.KEYS).distinct().withColumn("k", F.lit(1))


def pair_number():
    return F.col("panel_id").cast("int").alias("pair")


def pair_sql(cov):
    """Variances a and b, covariance c, larger eigenvalue and half the gap of each 2 x 2 matrix."""
    return (
        "SELECT fold_id, pair, a, b, c, (a + b) / 2 + r AS top, (a + b) / 2 - r AS low, r FROM (SELECT *, sqrt(pow((a - b) / 2, 2) + c * c) AS r FROM ("
        f"SELECT fold_id, i // 2 AS pair, max(v) FILTER (i = j AND i % 2 = 0) AS a, max(v) FILTER (i = j AND i % 2 = 1) AS b, max(v) FILTER (i < j) AS c FROM {cov} WHERE i // 2 = j // 2 GROUP BY 1, 2) m) e"
    )


@query(
    "spectrum_two_series",
    sql(
        with_("etecov", q=pair_sql("etecov")),
        "SELECT fold_id, pair, abs(c) AS cov_offdiag_spectral, exp(-(top / (a + b) * ln(top / (a + b)) + low / (a + b) * ln(low / (a + b)))) AS effective_rank FROM q",
        "", "fold_id pair", "cov_offdiag_spectral effective_rank", FINE,
    ),
    FINE,
)
def spectrum_two_series(spark, sf):
    """Effective rank and off-diagonal norm by value."""
    window, _ = pair_window(pair_rows(spark, sf), "test")
    return M.window_spectrum(window, M.KEYS).select("fold_id", pair_number(), "cov_offdiag_spectral", "effective_rank")


@query(
    "pca_factor_form",
    sql(
        with_("etrcov", q=pair_sql("etrcov")),
        "SELECT fold_id, pair, 0 AS i, 0 AS j, a AS v FROM q UNION ALL SELECT fold_id, pair, 1, 1, b FROM q UNION ALL SELECT fold_id, pair, 0, 1, top * c / (2 * r) FROM q",
        "", "fold_id pair i j", "v", FINE,
    ),
    FINE,
)
def pca_factor_form(spark, sf):
    """All cells of the one-factor form, by value."""
    form = CV.factor_form(*pair_window(pair_rows(spark, sf), "training"))
    return CV.form_cells(form).select("fold_id", pair_number(), "i", "j", "v")


@query(
    "factor_form_gmv",
    sql(
        with_(
            "etrcov", q=pair_sql("etrcov"),
            f="SELECT fold_id, pair, a, b, top * c / (2 * r) AS o FROM q",
        ),
        "SELECT fold_id, pair, (b - o) / (a + b - 2 * o) AS w, (a * b - o * o) / (a + b - 2 * o) AS predicted FROM f",
        "", "fold_id pair", "w predicted", FINE,
    ),
    FINE,
)
def factor_form_gmv(spark, sf):
    """Minimum-variance weight of a pair's first series and the predicted variance, both from the factor form."""
    form = materialize(CV.factor_form(*pair_window(pair_rows(spark, sf), "training")))
    weights = materialize(CV.form_minimum_variance(form))
    return weights.filter("idx = 0").join(CV.form_variance(form, weights), M.KEYS).select("fold_id", pair_number(), "w", "predicted")


@query(
    "overlap_two_series",
    sql(
        with_(
            "etrcov", "etecov",
            q="SELECT fold_id, pair, atan2(2 * c, a - b) / 2 AS angle FROM (" + pair_sql("etrcov") + ") x",
            u="SELECT fold_id, pair, atan2(2 * c, a - b) / 2 AS angle FROM (" + pair_sql("etecov") + ") x",
        ),
        "SELECT q.fold_id, q.pair, pow(cos(q.angle - u.angle), 2) AS overlap FROM q JOIN u ON u.fold_id = q.fold_id AND u.pair = q.pair",
        "", "fold_id pair", "overlap", FINE,
    ),
    FINE,
)
def overlap_two_series(spark, sf):
    """Overlap of the leading directions of training and test, by value."""
    rows = pair_rows(spark, sf)
    a, b = (materialize(CV.window_vectors(*pair_window(rows, s))) for s in ("training", "test"))
    return CV.subspace_overlap(a, b).select("fold_id", pair_number(), "overlap")


def rebuilt_sql(q, larger, smaller, extra=""):
    """Cells of a 2 x 2 matrix with the eigenvectors of ``q`` and other eigenvalues."""
    share = "(1 + (a - b) / (2 * r)) / 2"
    ends = f"SELECT *, {larger} AS x, {smaller} AS y, {share} AS s FROM {q}"
    cell = lambda i, j, v: f"SELECT fold_id, pair, {i} AS i, {j} AS j, {v} AS v{extra} FROM ({ends}) e{i}{j}"
    return " UNION ALL ".join([cell(0, 0, "x * s + y * (1 - s)"), cell(1, 1, "x * (1 - s) + y * s"), cell(0, 1, "(x - y) * c / (2 * r)")])


def pair_cov(spark, sf):
    return M.fold_covariance(pair_rows(spark, sf), EMB)


@query(
    "eigen_floor_two_series",
    sql(
        with_("etrcov", q=pair_sql("etrcov")),
        rebuilt_sql("q", "top", "greatest(low, 0.9 * (a + b) / 2)", ", low < 0.9 * (a + b) / 2 AS activated"),
        "activated", "fold_id pair i j", "v", FINE,
    ),
    FINE,
)
def eigen_floor_two_series(spark, sf):
    """All cells, by value, with a floor high enough to act on part of the matrices."""
    return CV.eigen_floor(pair_cov(spark, sf), 0.9).select("fold_id", pair_number(), "i", "j", "v", "activated")


@query(
    "qis_two_series",
    sql(
        with_(
            "etrcov",
            q=pair_sql("etrcov"),
            # concentration, bandwidth and inverse eigenvalues
            h="SELECT q.*, 2.0 / (n - 1) AS ratio, pow(pow(2.0 / (n - 1), 2) / 2, 0.35) AS h, 1 / top AS p, 1 / low AS o FROM q JOIN (SELECT fold_id, max(n) AS n FROM etrcov GROUP BY 1) t ON t.fold_id = q.fold_id",
            # real and imaginary part of the transform at each of the two
            m="SELECT *, o * (o - p) / (pow(o - p, 2) + pow(h * o, 2)) / 2 AS rp, (1 / h + o * o * h / (pow(o - p, 2) + pow(h * o, 2))) / 2 AS ip, "
            "p * (p - o) / (pow(p - o, 2) + pow(h * p, 2)) / 2 AS ro, (1 / h + p * p * h / (pow(p - o, 2) + pow(h * p, 2))) / 2 AS io FROM h",
            z="SELECT *, top / (pow(1 - ratio + ratio * rp, 2) + pow(ratio * ip, 2)) AS dt, low / (pow(1 - ratio + ratio * ro, 2) + pow(ratio * io, 2)) AS dl FROM m",
        ),
        rebuilt_sql("z", "dt * (top + low) / (dt + dl)", "dl * (top + low) / (dt + dl)"),
        "", "fold_id pair i j", "v", FINE,
    ),
    FINE,
)
def qis_two_series(spark, sf):
    """All cells of the quadratic-inverse shrinkage, by value."""
    return CV.quadratic_inverse(pair_cov(spark, sf)).select("fold_id", pair_number(), "i", "j", "v")


@query(
    "poet_two_series",
    sql(
        with_(
            "etrcov", "etr",
            q=pair_sql("etrcov"),
            d="SELECT fold_id, pos, idx, value - avg(value) OVER (PARTITION BY fold_id, idx) AS x FROM etr",
            # scores on the smaller axis give the residuals and their fourth moments
            z="SELECT q.fold_id, q.pair, count(*) AS t, avg(pow(cos(w) * e.x - sin(w) * d.x, 2)) AS m2, avg(pow(cos(w) * e.x - sin(w) * d.x, 4)) AS m4 "
            "FROM (SELECT *, atan2(2 * c, a - b) / 2 AS w FROM q) q JOIN d ON d.fold_id = q.fold_id AND d.idx = 2 * q.pair JOIN d e ON e.fold_id = d.fold_id AND e.pos = d.pos AND e.idx = d.idx + 1 GROUP BY 1, 2",
            f="SELECT q.*, (t - 1.0) / t AS f, greatest(m2 - 0.5 * sqrt(greatest(m4 - m2 * m2, 0) * t / (t - 1.0)) * (pow(2, -0.5) + sqrt(ln(2) / t)), 0) AS kept FROM q JOIN z ON z.fold_id = q.fold_id AND z.pair = q.pair",
        ),
        "SELECT fold_id, pair, 0 AS i, 0 AS j, a * f AS v FROM f UNION ALL SELECT fold_id, pair, 1, 1, b * f FROM f UNION ALL SELECT fold_id, pair, 0, 1, c / (2 * r) * (top * f - kept) FROM f",
        "", "fold_id pair i j", "v", FINE,
    ),
    FINE,
)
def poet_two_series(spark, sf):
    """All cells of the thresholded one-factor estimator, by value."""
    window, k = pair_window(pair_rows(spark, sf), "training")
    return CV.thresholded_factors(window, k).select("fold_id", pair_number(), "i", "j", "v")
