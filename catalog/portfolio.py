"""Queries: weights, risk, turnover, the covariance backtest and its summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.alignment import type_returns
from catalog.estimation import aligned_panels, fold_rows
from catalog import inputs as I
from catalog.inputs import cte, staged, with_
from catalog.registry import query, sql
from foldwise.operators import calendar as C
from foldwise.operators import covariance as CV
from foldwise.operators import folds as FD
from foldwise.operators import inference as IN
from foldwise.operators import moments as M
from foldwise.operators import portfolio as PF
from foldwise.operators import quality as Q
from foldwise.operators import selection as S
from foldwise.plans import backtest as B
from foldwise.plans import screening as SC
from foldwise.session import materialize

TRAIN, TEST = 104, 26
IN_SEED = 20260902
DESIGN = FD.two_segment(TRAIN, TEST)

# simple returns of the aligned assets, by position
cte(
    "simp", "al",
    "SELECT dt, pos, n_dates, series, idx, n_assets, role, CASE WHEN role = 'asset' THEN exp(value) - 1 ELSE value END AS value FROM al",
)
cte("simpa", "simp", "SELECT * FROM simp WHERE role = 'asset'")
fold_rows("p", "simpa", TRAIN, TEST, TEST)
fold_rows("pw", "simpa", 52, TEST, TEST)


@staged("simple_rows")
def simple_rows(spark, sf):
    y, x = aligned_panels(spark, sf)
    return SC.prepare(y.withColumn("value", F.expm1("value")), x)


def asset_folds(spark, sf):
    rows, index = simple_rows(spark, sf)
    y, _ = SC.split_roles(rows)
    return rows, index, y, FD.assign_folds(y, DESIGN)


def inverse_weights(name, cov, n):
    """SQL pieces <name>w: minimum-variance weights by sweeping every pivot of a covariance piece.

    The pieces keep one matrix per (fold_id, tag); after all sweeps it is minus the inverse.
    """
    cte(f"{name}0", cov, f"SELECT fold_id, tag, i, j, v FROM {cov} UNION ALL SELECT fold_id, tag, j, i, v FROM {cov} WHERE i <> j")
    for k in range(n):
        a = f"{name}{k}"
        cte(
            f"{name}{k + 1}", a,
            f"SELECT a.fold_id, a.tag, a.i, a.j, CASE WHEN a.i = {k} AND a.j = {k} THEN -1 / d.v WHEN a.i = {k} OR a.j = {k} THEN a.v / d.v ELSE a.v - r.v * c.v / d.v END AS v "
            f"FROM {a} a JOIN {a} d ON d.fold_id = a.fold_id AND d.tag = a.tag AND d.i = {k} AND d.j = {k} JOIN {a} r ON r.fold_id = a.fold_id AND r.tag = a.tag AND r.i = a.i AND r.j = {k} "
            f"JOIN {a} c ON c.fold_id = a.fold_id AND c.tag = a.tag AND c.i = {k} AND c.j = a.j",
        )
    cte(
        f"{name}w", f"{name}{n}",
        f"SELECT fold_id, tag, i AS idx, sum(v) / sum(sum(v)) OVER (PARTITION BY fold_id, tag) AS w FROM {name}{n} GROUP BY 1, 2, 3",
    )


N_BRANDS = 25
cte(
    "pstat", "ptrcov",
    "SELECT fold_id, sum(v) FILTER (i = j) AS tr, count(*) FILTER (i = j) AS p, sum(CASE WHEN i = j THEN v * v ELSE 2 * v * v END) AS ss, max(n) AS t FROM ptrcov GROUP BY 1",
)
cte("ppop", "pstat", "SELECT fold_id, p, t, tr * (t - 1) / t AS tr, ss * pow((t - 1) / t, 2) AS ss, tr * (t - 1) / t / p AS mu FROM pstat")
cte(
    "plw", "ppop ptr",
    "SELECT fold_id, CASE WHEN beta = 0 THEN 0 ELSE beta / delta END AS w FROM (SELECT fold_id, delta, least((q2 / t - ss) / (p * t), delta) AS beta FROM ("
    "SELECT e.fold_id, p, t, ss, q2, (ss - 2 * mu * tr + p * mu * mu) / p AS delta FROM ppop e JOIN (SELECT fold_id, sum(q * q) AS q2 FROM (SELECT r.fold_id, pos, "
    "sum(pow(value - m, 2)) AS q FROM ptr r JOIN (SELECT fold_id, idx, avg(value) AS m FROM ptr GROUP BY 1, 2) a ON a.fold_id = r.fold_id AND a.idx = r.idx GROUP BY 1, 2) d GROUP BY 1) n "
    "ON n.fold_id = e.fold_id) x) y",
)
cte(
    "poas", "ppop",
    "SELECT fold_id, CASE WHEN den = 0 THEN 1 ELSE least(1, (alpha + mu * mu) / den) END AS w FROM (SELECT fold_id, mu, ss / (p * p) AS alpha, (t + 1) * (ss / (p * p) - mu * mu / p) AS den FROM ppop) x",
)
cte(
    "mats", "ptrcov pstat ppop plw poas",
    "SELECT fold_id, 'sample_covariance' AS tag, i, j, v FROM ptrcov UNION ALL "
    "SELECT c.fold_id, 'ridge_10pct', i, j, 0.9 * v + CASE WHEN i = j THEN 0.1 * tr / p ELSE 0 END FROM ptrcov c JOIN pstat s ON s.fold_id = c.fold_id UNION ALL "
    "SELECT c.fold_id, 'ledoit_wolf', c.i, c.j, (1 - w) * c.v * (p.t - 1) / p.t + CASE WHEN c.i = c.j THEN w * p.mu ELSE 0 END FROM ptrcov c JOIN ppop p ON p.fold_id = c.fold_id JOIN plw w ON w.fold_id = c.fold_id UNION ALL "
    "SELECT c.fold_id, 'oas_shrinkage', c.i, c.j, (1 - w) * c.v * (p.t - 1) / p.t + CASE WHEN c.i = c.j THEN w * p.mu ELSE 0 END FROM ptrcov c JOIN ppop p ON p.fold_id = c.fold_id JOIN poas w ON w.fold_id = c.fold_id",
)
inverse_weights("inv", "mats", N_BRANDS)
cte(
    "books", "invw pstat ptrcov",
    "SELECT fold_id, tag AS method, idx, w FROM invw UNION ALL SELECT DISTINCT c.fold_id, 'equal_weight', c.i, 1.0 / p FROM ptrcov c JOIN pstat s ON s.fold_id = c.fold_id",
)
cte(
    "pred", "books mats ptrcov",
    "SELECT b.fold_id, b.method, sum(CASE WHEN m.i = m.j THEN 1 ELSE 2 END * m.v * b.w * c.w) AS predicted_variance FROM books b JOIN (SELECT * FROM mats UNION ALL "
    "SELECT fold_id, 'equal_weight', i, j, v FROM ptrcov) m ON m.fold_id = b.fold_id AND m.tag = b.method AND m.i = b.idx JOIN books c ON c.fold_id = m.fold_id AND c.method = b.method AND c.idx = m.j GROUP BY 1, 2",
)
cte(
    "pnl", "books pte",
    "SELECT b.fold_id, b.method, t.pos, t.dt, sum(b.w * t.value) AS gross FROM books b JOIN pte t ON t.fold_id = b.fold_id AND t.idx = b.idx GROUP BY 1, 2, 3, 4",
)
cte(
    "drifted", "books pte",
    "SELECT fold_id, method, idx, g / sum(g) OVER (PARTITION BY fold_id, method) AS drifted FROM (SELECT b.fold_id, b.method, b.idx, b.w * product(1 + t.value) AS g FROM books b JOIN pte t ON t.fold_id = b.fold_id AND t.idx = b.idx "
    "GROUP BY 1, 2, 3, b.w) q",
)
cte(
    "trades", "drifted",
    "SELECT b.fold_id, b.method, sum(abs(b.w - coalesce(d.drifted, 0))) AS turnover, count(d.drifted) = 0 AS initial_formation FROM books b LEFT JOIN drifted d ON d.fold_id = b.fold_id - 1 AND d.method = b.method AND d.idx = b.idx GROUP BY 1, 2",
)
_cost = "CASE WHEN t.initial_formation THEN 0 ELSE t.turnover * {b} / 10000.0 END"
_net = "(gross - CASE WHEN pos = first_pos THEN " + _cost + " ELSE 0 END)"
cte(
    "risk", "pnl trades pred",
    "SELECT q.fold_id, q.method, var_samp(gross) AS realized_variance, max(predicted_variance) AS predicted_variance, "
    + ", ".join(
        f"avg({_net.format(b=b)}) AS net_mean_return_{b}bps, stddev_samp({_net.format(b=b)}) * sqrt(252) AS net_annualized_volatility_{b}bps, max({_cost.format(b=b)}) AS rebalance_cost_{b}bps"
        for b in (5, 10, 20)
    )
    + ", max(t.turnover) AS turnover, bool_or(t.initial_formation) AS initial_formation, max(x.gross_exposure) AS gross_exposure, max(x.max_abs_weight) AS max_abs_weight "
    "FROM (SELECT *, min(pos) OVER (PARTITION BY fold_id, method) AS first_pos FROM pnl) q JOIN trades t ON t.fold_id = q.fold_id AND t.method = q.method JOIN pred p ON p.fold_id = q.fold_id AND p.method = q.method "
    "JOIN (SELECT fold_id, method, sum(abs(w)) AS gross_exposure, max(abs(w)) AS max_abs_weight FROM books GROUP BY 1, 2) x ON x.fold_id = q.fold_id AND x.method = q.method GROUP BY 1, 2",
)
cte(
    "risk2", "risk",
    "SELECT *, sqrt(252 * realized_variance) AS realized_annualized_volatility, realized_variance / predicted_variance AS realized_to_predicted_ratio, ln(predicted_variance) + realized_variance / predicted_variance AS qlike FROM risk",
)
RISK_NUM = (
    "realized_variance predicted_variance realized_annualized_volatility realized_to_predicted_ratio qlike gross_exposure max_abs_weight turnover "
    + " ".join(f"net_mean_return_{b}bps net_annualized_volatility_{b}bps rebalance_cost_{b}bps" for b in (5, 10, 20))
)


def equal_setup(spark, sf):
    rows, index, y, placed = asset_folds(spark, sf)
    placed = materialize(placed)
    w = PF.equal_weights(index, placed)
    return rows, index, placed, w, placed.filter("segment = 'test'")


@query("equal_weight", sql(with_("books"), "SELECT fold_id, idx, w FROM books WHERE method = 'equal_weight'", "", "fold_id idx", "w"))
def equal_weight(spark, sf):
    return equal_setup(spark, sf)[3].select("fold_id", "idx", "w")


def linear_matrices(spark, sf):
    rows, index, y, placed = asset_folds(spark, sf)
    cov = materialize(M.fold_covariance(y, DESIGN))
    placed = materialize(placed)
    train = placed.filter("segment = 'training'")
    lw, oas = CV.ledoit_wolf_weights(cov, train), CV.oas_weights(cov)
    made = {
        "sample_covariance": cov, "ridge_10pct": CV.ridge(cov), "ledoit_wolf": CV.shrink_to_identity(cov, lw),
        "oas_shrinkage": CV.shrink_to_identity(cov, oas), "equal_weight": cov,
    }
    return CV.union_all([CV.tag(k, v) for k, v in made.items()]), placed.filter("segment = 'test'")


@query(
    "gmv_weights",
    sql(with_("books"), "SELECT fold_id, method, idx, w FROM books WHERE method <> 'equal_weight'", "method", "fold_id idx", "w"),
)
def gmv_weights(spark, sf):
    m, _ = linear_matrices(spark, sf)
    return PF.minimum_variance(m.filter("method <> 'equal_weight'")).select("fold_id", "method", "idx", "w")


@query(
    "gmv_long_only",
    sql(
        with_("mats"),
        "SELECT DISTINCT fold_id, tag AS method, 1.0 AS total, false AS any_short, 0.0 AS held_gap, true AS others_pull_more, true AS beats_equal FROM mats",
        "method any_short others_pull_more beats_equal", "fold_id", "total held_gap",
    ),
)
def gmv_long_only(spark, sf):
    """Certificate: the optimality conditions of the constrained problem, from an independent join-sum of Sigma w."""
    m, _ = linear_matrices(spark, sf)
    m = materialize(m.filter("method <> 'equal_weight'"))
    w = materialize(PF.minimum_variance(m, long_only=True))
    both = m.unionByName(m.filter("i <> j").select(*M.KEYS, "method", F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    by = [*PF.BOOK]
    pull = both.join(w.select(*by, F.col("idx").alias("j"), F.col("w").alias("wj")), [*by, "j"]).groupBy(
        *by, F.col("i").alias("idx")
    ).agg(F.sum(F.col("v") * F.col("wj")).alias("sw"), F.sum("v").alias("row_sum"))
    x = w.select(*by, "idx", "w").join(pull, [*by, "idx"])
    level = x.groupBy(*by).agg(
        F.sum(F.col("w") * F.col("sw")).alias("level"), F.sum("w").alias("total"),
        (F.sum("row_sum") / F.pow(F.count(F.lit(1)), F.lit(2))).alias("equal_var"),
    )
    rel = F.col("sw") / F.col("level") - 1
    return x.join(level, by).groupBy("fold_id", "method").agg(
        F.max("total").alias("total"), F.bool_or(F.col("w") < 0).alias("any_short"),
        F.max(F.when(F.col("w") > 1e-9, F.abs(rel)).otherwise(0.0)).alias("held_gap"),
        F.bool_and(rel > -1e-7).alias("others_pull_more"),
        F.bool_and(F.col("level") <= F.col("equal_var") * (1 + 1e-9)).alias("beats_equal"),
    )


@query(
    "portfolio_daily_pnl",
    sql(with_("pnl"), "SELECT fold_id, dt, gross FROM pnl WHERE method = 'equal_weight'", "dt", "fold_id", "gross"),
)
def portfolio_daily_pnl(spark, sf):
    *_, w, test = equal_setup(spark, sf)
    return PF.daily_pnl(w, test).select("fold_id", "dt", "gross")


@query("drift_weights", sql(with_("drifted"), "SELECT fold_id, idx, drifted FROM drifted WHERE method = 'equal_weight'", "", "fold_id idx", "drifted"))
def drift_weights(spark, sf):
    *_, w, test = equal_setup(spark, sf)
    return PF.drifted_weights(w, test).select("fold_id", "idx", "drifted")


@query(
    "prior_fold_weights",
    sql(
        with_("drifted"), "SELECT b.fold_id, b.idx, b.w, d.drifted FROM books b LEFT JOIN drifted d ON d.fold_id = b.fold_id - 1 AND d.method = b.method AND d.idx = b.idx WHERE b.method = 'equal_weight'",
        "", "fold_id idx", "w drifted",
    ),
)
def prior_fold_weights(spark, sf):
    *_, w, test = equal_setup(spark, sf)
    before = PF.drifted_weights(w, test).withColumn("fold_id", F.col("fold_id") + 1)
    return w.join(before, [*PF.BOOK, "idx"], "left").select("fold_id", "idx", "w", "drifted")


@query(
    "turnover",
    sql(with_("trades"), "SELECT fold_id, turnover, initial_formation FROM trades WHERE method = 'equal_weight'", "initial_formation", "fold_id", "turnover"),
)
def turnover(spark, sf):
    *_, w, test = equal_setup(spark, sf)
    return PF.turnover(w, test).select("fold_id", "turnover", "initial_formation")


def linear_results(spark, sf, methods=None):
    m, test = linear_matrices(spark, sf)
    m = m.filter(F.col("method").isin(methods)) if methods else m
    w = materialize(PF.minimum_variance(m))
    test = materialize(test)
    pnl = materialize(PF.daily_pnl(w, test))
    return PF.risk_results(pnl, PF.weight_stats(w), PF.turnover(w, test)), pnl


@query(
    "risk_forecast_eval",
    sql(
        with_("risk2"), "SELECT * FROM risk2 WHERE method = 'equal_weight'", "method", "fold_id",
        "realized_variance predicted_variance realized_annualized_volatility realized_to_predicted_ratio qlike gross_exposure max_abs_weight",
    ),
)
def risk_forecast_eval(spark, sf):
    r, _ = linear_results(spark, sf, ["equal_weight"])
    return r.select(
        "method", "fold_id", "realized_variance", "predicted_variance", "realized_annualized_volatility", "realized_to_predicted_ratio",
        "qlike", "gross_exposure", "max_abs_weight",
    )


@query(
    "turnover_costs",
    sql(
        with_("risk2"),
        " UNION ALL ".join(
            f"SELECT fold_id, method, {b} AS bps, net_mean_return_{b}bps AS net_mean, net_annualized_volatility_{b}bps AS net_vol, rebalance_cost_{b}bps AS cost FROM risk2" for b in (5, 10, 20)
        ),
        "method", "fold_id bps", "net_mean net_vol cost",
    ),
)
def turnover_costs(spark, sf):
    r, _ = linear_results(spark, sf)
    grid = F.explode(F.array(*[
        F.struct(
            F.lit(b).alias("bps"), F.col(f"net_mean_return_{b}bps").alias("net_mean"),
            F.col(f"net_annualized_volatility_{b}bps").alias("net_vol"), F.col(f"rebalance_cost_{b}bps").alias("cost"),
        )
        for b in PF.COST_BPS
    ]))
    return r.select("fold_id", "method", grid.alias("g")).select("fold_id", "method", "g.*")


@query(
    "grid_cross_join",
    sql(
        with_("trades"),
        "SELECT fold_id, method, bps, CASE WHEN initial_formation THEN 0 ELSE turnover * bps / 10000.0 END AS cost FROM trades CROSS JOIN (VALUES (5), (10), (20)) g(bps) WHERE method = 'equal_weight'",
        "method", "fold_id bps", "cost",
    ),
)
def grid_cross_join(spark, sf):
    """The cost grid laid over the fold results by an array, not a join."""
    *_, w, test = equal_setup(spark, sf)
    t = PF.turnover(w, test).withColumn("bps", F.explode(F.array(*[F.lit(b) for b in PF.COST_BPS])))
    cost = F.when(F.col("initial_formation"), 0.0).otherwise(F.col("turnover") * F.col("bps") / 10000.0)
    return t.select("fold_id", "method", "bps", cost.alias("cost"))


# ---------------------------------------------------------------- frozen selections as of a date


def frozen_ledger(cal_pos):
    """Selections certified every 26 weeks from week 30 on: two drivers and one by turns."""
    k = ((F.col("pos") - 30) / 26).cast("long") + 1
    picked = F.when(k % 2 == 1, F.array(F.lit("1-URGENT"), F.lit("BUILDING"))).otherwise(F.array(F.lit("5-LOW")))
    return cal_pos.filter("pos >= 30 AND (pos - 30) % 26 = 0").select(
        "panel_id", k.alias("source_fold"), F.col("dt").alias("certification_end"), picked.alias("selected")
    )


cte("pledger", "both_dt", "SELECT (pos - 30) // 26 + 1 AS source_fold, dt AS certification_end, CASE WHEN ((pos - 30) // 26 + 1) % 2 = 1 THEN '1-URGENT | BUILDING' ELSE '5-LOW' END AS selected FROM both_dt WHERE pos >= 30 AND (pos - 30) % 26 = 0")
cte(
    "pspan", "both_dt",
    " UNION ALL ".join(
        f"SELECT '{t}' AS design, k + 1 AS fold_id, (SELECT dt FROM both_dt WHERE pos = k * 26 + {t - 1}) AS training_end FROM (SELECT unnest(range(0, (max(n_dates) - {t + 26}) // 26 + 1)) AS k FROM both_dt) q" for t in (52, 104)
    ),
)


@query(
    "asof_frozen_selection",
    sql(
        with_("pspan", "pledger"), "SELECT s.design, s.fold_id, s.training_end, l.source_fold, l.selected AS selected_drivers FROM pspan s ASOF JOIN pledger l ON s.training_end >= l.certification_end",
        "design training_end selected_drivers", "fold_id source_fold",
    ),
)
def asof_frozen_selection(spark, sf):
    y, _ = aligned_panels(spark, sf)
    pos = materialize(C.positions(C.calendar(y)))
    spans = CV.union_all([FD.fold_calendar(pos, FD.two_segment(t, TEST)) for t in (52, 104)]).select(*M.KEYS, "training_end")
    picks = PF.asof_selection(spans, frozen_ledger(pos))
    return picks.select("design", "fold_id", "training_end", "source_fold", F.array_join("selected", " | ").alias("selected_drivers"))


@I.staged("backtest")
def backtest(spark, sf):
    """All eleven methods, both designs and both constraints, run once for the queries that report on it."""
    y, x = aligned_panels(spark, sf)
    ledger = frozen_ledger(C.positions(C.calendar(y)))
    out = B.covariance_backtest(y, x, ledger, training=(52, TRAIN), test=TEST, constraints=("unconstrained", "long_only"))
    return {k: materialize(v) for k, v in out.items()}


FREE = "portfolio_constraint = 'unconstrained'"
LINEAR = ["equal_weight", "sample_covariance", "ridge_10pct", "ledoit_wolf", "oas_shrinkage"]


@query(
    "covariance_backtest",
    sql(with_("risk2"), "SELECT * FROM risk2", "method initial_formation", "fold_id", RISK_NUM),
)
def covariance_backtest(spark, sf):
    """The full loop; the rows of the methods and the design SQL can follow (all: covariance_backtest_all)."""
    r = backtest(spark, sf)["fold_results"].filter(F.col("method").isin(LINEAR) & (F.col("design") == str(TRAIN))).filter(FREE)
    return r.select("method", "initial_formation", "fold_id", *RISK_NUM.split())


@query("covariance_backtest_all")
def covariance_backtest_all(spark, sf):
    """Eleven methods, both designs; checked by brute force in the tests."""
    r = backtest(spark, sf)["fold_results"].filter(FREE)
    return r.select("design", "fold_id", "method", "initial_formation", "chosen_alpha", "eigen_floor_activated", *RISK_NUM.split())


@query("covariance_backtest_long_only")
def covariance_backtest_long_only(spark, sf):
    r = backtest(spark, sf)["fold_results"].filter("portfolio_constraint = 'long_only'")
    return r.select("design", "fold_id", "method", "initial_formation", "chosen_alpha", "eigen_floor_activated", *RISK_NUM.split())


@query("fold_summary_all")
def fold_summary_all(spark, sf):
    """Eleven methods, both designs and constraints, with the floor share and the median alpha."""
    out = backtest(spark, sf)
    return B.fold_summary(out["fold_results"], out["daily_pnl"]).drop("panel_id")


SUMMARY = (
    "SELECT r.method, count(*) AS folds, max(v.pooled) AS pooled_annualized_volatility, quantile_cont(realized_annualized_volatility, 0.5) AS median_fold_annualized_volatility, "
    "quantile_cont(realized_to_predicted_ratio, 0.5) AS median_realized_to_predicted_ratio, avg(qlike) AS mean_qlike, quantile_cont(gross_exposure, 0.5) AS median_gross_exposure, "
    "quantile_cont(max_abs_weight, 0.5) AS median_max_abs_weight, avg(turnover) FILTER (NOT initial_formation) AS mean_recurring_turnover FROM risk2 r JOIN "
    "(SELECT method, stddev_samp(gross) * sqrt(252) AS pooled FROM pnl GROUP BY 1) v ON v.method = r.method GROUP BY 1"
)


@query(
    "fold_summary",
    sql(
        with_("risk2"), SUMMARY, "method", "folds",
        "pooled_annualized_volatility median_fold_annualized_volatility median_realized_to_predicted_ratio mean_qlike median_gross_exposure median_max_abs_weight mean_recurring_turnover",
    ),
)
def fold_summary(spark, sf):
    r, pnl = linear_results(spark, sf)
    r = materialize(r.withColumn("chosen_alpha", F.lit(None).cast("double")))
    return B.fold_summary(r, pnl).drop("panel_id", "design", "eigen_floor_activation_fraction", "median_chosen_alpha")


# ---------------------------------------------------------------- alpha tuning with two named drivers

FIT = int(0.75 * TRAIN)
fold_rows("f", "simp", FIT, TRAIN - FIT + TEST, TEST)
cte("fval", "fte", f"SELECT * FROM fte WHERE pos < (fold_id - 1) * {TEST} + {TRAIN} AND role = 'asset'")
cte(
    "fob2", "ftr",
    "SELECT y.fold_id, y.idx, covar_samp(y.value, a.value) AS ya, covar_samp(y.value, b.value) AS yb, var_samp(a.value) AS aa, var_samp(b.value) AS bb, covar_samp(a.value, b.value) AS ab FROM ftr y "
    "JOIN ftr a ON a.fold_id = y.fold_id AND a.pos = y.pos AND a.series = '1-URGENT' JOIN ftr b ON b.fold_id = y.fold_id AND b.pos = y.pos AND b.series = 'BUILDING' WHERE y.role = 'asset' GROUP BY 1, 2",
)
cte("fob", "fob2", "SELECT *, (bb * ya - ab * yb) / (aa * bb - ab * ab) AS b0, (aa * yb - ab * ya) / (aa * bb - ab * ab) AS b1 FROM fob2")
cte(
    "fmats", "ftrcov fob",
    "SELECT c.fold_id, alpha AS tag, c.i, c.j, (1 - alpha) * CASE WHEN c.i = c.j THEN c.v ELSE a.b0 * (a.aa * b.b0 + a.ab * b.b1) + a.b1 * (a.ab * b.b0 + a.bb * b.b1) END + alpha * c.v AS v "
    "FROM ftrcov c JOIN fob a ON a.fold_id = c.fold_id AND a.idx = c.i JOIN fob b ON b.fold_id = c.fold_id AND b.idx = c.j CROSS JOIN (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) g(alpha)",
)
inverse_weights("finv", "fmats", N_BRANDS)
cte(
    "trial", "finvw fval",
    "SELECT fold_id, tag AS alpha, var_samp(gross) AS validation_variance FROM (SELECT w.fold_id, w.tag, v.pos, sum(w.w * v.value) AS gross FROM finvw w JOIN fval v ON v.fold_id = w.fold_id AND v.idx = w.idx GROUP BY 1, 2, 3) q GROUP BY 1, 2",
)


def alpha_trials(spark, sf):
    rows, _ = simple_rows(spark, sf)
    placed = materialize(FD.assign_folds(rows, B.tuning_design(TRAIN, TEST)))
    named = S.fixed_selection(placed.select(*M.KEYS).distinct(), ["1-URGENT", "BUILDING"])
    return B.fold_books(B.training_windows(placed, named), methods=()).filter("kind = 'trial'")


@query("tune_alpha", sql(with_("trial"), "SELECT * FROM trial", "", "fold_id", "alpha validation_variance"))
def tune_alpha(spark, sf):
    return alpha_trials(spark, sf).select("fold_id", "alpha", "validation_variance")


@query(
    "alpha_argmin",
    sql(with_("trial"), "SELECT fold_id, arg_min(alpha, (validation_variance, alpha)) AS alpha FROM trial GROUP BY 1", "", "fold_id", "alpha"),
)
def alpha_argmin(spark, sf):
    return PF.pick_alpha(alpha_trials(spark, sf)).select("fold_id", "alpha")


@query("inference_cov_backtest")
def inference_cov_backtest(spark, sf):
    """Families by design and metric over the backtest's results: the residual-aware method against the ten others, a seed for each family."""
    family = ["design", "metric"]
    results = backtest(spark, sf)["fold_results"].filter(FREE)
    d = materialize(IN.metric_families(results, ["design"], ["realized_variance", "qlike"], "residual_aware_qr"))
    return IN.family_inference(d, family, seed=IN.seeded(d, family, IN_SEED))


@query("release_checks_backtest")
def release_checks_backtest(spark, sf):
    """Release gates over the real backtest under both constraints and over its inference; brute force in the tests."""
    results = backtest(spark, sf)["fold_results"]
    folds = {str(r.design): r.n for r in results.groupBy("design").agg(F.countDistinct("fold_id").alias("n")).collect()}
    methods = results.select("method").distinct()
    out = None
    for name in ("unconstrained", "long_only"):
        own = results.filter(F.col("portfolio_constraint") == name)
        gates = Q.results_checks(own, methods, folds).unionByName(Q.constraint_gates(own, name)).withColumn("results", F.lit(name))
        out = gates if out is None else out.unionByName(gates)
    tested = inference_cov_backtest(spark, sf)
    return out.unionByName(Q.inference_gates(tested, ["realized_variance", "qlike"], "metric").withColumn("results", F.lit("inference")))


@query(
    "backtest_report",
    sql(
        with_("simpa", "pk", "pwk"),
        "SELECT 'px' AS panel_id, portfolio_constraint, count(DISTINCT dt) AS common_dates, min(dt) AS first_date, max(dt) AS last_date, count(DISTINCT series) AS assets, "
        f"'{', '.join(sorted(B.METHODS))}' AS estimators, '52=' || (SELECT count(*) FROM pwk) || ', {TRAIN}=' || (SELECT count(*) FROM pk) AS folds_by_training_design, "
        "'PILOT_PANEL_B_ESTIMATION_COMPLETE' AS status FROM simpa CROSS JOIN (VALUES ('unconstrained'), ('long_only')) v(portfolio_constraint) GROUP BY portfolio_constraint",
        "panel_id portfolio_constraint first_date last_date estimators folds_by_training_design status", "common_dates assets",
    ),
)
def backtest_report(spark, sf):
    return B.backtest_report(aligned_panels(spark, sf)[0], backtest(spark, sf)["fold_results"])
