"""Covariance backtest: eleven estimators, every design and fold in one set of jobs.

A fold is one task: its training window (dates x series) comes in, the sample's eigenpairs are
taken once, the alpha path, all estimators and both constraints follow from it, and only weights
and forecasts leave.  No covariance cell is ever a row.  The only link between folds is the
turnover, a join with the fold before; no fold waits for another.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators import covariance as CV
from foldwise.operators import folds, kernels, portfolio
from foldwise.operators.calendar import KEY
from foldwise.operators.moments import KEYS, window_matrix
from foldwise.plans.screening import prepare, split_roles
from foldwise.session import materialize

# Names and grid as published.
ALPHAS = (0.0, 0.10, 0.25, 0.50, 0.75, 0.90)
METHODS = [
    "equal_weight", "sample_covariance", "ridge_10pct", "ledoit_wolf", "oas_shrinkage", "nonlinear_shrinkage_qis",
    "pca_matched", "pca_plus_two", "poet_soft_c0_5", "structured_q0", "residual_aware_qr",
]


def tuning_design(training: int, test: int) -> folds.Design:
    """Training split into the first three quarters (fit) and the rest (validation)."""
    fit = int(0.75 * training)
    return folds.Design(str(training), [("fit", fit), ("validate", training - fit), ("test", test)], step=test)


BOOKS = (
    "panel_id string, design string, fold_id long, kind string, constraint string, method string, alpha double, idx int, w double, pull double, "
    "predicted double, activated boolean, validation_variance double, n_fit int"
)


def fold_books(
    windows: DataFrame, *, alphas=ALPHAS, floor_scale: float = 1e-6, constraints=("unconstrained",), methods=tuple(METHODS),
) -> DataFrame:
    """The alpha path (kind ``trial``) and the weights (kind ``weight``) of every fold.

    ``windows``: keys, segment (``fit`` or ``validate``), pos, role, idx (assets and drivers numbered
    apart), value, wanted (how many assets and drivers there are).  One group is one training window.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = {}
        for role, own in pdf.groupby("role"):
            sides[role] = window_matrix(own, int(own["wanted"].iloc[0]))[0]
        x, z = sides["asset"], sides["driver"]
        if len(x) != len(z):
            raise ValueError(f"drivers and assets have different dates: {key}")
        fit = pdf.loc[pdf["segment"] == "fit", "pos"].nunique()
        trials = kernels.alpha_path(x, z, fit, alphas, floor_scale)
        alpha = min((v, a) for a, v, _ in trials)[1]
        columns = [c.split()[0] for c in BOOKS.split(", ")]
        rows = [[*key, "trial", None, "residual_aware_qr", a, None, None, None, None, hit, v, fit] for a, v, hit in trials]
        forms = kernels.fold_forms(x, z, alpha, floor_scale) if methods else {}
        for method, constraint in product(methods, constraints):
            form = forms[method]
            if method == "equal_weight":
                w = np.full(x.shape[1], 1.0 / x.shape[1])
            else:
                w = kernels.long_only_weights(form.dense()) if constraint == "long_only" else form.unconstrained()
            pull = form.times(w)
            predicted = float(w @ pull)
            if not np.isfinite(predicted) or predicted <= 0:
                raise ValueError(f"predicted variance is not positive: {key} {method}")
            chosen = alpha if method == "residual_aware_qr" else None
            rows += [[*key, "weight", constraint, method, chosen, i, w[i], pull[i], predicted, form.hit, None, fit] for i in range(len(w))]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    return windows.groupBy(*KEYS).applyInPandas(run, BOOKS)


def training_windows(placed: DataFrame, selected: DataFrame) -> DataFrame:
    """Input of :func:`fold_books`: assets and the selected drivers (keys, slot, series) on the fit and validation dates."""
    y, x = split_roles(placed.filter(F.col("segment").isin("fit", "validate")))
    columns = [*KEYS, "segment", "pos", "role", "idx", "value", "wanted"]
    count = selected.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("int").alias("wanted"))
    picked = x.drop("idx").join(selected.select(*KEYS, "series", F.col("slot").alias("idx")), [*KEYS, "series"]).join(count, KEYS)
    return y.withColumn("wanted", F.col("n_assets")).select(*columns).unionByName(picked.select(*columns))


def covariance_backtest(
    assets: DataFrame, drivers: DataFrame, ledger: DataFrame, *, training=(252, 504), test: int = 126,
    floor_scale: float = 1e-6, constraints=("unconstrained",),
) -> dict[str, DataFrame]:
    """``assets``: complete log returns; ``drivers``: complete innovations; ``ledger``: frozen selections.

    A selected driver that the panel lacks stops the job.  Returns the tables ``fold_results``,
    ``alpha_tuning``, ``daily_pnl``, ``weights``, each with the constraint in ``portfolio_constraint``.
    """
    simple = assets.withColumn("value", F.expm1("value"))
    rows, _ = prepare(simple, drivers)
    cal = rows.select(*KEY, "pos", "n_dates").distinct()
    designs = [tuning_design(t, test) for t in training]
    spans = materialize(CV.union_all([folds.fold_calendar(cal, d) for d in designs]).select(
        *KEYS, F.col("fit_start").alias("training_start"), F.col("validate_end").alias("training_end"), "test_start", "test_end"
    ))
    picks = materialize(portfolio.asof_selection(spans, ledger))
    selected = picks.select(*KEYS, F.posexplode("selected").alias("slot", "series"))
    absent = selected.select("panel_id", "series").distinct().join(drivers.select("panel_id", "series").distinct(), ["panel_id", "series"], "left_anti")
    lost, names = absent.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("series"))).first()
    if lost:
        raise ValueError(f"{lost} selected drivers are not in the panel: {names}")
    placed = CV.union_all([folds.assign_folds(rows, d, {s: [s] for s in ("fit", "validate", "test")}) for d in designs])
    books = materialize(fold_books(training_windows(placed, selected), floor_scale=floor_scale, constraints=constraints))
    test_rows = materialize(split_roles(placed)[0].filter("segment = 'test'").select(*KEYS, "pos", "dt", "idx", "value"))
    chosen = books.filter("kind = 'weight' AND alpha IS NOT NULL").select(*portfolio.BOOK, F.col("alpha").alias("chosen_alpha")).distinct()
    facts = spans.join(picks.select(*KEYS, "source_fold", F.size("selected").alias("selected_count")), KEYS)
    results, pnls, weights = [], [], []
    for name in constraints:
        w = books.filter((F.col("kind") == "weight") & (F.col("constraint") == name)).select(*portfolio.BOOK, "idx", "w", "pull", "predicted", "activated")
        pnl = materialize(portfolio.daily_pnl(w, test_rows))
        risk = portfolio.risk_results(pnl, portfolio.weight_stats(w), portfolio.turnover(w, test_rows))
        tag = lambda df: df.withColumn("portfolio_constraint", F.lit(name))  # noqa: B023, E731
        results.append(tag(risk.join(chosen, portfolio.BOOK, "left").join(facts, KEYS)))
        pnls.append(tag(pnl))
        weights.append(tag(w))
    trials = books.filter("kind = 'trial'").select(*KEYS, "alpha", "validation_variance", F.col("activated").alias("eigen_floor_activated"))
    return {
        "fold_results": CV.union_all(results), "alpha_tuning": trials, "daily_pnl": CV.union_all(pnls), "weights": CV.union_all(weights),
    }


def fold_summary(results: DataFrame, pnl: DataFrame) -> DataFrame:
    """One row per design, method and (where given) constraint; turnover leaves out the initial formation."""
    by = ["panel_id", "design", "method", *[c for c in ("portfolio_constraint",) if c in results.columns]]
    pooled = pnl.groupBy(*by).agg(
        (F.stddev_samp("gross") * F.sqrt(F.lit(float(portfolio.TRADING_DAYS)))).alias("pooled_annualized_volatility")
    )
    median = lambda c: F.percentile(c, 0.5)
    out = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("folds"),
        median("realized_annualized_volatility").alias("median_fold_annualized_volatility"),
        median("realized_to_predicted_ratio").alias("median_realized_to_predicted_ratio"),
        F.avg("qlike").alias("mean_qlike"), median("gross_exposure").alias("median_gross_exposure"),
        median("max_abs_weight").alias("median_max_abs_weight"),
        F.avg(F.when(~F.col("initial_formation"), F.col("turnover"))).alias("mean_recurring_turnover"),
        F.avg(F.col("eigen_floor_activated").cast("int")).alias("eigen_floor_activation_fraction"),
        median("chosen_alpha").alias("median_chosen_alpha"),
    )
    return out.join(pooled, by)


def backtest_report(returns: DataFrame, results: DataFrame) -> DataFrame:
    """One row per panel and constraint: dates and width of the panel, estimators, folds of every design.

    ``estimators`` and ``folds_by_training_design`` (``design=folds``) are lists in the order of their names.
    """
    panel = returns.groupBy("panel_id").agg(
        F.countDistinct("dt").alias("common_dates"), F.min("dt").alias("first_date"), F.max("dt").alias("last_date"),
        F.countDistinct("series").alias("assets"),
    )
    by = ["panel_id", "portfolio_constraint"]
    each = results.groupBy(*by, "design").agg(F.countDistinct("fold_id").alias("folds"), F.collect_set("method").alias("methods"))
    named = F.struct(F.col("design").cast("int"), F.concat_ws("=", "design", F.col("folds").cast("string")).alias("text"))
    made = each.groupBy(*by).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("methods")))), ", ").alias("estimators"),
        F.array_join(F.sort_array(F.collect_list(named)).getField("text"), ", ").alias("folds_by_training_design"),
    )
    return panel.join(made, "panel_id").withColumn("status", F.lit("PILOT_PANEL_B_ESTIMATION_COMPLETE"))
