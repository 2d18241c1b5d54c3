"""Minimum-variance weights and what they earn, risk and cost per test block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators import kernels
from foldwise.operators.moments import KEYS

BOOK = [*KEYS, "method"]
COST_BPS = (5, 10, 20)
TRADING_DAYS = 252
WEIGHTS = (
    "panel_id string, design string, fold_id long, method string, idx int, w double, pull double, predicted double, activated boolean"
)


def minimum_variance(
    matrices: DataFrame, *, long_only: bool = False, floor_scale: float = 1e-6, equal=("equal_weight",), book=None
) -> DataFrame:
    """Weights of each (panel, design, fold, method) matrix after the eigenvalue floor.

    Methods named in ``equal`` hold 1/n; they still get a predicted variance.
    ``pull`` is (Sigma w)_i, constant over the held assets at the optimum.
    """
    book = book or BOOK
    types = dict(matrices.dtypes)

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        m, hit = kernels.floored(kernels.dense(pdf), floor_scale)
        if key[3] in equal:
            w = np.full(len(m), 1.0 / len(m))
        else:
            w = kernels.long_only_weights(m) if long_only else kernels.unconstrained_weights(m)
        pull = m @ w
        predicted = float(w @ pull)
        if not np.isfinite(predicted) or predicted <= 0:
            raise ValueError(f"predicted variance is not positive: {key}")
        return pd.DataFrame({
            **dict(zip(book, key)), "idx": np.arange(len(m)), "w": w, "pull": pull, "predicted": predicted, "activated": hit,
        })

    schema = ", ".join(f"{k} {types[k]}" for k in book) + ", idx int, w double, pull double, predicted double, activated boolean"
    return matrices.select(*book, "i", "j", "v").groupBy(*book).applyInPandas(solve, schema)


def equal_weights(index: DataFrame, folds: DataFrame) -> DataFrame:
    """1/n for every asset of a panel in each fold."""
    assets = index.filter(F.col("role") == "asset").select("panel_id", "idx", (1.0 / F.col("n_assets")).alias("w"))
    return folds.select(*KEYS).distinct().join(assets, "panel_id").withColumn("method", F.lit("equal_weight")).select(*BOOK, "idx", "w")


def daily_pnl(weights: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Sum of weight x simple return per test date (partial sums before the shuffle)."""
    keys = [c for c in weights.columns if c in BOOK or c == "alpha"]
    return (
        test_rows.select(*KEYS, "pos", "dt", "idx", "value").join(weights.select(*keys, "idx", "w"), [*KEYS, "idx"])
        .groupBy(*keys, "pos", "dt").agg(F.sum(F.col("w") * F.col("value")).alias("gross"))
    )


def drifted_weights(weights: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Weights after the block's returns, renormalised; a vanished total stops the job."""
    wealth = test_rows.groupBy(*KEYS, "idx").agg(F.product(F.col("value") + 1.0).alias("growth"))
    grown = weights.select(*BOOK, "idx", "w").join(wealth, [*KEYS, "idx"]).withColumn("g", F.col("w") * F.col("growth"))
    totals = grown.groupBy(*BOOK).agg(F.sum("g").alias("all_g"))
    bad = F.coalesce(F.isnan("all_g") | (F.abs("all_g") < 1e-14), F.lit(True))
    share = F.when(bad, F.raise_error(F.lit("portfolio wealth invalid during drift")).cast("double")).otherwise(F.col("g") / F.col("all_g"))
    return grown.join(totals, BOOK).select(*BOOK, "idx", share.alias("drifted"))


def turnover(weights: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Sum of absolute trades against the drifted weights of the fold before."""
    before = drifted_weights(weights, test_rows).withColumn("fold_id", F.col("fold_id") + 1)
    return (
        weights.select(*BOOK, "idx", "w").join(before, [*BOOK, "idx"], "left")
        .groupBy(*BOOK).agg(
            F.sum(F.abs(F.col("w") - F.coalesce(F.col("drifted"), F.lit(0.0)))).alias("turnover"),
            (F.count("drifted") == 0).alias("initial_formation"),
        )
    )


def weight_stats(weights: DataFrame) -> DataFrame:
    return weights.groupBy(*BOOK).agg(
        F.max("predicted").alias("predicted_variance"), F.sum(F.abs("w")).alias("gross_exposure"),
        F.max(F.abs("w")).alias("max_abs_weight"), F.bool_or("activated").alias("eigen_floor_activated"),
    )


def risk_results(pnl: DataFrame, stats: DataFrame, trades: DataFrame, costs=COST_BPS) -> DataFrame:
    """Realised against predicted risk, QLIKE, turnover and costs per fold and method.

    The cost is charged on the first test date; the initial formation is free.
    """
    first = F.col("pos") == F.min("pos").over(Window.partitionBy(*BOOK))
    days = pnl.withColumn("is_first", first).join(trades, BOOK)
    cost = lambda bps: F.when(F.col("initial_formation"), 0.0).otherwise(F.col("turnover") * bps / 10000.0)
    net = lambda bps: F.col("gross") - F.when(F.col("is_first"), cost(bps)).otherwise(0.0)
    aggs = [F.var_samp("gross").alias("realized_variance")]
    for bps in costs:
        aggs += [
            F.avg(net(bps)).alias(f"net_mean_return_{bps}bps"),
            (F.stddev_samp(net(bps)) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias(f"net_annualized_volatility_{bps}bps"),
            F.max(cost(bps)).alias(f"rebalance_cost_{bps}bps"),
        ]
    out = days.groupBy(*BOOK).agg(*aggs, F.max("turnover").alias("turnover"), F.bool_or("initial_formation").alias("initial_formation"))
    real, pred = F.col("realized_variance"), F.col("predicted_variance")
    checked = F.when(pred > 0, pred).otherwise(F.raise_error(F.lit("predicted variance is not positive")).cast("double"))
    return (
        out.join(stats, BOOK)
        .withColumn("predicted_variance", checked)
        .withColumn("realized_annualized_volatility", F.sqrt(TRADING_DAYS * real))
        .withColumn("realized_to_predicted_ratio", real / pred)
        .withColumn("qlike", F.ln(pred) + real / pred)
    )


def pick_alpha(scores: DataFrame) -> DataFrame:
    """Alpha of least validation variance, the smaller on ties; ``scores``: keys, alpha, validation_variance."""
    best = F.min(F.struct("validation_variance", "alpha"))
    return scores.groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, F.col("b.alpha").alias("alpha"))


def asof_selection(folds: DataFrame, ledger: DataFrame) -> DataFrame:
    """Latest frozen selection certified by each fold's training end.

    ``folds``: keys, training_end.  ``ledger``: panel_id, source_fold, certification_end,
    selected (array).  Both are laid on one time line and the last ledger row is
    carried along it, so no fold is paired with more than one row.
    """
    marks = ledger.select(
        "panel_id", F.col("certification_end").alias("at"), F.lit(0).alias("kind"),
        F.struct("source_fold", "certification_end", "selected").alias("pick"),
    )
    asks = folds.select("panel_id", F.col("training_end").alias("at"), F.lit(1).alias("kind"), *KEYS[1:])
    w = Window.partitionBy("panel_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    line = asks.unionByName(marks, allowMissingColumns=True).withColumn("pick", F.last("pick", ignorenulls=True).over(w))
    none = F.col("pick").isNull() | (F.size("pick.selected") == 0)
    stop = F.raise_error(F.concat(F.lit("no usable selection by "), F.col("at").cast("string")))
    return line.filter("kind = 1").select(
        *KEYS, F.col("at").alias("training_end"), F.col("pick.source_fold"),
        F.when(none, stop.cast("array<string>")).otherwise(F.col("pick.selected")).alias("selected"),
    )
