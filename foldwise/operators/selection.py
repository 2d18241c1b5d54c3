"""Greedy choice of drivers per fold, all folds at once, one Spark job per round.

Scores come from the training moments alone, which stay packed per (fold, pair of asset tiles):
a task holds two tiles of assets and the driver pool, whatever the width of the panel, and one
hot panel spreads over its tile pairs.  A round takes the chosen drivers out of each packed matrix,
scores all candidates at once by matrix products and leaves one partial sum per candidate; the
moments themselves are written once and never rewritten.  The state (chosen drivers, objective, log)
is one short row per fold and is checkpointed after each round, so a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.operators.moments import KEYS
from foldwise.session import materialize

TOLERANCE = 1e-12
DIGITS = 12
STATE = ["chosen", "objective", "score", "base_score", "active", "path"]
STEP_TYPE = "array<struct<operation:string,driver:int,model_size:int,s_f:double,objective:double>>"


def even_subset(index: DataFrame, asset_limit: int | None) -> DataFrame:
    """Evenly spaced assets where a panel has more than the limit (half-to-even rounding); without a limit all of them."""
    if asset_limit is None:
        return index.filter(F.col("role") == "asset")
    n = F.col("n_assets")
    step = (n - 1) / F.lit(asset_limit - 1)
    k = F.explode(F.sequence(F.lit(0), F.lit(asset_limit - 1)))
    spaced = (
        index.select("panel_id", "n_assets").distinct().filter(n > asset_limit)
        .withColumn("k", k).select("panel_id", F.bround(F.col("k") * step).cast("int").alias("idx")).distinct()
    )
    assets = index.filter(F.col("role") == "asset")
    narrow = assets.filter(n <= asset_limit)
    return narrow.unionByName(assets.filter(n > asset_limit).join(spaced, ["panel_id", "idx"], "left_semi").select(*narrow.columns))


def _without(m: np.ndarray, head, place: dict, floor: np.ndarray) -> np.ndarray:
    """The moments left when the series of ``head`` explain what they can, one after the other."""
    for q in head:
        p = place[int(q)]
        if m[p, p] > floor[p]:
            m = m - np.outer(m[:, p], m[p]) / m[p, p]
    return m


def _inverse_variance(raw: np.ndarray, total: np.ndarray, variance_floor: float | None) -> np.ndarray:
    """1 / variance; a variance that is zero to rounding counts as uncorrelated, unless it is floored."""
    if variance_floor is not None:
        return 1.0 / np.maximum(raw, variance_floor)
    return np.divide(1.0, raw, out=np.zeros_like(raw), where=raw > 1e-13 * np.maximum(total, 0.0))


def _added(m: np.ndarray, total: np.ndarray, a, b, drivers, floor, variance_floor) -> np.ndarray:
    """Sum of squared residual correlations of the tile pair for each driver added to the head.

    With w the inverse residual variances, (c_ij - b_i b_j / d)^2 w_i w_j is summed by expanding the
    square, so all drivers take three matrix products.
    """
    d = np.diag(m)[drivers]
    inv = np.divide(1.0, d, out=np.zeros_like(d), where=d > floor[drivers])
    cross = m[np.ix_(a, b)]

    def side(k):
        loads = m[np.ix_(k, drivers)]
        raw = np.diag(m)[k][:, None] - loads * loads * inv
        return loads, raw, _inverse_variance(raw, total[k][:, None], variance_floor)

    la, raw, wa = side(a)
    lb, _, wb = side(b)
    sums = ((cross * cross) @ wb * wa).sum(axis=0) - 2 * inv * ((cross @ (lb * wb)) * (la * wa)).sum(axis=0)
    sums = sums + inv * inv * (la * la * wa).sum(axis=0) * (lb * lb * wb).sum(axis=0)
    if a is b:
        sums = (sums - ((raw * wa) ** 2).sum(axis=0)) / 2
    return np.maximum(sums, 0.0)


def _plain(m: np.ndarray, total: np.ndarray, a, b, variance_floor) -> float:
    w = _inverse_variance(np.diag(m), total, variance_floor)
    r2 = m[np.ix_(a, b)] ** 2 * w[a][:, None] * w[b]
    return float((r2.sum() - np.trace(r2)) / 2 if a is b else r2.sum())


def _partial_sums(variance_floor: float | None, add: bool):
    """UDF over packed tile pairs: a sum per driver added to the first head, or one per head."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def sums(ids: pd.Series, c: pd.Series, ti: pd.Series, tj: pd.Series, n_assets: pd.Series, tile: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for names, flat, i, j, n, width, trials in zip(ids, c, ti, tj, n_assets, tile, heads):
            names = np.asarray(names)
            m = np.asarray(flat, dtype=float).reshape(len(names), len(names))
            total = np.diag(m).copy()
            floor = np.maximum(total, 0.0) * 1e-12
            place = {int(s): k for k, s in enumerate(names)}
            own = np.where(names < n, names // width, -1)
            a = np.flatnonzero(own == i)
            b = a if i == j else np.flatnonzero(own == j)
            if add:
                out.append(_added(_without(m, trials[0], place, floor), total, a, b, np.flatnonzero(names >= n), floor, variance_floor))
            else:
                out.append([_plain(_without(m, t, place, floor), total, a, b, variance_floor) for t in trials])
        return pd.Series(out)

    return sums


# A state row has a few hundred bytes; up to this many folds it is sent to the tiles, beyond the tiles are shuffled to it.
FOLDS_TO_SEND = 200_000


def _scores(tiles: DataFrame, asked: DataFrame, variance_floor: float | None, add: bool, send: bool) -> DataFrame:
    """(keys, k, score) of each trial; ``asked``: keys, heads (array of driver lists)."""
    sums = _partial_sums(variance_floor, add)("ids", "c", "ti", "tj", "n_assets", "tile", "heads")
    part = tiles.join(F.broadcast(asked) if send else asked, KEYS).select(*KEYS, "n_assets", F.posexplode(sums).alias("k", "r2"))
    n = F.col("n_assets")
    return part.groupBy(*KEYS, "n_assets", "k").agg(F.sum("r2").alias("r2")).select(
        *KEYS, "k", F.sqrt(2 * F.col("r2") / F.greatest(n * (n - 1), F.lit(1))).alias("score")
    )


def candidate_scores(tiles: DataFrame, index: DataFrame, variance_floor: float | None = None) -> DataFrame:
    """Score of every driver as the first one: keys, idx, score."""
    tiles = _sized(tiles, index)
    asked = tiles.select(*KEYS, F.array(F.array().cast("array<int>")).alias("heads")).distinct()
    n = index.select("panel_id", "n_assets").distinct()
    return _scores(tiles, asked, variance_floor, True, False).join(n, "panel_id").select(*KEYS, (F.col("n_assets") + F.col("k")).alias("idx"), "score")


def _sized(tiles: DataFrame, index: DataFrame) -> DataFrame:
    size = index.select("panel_id", "n_assets", "n_series").distinct()
    return materialize(tiles.join(size, "panel_id"))


def _step(operation, driver, size, score, objective):
    return F.array(F.struct(
        F.lit(operation).alias("operation"), driver.alias("driver"), size.alias("model_size"), score.alias("s_f"),
        objective.alias("objective"),
    ))


def _round(tiles: DataFrame, state: DataFrame, variance_floor, penalty: float, max_drivers: int, forward: bool, send: bool) -> DataFrame:
    chosen = F.col("chosen")
    more = (F.size(chosen) < max_drivers) & (F.col("n_series") > F.col("n_assets")) if forward else F.size(chosen) > 0
    heads = F.array(chosen) if forward else F.transform(chosen, lambda d: F.array_remove(chosen, d))
    asked = state.filter(F.col("active") & more).select(*KEYS, heads.alias("heads"))
    tried = _scores(tiles, asked, variance_floor, forward, send).join(state.select(*KEYS, "chosen", "n_assets"), KEYS)
    if forward:
        tried = tried.withColumn("driver", F.col("n_assets") + F.col("k")).filter(~F.array_contains("chosen", F.col("driver")))
    else:
        tried = tried.withColumn("driver", F.get("chosen", F.col("k")))
    size = F.size(chosen) + (1 if forward else -1)
    rated = F.struct(F.round(F.col("score") + penalty * size, DIGITS).alias("objective"), F.col("driver").alias("driver"), F.col("score").alias("score"))
    best = tried.groupBy(*KEYS).agg(F.min(rated).alias("best"))
    better = F.coalesce(F.col("best.objective") < F.col("objective") - TOLERANCE, F.lit(False))
    driver = F.col("best.driver")
    after = F.concat(chosen, F.array(driver)) if forward else F.array_remove(chosen, driver)
    step = _step("ADD" if forward else "DELETE", driver, F.size(after), F.col("best.score"), F.col("best.objective"))
    return state.join(best, KEYS, "left").select(
        *KEYS, "n_assets", "n_series",
        F.when(better, after).otherwise(chosen).alias("chosen"),
        F.when(better, F.col("best.objective")).otherwise(F.col("objective")).alias("objective"),
        F.when(better, F.col("best.score")).otherwise(F.col("score")).alias("score"),
        "base_score",
        better.alias("active"),
        F.when(better, F.concat("path", step.cast(STEP_TYPE))).otherwise(F.col("path")).alias("path"),
    )


def greedy_select(
    tiles: DataFrame, index: DataFrame, *, penalty: float, max_drivers: int, backward: bool = False,
    variance_floor: float | None = None,
) -> DataFrame:
    """Forward selection, then backward deletion if asked; one row per fold.

    ``tiles``: training moments as from :func:`moments.fold_tiles`, over assets (first numbers) and drivers.
    """
    tiles = _sized(tiles, index)
    fold = tiles.select(*KEYS, "n_assets", "n_series").distinct()
    nothing = fold.select(*KEYS, F.array(F.array().cast("array<int>")).alias("heads"))
    base = _scores(tiles, nothing, variance_floor, False, False).select(*KEYS, F.col("score").alias("base_score"))
    state = materialize(fold.join(base, KEYS).select(
        *KEYS, "n_assets", "n_series", F.array().cast("array<int>").alias("chosen"), F.col("base_score").alias("objective"),
        F.col("base_score").alias("score"), "base_score", F.lit(True).alias("active"), F.array().cast(STEP_TYPE).alias("path"),
    ))
    send = state.count() <= FOLDS_TO_SEND
    for forward in [True, False] if backward else [True]:
        state = state.withColumn("active", F.lit(True))
        for _ in range(max_drivers):
            state = materialize(_round(tiles, state, variance_floor, penalty, max_drivers, forward, send))
            if not state.filter("active").take(1):
                break
    return state.drop("n_assets", "n_series")


def named_selection(state: DataFrame, index: DataFrame) -> DataFrame:
    """(keys, slot, series) rows of the chosen drivers."""
    return (
        state.select(*KEYS, F.posexplode("chosen").alias("slot", "idx"))
        .join(index.select("panel_id", "idx", "series"), ["panel_id", "idx"]).select(*KEYS, "slot", "series")
    )


def selection_path(state: DataFrame, index: DataFrame) -> DataFrame:
    """Ordered ADD and DELETE steps with size, score and objective."""
    steps = state.select(*KEYS, F.posexplode("path").alias("k", "s")).select(
        *KEYS, (F.col("k") + 1).alias("step"), F.col("s.operation"), F.col("s.driver").alias("idx"), F.col("s.model_size"),
        F.col("s.s_f"), F.col("s.objective"),
    )
    return steps.join(index.select("panel_id", "idx", F.col("series").alias("driver")), ["panel_id", "idx"]).drop("idx")


def fixed_selection(folds: DataFrame, names) -> DataFrame:
    """The same named drivers for every fold (observable comparator)."""
    return folds.select(*KEYS, F.posexplode(F.array(*[F.lit(n) for n in names])).alias("slot", "series"))


def argmin_stable(trials: DataFrame, keys, value: str, tie: str) -> DataFrame:
    """Row with the lowest (rounded value, tie) per key; combines before the shuffle."""
    best = F.min(F.struct(F.round(value, DIGITS).alias(value), F.col(tie).alias(tie)))
    return trials.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")
