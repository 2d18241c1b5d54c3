"""Multi-response least squares per fold, with parameters frozen on the fit rows.

The features of a date become a few columns (``slots`` of them, known when the
plan is made), so cross-moments with all assets are plain ``covar_samp``
aggregates that combine before the shuffle.  Python only inverts one small
matrix per fold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.expr import total
from foldwise.operators.kernels import correlation_inverse
from foldwise.operators.moments import KEYS

SCALE_FLOOR = 1e-12


def slot_columns(slots: int) -> list[str]:
    return [f"z{s}" for s in range(slots)]


def feature_columns(features: DataFrame, slots: int, keys=KEYS) -> DataFrame:
    """(keys, segment, pos, slot, z) rows to one row per date with a column per slot."""
    return features.groupBy(*keys, "segment", "pos").agg(
        *[F.max(F.when(F.col("slot") == s, F.col("z"))).alias(f"z{s}") for s in range(slots)]
    )


def selected_features(driver_rows: DataFrame, selection: DataFrame) -> DataFrame:
    """Driver rows (already assigned to folds) of the selected series, by slot."""
    return driver_rows.join(selection.select(*KEYS, "series", "slot"), [*KEYS, "series"]).select(
        *KEYS, "segment", "pos", "slot", F.col("value").alias("z")
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def scaled_inverse(gram: pd.Series, size: pd.Series) -> pd.Series:
    """Inverse of a feature covariance by way of its correlation; minimum norm when singular."""
    return pd.Series([correlation_inverse(np.asarray(g, dtype=float).reshape(m, m)).ravel() for g, m in zip(gram, size)])


def fit_betas(y_fit: DataFrame, z_fit: DataFrame, slots: int, keys=KEYS) -> DataFrame:
    """Per fold and asset: training mean, feature means and coefficients.

    ``y_fit`` rows: keys, pos, idx, value.  ``z_fit``: keys, pos, z0.. (unused
    slots NULL, which leaves their coefficient at zero).
    """
    zs = slot_columns(slots)
    cross = [
        F.coalesce(F.covar_samp(zs[min(a, b)], zs[max(a, b)]), F.lit(0.0)) for a in range(slots) for b in range(slots)
    ]
    fold_x = z_fit.groupBy(*keys).agg(
        F.array(*cross).alias("gram"), F.array(*[F.coalesce(F.avg(z), F.lit(0.0)) for z in zs]).alias("z_mean")
    ).withColumn("inv", scaled_inverse("gram", F.lit(slots))).drop("gram")
    fold_y = (
        y_fit.select(*keys, "pos", "idx", "value").join(z_fit.select(*keys, "pos", *zs), [*keys, "pos"])
        .groupBy(*keys, "idx")
        .agg(
            F.avg("value").alias("y_mean"),
            F.array(*[F.coalesce(F.covar_samp("value", z), F.lit(0.0)) for z in zs]).alias("rhs"),
        )
    )
    inv, rhs = F.col("inv"), F.col("rhs")
    row = lambda a: total([inv[a * slots + b] * rhs[b] for b in range(slots)])
    return fold_y.join(fold_x, keys).select(
        *keys, "idx", "y_mean", "z_mean", F.array(*[row(a) for a in range(slots)]).alias("beta"), "rhs"
    )


def residuals(y: DataFrame, z: DataFrame, betas: DataFrame, slots: int, keys=KEYS) -> DataFrame:
    """y minus its frozen fit; keeps the columns of ``y``."""
    zs = slot_columns(slots)
    fit = F.col("y_mean") + total(
        [F.col("beta")[s] * F.coalesce(F.col(zs[s]) - F.col("z_mean")[s], F.lit(0.0)) for s in range(slots)]
    )
    return (
        y.join(z.select(*keys, "pos", *zs), [*keys, "pos"])
        .join(betas, [*keys, "idx"])
        .withColumn("value", F.col("value") - fit)
        .select(*y.columns)
    )


def frozen_residuals(
    y: DataFrame, features: DataFrame, slots: int, fit_segment: str, eval_segment: str, keys=KEYS
) -> DataFrame:
    """Fit on one segment, residuals on another, for the folds that have features.

    Where nothing was selected the caller falls back on the baseline.
    """
    z = feature_columns(features, slots, keys)
    on = lambda df, s: df.filter(F.col("segment") == s)
    y_fit, y_eval = on(y, fit_segment), on(y, eval_segment)
    z_fit, z_eval = on(z, fit_segment).drop("segment"), on(z, eval_segment).drop("segment")
    return residuals(y_eval, z_eval, fit_betas(y_fit, z_fit, slots, keys), slots, keys)


def baseline_residuals(y: DataFrame, fit_segment: str, eval_segment: str) -> DataFrame:
    """Values minus the mean of the fit segment, per fold and asset."""
    mean = y.filter(F.col("segment") == fit_segment).groupBy(*KEYS, "idx").agg(F.avg("value").alias("y_mean"))
    return (
        y.filter(F.col("segment") == eval_segment).join(mean, [*KEYS, "idx"])
        .withColumn("value", F.col("value") - F.col("y_mean")).select(*y.columns)
    )


def standardize(rows: DataFrame, fit_segment: str, eval_segment: str) -> DataFrame:
    """Training mean and scale (ddof 1, tiny scales become 1) applied to the other rows."""
    p = rows.filter(F.col("segment") == fit_segment).groupBy(*KEYS, "series").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s")
    )
    scale = F.when(F.col("s") > SCALE_FLOOR, F.col("s")).otherwise(1.0)
    return (
        rows.filter(F.col("segment") == eval_segment).join(p, [*KEYS, "series"])
        .withColumn("value", (F.col("value") - F.col("m")) / scale).select(*rows.columns)
    )
