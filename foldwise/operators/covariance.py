"""Covariance estimators on long matrices (keys, i, j, n, v with i <= j).

Linear shrinkage and driver-structured forms are column arithmetic on the long
matrix; only eigenvalue methods go through one dense matrix per group.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.expr import total
from foldwise.operators import kernels
from foldwise.operators.groups import per_group
from foldwise.operators.moments import KEYS, window_matrix

CELLS = [*KEYS, "i", "j", "v"]
MATRIX = "panel_id string, design string, fold_id long, i int, j int, v double"


def diagonal():
    return F.col("i") == F.col("j")


def assets_only(cov: DataFrame, index: DataFrame) -> DataFrame:
    """The asset block of a covariance that also covers drivers (assets come first)."""
    n = index.select("panel_id", "n_assets").distinct()
    return cov.join(n, "panel_id").filter("i < n_assets AND j < n_assets").drop("n_assets")


def matrix_stats(cov: DataFrame) -> DataFrame:
    """Per fold: trace, width, sum of squares over the full matrix, rows used."""
    twice = F.when(diagonal(), 1.0).otherwise(2.0)
    return cov.groupBy(*KEYS).agg(
        F.sum(F.when(diagonal(), F.col("v")).otherwise(0.0)).alias("tr"), F.count_if(diagonal()).alias("p"),
        F.sum(twice * F.col("v") * F.col("v")).alias("ss"), F.max("n").alias("t"),
    )


def ridge(cov: DataFrame, intensity: float = 0.10) -> DataFrame:
    target = F.when(diagonal(), F.col("tr") / F.col("p")).otherwise(0.0)
    return cov.join(matrix_stats(cov), KEYS).withColumn(
        "v", (1 - intensity) * F.col("v") + intensity * target
    ).select(*CELLS)


def squared_norms(rows: DataFrame) -> DataFrame:
    """Per fold: sum over dates of the squared centred norm, squared.

    ``rows``: training rows assigned to folds (keys, pos, idx, value).
    """
    mean = rows.groupBy(*KEYS, "idx").agg(F.avg("value").alias("m"))
    dev = F.col("value") - F.col("m")
    return (
        rows.select(*KEYS, "pos", "idx", "value").join(mean, [*KEYS, "idx"])
        .groupBy(*KEYS, "pos").agg(F.sum(dev * dev).alias("q"))
        .groupBy(*KEYS).agg(F.sum(F.col("q") * F.col("q")).alias("q2"))
    )


def shrink_to_identity(cov: DataFrame, weights: DataFrame) -> DataFrame:
    """(1-w) S0 + w (tr S0 / p) I with S0 the ddof-0 covariance; weights: keys, w."""
    s0 = F.col("v") * (F.col("t") - 1) / F.col("t")
    mu = F.col("tr") * (F.col("t") - 1) / F.col("t") / F.col("p")
    shrunk = (1 - F.col("w")) * s0 + F.when(diagonal(), F.col("w") * mu).otherwise(0.0)
    return cov.join(matrix_stats(cov).join(weights, KEYS), KEYS).withColumn("v", shrunk).select(*CELLS)


def _population(stats: DataFrame) -> DataFrame:
    f = (F.col("t") - 1) / F.col("t")
    return stats.withColumn("tr", F.col("tr") * f).withColumn("ss", F.col("ss") * f * f).withColumn("mu", F.col("tr") / F.col("p"))


def ledoit_wolf_weights(cov: DataFrame, rows: DataFrame) -> DataFrame:
    """Linear shrinkage intensity (Ledoit and Wolf 2004)."""
    p, t, mu = F.col("p"), F.col("t"), F.col("mu")
    delta = (F.col("ss") - 2 * mu * F.col("tr") + p * mu * mu) / p
    beta = F.least((F.col("q2") / t - F.col("ss")) / (p * t), F.col("delta"))
    return (
        _population(matrix_stats(cov)).join(squared_norms(rows), KEYS)
        .withColumn("delta", delta).withColumn("beta", beta)
        .select(*KEYS, F.when(F.col("beta") == 0, 0.0).otherwise(F.col("beta") / F.col("delta")).alias("w"))
    )


def oas_weights(cov: DataFrame) -> DataFrame:
    """Oracle-approximating shrinkage intensity (Chen et al. 2010)."""
    p, t, mu2 = F.col("p"), F.col("t"), F.col("mu") * F.col("mu")
    alpha = F.col("ss") / (p * p)
    den = (t + 1) * (alpha - mu2 / p)
    return _population(matrix_stats(cov)).select(
        *KEYS, F.when(den == 0, 1.0).otherwise(F.least(F.lit(1.0), (alpha + mu2) / den)).alias("w")
    )


def structured(cov: DataFrame, betas: DataFrame, slots: int) -> DataFrame:
    """Factor part plus residual variances in ``v``; with residual covariances in ``full``.

    By the normal equations beta_i' Cov(z) beta_j is beta_i . Cov(z, y_j), and the
    full form is the sample covariance, so both sit in one row without a join.
    """
    b = betas.select(*KEYS, F.col("idx").alias("i"), "beta")
    c = betas.select(*KEYS, F.col("idx").alias("j"), "rhs")
    factor = total([F.col("beta")[s] * F.col("rhs")[s] for s in range(slots)])
    return (
        cov.join(b, [*KEYS, "i"]).join(c, [*KEYS, "j"])
        .withColumn("full", F.col("v")).withColumn("v", F.when(diagonal(), F.col("v")).otherwise(factor))
        .select(*KEYS, "i", "j", "v", "full")
    )


def blend(pair: DataFrame, alpha: DataFrame) -> DataFrame:
    """(1-alpha) v + alpha full; ``alpha``: keys, alpha (one or more per fold)."""
    a = F.col("alpha")
    return pair.join(alpha, KEYS).withColumn("v", (1 - a) * F.col("v") + a * F.col("full")).drop("full")


def _per_fold(cov: DataFrame, fn, columns, schema=MATRIX) -> DataFrame:
    return per_group(cov.select(*columns), KEYS, fn, schema)


def quadratic_inverse(cov: DataFrame) -> DataFrame:
    def run(key, pdf):
        spectrum = kernels.spectrum(kernels.dense(pdf))
        return kernels.cells(KEYS, key, kernels.quadratic_inverse(spectrum, int(pdf["n"].iloc[0])))

    return _per_fold(cov, run, [*CELLS, "n"])


def leading_plus_diagonal(cov: DataFrame, factors: DataFrame) -> DataFrame:
    """``factors``: keys, k."""

    def run(key, pdf):
        m = kernels.dense(pdf)
        return kernels.cells(KEYS, key, kernels.leading_plus_diagonal(m, kernels.spectrum(m), int(pdf["k"].iloc[0])))

    return _per_fold(cov.join(factors, KEYS), run, [*CELLS, "k"])


def thresholded_factors(rows: DataFrame, factors: DataFrame, constant: float = 0.5) -> DataFrame:
    """From the training rows themselves (fourth moments of residuals are needed)."""

    def run(key, pdf):
        x, _ = window_matrix(pdf)
        return kernels.cells(KEYS, key, kernels.thresholded_factors(x, int(pdf["k"].iloc[0]), constant))

    return _per_fold(rows.join(factors, KEYS), run, [*KEYS, "pos", "idx", "value", "k"])


def eigen_floor(cov: DataFrame, scale: float = 1e-6, absolute: float = 0.0) -> DataFrame:
    def run(key, pdf):
        m, hit = kernels.floored(kernels.dense(pdf), scale, absolute)
        return kernels.cells(KEYS, key, m, activated=hit)

    return _per_fold(cov, run, CELLS, MATRIX + ", activated boolean")


def leading_vectors(cov: DataFrame, factors: DataFrame) -> DataFrame:
    """(keys, comp, idx, loading) of the leading eigenvectors, comp 0 the largest."""

    def run(key, pdf):
        m = kernels.dense(pdf)
        k = min(max(int(pdf["k"].iloc[0]), 1), len(m))
        _, q = kernels.np.linalg.eigh(m)
        v = q[:, ::-1][:, :k]
        comp, idx = kernels.np.meshgrid(range(k), range(len(m)), indexing="ij")
        return pd.DataFrame({
            **dict(zip(KEYS, key)), "comp": comp.ravel(), "idx": idx.ravel(), "loading": v.T.ravel(),
        })

    schema = "panel_id string, design string, fold_id long, comp int, idx int, loading double"
    return _per_fold(cov.join(factors, KEYS), run, [*CELLS, "k"], schema)


def window_vectors(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """As :func:`leading_vectors`, straight from the rows of each window: no cell of a covariance is formed."""

    def run(key, pdf):
        x, idx = window_matrix(pdf)
        _, q = kernels.leading_pairs(x, max(int(pdf["k"].iloc[0]), 1))
        comp, at = kernels.np.meshgrid(range(q.shape[1]), idx, indexing="ij")
        return pd.DataFrame({**dict(zip(KEYS, key)), "comp": comp.ravel(), "idx": at.ravel(), "loading": q.T.ravel()})

    schema = "panel_id string, design string, fold_id long, comp int, idx int, loading double"
    return _per_fold(rows.join(factors, KEYS), run, [*KEYS, "pos", "idx", "value", "k"], schema)


def factor_form(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Leading eigenpart plus the rest of the diagonal, as one row per series: keys, idx, load (array), rest.

    The matrix is load_i . load_j off the diagonal and load_i . load_i + rest_i on it: n x (k + 1) numbers
    a fold in place of n x n cells.  ``factors``: keys, k; at least one and fewer than the series.
    """

    def run(key, pdf):
        x, idx = window_matrix(pdf)
        lam, q = kernels.leading_pairs(x, min(max(int(pdf["k"].iloc[0]), 1), max(x.shape[1] - 1, 1)))
        load = q * kernels.np.sqrt(lam)
        rest = kernels.np.clip(x.var(axis=0, ddof=1) - (load * load).sum(axis=1), 0.0, None)
        return pd.DataFrame({**dict(zip(KEYS, key)), "idx": idx, "load": list(load), "rest": rest})

    schema = "panel_id string, design string, fold_id long, idx int, load array<double>, rest double"
    return _per_fold(rows.join(factors, KEYS), run, [*KEYS, "pos", "idx", "value", "k"], schema)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)


def form_cells(form: DataFrame) -> DataFrame:
    """All i <= j cells of a factor form, for users who need the matrix itself (n x n rows are its size)."""
    a = form.select(*KEYS, F.col("idx").alias("i"), F.col("load").alias("la"), "rest")
    b = form.select(*KEYS, F.col("idx").alias("j"), F.col("load").alias("lb"))
    v = _dot("la", "lb") + F.when(diagonal(), F.col("rest")).otherwise(0.0)
    return a.join(b, KEYS).filter("i <= j").withColumn("v", v).select(*CELLS)


def form_variance(form: DataFrame, weights: DataFrame) -> DataFrame:
    """Predicted variance of ``weights`` (keys, idx, w) under a factor form: keys, predicted.

    Sums of w x load by component, then their squares; rows meet on series, never in pairs.
    """
    held = form.join(weights.select(*KEYS, "idx", "w"), [*KEYS, "idx"])
    own = held.groupBy(*KEYS).agg(F.sum(F.col("w") * F.col("w") * F.col("rest")).alias("own"))
    pull = held.select(*KEYS, "w", F.posexplode("load").alias("comp", "l")).groupBy(*KEYS, "comp").agg(F.sum(F.col("w") * F.col("l")).alias("f"))
    common = pull.groupBy(*KEYS).agg(F.sum(F.col("f") * F.col("f")).alias("common"))
    return own.join(common, KEYS, "left").select(*KEYS, (F.col("own") + F.coalesce("common", F.lit(0.0))).alias("predicted"))


def form_minimum_variance(form: DataFrame) -> DataFrame:
    """Minimum-variance weights of a factor form (keys, idx, w); a series without a rest stops the job."""

    def run(key, pdf):
        w = kernels.factor_weights(kernels.np.stack(pdf["load"].to_numpy()), pdf["rest"].to_numpy())
        return pd.DataFrame({**dict(zip(KEYS, key)), "idx": pdf["idx"], "w": w})

    return _per_fold(form, run, [*KEYS, "idx", "load", "rest"], "panel_id string, design string, fold_id long, idx int, w double")


def subspace_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean squared cosine of the principal angles between two leading subspaces.

    Equals the squared inner products of the basis vectors summed over k.
    Inputs as from :func:`leading_vectors`, joined on keys and idx.
    """
    left = a.select(*KEYS, F.col("comp").alias("ca"), "idx", F.col("loading").alias("la"))
    right = b.select(*KEYS, F.col("comp").alias("cb"), "idx", F.col("loading").alias("lb"))
    inner = left.join(right, [*KEYS, "idx"]).groupBy(*KEYS, "ca", "cb").agg(F.sum(F.col("la") * F.col("lb")).alias("c"))
    return inner.groupBy(*KEYS).agg(
        (F.sum(F.col("c") * F.col("c")) / (F.max("ca") + 1)).alias("overlap"), (F.max("ca") + 1).alias("k")
    )


def tag(method: str, cov: DataFrame) -> DataFrame:
    return cov.select(*KEYS, F.lit(method).alias("method"), "i", "j", "v")


def union_all(frames) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)
