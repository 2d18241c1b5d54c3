"""Second moments of panels by tiled matrix products.

The pairs of a date are never emitted as rows.  Rows of a window are grouped by
(keys, tile, tile), a tile being at most ``TILE`` series wide, and each group is
one small matrix product in a task.  A group holds at most window length x
2 x TILE numbers whatever the width of the panel, so one hot panel spreads over
its blocks and tile pairs.

Overlapping training windows share blocks: moments are taken once per block
of gcd(step, length) dates and added up per fold.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.calendar import KEY, calendar, positions
from foldwise.operators.folds import Design, covering_folds
from foldwise.operators.groups import per_group
from foldwise.operators.kernels import offdiagonal_norm

TILE = 256
MAX_BLOCKS = 16
KEYS = ["panel_id", "design", "fold_id"]


def series_index(panel: DataFrame) -> DataFrame:
    """Dense numbers for the series of each panel, in order of role and name."""
    has_role = "role" in panel.columns
    names = (panel if has_role else panel.withColumn("role", F.lit("asset"))).select("panel_id", "role", "series").distinct()
    w = Window.partitionBy("panel_id")
    return names.select(
        "panel_id", "role", "series",
        (F.row_number().over(w.orderBy("role", "series")) - 1).cast("int").alias("idx"),
        F.count(F.lit(1)).over(w).cast("int").alias("n_series"),
        F.count(F.when(F.col("role") == "asset", 1)).over(w).cast("int").alias("n_assets"),
    )


def indexed(panel: DataFrame, index: DataFrame | None = None, cal_pos: DataFrame | None = None) -> DataFrame:
    """Rows with date position and series number: the input of the moment operators."""
    panel = panel if "role" in panel.columns else panel.withColumn("role", F.lit("asset"))
    index = series_index(panel) if index is None else index
    cal_pos = positions(calendar(panel)) if cal_pos is None else cal_pos
    return panel.join(index, ["panel_id", "role", "series"]).join(cal_pos, KEY)


def index_of(rows: DataFrame) -> DataFrame:
    """The series index carried by indexed rows."""
    return rows.select("panel_id", "role", "series", "idx", "n_series", "n_assets").distinct()


def stack_roles(assets: DataFrame, drivers: DataFrame) -> DataFrame:
    a = assets.select("panel_id", "dt", F.lit("asset").alias("role"), "series", "value")
    return a.unionByName(drivers.select("panel_id", "dt", F.lit("driver").alias("role"), "series", "value"))


def tiled(rows: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """Send each row to the tile pairs that need it (once each when the panel fits one tile)."""
    own = F.floor(F.col("idx") / tile).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n_series") / tile) - 1).cast("int")))
    return (
        rows.select(*keys, "pos", "idx", "n_series", "value")
        .withColumn("own", own).withColumn("other", other)
        .withColumn("ti", F.least("own", "other")).withColumn("tj", F.greatest("own", "other"))
        .select(*keys, "ti", "tj", "pos", "idx", "n_series", "value")
    )


def tile_width(n_series: int, ti: int, tj: int, tile: int) -> int:
    """How many series a pair of tiles holds when none is absent."""
    return sum(min(tile, n_series - t * tile) for t in {ti, tj})


def window_matrix(pdf: pd.DataFrame, expected: int | None = None):
    """Dates x series array of one group; a missing or doubled cell, or a series absent from the whole group, stops the job."""
    pos, r = np.unique(pdf["pos"].to_numpy(), return_inverse=True)
    idx, c = np.unique(pdf["idx"].to_numpy(), return_inverse=True)
    x = np.full((len(pos), len(idx)), np.nan)
    x[r, c] = pdf["value"].to_numpy(dtype=float)
    if len(pdf) > x.size:
        raise ValueError("window has several rows for one date and series")
    if np.isnan(x).any() or (expected is not None and len(idx) != expected):
        raise ValueError("window is incomplete: align the panel first")
    return x, idx


def _tile_sides(idx, ti, tj, tile):
    own = idx // tile
    return np.flatnonzero(own == ti), np.flatnonzero(own == tj)


def co_moments(rows: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """Per group of ``keys``: n, both means and the centred cross-product of each i <= j."""

    def product(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, idx = window_matrix(pdf, tile_width(int(pdf["n_series"].iloc[0]), key[-2], key[-1], tile))
        a, b = _tile_sides(idx, key[-2], key[-1], tile)
        mean = x.mean(axis=0)
        xc = x - mean
        c = xc[:, a].T @ xc[:, b]
        i, j = np.meshgrid(idx[a], idx[b], indexing="ij")
        use = i <= j
        out = {k: v for k, v in zip(keys, key)}
        return pd.DataFrame({
            **out, "i": i[use], "j": j[use], "n": len(x),
            "mi": np.broadcast_to(mean[a][:, None], c.shape)[use],
            "mj": np.broadcast_to(mean[b][None, :], c.shape)[use], "c": c[use],
        })

    t = tiled(rows, keys, tile)
    types = dict(t.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", i int, j int, n long, mi double, mj double, c double"
    return per_group(t, [*keys, "ti", "tj"], product, schema)


def fold_covariance(rows: DataFrame, design: Design, segments=None, tile: int = TILE) -> DataFrame:
    """Unbiased covariance of each i <= j per fold over the named segments (default: first).

    Output: panel_id, design, fold_id, i, j, n, mi, mj, v.
    """
    members = segments or [design.segments[0][0]]
    offset = min(design.offset(m) for m in members)
    length = sum(design.length(m) for m in members)
    unit = gcd(gcd(design.step, length), offset)
    ids = lambda pos: covering_folds(pos, F.col("n_dates"), design, offset, length)
    rows = rows.withColumn("design", F.lit(design.name))
    if length // unit > MAX_BLOCKS:
        direct = rows.withColumn("fold_id", F.explode(ids(F.col("pos"))))
        parts = co_moments(direct, KEYS, tile)
    else:
        blocks = rows.withColumn("block", F.floor(F.col("pos") / unit).cast("long"))
        per_block = co_moments(blocks, ["panel_id", "design", "n_dates", "block"], tile)
        parts = per_block.withColumn("fold_id", F.explode(ids(F.col("block") * unit)))
    n, mi, mj = F.col("n"), F.col("mi"), F.col("mj")
    summed = parts.groupBy(*KEYS, "i", "j").agg(
        F.sum("n").alias("n"), (F.sum(n * mi) / F.sum(n)).alias("mi"), (F.sum(n * mj) / F.sum(n)).alias("mj"),
        F.sum("c").alias("_c"), F.sum(n * mi * mj).alias("_m"),
    )
    between = F.col("_m") - n * mi * mj
    return summed.withColumn("v", (F.col("_c") + between) / (n - 1)).drop("_c", "_m")


def group_covariance(rows: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """Unbiased covariance within each group of ``keys``."""
    return co_moments(rows, keys, tile).withColumn("v", F.col("c") / (F.col("n") - 1)).drop("c")


def offdiag_scores(rows: DataFrame, keys, variance_floor: float | None = None, tile: int = TILE) -> DataFrame:
    """s_f, s_inf and cov_offdiag_f per group without emitting the pairs.

    A pair with a zero-variance side counts as uncorrelated, or its variance is
    floored when ``variance_floor`` is given (the two published variants).
    """

    def partial(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, idx = window_matrix(pdf, tile_width(int(pdf["n_series"].iloc[0]), key[-2], key[-1], tile))
        if len(x) < 3:
            raise ValueError("a score needs at least three rows")
        a, b = _tile_sides(idx, key[-2], key[-1], tile)
        xc = x - x.mean(axis=0)
        c = xc[:, a].T @ xc[:, b] / (len(x) - 1)
        var = (xc * xc).sum(axis=0) / (len(x) - 1)
        sd = np.sqrt(var if variance_floor is None else np.maximum(var, variance_floor))
        scale = np.outer(sd[a], sd[b])
        r = np.divide(c, scale, out=np.zeros_like(c), where=scale > 0)
        use = idx[a][:, None] < idx[b][None, :]
        return pd.DataFrame([{
            **{k: v for k, v in zip(keys, key)}, "r2": float((r[use] ** 2).sum()),
            "top": float(np.abs(r[use]).max()) if use.any() else 0.0, "c2": float((c[use] ** 2).sum()), "pairs": int(use.sum()),
        }])

    t = tiled(rows, keys, tile)
    types = dict(t.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", r2 double, top double, c2 double, pairs long"
    pairs = F.sum("pairs")
    mean_root = lambda c: F.coalesce(F.sqrt(F.try_divide(F.sum(c), pairs)), F.lit(0.0))
    return per_group(t, [*keys, "ti", "tj"], partial, schema).groupBy(*keys).agg(
        mean_root("r2").alias("s_f"), F.max("top").alias("s_inf"), mean_root("c2").alias("cov_offdiag_f")
    )


def window_spectrum(rows: DataFrame, keys) -> DataFrame:
    """Effective rank and spectral norm of the off-diagonal covariance per group.

    One group is window length x panel width numbers.  The rank takes the eigenvalues of the smaller side's
    product, the norm takes products with the window alone; no array is as wide as the panel twice over.
    """

    def spectrum(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x, _ = window_matrix(pdf)
        xc = (x - x.mean(axis=0)) / np.sqrt(len(x) - 1)
        gram = xc @ xc.T if x.shape[1] > x.shape[0] else xc.T @ xc
        shares = np.maximum(np.linalg.eigvalsh(gram), 0.0)
        shares = shares / max(shares.sum(), 1e-18)
        shares = shares[shares > 0]
        own = (xc * xc).sum(axis=0)
        return pd.DataFrame([{
            **{k: v for k, v in zip(keys, key)}, "effective_rank": float(np.exp(-(shares * np.log(shares)).sum())),
            "share_total": float(shares.sum()), "cov_offdiag_spectral": offdiagonal_norm(xc),
            "n_series": x.shape[1], "offdiag_sum": float((xc.sum(axis=1) ** 2).sum() - own.sum()),
            "offdiag_sq": float((gram * gram).sum() - (own * own).sum()),
        }])

    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + (
        ", effective_rank double, share_total double, cov_offdiag_spectral double, n_series long, offdiag_sum double, offdiag_sq double"
    )
    return per_group(rows.select(*keys, "pos", "idx", "value"), keys, spectrum, schema)


# ---- packed tile pairs ---------------------------------------------------------------------------

PACKED = "ids array<int>, n long, mean array<double>, c array<double>"


def _paired(rows: DataFrame, keys, tile: int) -> DataFrame:
    """Send assets to the asset tile pairs that need them and every driver to all of them."""
    tiles = F.ceil(F.col("n_assets") / tile).cast("int")
    every = F.sequence(F.lit(0), tiles - 1)
    own = F.floor(F.col("idx") / tile).cast("int")
    mine = F.transform(every, lambda o: F.struct(F.least(own, o).alias("ti"), F.greatest(own, o).alias("tj")))
    both = F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, tiles - 1), lambda j: F.struct(i.alias("ti"), j.alias("tj")))))
    pair = F.explode(F.when(F.col("role") == "asset", mine).otherwise(both))
    return rows.select(*keys, "pos", "idx", "n_assets", "n_series", "value", pair.alias("p")).select(
        *keys, "p.ti", "p.tj", "pos", "idx", "n_assets", "n_series", "value"
    )


def tile_moments(rows: DataFrame, keys, tile: int = TILE) -> DataFrame:
    """One row per group of ``keys`` and pair of asset tiles: series numbers, n, means and the packed cross-product.

    The matrix covers the pair's assets and all drivers, so it is as wide as two tiles and the pool.
    """

    def product(key, pdf: pd.DataFrame) -> pd.DataFrame:
        assets, series = int(pdf["n_assets"].iloc[0]), int(pdf["n_series"].iloc[0])
        x, idx = window_matrix(pdf, tile_width(assets, key[-2], key[-1], tile) + series - assets)
        mean = x.mean(axis=0)
        xc = x - mean
        return pd.DataFrame([{**dict(zip([*keys, "ti", "tj"], key)), "ids": idx.astype(np.int32), "n": len(x), "mean": mean, "c": (xc.T @ xc).ravel()}])

    t = _paired(rows, keys, tile)
    types = dict(t.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, "ti", "tj"]) + f", {PACKED}"
    return per_group(t, [*keys, "ti", "tj"], product, schema)


def fold_tiles(rows: DataFrame, design: Design, segments=None, tile: int = TILE) -> DataFrame:
    """Unbiased training covariance of each fold, packed per pair of asset tiles: KEYS, ti, tj, ids, n, c, tile.

    Block moments are added up per fold; one group holds the blocks of one window and pair.
    """
    members = segments or [design.segments[0][0]]
    offset = min(design.offset(m) for m in members)
    length = sum(design.length(m) for m in members)
    unit = gcd(gcd(design.step, length), offset)
    blocks = rows.withColumn("design", F.lit(design.name)).withColumn("block", F.floor(F.col("pos") / unit).cast("long"))
    per_block = tile_moments(blocks, ["panel_id", "design", "n_dates", "block"], tile)
    ids = covering_folds(F.col("block") * unit, F.col("n_dates"), design, offset, length)
    parts = per_block.withColumn("fold_id", F.explode(ids)).select(*KEYS, "ti", "tj", "ids", "n", "mean", "c")

    def added(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(dtype=float)
        ids = pdf["ids"].iloc[0]
        means = np.stack(pdf["mean"].to_numpy())
        centre = n @ means / n.sum()
        away = means - centre
        c = np.sum(np.stack(pdf["c"].to_numpy()), axis=0).reshape(len(ids), -1) + (away * n[:, None]).T @ away
        return pd.DataFrame([{**dict(zip([*KEYS, "ti", "tj"], key)), "ids": ids, "n": int(n.sum()), "c": (c / (n.sum() - 1)).ravel()}])

    types = dict(parts.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in [*KEYS, "ti", "tj"]) + ", ids array<int>, n long, c array<double>"
    return per_group(parts, [*KEYS, "ti", "tj"], added, schema).withColumn("tile", F.lit(tile))
