"""Alignment of two panels on common, complete dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.calendar import KEY, calendar, positions


def common_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    return calendar(left).join(calendar(right), KEY, "left_semi")


def on_dates(panel: DataFrame, dates: DataFrame) -> DataFrame:
    return panel.join(dates, KEY, "left_semi")


def series_count(panel: DataFrame, name: str) -> DataFrame:
    return panel.select("panel_id", "series").distinct().groupBy("panel_id").agg(F.count(F.lit(1)).alias(name))


def complete_dates(panel: DataFrame) -> DataFrame:
    """Dates on which every series of the panel has a value."""
    return (
        panel.groupBy(*KEY).agg(F.count("value").alias("present"))
        .join(series_count(panel, "wanted"), "panel_id")
        .filter("present = wanted").select(*KEY)
    )


def intersect_complete(assets: DataFrame, drivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both panels on the dates where both have all their series."""
    dates = complete_dates(assets).join(complete_dates(drivers), KEY, "left_semi")
    return on_dates(assets, dates), on_dates(drivers, dates)


def missing_cells(panel: DataFrame) -> DataFrame:
    """Cells absent from a panel per panel_id: rows here mean an incomplete input."""
    return (
        panel.groupBy("panel_id")
        .agg(F.countDistinct("dt").alias("d"), F.countDistinct("series").alias("s"), F.count("value").alias("present"))
        .select("panel_id", (F.col("d") * F.col("s") - F.col("present")).alias("missing"))
    )


def require_complete(*panels: DataFrame) -> None:
    for panel in panels:
        bad = missing_cells(panel).filter("missing > 0").take(1)
        if bad:
            raise ValueError(f"inputs must be common and complete: {bad[0].asDict()}")


def complete_alignment(
    assets: DataFrame, drivers: DataFrame, *, date_share: float = 0.80, driver_share: float = 0.98
) -> tuple[DataFrame, DataFrame]:
    """Common dates with enough drivers, then drivers with enough coverage, then complete cases.

    The driver coverage is measured only on the dates kept by the first rule.
    """
    width = series_count(drivers, "k")
    shared = on_dates(drivers, calendar(assets))
    active = (
        shared.groupBy(*KEY).agg(F.count("value").alias("present"))
        .join(width, "panel_id").filter(F.col("present") / F.col("k") >= date_share).select(*KEY)
    )
    n_active = active.groupBy("panel_id").agg(F.count(F.lit(1)).alias("n_active"))
    on_active = on_dates(shared, active)
    kept = (
        on_active.groupBy("panel_id", "series").agg(F.count("value").alias("present"))
        .join(n_active, "panel_id").filter(F.col("present") / F.col("n_active") >= driver_share)
        .select("panel_id", "series")
    )
    x = on_active.join(kept, ["panel_id", "series"], "left_semi")
    all_x = (
        x.groupBy(*KEY).agg(F.count("value").alias("present"))
        .join(kept.groupBy("panel_id").agg(F.count(F.lit(1)).alias("k")), "panel_id")
        .filter("present = k").select(*KEY)
    )
    all_y = (
        assets.groupBy(*KEY).agg(F.count("value").alias("present"))
        .join(series_count(assets, "n"), "panel_id").filter("present = n").select(*KEY)
    )
    dates = all_y.join(all_x, KEY, "left_semi")
    return on_dates(assets, dates), on_dates(x, dates)


def state_on_dates(state: DataFrame, dates: DataFrame) -> DataFrame:
    """State levels on given dates, filled forward and then backward without limit.

    A panel has one state series; its window holds one calendar at most.
    """
    w = Window.partitionBy("panel_id").orderBy("pos")
    forward = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    backward = F.first("value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return (
        positions(dates.select(*KEY).distinct())
        .join(state.select(*KEY, "value"), KEY, "left")
        .select(*KEY, F.coalesce(forward, backward).alias("value"))
    )


def month_end_last(levels: DataFrame) -> DataFrame:
    """Last non-missing level of each month, stamped with the month's last day."""
    present = levels.filter(F.col("value").isNotNull())
    return (
        present.groupBy("panel_id", "series", F.last_day("dt").alias("dt"))
        .agg(F.max_by("value", "dt").alias("value"))
        .select("panel_id", "dt", "series", "value")
    )


def nonoverlap_sum(panel: DataFrame, horizons) -> DataFrame:
    """Sums over blocks of h rows that end on the last date; short lead-in dropped.

    All horizons in one pass: each row goes to one block per horizon and the sums
    combine before the shuffle.
    """
    from foldwise.operators.calendar import with_positions

    hs = F.explode(F.array(*[F.lit(int(h)) for h in horizons]))
    rows = with_positions(panel).withColumn("horizon", hs)
    back = F.col("n_dates") - 1 - F.col("pos")
    blocks = F.floor(F.col("n_dates") / F.col("horizon"))
    block = blocks - 1 - F.floor(back / F.col("horizon"))
    return (
        rows.withColumn("block", block.cast("long")).filter("block >= 0")
        .groupBy("panel_id", "horizon", "block", "series")
        .agg(F.max("dt").alias("dt"), F.sum("value").alias("value"))
        .select("panel_id", "horizon", "dt", "series", "value")
    )
