"""Calendars and positions.

``dt`` is a DATE, so one calendar has at most about 73,000 rows per 200 years
whatever the size of the panel: the window below sorts distinct dates, never
the panel itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from foldwise.session import materialize

KEY = ["panel_id", "dt"]


def calendar(panel: DataFrame) -> DataFrame:
    return panel.select(*KEY).distinct()


def positions(cal: DataFrame) -> DataFrame:
    """0-based position of each date and the calendar length, per panel."""
    by_panel = Window.partitionBy("panel_id")
    return cal.select(
        *KEY,
        (F.row_number().over(by_panel.orderBy("dt")) - 1).cast("long").alias("pos"),
        F.count(F.lit(1)).over(by_panel).alias("n_dates"),
    )


def with_positions(panel: DataFrame, cal_pos: DataFrame | None = None) -> DataFrame:
    cal_pos = positions(calendar(panel)) if cal_pos is None else cal_pos
    return panel.join(cal_pos, KEY)


def date_slice(panel: DataFrame, start, end) -> DataFrame:
    """Inclusive date range; the filter reaches the scan."""
    return panel.filter(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def stored(df: DataFrame, message: str, *faults) -> DataFrame:
    """The table, written once; stops with ``message`` where it is empty.

    ``faults`` are (message, condition) pairs: a row that meets a condition stops the job.  The
    rows are counted while they are written, so the guards cost no further scan.
    """
    seen = Observation()
    counts = [F.count_if(F.coalesce(bad, F.lit(False))).alias(f"fault{k}") for k, (_, bad) in enumerate(faults)]
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts))
    found = seen.get
    if not found["rows"]:
        raise ValueError(message)
    for k, (what, _) in enumerate(faults):
        if found[f"fault{k}"]:
            raise ValueError(f"{what}: {found[f'fault{k}']} rows")
    return out


def duplicate_keys(panel: DataFrame, keys=("panel_id", "dt", "series")) -> DataFrame:
    """Keys that occur more than once (partial counts before the shuffle)."""
    return panel.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def unsorted_steps(listing: DataFrame, keys=("panel_id",), order="row_no") -> DataFrame:
    """Places where a delivered calendar does not strictly increase."""
    w = Window.partitionBy(*keys).orderBy(order)
    prior = F.lag("dt").over(w)
    return listing.withColumn("prior_dt", prior).filter(F.col("prior_dt") >= F.col("dt"))


def check_lengths(**lengths: int) -> None:
    for name, value in lengths.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


def check_not_negative(**counts: int) -> None:
    for name, value in counts.items():
        if value < 0:
            raise ValueError(f"{name} cannot be negative")
