"""Structural audit of whole panels and of delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.expr import parse_mixed_date, safe_ln
from foldwise.operators.calendar import KEY, calendar, positions
from foldwise.session import materialize, parallelism

MOVE_LIMIT = 0.40
DATE_TOKENS = ("date", "fecha", "time")  # fixed values: name parts that suggest a date column


def panel_audit(panel: DataFrame) -> DataFrame:
    """Per panel: size, span, complete, non-positive and jumpy columns, missing shares.

    First one row per series (partial sums before the shuffle), then one per panel.
    """
    cal_pos = positions(calendar(panel))
    w = Window.partitionBy("panel_id", "series").orderBy("pos")
    x = F.col("value")
    near = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag("value").over(w))
    per_series = (
        panel.join(cal_pos, KEY)
        .withColumn("near", near)
        .groupBy("panel_id", "series")
        .agg(
            (1.0 - F.count("value") / F.max("n_dates")).alias("missing"),
            F.count_if(x <= 0).alias("nonpositive"),
            F.max(F.abs(safe_ln(x) - safe_ln(F.col("near")))).alias("max_log"),
            F.max(F.when((F.col("near") == 0) & (x != 0), F.lit(float("inf"))).otherwise(F.abs(F.try_divide(x, F.col("near")) - 1.0))).alias("max_simple"),
        )
    )
    span = cal_pos.groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("dt").alias("date_min"), F.max("dt").alias("date_max")
    )
    shape = per_series.groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(F.col("missing") == 0).alias("complete_columns"),
        F.count_if(F.col("nonpositive") > 0).alias("nonpositive_columns"),
        F.count_if(F.col("max_log") > MOVE_LIMIT).alias("columns_with_log_move"),
        F.count_if(F.col("max_simple") > MOVE_LIMIT).alias("columns_with_simple_move"),
        F.percentile("missing", 0.5).alias("median_missing_fraction"),
        F.max("missing").alias("max_missing_fraction"),
    )
    return span.join(shape, "panel_id")


def order_summary(rows: DataFrame, keys, order: str, value: str, buckets: int | None = None) -> DataFrame:
    """keys, sorted: does ``value`` never fall along ``order``; rows without a value are passed over.

    The rows are cut into ranges of (keys, order); a range is summed up as (first, last, sorted so far) and
    the summaries are compared at their borders, so one long table spreads over many tasks.
    """
    keys = list(keys)
    listed = rows.filter(F.col(value).isNotNull()).select(*keys, order, value).repartitionByRange(buckets or parallelism(rows), *keys, order)
    placed = materialize(listed.withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "range").orderBy(order)
    part = placed.withColumn("before", F.lag(value).over(inside)).groupBy(*keys, "range").agg(
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.bool_and(F.coalesce(F.col("before") <= F.col(value), F.lit(True))).alias("ok")
    )
    along = Window.partitionBy(*keys).orderBy("range")
    met = part.withColumn("border", F.coalesce(F.lag("last").over(along) <= F.col("first"), F.lit(True)))
    return met.groupBy(*keys).agg(F.bool_and(F.col("ok") & F.col("border")).alias("sorted"))


def delivered_audit(table: DataFrame, keys, order: str, date: str) -> DataFrame:
    """Per delivered table: rows, columns, empty rows and columns, span, valid and repeated dates, and whether the dates never fall.

    ``keys`` name the table, ``order`` is the place of a row in it; all other columns are its content.
    """
    keys = list(keys)
    content = [c for c in table.columns if c not in (*keys, order)]
    blank = F.lit(True)
    for c in content:
        blank = blank & F.col(f"`{c}`").isNull()
    empty = sum((F.when(F.count(f"`{c}`") == 0, 1).otherwise(0) for c in content), F.lit(0))
    shape = table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(content)).alias("n_columns"), F.count_if(blank).alias("empty_rows"), empty.alias("empty_columns"),
        F.min(date).alias("date_min"), F.max(date).alias("date_max"), F.count(date).alias("date_valid_rows"),
        (F.count(date) - F.countDistinct(date)).alias("duplicate_dates"),
    )
    kept = order_summary(table, keys, order, date).withColumnRenamed("sorted", "monotonic_dates")
    return shape.join(kept, keys, "left").withColumn("monotonic_dates", F.coalesce("monotonic_dates", F.lit(True)))


def column_date_scores(wide: DataFrame) -> DataFrame:
    """Per candidate column of a delivered table: how many values read as dates.

    Columns named like dates are candidates, else all of them.  Eight-digit
    numbers are read as YYYYMMDD when at least half of the column looks so.
    """
    named = [c for c in wide.columns if any(t in c.strip().lower() for t in DATE_TOKENS)]
    candidates = named or wide.columns
    cells = wide.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in candidates]).unpivot([], candidates, "column", "raw")
    number = F.col("raw").try_cast("double")
    compact = F.round(number).cast("long").cast("string")
    order = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("column"))
    return (
        cells.groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.avg(F.coalesce(number.between(19000101, 21001231), F.lit(False)).cast("int")).alias("compact_share"),
            F.count(F.when(number.between(19000101, 21001231), parse_mixed_date(compact))).alias("n_compact"),
            F.count(parse_mixed_date(F.when(~F.col("raw").rlike(r"^\d+(\.\d*)?$"), F.col("raw")))).alias("n_text"),
        )
        .withColumn("n_dates", F.when(F.col("compact_share") >= 0.5, F.col("n_compact")).otherwise(F.col("n_text")))
        .withColumn("ord", order)
        .select("column", "ord", "n_rows", "n_dates", "compact_share")
    )


def detect_date_column(wide: DataFrame) -> DataFrame:
    """The candidate with most dates, if at least max(3, half of the rows) parse; first wins ties."""
    scores = column_date_scores(wide).filter(F.col("n_dates") >= F.greatest(F.lit(3), F.floor(F.col("n_rows") * 0.5)))
    best = scores.agg(F.min(F.struct(-F.col("n_dates"), F.col("ord"), F.col("column"), F.col("n_rows"))).alias("b"))
    return best.select(
        F.col("b.column").alias("date_column"), (-F.col("b.col1")).alias("date_valid_rows"), F.col("b.n_rows").alias("n_rows")
    )
