"""Prices to auditable returns: no bridging of gaps, split and event repair.

Panels are sparse and long: a missing price is an absent or NULL row, so no
dense date-by-series grid is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.expr import nearest_split, valid_price
from foldwise.operators.calendar import KEY, calendar, positions

APPLY, EXCLUDE, KEEP = "APPLY_FACTOR", "EXCLUDE_DATE", "KEEP_OBSERVED"
VERIFIED = "ADJUSTED_VERIFIED_FACTOR"
MECHANICAL = "ADJUSTED_MECHANICAL_SPLIT_CANDIDATE"
EXCLUDED = "EXCLUDED_VERIFIED_DISTRIBUTION_DATE"
RETAINED = "RETAINED_VERIFIED_MARKET_MOVE"
UNMATCHED = "UNMATCHED_LARGE_MOVE"

LEDGER_COLUMNS = [
    "date", "ticker", "disposition", "factor", "verification_status",
    "event_type", "source_url", "rationale",
]


def adjacent_pairs(prices: DataFrame, cal_pos: DataFrame | None = None) -> DataFrame:
    """Each price with the one on the source row just before it.

    The position test makes sure that a gap is not bridged: a pair counts only
    when both ends are valid and the prior date is the calendar's previous one.
    """
    cal_pos = positions(calendar(prices)) if cal_pos is None else cal_pos
    w = Window.partitionBy("panel_id", "series").orderBy("pos")
    near = F.lag("pos").over(w) == F.col("pos") - 1
    return (
        prices.join(cal_pos, KEY)
        .withColumn("prior_dt", F.when(near, F.lag("dt").over(w)))
        .withColumn("prior_price", F.when(near, F.lag("value").over(w)))
        .withColumn(
            "pair_ok",
            F.coalesce(valid_price(F.col("value")) & valid_price(F.col("prior_price")), F.lit(False)),
        )
        .withColumn("ratio", F.when(F.col("pair_ok"), F.col("value") / F.col("prior_price")))
        .withColumn("raw_log", F.when(F.col("pair_ok"), F.ln("ratio")))
        .withColumnRenamed("value", "price")
    )


def log_returns(prices: DataFrame) -> DataFrame:
    return adjacent_pairs(prices).filter("pair_ok").select("panel_id", "dt", "series", F.col("raw_log").alias("value"))


def universe_of(prices: DataFrame) -> DataFrame:
    return prices.select("panel_id", "series").distinct()


def synchronous_pairs(prices: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Pairs on dates where every series of the universe has a valid pair.

    The count over (panel, date) is a window, so the pairs are shuffled once
    more and not joined with themselves; its partitions are one date wide.
    """
    dates = calendar(prices)  # of all source rows, also those outside the universe
    if universe is None:
        universe = universe_of(prices)
    else:
        prices = prices.join(universe.select("panel_id", "series"), ["panel_id", "series"], "left_semi")
    width = universe.groupBy("panel_id").agg(F.count(F.lit(1)).alias("n_series"))
    # the width travels with the short calendar, so no large join has the panel alone as its key
    cal_pos = positions(dates).join(width, "panel_id")
    w = Window.partitionBy(*KEY)
    return (
        adjacent_pairs(prices, cal_pos)
        .filter("pair_ok")
        .withColumn("n_ok", F.count(F.lit(1)).over(w))
        .filter("n_ok = n_series")
        .drop("n_ok", "n_series")
    )


def synchronous_returns(prices: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    return synchronous_pairs(prices, universe).select("panel_id", "dt", "series", F.col("raw_log").alias("value"))


def to_simple(returns: DataFrame) -> DataFrame:
    """Stored log returns to simple returns, once, before estimation."""
    return returns.withColumn("value", F.expm1("value"))


def ledger_problems(ledger: DataFrame) -> DataFrame:
    """One row per failed check of an event ledger (empty means usable)."""
    missing = [c for c in LEDGER_COLUMNS if c not in ledger.columns]
    spark = ledger.sparkSession
    if missing:
        return spark.createDataFrame([(f"missing columns {missing}", len(missing))], "problem string, n long")
    flags = ledger.agg(
        F.count_if(~F.coalesce(F.col("disposition").isin(APPLY, EXCLUDE, KEEP), F.lit(False))).alias("unknown disposition"),
        F.count_if(
            (F.col("disposition") == APPLY) & ~F.coalesce(F.col("factor") > 0, F.lit(False))
        ).alias("factor not positive"),
    )
    keys = [c for c in ("panel_id", "date", "ticker") if c in ledger.columns]
    doubled = ledger.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("duplicate key"))
    both = flags.unpivot([], flags.columns, "problem", "n").unionByName(
        doubled.unpivot([], doubled.columns, "problem", "n")
    )
    return both.filter("n > 0")


def require_ledger(ledger: DataFrame) -> None:
    """Stop on a ledger that would misstate or multiply returns."""
    found = [f"{r['problem']}: {r['n']}" for r in ledger_problems(ledger).orderBy("problem").collect()]
    if found:
        raise ValueError(f"event ledger is not usable ({'; '.join(found)})")


def price_events(
    pairs: DataFrame,
    ledger: DataFrame,
    *,
    candidate_log: float = 0.5,
    split_tolerance: float = 0.05,
) -> DataFrame:
    """Disposition of every synchronous pair in one pass.

    ``ledger`` has panel_id, date, ticker and the other ledger columns and at
    most one row per key, so the left join keeps the row count; Catalyst
    broadcasts it only when its size allows.  Rows without an event have a NULL
    ``rule_status`` and keep the raw return.
    """
    require_ledger(ledger)
    led = ledger.select("panel_id", F.col("date").alias("dt"), F.col("ticker").alias("series"), *LEDGER_COLUMNS[2:])
    disposition, factor, ratio = F.col("disposition"), F.col("factor"), F.col("ratio")
    large = F.abs("raw_log") >= candidate_log
    by_date = Window.partitionBy(*KEY)  # as in the synchronous count: no further shuffle
    split = F.when(large, nearest_split(ratio))
    ledgered = disposition.isNotNull()
    accepted = large & ~ledgered & (F.col("near.relative_error") <= split_tolerance)
    status: Column = (
        F.when(disposition == APPLY, VERIFIED)
        .when(disposition == EXCLUDE, EXCLUDED)
        .when(disposition == KEEP, RETAINED)
        .when(accepted, MECHANICAL)
        .when(large, UNMATCHED)
    )
    used = F.when(disposition == APPLY, factor).when(large, F.col("near.factor"))
    return (
        pairs.join(led, ["panel_id", "dt", "series"], "left")
        .withColumn("is_candidate", large)
        .withColumn("near", split)
        .withColumn("rule_status", status)
        .withColumn("matched_split_factor", used)
        .withColumn(
            "relative_error",
            F.when(disposition == APPLY, F.abs(ratio - factor) / factor).when(large, F.col("near.relative_error")),
        )
        .withColumn(
            "adjusted_log_return",
            F.when(F.col("rule_status").isin(VERIFIED, MECHANICAL), F.ln(ratio / F.col("matched_split_factor")))
            .otherwise(F.col("raw_log")),
        )
        .withColumn(
            "verification_status",
            F.when(F.col("rule_status").isNotNull() & ~ledgered, "MECHANICAL_RULE_ONLY").otherwise(F.col("verification_status")),
        )
        .drop("near")
        .withColumn("date_excluded", F.max(F.coalesce(F.col("rule_status") == EXCLUDED, F.lit(False))).over(by_date))
        .withColumn(
            "date_touched",
            F.max(F.coalesce(F.col("rule_status").isin(VERIFIED, MECHANICAL, EXCLUDED), F.lit(False))).over(by_date),
        )
    )


def event_audit(events: DataFrame) -> DataFrame:
    """Audit rows: large moves and ledgered moves below the threshold."""
    blank = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("event_type", "source_url", "rationale")]
    return events.filter(F.col("rule_status").isNotNull()).select(
        "panel_id", F.col("dt").alias("date"), F.col("series").alias("ticker"),
        F.col("prior_dt").alias("prior_source_date"), "prior_price", F.col("price").alias("current_price"),
        F.col("ratio").alias("raw_price_ratio"), F.col("raw_log").alias("raw_log_return"),
        "matched_split_factor", "relative_error", "rule_status", "verification_status", *blank,
        "adjusted_log_return", "is_candidate",
    )


def adjusted_returns(events: DataFrame) -> DataFrame:
    """Repaired returns; a verified distribution removes its whole date."""
    return events.filter("NOT date_excluded").select("panel_id", "dt", "series", F.col("adjusted_log_return").alias("value"))


def unresolved_moves(events: DataFrame, limit: float = 0.40) -> DataFrame:
    """Large moves left after repair and exclusion that no ledger row explains."""
    open_moves = F.col("disposition").isNull() & (F.abs("adjusted_log_return") > limit) & ~F.col("date_excluded")
    return events.filter(open_moves).select(
        "panel_id", F.col("dt").alias("date"), F.col("series").alias("ticker"), "adjusted_log_return",
        F.expm1("adjusted_log_return").alias("adjusted_simple_return"), F.lit("REVIEW_REQUIRED").alias("status"),
    )


def drop_dates(rows: DataFrame, dates: DataFrame) -> DataFrame:
    return rows.join(dates, KEY, "left_anti")


def without_event_days(events: DataFrame) -> DataFrame:
    """Sensitivity panel: every date with an adjusted or excluded event removed."""
    return events.filter("NOT date_touched").select("panel_id", "dt", "series", F.col("adjusted_log_return").alias("value"))


def construction_report(prices: DataFrame, events: DataFrame, limit: float = 0.40) -> DataFrame:
    """One row of counters per panel; a panel without synchronous dates has zeros and is provisional."""
    source = prices.groupBy("panel_id").agg(
        F.countDistinct("dt").alias("source_rows_in_range"), F.countDistinct("series").alias("assets")
    )
    per_status = {
        "verified_factor_adjustments": VERIFIED,
        "mechanical_split_adjustments": MECHANICAL,
        "unmatched_large_candidates": UNMATCHED,
        "verified_market_moves_retained": RETAINED,
    }
    kept = ~F.col("date_excluded")
    open_move = kept & F.col("disposition").isNull() & (F.abs("adjusted_log_return") > limit)
    kept_date = F.when(kept, F.col("dt"))
    counts = events.groupBy("panel_id").agg(
        F.countDistinct("dt").alias("synchronous_rows"),
        F.count_if(F.col("is_candidate")).alias("automatic_large_move_candidates"),
        F.count("rule_status").alias("event_audit_rows"),
        *[F.count_if(F.col("rule_status") == s).alias(n) for n, s in per_status.items()],
        F.countDistinct(F.when(~kept, F.col("dt"))).alias("verified_distribution_dates_excluded"),
        F.countDistinct(kept_date).alias("retained_return_rows"),
        F.min(kept_date).alias("first_return_date"),
        F.max(kept_date).alias("last_return_date"),
        F.count_if(open_move).alias("unresolved_post_adjustment_moves"),
    )
    numbers = [c for c, t in counts.dtypes if t == "bigint"]
    return (
        source.join(counts, "panel_id", "left").fillna(0, numbers)
        .withColumn(
            "dropped_return_rows_due_to_missing_or_invalid_endpoint",
            F.col("source_rows_in_range") - 1 - F.col("synchronous_rows"),
        )
        .withColumn("dropped_return_rows_due_to_verified_distribution", F.col("verified_distribution_dates_excluded"))
        .withColumn("data_product", F.lit("fixed-universe split-adjusted log price returns"))
        .withColumn("dividends_included", F.lit(False))
        .withColumn("missing_prices_imputed", F.lit(False))
        .withColumn("return_across_missing_source_observation", F.lit(False))
        .withColumn("survivorship_conditioned_fixed_universe", F.lit(True))
        .withColumn(
            "publication_status",
            F.when((F.col("unresolved_post_adjustment_moves") == 0) & (F.col("retained_return_rows") > 0), "READY_FOR_FIXED_UNIVERSE_PRICE_RETURN_ANALYSIS")
            .otherwise("PROVISIONAL_PENDING_EVENT_REVIEW"),
        )
    )


def report_rows(report: DataFrame, keys=("panel_id",)) -> DataFrame:
    """A one-row report as (metric, value) rows."""
    values = [c for c in report.columns if c not in keys]
    text = report.select(*keys, *[F.col(c).cast("string").alias(c) for c in values])
    return text.unpivot(list(keys), values, "metric", "value")
