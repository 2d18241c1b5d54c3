"""Driver levels to point-in-time innovations.

Missing levels are absent rows.  Carrying forward is done by spreading each
observation over the positions it covers (at most ``carry`` + 1 of them, and
never past the next observation), so the cost follows the observations and not
a dense calendar-by-series grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.expr import is_finite, safe_ln
from foldwise.operators.calendar import KEY, calendar, check_not_negative, positions

LOG_DIFFERENCE, DIFFERENCE = "LOG_DIFFERENCE", "DIFFERENCE"

# Label sets and tokens of the driver classification.
FUTURE_PATTERN = r"^Generic 1st .* Future$"
YIELD_LABELS = [
    "BONOS Y OBLIG DEL ESTADO", "BUONI POLIENNALI DEL TES", "FRANCE (GOVT OF)", "INDIA GOVERNMENT BOND",
    "NETHERLANDS GOVERNMENT", "UK Gilts 10 Yr", "UK Gilts 30 Year", "UK Gilts 5 Year", "US Generic Govt 10 Yr",
    "US Generic Govt 2 Yr", "US Generic Govt 5 Yr",
]
RATE_LABELS = ["DB Euro Overnight Rate"]
SENTINEL_MINUS_ONE = [
    "CSI 300 INDEX", "Eonia Capitalization Index 7 D", "Russian Ruble SPOT (TOM)", "S&P CoreLogic Case-Shiller 20-",
    "USD-CLP RR 25D 3M",
]
LOW_FREQUENCY_RELEASES = ["S&P CoreLogic Case-Shiller 20-", "US Initial Jobless Claims SA"]
TRUNCATED_SERIES = ["Eonia Capitalization Index 7 D", "Russian Ruble SPOT (TOM)"]
FX_TOKENS = [
    "X-RATE", "Peso Spot", "Dollar Spot", "Pound Spot", "Euro Spot", "Rupee Spot", "Yen Spot", "Krone Spot",
    "Krona Spot", "Real Spot", "Zloty Spot", "Ruble SPOT", "Rand Spot", "Singapore Dollar Spot", "Won Spot",
    "Franc Spot", "Lira Spot",
]
EQUITY_LABELS = ["MSCI INDIA", "NIKKEI 225", "S&P/BMV IPC"]
COMMODITY_TOKENS = ["Commodity", "Gold Spot", "Silver Spot", "LME ", "CRB"]
FUTURE_REASON = "A rolled contract: jumps at roll dates need a check of their own."
RELEASE_REASON = "No vintage and no time of publication is known."
TRUNCATED_REASON = "The series ends in a run of sentinel values."


def _has_any(label: Column, tokens) -> Column:
    hit = label.contains(tokens[0])
    for t in tokens[1:]:
        hit = hit | label.contains(t)
    return hit


def class_rules(label: Column) -> list[tuple]:
    """Ordered (condition, class, transformation, unit, eligible, reason); first match wins."""
    return [
        (label.rlike(FUTURE_PATTERN), "generic_future", LOG_DIFFERENCE, "contract quotation", True, FUTURE_REASON),
        (label.isin(LOW_FREQUENCY_RELEASES), "macro_release", "EXCLUDE", "published level", False, RELEASE_REASON),
        (label.isin(TRUNCATED_SERIES), "discontinued_or_truncated_market_series", "EXCLUDE", "source level", False,
         TRUNCATED_REASON),
        (label.contains("EUR SWAP ANN"), "swap_rate", DIFFERENCE, "percentage points", True, ""),
        (label.isin(YIELD_LABELS) | label.contains("GOVT BND"), "sovereign_yield", DIFFERENCE, "percentage points", True, ""),
        (label.isin(RATE_LABELS), "money_market_rate", DIFFERENCE, "percentage points", True, ""),
        (label.contains("RR 25D"), "option_risk_reversal", DIFFERENCE, "volatility points", True, ""),
        (label == "Cboe Volatility Index", "volatility_index", LOG_DIFFERENCE, "index level", True, ""),
        (_has_any(label, FX_TOKENS), "foreign_exchange", LOG_DIFFERENCE, "exchange-rate level", True, ""),
        (label == "DOLLAR INDEX SPOT", "currency_index", LOG_DIFFERENCE, "index level", True, ""),
        (label.contains("INDEX") | label.isin(EQUITY_LABELS), "equity_index", LOG_DIFFERENCE, "index level", True, ""),
        (_has_any(label, COMMODITY_TOKENS), "commodity", LOG_DIFFERENCE, "price or index level", True, ""),
        (F.lit(True), "bond_or_credit_index", LOG_DIFFERENCE, "index level", True, ""),
    ]


def classify_labels(df: DataFrame, label: str = "source_label") -> DataFrame:
    """Add class, transformation, unit, eligibility and reason of each label."""
    rule = None
    for cond, cls, transformation, unit, eligible, reason in class_rules(F.col(label)):
        out = F.struct(
            F.lit(cls).alias("economic_class"), F.lit(transformation).alias("transformation"), F.lit(unit).alias("unit"),
            F.lit(eligible).alias("pilot_eligible"), F.lit(reason).alias("reason"),
        )
        rule = F.when(cond, out) if rule is None else rule.when(cond, out)
    return df.withColumn("_rule", rule).select("*", "_rule.*").drop("_rule")


def series_profile(levels: DataFrame) -> DataFrame:
    """Counts, missing share, span and largest adjacent log move per series.

    The span and the row count are those of the panel's calendar, so absent rows
    count as missing.  Partial aggregation runs before the shuffle by series.
    """
    cal_pos = positions(calendar(levels))
    span = cal_pos.groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("dt").alias("observed_start"), F.max("dt").alias("observed_end")
    )
    x = F.col("value")
    w = Window.partitionBy("panel_id", "series").orderBy("pos")
    near = F.lag("pos").over(w) == F.col("pos") - 1
    move = F.abs(safe_ln(x) - F.when(near, safe_ln(F.lag("value").over(w))))
    return (
        levels.join(cal_pos.select(*KEY, "pos"), KEY)
        .withColumn("move", move)
        .groupBy("panel_id", "series")
        .agg(
            F.count("value").alias("observations"),
            F.count_if(is_finite(x) & (x <= 0)).alias("nonpositive_observations"),
            F.max("move").alias("max_abs_adjacent_log_change"),
        )
        .join(span, "panel_id")
        .withColumn("missing_fraction", 1.0 - F.col("observations") / F.col("n_rows"))
        .drop("n_rows")
    )


# What no level can tell; a ledger takes it from a table of the caller's, one row per panel.
PROVENANCE = [
    "source_file", "source_vendor", "source_field", "availability_timestamp_or_timezone", "missing_value_rule", "reviewed_by", "reviewed_on",
]
SENTINEL_RULE = "Exact -1 is a missing-value sentinel; no fill."
NO_SENTINEL_RULE = "No numeric sentinel declared."


def with_provenance(rows: DataFrame, provenance: DataFrame | None) -> DataFrame:
    """Add the columns of ``PROVENANCE`` by panel; what is not given is blank, and two rows for a panel stop the job."""
    given = [c for c in PROVENANCE if provenance is not None and c in provenance.columns]
    if given:
        twice = F.raise_error(F.concat(F.lit("two provenance rows for panel "), F.col("panel_id"))).cast("string")
        one = lambda c: F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.max(F.col(c).cast("string"))).alias(c)
        rows = rows.join(provenance.groupBy("panel_id").agg(*[one(c) for c in given]), "panel_id", "left")
    blank = F.lit("")
    return rows.withColumns({c: F.coalesce(F.col(c), blank) if c in given else blank for c in PROVENANCE})


def driver_ledger(levels: DataFrame, provenance: DataFrame | None = None, *, lag: int = 1, sentinels=SENTINEL_MINUS_ONE) -> DataFrame:
    """One metadata row per driver: profile, classification, rules, and the panel's provenance.

    Without ``provenance`` its columns are blank, which ``driver_ledger_gates`` reports as undocumented.
    """
    check_not_negative(lag=lag)
    profiled = classify_labels(series_profile(levels).withColumnRenamed("series", "source_label"))
    declared = F.when(F.col("source_label").isin(list(sentinels)), SENTINEL_RULE).otherwise(NO_SENTINEL_RULE)
    return with_provenance(profiled, provenance).select(
        "panel_id", "source_label", "economic_class",
        F.col("transformation").alias("suggested_transformation"),
        F.col("transformation").alias("approved_transformation"), "unit", *PROVENANCE[:4],
        F.lit(lag).alias("availability_lag_trading_days"), "missing_value_rule", declared.alias("sentinel_value_rule"),
        "observed_start", "observed_end", "observations", "missing_fraction", "nonpositive_observations",
        "pilot_eligible", F.col("reason").alias("pilot_exclusion_reason"),
        F.col("pilot_eligible").alias("confirmatory_eligible"),
        F.when(F.col("pilot_eligible"), "").otherwise(F.col("reason")).alias("exclusion_reason"),
        "reviewed_by", "reviewed_on",
    )


def mark_sentinels(levels: DataFrame, sentinels=SENTINEL_MINUS_ONE) -> DataFrame:
    """NULL the declared sentinel values and flag their rows."""
    hit = F.coalesce(F.col("series").isin(list(sentinels)) & (F.col("value") == -1), F.lit(False))
    return levels.withColumn("is_sentinel", hit).withColumn("value", F.when(~hit, F.col("value")))


def carry_to_target(levels: DataFrame, target: DataFrame, carry: int = 3, sentinels=SENTINEL_MINUS_ONE) -> DataFrame:
    """Latest level on each target date, at most ``carry`` union-calendar rows old.

    ``target`` is a calendar (panel_id, dt).  The limit counts rows of the union
    of both calendars; sentinel dates stay missing themselves but use up a step.
    """
    check_not_negative(carry=carry)
    union_pos = positions(calendar(levels).unionByName(target.select(*KEY)).distinct())
    marked = mark_sentinels(levels, sentinels).join(union_pos.drop("n_dates"), KEY)
    w = Window.partitionBy("panel_id", "series").orderBy("pos")
    stop = F.least(F.col("pos") + carry, F.coalesce(F.lead("pos").over(w) - 1, F.col("pos") + carry))
    spread = (
        marked.filter(F.col("value").isNotNull())
        .withColumn("stop", stop)
        .withColumn("upos", F.explode(F.sequence("pos", "stop")))
        .select("panel_id", "series", "upos", "value")
    )
    blocked = marked.filter("is_sentinel").select("panel_id", "series", F.col("pos").alias("upos"))
    on_target = union_pos.join(target.select(*KEY), KEY, "left_semi").select("panel_id", "dt", F.col("pos").alias("upos"))
    return (
        spread.join(blocked, ["panel_id", "series", "upos"], "left_anti")
        .join(on_target, ["panel_id", "upos"])
        .select("panel_id", "dt", "series", "value")
    )


def transform_on_calendar(sampled: DataFrame, ledger: DataFrame, target_pos: DataFrame) -> DataFrame:
    """Log or plain difference between neighbouring target dates, eligible series only."""
    rules = ledger.filter("pilot_eligible").select(
        "panel_id", F.col("source_label").alias("series"), F.col("approved_transformation").alias("rule")
    )
    w = Window.partitionBy("panel_id", "series").orderBy("pos")
    prior = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.lag("value").over(w))
    x, p, rule = F.col("value"), F.col("prior"), F.col("rule")
    unknown = F.raise_error(F.concat(F.lit("unsupported transformation for "), F.col("series"))).cast("double")
    step = (
        F.when(rule == LOG_DIFFERENCE, F.when((x > 0) & (p > 0), F.ln(x / p)))
        .when(rule == DIFFERENCE, x - p)
        .otherwise(unknown)
    )
    return (
        sampled.join(target_pos.select(*KEY, "pos"), KEY)
        .join(rules, ["panel_id", "series"])
        .withColumn("prior", prior)
        .select("panel_id", "dt", "pos", "series", step.alias("value"))
        .filter("value IS NOT NULL")
    )


def availability_lag(rows: DataFrame, target_pos: DataFrame, lag: int) -> DataFrame:
    """Move each value ``lag`` target sessions later (rows pushed off the end vanish)."""
    check_not_negative(lag=lag)
    if lag == 0:
        return rows.select("panel_id", "dt", "series", "value")
    later = target_pos.select("panel_id", F.col("dt").alias("dt"), "pos")
    return (
        rows.select("panel_id", "series", "value", (F.col("pos") + lag).alias("pos"))
        .join(later, ["panel_id", "pos"])
        .select("panel_id", "dt", "series", "value")
    )


def driver_innovations(
    levels: DataFrame, ledger: DataFrame, target: DataFrame, *, lag: int = 1, carry: int = 3, sentinels=SENTINEL_MINUS_ONE
) -> DataFrame:
    """Sentinels, limited carry, sampling on the target calendar, difference, lag."""
    target_pos = positions(target)
    sampled = carry_to_target(levels, target, carry, sentinels)
    return availability_lag(transform_on_calendar(sampled, ledger, target_pos), target_pos, lag)


def driver_panel_report(ledger: DataFrame, assets: DataFrame, innovations: DataFrame, lag: int = 1) -> DataFrame:
    """One row of counters per panel of the ledger: drivers by fate, and the panel of common complete innovations.

    Common dates are those of the assets on which every eligible driver has an innovation.  A panel
    without any has zeros and null dates.
    """
    check_not_negative(lag=lag)
    of = lambda c: F.count_if(F.col("economic_class") == c)
    drivers = ledger.groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("source_drivers"), F.count_if("pilot_eligible").alias("pilot_eligible_drivers"),
        of("generic_future").alias("excluded_generic_futures"), of("macro_release").alias("excluded_low_frequency_releases"),
        of("discontinued_or_truncated_market_series").alias("excluded_discontinued_or_truncated"),
        F.count_if("confirmatory_eligible").alias("confirmatory_eligible_drivers"),
    )
    finite = lambda: F.count_if(F.col("value").isNotNull() & ~is_finite(F.col("value")))
    wanted = innovations.select("panel_id", "series").distinct().groupBy("panel_id").agg(F.count(F.lit(1)).alias("wide"))
    by_day = innovations.groupBy(*KEY).agg(F.count("value").alias("there"), finite().alias("x_bad"))
    days = assets.groupBy(*KEY).agg(F.count("value").alias("y_there"), finite().alias("y_bad"))
    joined = days.join(by_day, KEY, "left").join(wanted, "panel_id", "left")
    common = F.coalesce(F.col("there") == F.col("wide"), F.lit(False))
    on = lambda c: F.when(common, F.col(c))
    width = assets.select("panel_id", "series").distinct().groupBy("panel_id").agg(F.count(F.lit(1)).alias("asset_count"))
    panel = joined.groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("asset_return_rows_before_driver_intersection"), F.count_if(common).alias("common_complete_rows"),
        F.min(on("dt")).alias("common_start"), F.max(on("dt")).alias("common_end"), F.coalesce(F.sum(on("y_there")), F.lit(0)).alias("_cells"),
        F.coalesce(F.sum(on("wide") - on("there")), F.lit(0)).alias("innovation_missing_cells_common"),
        F.coalesce(F.sum(on("x_bad")), F.lit(0)).alias("nonfinite_innovation_cells_common"),
        F.coalesce(F.sum(on("y_bad")), F.lit(0)).alias("nonfinite_asset_cells_common"),
    )
    out = drivers.join(panel, "panel_id", "left").join(width, "panel_id", "left")
    out = out.fillna(0, [c for c, t in out.dtypes if t == "bigint"])
    return out.withColumn(
        "asset_missing_cells_common", F.col("common_complete_rows") * F.col("asset_count") - F.col("_cells")
    ).withColumn("availability_lag_asset_sessions", F.lit(lag)).withColumn(
        "status", F.when(F.col("common_complete_rows") > 0, "PILOT_READY_CONFIRMATORY_PROVENANCE_UNRESOLVED").otherwise("NO_COMMON_COMPLETE_ROWS")
    ).drop("_cells")
