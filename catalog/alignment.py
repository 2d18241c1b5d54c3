"""Queries: drivers, calendars, alignment, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.construction import CLASS_SQL, TRANSFORM_SQL, brand_assets
from catalog.inputs import cte, with_
from catalog.pieces import add_positions
from catalog.registry import query, sql
from foldwise.operators import align as A
from foldwise.operators import calendar as C
from foldwise.operators import drivers as D
from foldwise.operators import folds as FD
from foldwise.operators import profile as PR

PV = "panel_id dt series"

# Labels that exercise the rules: one differenced, two declared with a -1 sentinel, one ineligible.
DRIVER_NAMES = [
    ("1-URGENT", "EUR SWAP ANN 1Y"), ("2-HIGH", "CSI 300 INDEX"), ("3-MEDIUM", "USD-CLP RR 25D 3M"),
    ("4-NOT SPECIFIED", "US Initial Jobless Claims SA"), ("5-LOW", "Gold Spot   $/Oz"),
]
NAME_SQL = "CASE series " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in DRIVER_NAMES) + " ELSE series END"
# every 9th week of the declared series is a sentinel (week number since 1990)
VALUE_SPARK = (
    "CASE WHEN series IN ('2-HIGH', '3-MEDIUM') AND cast(datediff(dt, date'1990-01-01') / 7 as int) % 9 = 0 THEN cast(-1 as double) ELSE value END"
)
VALUE_SQL = (
    "CASE WHEN series IN ('2-HIGH', '3-MEDIUM') AND ((dt - DATE '1990-01-01') // 7) % 9 = 0 THEN -1.0 ELSE value END"
)


def levels(spark, sf):
    """Ten weekly driver levels with rule-bearing labels and sentinels."""
    d = I.drv_w(spark, sf).withColumn("value", F.expr(VALUE_SPARK))
    return d.withColumn("series", F.expr(NAME_SQL)).select("panel_id", "dt", "series", "value")


def level_ledger(spark, sf):
    return D.classify_labels(
        levels(spark, sf).select("panel_id", F.col("series").alias("source_label")).distinct()
    ).withColumnRenamed("transformation", "approved_transformation")


def target_weeks(spark, sf):
    return C.calendar(I.px_type_w(spark, sf))


cte("levels", "drv_w", f"SELECT panel_id, dt, {NAME_SQL} AS series, {VALUE_SQL} AS value FROM drv_w")
add_positions("levels")
cte(
    "level_ledger", "levels",
    f"SELECT source_label, economic_class, {TRANSFORM_SQL} AS rule FROM (SELECT source_label, {CLASS_SQL.replace('label', 'source_label')} AS economic_class "
    "FROM (SELECT DISTINCT series AS source_label FROM levels) q) q2",
)
cte("target", "px_type_w", "SELECT DISTINCT panel_id, dt FROM px_type_w")
cte("target_pos", "target", "SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS pos FROM target")
cte(
    "carried", "levels target",
    "SELECT g.dt, g.series, CASE WHEN g.blocked THEN NULL ELSE g.x END AS value FROM (SELECT u.dt, s.series, "
    "coalesce(l.value = -1 AND s.series IN ('CSI 300 INDEX', 'USD-CLP RR 25D 3M'), false) AS blocked, "
    "last_value(CASE WHEN l.value = -1 AND s.series IN ('CSI 300 INDEX', 'USD-CLP RR 25D 3M') THEN NULL ELSE l.value END IGNORE NULLS) "
    "OVER (PARTITION BY s.series ORDER BY u.dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS x "
    "FROM (SELECT dt FROM levels UNION SELECT dt FROM target) u CROSS JOIN (SELECT DISTINCT series FROM levels) s "
    "LEFT JOIN levels l ON l.dt = u.dt AND l.series = s.series) g WHERE g.dt IN (SELECT dt FROM target)",
)
cte(
    "innov0", "carried level_ledger target_pos",
    "SELECT dt, pos, series, CASE WHEN rule = 'DIFFERENCE' THEN value - prior WHEN value > 0 AND prior > 0 THEN ln(value / prior) END AS value "
    "FROM (SELECT c.dt, t.pos, c.series, l.rule, c.value, lag(c.value) OVER (PARTITION BY c.series ORDER BY c.dt) AS prior FROM carried c "
    "JOIN level_ledger l ON l.source_label = c.series JOIN target_pos t ON t.dt = c.dt WHERE l.rule <> 'EXCLUDE') q",
)


def innovations(spark, sf, lag=0):
    return D.driver_innovations(levels(spark, sf), level_ledger(spark, sf), target_weeks(spark, sf), lag=lag)


@query(
    "sentinel_mask",
    sql(
        with_("levels"),
        "SELECT panel_id, dt, series, value = -1 AND series IN ('CSI 300 INDEX', 'USD-CLP RR 25D 3M') AS is_sentinel, "
        "CASE WHEN value = -1 AND series IN ('CSI 300 INDEX', 'USD-CLP RR 25D 3M') THEN NULL ELSE value END AS value FROM levels",
        PV + " is_sentinel", num="value",
    ),
)
def sentinel_mask(spark, sf):
    return D.mark_sentinels(levels(spark, sf)).select("panel_id", "dt", "series", "is_sentinel", "value")


@query(
    "limited_carry",
    sql(with_("carried"), "SELECT 'px' AS panel_id, dt, series, value FROM carried WHERE value IS NOT NULL", PV, num="value"),
)
def limited_carry(spark, sf):
    return D.carry_to_target(levels(spark, sf), target_weeks(spark, sf), carry=3)


@query(
    "calendar_union_reindex",
    sql(
        with_("drv_seg_d", "px_brand_d"),
        "SELECT u.dt, s.series, last_value(l.value IGNORE NULLS) OVER (PARTITION BY s.series ORDER BY u.dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS value "
        "FROM (SELECT dt FROM drv_seg_d UNION SELECT dt FROM px_brand_d) u CROSS JOIN (SELECT DISTINCT series FROM drv_seg_d) s "
        "LEFT JOIN drv_seg_d l ON l.dt = u.dt AND l.series = s.series QUALIFY u.dt IN (SELECT dt FROM px_brand_d) AND "
        "last_value(l.value IGNORE NULLS) OVER (PARTITION BY s.series ORDER BY u.dt ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) IS NOT NULL",
        "dt series", num="value",
    ),
)
def calendar_union_reindex(spark, sf):
    target = C.calendar(I.px_brand_d(spark, sf))
    return D.carry_to_target(I.drv_seg_d(spark, sf), target, carry=3).select("dt", "series", "value")


@query(
    "log_or_diff",
    sql(with_("innov0"), "SELECT 'px' AS panel_id, dt, series, value FROM innov0 WHERE value IS NOT NULL", PV, num="value"),
)
def log_or_diff(spark, sf):
    pos = C.positions(target_weeks(spark, sf))
    sampled = D.carry_to_target(levels(spark, sf), target_weeks(spark, sf))
    return D.transform_on_calendar(sampled, level_ledger(spark, sf), pos).select("panel_id", "dt", "series", "value")


LAGGED = "SELECT 'px' AS panel_id, t.dt, i.series, i.value FROM innov0 i JOIN target_pos t ON t.pos = i.pos + 1 WHERE i.value IS NOT NULL"


@query("availability_lag", sql(with_("innov0"), LAGGED.replace("+ 1", "+ 2"), PV, num="value"))
def availability_lag(spark, sf):
    return innovations(spark, sf, lag=2)


@query("driver_innovations", sql(with_("innov0"), LAGGED, PV, num="value"))
def driver_innovations(spark, sf):
    return innovations(spark, sf, lag=1)


@query(
    "calendar_intersection",
    sql(
        with_("px_brand_d", "drv_seg_d"),
        "SELECT DISTINCT a.panel_id, a.dt FROM px_brand_d a JOIN drv_seg_d b ON a.dt = b.dt", "panel_id dt",
    ),
)
def calendar_intersection(spark, sf):
    return A.common_dates(I.px_brand_d(spark, sf), I.drv_seg_d(spark, sf))


cte(
    "act", "px_brand_m drv_nation_m",
    "SELECT dt FROM drv_nation_m WHERE dt IN (SELECT dt FROM px_brand_m) GROUP BY dt "
    "HAVING count(value) / (SELECT count(DISTINCT series) FROM drv_nation_m) >= 0.80",
)
cte(
    "keepx", "act",
    "SELECT series FROM drv_nation_m WHERE dt IN (SELECT dt FROM act) GROUP BY series HAVING count(value) / (SELECT count(*) FROM act) >= 0.98",
)
cte(
    "aligned_dt", "keepx",
    "SELECT dt FROM act WHERE dt IN (SELECT dt FROM drv_nation_m WHERE series IN (SELECT series FROM keepx) GROUP BY dt HAVING count(value) = (SELECT count(*) FROM keepx)) "
    "AND dt IN (SELECT dt FROM px_brand_m GROUP BY dt HAVING count(value) = (SELECT count(DISTINCT series) FROM px_brand_m))",
)


@query(
    "complete_alignment",
    sql(
        with_("aligned_dt"),
        "SELECT 'asset' AS role, dt, series, value FROM px_brand_m WHERE dt IN (SELECT dt FROM aligned_dt) UNION ALL "
        "SELECT 'driver', dt, series, value FROM drv_nation_m WHERE dt IN (SELECT dt FROM aligned_dt) AND series IN (SELECT series FROM keepx)",
        "role dt series", num="value",
    ),
)
def complete_alignment(spark, sf):
    y, x = A.complete_alignment(I.px_brand_m(spark, sf), I.drv_nation_m(spark, sf))
    a = y.select(F.lit("asset").alias("role"), "dt", "series", "value")
    return a.unionByName(x.select(F.lit("driver").alias("role"), "dt", "series", "value"))


def state_level(spark, sf):
    """A market-wide level on order days: average order value of one segment."""
    return I.drv_seg_d(spark, sf).filter(F.col("series") == "BUILDING")


cte("state", "drv_seg_d", "SELECT dt, value FROM drv_seg_d WHERE series = 'BUILDING'")


@query(
    "state_reindex_fill",
    sql(
        with_("state", "px_brand_d"),
        "SELECT dt, coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        "first_value(value IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value "
        "FROM (SELECT d.dt, s.value FROM (SELECT DISTINCT dt FROM px_brand_d) d LEFT JOIN state s ON s.dt = d.dt) q",
        "dt", num="value",
    ),
)
def state_reindex_fill(spark, sf):
    return A.state_on_dates(state_level(spark, sf), C.calendar(I.px_brand_d(spark, sf))).select("dt", "value")


@query(
    "nonoverlap_sum",
    sql(
        with_("assets", "assets_pos"),
        "SELECT horizon, max(dt) AS dt, series, sum(value) AS value FROM (SELECT a.*, h.horizon, (n_dates // h.horizon) - 1 - ((n_dates - 1 - pos) // h.horizon) AS block "
        "FROM assets a JOIN assets_pos p ON p.dt = a.dt CROSS JOIN (VALUES (1), (5)) h(horizon)) q WHERE block >= 0 GROUP BY horizon, block, series",
        "dt series", "horizon", "value",
    ),
)
def nonoverlap_sum(spark, sf):
    return A.nonoverlap_sum(brand_assets(spark, sf), (1, 5)).select("horizon", "dt", "series", "value")


@query(
    "month_end_last",
    sql(
        with_("drv_seg_d"),
        "SELECT last_day(dt) AS dt, series, arg_max(value, dt) AS value FROM drv_seg_d GROUP BY 1, 2", "dt series", num="value",
    ),
)
def month_end_last(spark, sf):
    return A.month_end_last(I.drv_seg_d(spark, sf)).select("dt", "series", "value")


def profile_sql(p):
    return (
        f"SELECT q.series, count(value) AS observations, count(*) FILTER (value <= 0) AS nonpositive_observations, "
        "max(abs(CASE WHEN value > 0 AND near > 0 THEN ln(value / near) END)) AS max_abs_adjacent_log_change, "
        f"(SELECT min(dt) FROM {p}) AS observed_start, (SELECT max(dt) FROM {p}) AS observed_end, "
        f"1 - count(value) / (SELECT count(*) FROM {p}_pos) AS missing_fraction FROM (SELECT a.series, a.value, "
        f"CASE WHEN lag(pos) OVER w = pos - 1 THEN lag(a.value) OVER w END AS near FROM {p} a JOIN {p}_pos c ON a.dt = c.dt "
        "WINDOW w AS (PARTITION BY a.series ORDER BY pos)) q GROUP BY q.series"
    )


cte("level_profile", "levels levels_pos", profile_sql("levels"))


@query(
    "series_profile",
    sql(
        with_("level_profile"), "SELECT * FROM level_profile", "series observed_start observed_end", "observations nonpositive_observations",
        "max_abs_adjacent_log_change missing_fraction",
    ),
)
def series_profile(spark, sf):
    return D.series_profile(levels(spark, sf)).drop("panel_id")


PROVENANCE_SQL = (
    "SELECT 'px' AS panel_id, 'orders' AS source_file, min(o_orderstatus) AS source_vendor, 'o_totalprice' AS source_field, 'at the close' AS availability_timestamp_or_timezone, "
    "'carry up to three rows' AS missing_value_rule, 'rules' AS reviewed_by, CAST(CAST(max(o_orderdate) AS DATE) AS {text}) AS reviewed_on FROM orders"
)


def provenance(spark, sf):
    """Where the levels come from, as a table by panel: the least status and the last day of the orders."""
    o = I.table(spark, sf, "orders")
    return o.agg(F.min("o_orderstatus").alias("source_vendor"), F.to_date(F.max("o_orderdate")).cast("string").alias("reviewed_on")).select(
        F.lit("px").alias("panel_id"), F.lit("orders").alias("source_file"), "source_vendor", F.lit("o_totalprice").alias("source_field"),
        F.lit("at the close").alias("availability_timestamp_or_timezone"), F.lit("carry up to three rows").alias("missing_value_rule"),
        F.lit("rules").alias("reviewed_by"), "reviewed_on",
    )


def documented_ledger(spark, sf):
    return D.driver_ledger(levels(spark, sf), provenance(spark, sf))


cte("provenance", "", PROVENANCE_SQL.format(text="VARCHAR"))
cte(
    "driver_led", "level_profile level_ledger provenance",
    "SELECT p.series AS source_label, economic_class, rule AS suggested_transformation, rule AS approved_transformation, "
    "CASE economic_class WHEN 'option_risk_reversal' THEN 'volatility points' WHEN 'macro_release' THEN 'published level' WHEN 'foreign_exchange' THEN 'exchange-rate level' "
    "WHEN 'swap_rate' THEN 'percentage points' WHEN 'commodity' THEN 'price or index level' ELSE 'index level' END AS unit, v.* EXCLUDE (panel_id), "
    "1 AS availability_lag_trading_days, CASE WHEN p.series IN ('CSI 300 INDEX', 'USD-CLP RR 25D 3M') "
    "THEN 'Exact -1 is a missing-value sentinel; no fill.' ELSE 'No numeric sentinel declared.' END AS sentinel_value_rule, observed_start, observed_end, observations, "
    "missing_fraction, nonpositive_observations, rule <> 'EXCLUDE' AS pilot_eligible, rule <> 'EXCLUDE' AS confirmatory_eligible, "
    "CASE WHEN rule = 'EXCLUDE' THEN 'No vintage and no time of publication is known.' ELSE '' END AS pilot_exclusion_reason, "
    "CASE WHEN rule = 'EXCLUDE' THEN 'No vintage and no time of publication is known.' ELSE '' END AS exclusion_reason "
    "FROM level_profile p JOIN level_ledger l ON l.source_label = p.series CROSS JOIN provenance v",
)


@query(
    "driver_ledger",
    sql(
        with_("driver_led"), "SELECT * FROM driver_led",
        "source_label economic_class suggested_transformation approved_transformation unit source_file source_vendor source_field availability_timestamp_or_timezone "
        "missing_value_rule sentinel_value_rule observed_start observed_end pilot_eligible pilot_exclusion_reason confirmatory_eligible exclusion_reason reviewed_by reviewed_on",
        "availability_lag_trading_days observations nonpositive_observations", "missing_fraction",
    ),
)
def driver_ledger(spark, sf):
    return documented_ledger(spark, sf).drop("panel_id")


PANEL_COUNTS = (
    "source_drivers pilot_eligible_drivers excluded_generic_futures excluded_low_frequency_releases excluded_discontinued_or_truncated confirmatory_eligible_drivers "
    "availability_lag_asset_sessions asset_return_rows_before_driver_intersection common_complete_rows asset_count innovation_missing_cells_common asset_missing_cells_common "
    "nonfinite_innovation_cells_common nonfinite_asset_cells_common"
)


cte(
    "innov1", "innov0 target_pos",
    "SELECT t.dt, i.series, i.value FROM innov0 i JOIN target_pos t ON t.pos = i.pos + 1 WHERE i.value IS NOT NULL",
)
cte(
    "panel_dt", "innov1 px_type_w_ret",
    "SELECT dt FROM (SELECT DISTINCT dt FROM px_type_w_ret) y WHERE dt IN (SELECT dt FROM innov1 GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT series) FROM innov1))",
)


@query(
    "driver_panel_report",
    sql(
        with_("driver_led", "panel_dt"),
        "SELECT 'px' AS panel_id, count(*) AS source_drivers, count(*) FILTER (pilot_eligible) AS pilot_eligible_drivers, count(*) FILTER (economic_class = 'generic_future') AS excluded_generic_futures, "
        "count(*) FILTER (economic_class = 'macro_release') AS excluded_low_frequency_releases, count(*) FILTER (economic_class = 'discontinued_or_truncated_market_series') AS excluded_discontinued_or_truncated, "
        "count(*) FILTER (confirmatory_eligible) AS confirmatory_eligible_drivers, 1 AS availability_lag_asset_sessions, "
        "(SELECT count(DISTINCT dt) FROM px_type_w_ret) AS asset_return_rows_before_driver_intersection, (SELECT count(*) FROM panel_dt) AS common_complete_rows, "
        "(SELECT min(dt) FROM panel_dt) AS common_start, (SELECT max(dt) FROM panel_dt) AS common_end, (SELECT count(DISTINCT series) FROM px_type_w_ret) AS asset_count, "
        "(SELECT count(*) FROM panel_dt) * (SELECT count(DISTINCT series) FROM innov1) - (SELECT count(*) FROM innov1 WHERE dt IN (SELECT dt FROM panel_dt)) AS innovation_missing_cells_common, "
        "(SELECT count(*) FROM panel_dt) * (SELECT count(DISTINCT series) FROM px_type_w_ret) - (SELECT count(*) FROM px_type_w_ret WHERE dt IN (SELECT dt FROM panel_dt)) AS asset_missing_cells_common, "
        "(SELECT count(*) FROM innov1 WHERE NOT isfinite(value) AND dt IN (SELECT dt FROM panel_dt)) AS nonfinite_innovation_cells_common, "
        "(SELECT count(*) FROM px_type_w_ret WHERE NOT isfinite(value) AND dt IN (SELECT dt FROM panel_dt)) AS nonfinite_asset_cells_common, "
        "CASE WHEN (SELECT count(*) FROM panel_dt) > 0 THEN 'PILOT_READY_CONFIRMATORY_PROVENANCE_UNRESOLVED' ELSE 'NO_COMMON_COMPLETE_ROWS' END AS status FROM driver_led",
        "panel_id common_start common_end status", PANEL_COUNTS,
    ),
)
def driver_panel_report(spark, sf):
    return D.driver_panel_report(documented_ledger(spark, sf), type_returns(spark, sf), innovations(spark, sf, lag=1), lag=1)


def audit_sql(p):
    return (
        "SELECT panel_id, (SELECT count(*) FROM POS WHERE POS.panel_id = s.panel_id) AS n_rows, count(*) AS n_columns, min(lo) AS date_min, max(hi) AS date_max, "
        "count(*) FILTER (missing = 0) AS complete_columns, count(*) FILTER (nonpositive > 0) AS nonpositive_columns, "
        "count(*) FILTER (max_log > 0.4) AS columns_with_log_move, count(*) FILTER (max_simple > 0.4) AS columns_with_simple_move, "
        "quantile_cont(missing, 0.5) AS median_missing_fraction, max(missing) AS max_missing_fraction FROM ("
        "SELECT q.panel_id, series, 1 - count(value) / max(n_dates) AS missing, count(*) FILTER (value <= 0) AS nonpositive, "
        "max(abs(CASE WHEN value > 0 AND near > 0 THEN ln(value / near) END)) AS max_log, max(abs(value / nullif(near, 0) - 1)) AS max_simple, "
        "min(q.lo) AS lo, max(q.hi) AS hi FROM (SELECT a.panel_id, a.series, a.value, c.n_dates, min(c.dt) OVER (PARTITION BY a.panel_id) AS lo, "
        "max(c.dt) OVER (PARTITION BY a.panel_id) AS hi, CASE WHEN lag(c.pos) OVER w = c.pos - 1 THEN lag(a.value) OVER w END AS near "
        "FROM SRC a JOIN POS c ON a.panel_id = c.panel_id AND a.dt = c.dt WINDOW w AS (PARTITION BY a.panel_id, a.series ORDER BY c.pos)) q "
        "GROUP BY q.panel_id, series) s GROUP BY panel_id"
    ).replace("POS", f"{p}_pos").replace("SRC", p)


@query(
    "panel_audit",
    sql(
        with_("px_two_pos"), audit_sql("px_two"), "panel_id date_min date_max",
        "n_rows n_columns complete_columns nonpositive_columns columns_with_log_move columns_with_simple_move",
        "median_missing_fraction max_missing_fraction",
    ),
)
def panel_audit(spark, sf):
    return PR.panel_audit(I.px_two(spark, sf))


_DELIVERED = (
    "SELECT o_orderpriority AS panel_id, o_orderkey AS row_no, CASE WHEN o_orderkey % 10 < 9 THEN CAST(o_orderdate AS DATE) END AS dt, CASE WHEN o_orderkey % 10 < 8 THEN o_totalprice END AS price, "
    "CAST(NULL AS DOUBLE) AS void FROM orders UNION ALL SELECT 'sorted', row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey), CAST(o_orderdate AS DATE), o_totalprice, NULL FROM orders"
)


@query(
    "delivered_audit",
    sql(
        f"WITH d AS ({_DELIVERED})",
        "SELECT panel_id, count(*) AS n_rows, 3 AS n_columns, count(*) FILTER (dt IS NULL AND price IS NULL) AS empty_rows, 1 AS empty_columns, min(dt) AS date_min, max(dt) AS date_max, count(dt) AS date_valid_rows, "
        "count(dt) - count(DISTINCT dt) AS duplicate_dates, bool_and(coalesce(before <= dt, true)) AS monotonic_dates FROM (SELECT *, lag(dt IGNORE NULLS) OVER (PARTITION BY panel_id ORDER BY row_no) AS before FROM d) q GROUP BY 1",
        "panel_id date_min date_max monotonic_dates", "n_rows n_columns empty_rows empty_columns date_valid_rows duplicate_dates",
    ),
)
def delivered_audit(spark, sf):
    """Orders as they lie, a table per priority, and once more in date order."""
    o = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("dt"), "o_totalprice", "o_orderpriority")
    rest = F.col("o_orderkey") % 10
    as_is = o.select(
        F.col("o_orderpriority").alias("panel_id"), F.struct(F.lit(None).cast("date").alias("d"), F.col("o_orderkey").alias("k")).alias("row_no"), F.when(rest < 9, F.col("dt")).alias("dt"),
        F.when(rest < 8, F.col("o_totalprice")).alias("price"), F.lit(None).cast("double").alias("void"),
    )
    by_date = o.select(
        F.lit("sorted").alias("panel_id"), F.struct(F.col("dt").alias("d"), F.col("o_orderkey").alias("k")).alias("row_no"), "dt", F.col("o_totalprice").alias("price"),
        F.lit(None).cast("double").alias("void"),
    )
    return PR.delivered_audit(as_is.unionByName(by_date), ["panel_id"], "row_no", "dt")


# ---------------------------------------------------------------- positions and folds

cte("tw", "px_type_w_ret", "SELECT * FROM px_type_w_ret")
add_positions("tw")


def type_returns(spark, sf):
    from foldwise.operators import returns as R

    return R.synchronous_returns(I.px_type_w(spark, sf))


@query("calendar_position", sql(with_("px_two_pos"), "SELECT * FROM px_two_pos", "panel_id dt", "pos n_dates"))
def calendar_position(spark, sf):
    return C.positions(C.calendar(I.px_two(spark, sf)))


def fold_sql(p, segments, step, first, design="x"):
    """Folds with start and end dates per segment, as SQL over positions ``p``."""
    total = sum(n for _, n in segments)
    cols, at = [], 0
    for s, n in segments:
        cols.append(f"(SELECT dt FROM {p} z WHERE z.panel_id = q.panel_id AND z.pos = k * {step} + {at}) AS {s}_start")
        cols.append(f"(SELECT dt FROM {p} z WHERE z.panel_id = q.panel_id AND z.pos = k * {step} + {at + n - 1}) AS {s}_end")
        at += n
    return (
        f"SELECT panel_id, '{design}' AS design, k + {first} AS fold_id, {', '.join(cols)} FROM (SELECT panel_id, unnest(range(0, (max(n_dates) - {total}) // {step} + 1)) AS k "
        f"FROM {p} WHERE n_dates >= {total} GROUP BY panel_id) q"
    )


def span_cols(*segments):
    return " ".join(f"{s}_start {s}_end" for s in segments)


THREE = FD.three_segment(104, 52, 26)


@query(
    "folds_three_segment",
    sql(
        with_("px_two_ret_pos"), fold_sql("px_two_ret_pos", THREE.segments, 26, 1, "three"),
        "panel_id design " + span_cols("selection", "certification", "test"), "fold_id",
    ),
)
def folds_three_segment(spark, sf):
    from foldwise.operators import returns as R

    r = R.synchronous_returns(I.px_two(spark, sf))
    return FD.fold_calendar(C.positions(C.calendar(r)), THREE)


@query(
    "folds_two_segment",
    sql(
        with_("px_two_ret_pos"),
        fold_sql("px_two_ret_pos", [("training", 52), ("test", 26)], 26, 1, "52") + " UNION ALL "
        + fold_sql("px_two_ret_pos", [("training", 104), ("test", 26)], 26, 1, "104"),
        "panel_id design " + span_cols("training", "test"), "fold_id",
    ),
)
def folds_two_segment(spark, sf):
    from foldwise.operators import returns as R

    pos = C.positions(C.calendar(R.synchronous_returns(I.px_two(spark, sf))))
    return FD.fold_calendar(pos, FD.two_segment(52, 26)).unionByName(FD.fold_calendar(pos, FD.two_segment(104, 26)))


@query(
    "rolling_folds_step",
    sql(
        with_("px_two_ret_pos"), fold_sql("px_two_ret_pos", [("training", 52), ("test", 13)], 9, 0, "52"),
        "panel_id design " + span_cols("training", "test"), "fold_id",
    ),
)
def rolling_folds_step(spark, sf):
    from foldwise.operators import returns as R

    pos = C.positions(C.calendar(R.synchronous_returns(I.px_two(spark, sf))))
    return FD.fold_calendar(pos, FD.two_segment(52, 13, step=9, first_id=0))


@query(
    "fold_membership",
    sql(
        with_("tw", "tw_pos", f=fold_sql("tw_pos", [("training", 52), ("test", 26)], 26, 1)),
        "SELECT f.fold_id, CASE WHEN t.dt <= training_end THEN 'training' ELSE 'test' END AS segment, t.series, count(*) AS n, sum(t.value) AS total "
        "FROM tw t JOIN f ON t.dt BETWEEN f.training_start AND f.test_end GROUP BY 1, 2, 3",
        "segment series", "fold_id n", "total",
    ),
)
def fold_membership(spark, sf):
    rows = C.with_positions(type_returns(spark, sf))
    return FD.assign_folds(rows, FD.two_segment(52, 26)).groupBy("fold_id", "segment", "series").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
