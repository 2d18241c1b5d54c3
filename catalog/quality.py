"""Queries: gates over ledgers, panels and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.alignment import documented_ledger, levels, provenance
from catalog.construction import brand_assets, brand_events
from catalog.inference import FAMILY, diffs, strategy_results
from catalog.inputs import with_
from catalog.registry import query, sql
from foldwise.operators import drivers as D
from foldwise.operators import inference as IN
from foldwise.operators import profile as PR
from foldwise.operators import quality as Q
from foldwise.operators import returns as R

GATE = "gate passed detail"

# a review ledger laid over the parts: some blank identifiers, some unknown flags
ASSET_FIELDS = {
    "panel": "'B'", "source_label": "p_name",
    "stable_security_id": "CASE WHEN p_partkey % 500 = 3 THEN ' ' ELSE CAST(p_partkey AS {text}) END",
    "source_vendor": "p_brand", "source_field": "p_type", "data_type": "'price'",
    "corporate_action_adjusted": "CASE WHEN p_size > 45 THEN 'UNKNOWN' ELSE 'Yes' END", "delisting_return_policy": "'n/a'",
    "confirmatory_eligible": "CASE WHEN p_size % 3 = 0 THEN 'no' WHEN p_size % 3 = 1 THEN ' TRUE' ELSE '' END",
    "exclusion_reason": "''",
}


def _fields(text):
    return [f"{e.format(text=text)} AS {c}" for c, e in ASSET_FIELDS.items()]


def asset_ledger(spark, sf):
    return I.table(spark, sf, "part").selectExpr(*_fields("STRING"))


ASSET_GATES = (
    "SELECT 'asset_ledger_schema' AS gate, true AS passed, 'Complete' AS detail UNION ALL "
    "SELECT 'asset_confirmatory_universe_nonempty', count(*) > 0, count(*) || ' eligible rows' FROM e UNION ALL "
    "SELECT 'asset_returns_adjusted', bool_and(corporate_action_adjusted = 'Yes'), CASE WHEN bool_and(corporate_action_adjusted = 'Yes') THEN 'All eligible rows verified' ELSE 'Unverified adjustment status' END FROM e UNION ALL "
    "SELECT 'asset_stable_ids', bool_and(trim(stable_security_id) <> ''), CASE WHEN bool_and(trim(stable_security_id) <> '') THEN 'All eligible rows mapped' ELSE 'Stable IDs missing' END FROM e UNION ALL "
    "SELECT 'asset_source_provenance', bool_and(trim(source_vendor) <> '' AND trim(source_field) <> ''), CASE WHEN bool_and(trim(source_vendor) <> '' AND trim(source_field) <> '') THEN 'All eligible rows documented' ELSE 'Vendor/field missing' END FROM e"
)
ASSET_SQL = "SELECT " + ", ".join(_fields("VARCHAR")) + " FROM part"
ASSET_WITH = f"WITH l AS ({ASSET_SQL}), e AS (SELECT * FROM l WHERE lower(trim(confirmatory_eligible)) IN ('true', 'yes', 'y', '1'))"


@query("asset_ledger_gates", sql(ASSET_WITH, ASSET_GATES, GATE))
def asset_ledger_gates(spark, sf):
    return Q.asset_ledger_gates(asset_ledger(spark, sf))


@query(
    "driver_ledger_gates",
    sql(
        with_("level_ledger"),
        "SELECT 'driver_ledger_schema' AS gate, true AS passed, 'Complete' AS detail UNION ALL "
        "SELECT 'driver_eligibility_resolved', true, count(*) || '/' || count(*) || ' rows resolved' FROM level_ledger UNION ALL "
        "SELECT 'driver_confirmatory_universe_nonempty', count(*) > 0, count(*) || ' eligible rows' FROM level_ledger WHERE rule <> 'EXCLUDE' UNION ALL "
        "SELECT 'driver_point_in_time_metadata_complete', true, 'All eligible rows documented'",
        GATE,
    ),
)
def driver_ledger_gates(spark, sf):
    return Q.driver_ledger_gates(documented_ledger(spark, sf))


@query(
    "driver_ledger_gates_undocumented",
    sql(
        with_("level_ledger"),
        "SELECT 'driver_ledger_schema' AS gate, true AS passed, 'Complete' AS detail UNION ALL "
        "SELECT 'driver_eligibility_resolved', true, count(*) || '/' || count(*) || ' rows resolved' FROM level_ledger UNION ALL "
        "SELECT 'driver_confirmatory_universe_nonempty', count(*) > 0, count(*) || ' eligible rows' FROM level_ledger WHERE rule <> 'EXCLUDE' UNION ALL "
        "SELECT 'driver_point_in_time_metadata_complete', false, 'Required point-in-time fields missing'",
        GATE,
    ),
)
def driver_ledger_gates_undocumented(spark, sf):
    """A source whose field nobody wrote down does not pass."""
    return Q.driver_ledger_gates(D.driver_ledger(levels(spark, sf), provenance(spark, sf).drop("source_field")))


@query(
    "preflight_decision",
    sql(
        ASSET_WITH + f", g AS ({ASSET_GATES})",
        "SELECT CASE WHEN bool_and(passed) THEN 'GO' ELSE 'NO-GO' END AS decision, count(*) AS gates, count(*) FILTER (NOT passed) AS failed FROM g",
        "decision", "gates failed",
    ),
)
def preflight_decision(spark, sf):
    return Q.preflight_decision(Q.asset_ledger_gates(asset_ledger(spark, sf)))


LED = (
    "SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS ticker, CASE l_returnflag WHEN 'A' THEN 'APPLY_FACTOR' WHEN 'N' THEN 'KEEP_OBSERVED' ELSE 'RETURNED' END AS disposition, l_tax AS factor FROM lineitem JOIN part ON l_partkey = p_partkey"
)


@query(
    "event_ledger_checks",
    sql(
        f"WITH l AS ({LED})",
        "SELECT 'unknown disposition' AS problem, count(*) AS n FROM l WHERE disposition = 'RETURNED' HAVING count(*) > 0 UNION ALL "
        "SELECT 'factor not positive', count(*) FROM l WHERE disposition = 'APPLY_FACTOR' AND NOT coalesce(factor > 0, false) HAVING count(*) > 0 UNION ALL "
        "SELECT 'duplicate key', count(*) FROM (SELECT 1 FROM l GROUP BY date, ticker HAVING count(*) > 1) q HAVING count(*) > 0",
        "problem", "n",
    ),
)
def event_ledger_checks(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_returnflag", "l_tax")
    part = I.table(spark, sf, "part").select("p_partkey", "p_brand")
    flag = F.col("l_returnflag")
    led = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("ticker"),
        F.when(flag == "A", R.APPLY).when(flag == "N", R.KEEP).otherwise("RETURNED").alias("disposition"),
        F.col("l_tax").alias("factor"), *[F.lit("").alias(c) for c in R.LEDGER_COLUMNS[4:]],
    )
    return R.ledger_problems(led)


@query(
    "results_release_checks",
    sql(
        with_("strat", "psum"),
        "SELECT 'nonfinite metric' AS gate, count(*) = 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM strat WHERE NOT (isfinite(predicted_variance) AND isfinite(realized_variance) AND isfinite(qlike)) UNION ALL "
        "SELECT 'non-positive forecast variance', count(*) = 0, CAST(count(*) AS VARCHAR) FROM strat WHERE NOT predicted_variance > 0 UNION ALL "
        "SELECT 'method mismatch', count(*) = 0, CAST(count(*) AS VARCHAR) FROM ((SELECT p_type FROM part EXCEPT SELECT method FROM strat) UNION ALL (SELECT method FROM strat EXCEPT SELECT p_type FROM part)) q UNION ALL "
        "SELECT 'fold mismatch', count(*) = 0, CAST(count(*) AS VARCHAR) FROM (SELECT design, count(DISTINCT fold_id) AS n FROM strat GROUP BY 1) q WHERE n <> CASE design WHEN '52' THEN 11 ELSE 9 END UNION ALL "
        "SELECT 'every fold improves', count(*) = 0, CAST(count(*) AS VARCHAR) FROM strat WHERE NOT realized_variance - predicted_variance < 0 UNION ALL "
        "SELECT 'inference families present', count(*) = 0, coalesce(string_agg(f, ', ' ORDER BY f), '') FROM (VALUES ('104'), ('52'), ('none')) v(f) WHERE f NOT IN (SELECT design FROM psum) UNION ALL "
        "SELECT 'inference values finite', count(*) FILTER (NOT (isfinite(mean_difference) AND isfinite(standard_error))) = 0 AND count(*) > 0, "
        "CAST(count(*) FILTER (NOT (isfinite(mean_difference) AND isfinite(standard_error))) AS VARCHAR) FROM psum",
        GATE,
    ),
)
def results_release_checks(spark, sf):
    r = strategy_results(spark, sf)
    names = I.table(spark, sf, "part").select(F.col("p_type").alias("method"))
    checks = Q.results_checks(r, names, {"52": 11, "104": 9}, numeric=("predicted_variance", "realized_variance", "qlike"))
    tested = IN.paired_summary(diffs(spark, sf), FAMILY)
    checks = checks.unionByName(Q.inference_gates(tested, ["104", "52", "none"], "design", ("mean_difference", "standard_error")))
    return checks.unionByName(Q.improvement_gate(r.withColumn("d", F.col("realized_variance") - F.col("predicted_variance")), "d"))


QUIET = (
    "SELECT dt, series FROM events WHERE dt NOT IN (SELECT dt FROM events WHERE rule_status "
    "IN ('ADJUSTED_VERIFIED_FACTOR', 'ADJUSTED_MECHANICAL_SPLIT_CANDIDATE', 'EXCLUDED_VERIFIED_DISTRIBUTION_DATE'))"
)


@query(
    "panel_validation",
    sql(
        with_("assets", quiet=QUIET),
        "SELECT count(DISTINCT dt) AS n_rows, count(DISTINCT series) AS n_columns, 0 AS duplicate_cells, 0 AS nonfinite_cells, count(DISTINCT dt) * count(DISTINCT series) - count(*) AS missing_cells, "
        "max(abs(value)) AS max_abs_value, arg_max(series, abs(value)) AS max_abs_series, arg_max(dt, abs(value)) AS max_abs_date, "
        "(SELECT count(DISTINCT dt) FROM quiet) AS sensitivity_rows, (SELECT count(DISTINCT series) FROM quiet) AS sensitivity_columns, "
        "(SELECT coalesce(string_agg(rule_status || '=' || n, ', ' ORDER BY rule_status), '') FROM (SELECT rule_status, count(*) AS n FROM events WHERE rule_status IS NOT NULL GROUP BY 1) q) AS event_status_counts FROM assets",
        "max_abs_series max_abs_date event_status_counts", "n_rows n_columns duplicate_cells nonfinite_cells missing_cells sensitivity_rows sensitivity_columns", "max_abs_value",
    ),
)
def panel_validation(spark, sf):
    events = brand_events(spark, sf)
    return Q.panel_validation(brand_assets(spark, sf), R.without_event_days(events), events).drop("panel_id")


@query(
    "date_column_detect",
    sql("", "SELECT 'order_date' AS date_column, count(*) AS date_valid_rows, count(*) AS n_rows FROM orders", "date_column", "date_valid_rows n_rows"),
)
def date_column_detect(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    d = F.to_date("o_orderdate")
    wide = o.select(
        F.col("o_orderkey").alias("order_no"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy-MM-dd")).otherwise("n/a").alias("update_time"),
        F.date_format(d, "yyyyMMdd").cast("long").alias("order_date"), F.col("o_totalprice").alias("total"),
    )
    return PR.detect_date_column(wide)


PROFILE = "observed_start, observed_end, observations, missing_fraction, nonpositive_observations, max_abs_adjacent_log_change"


def _template(fixed):
    """Check SQL of a template: fixed texts, then the measured profile."""
    texts = ", ".join(f"'{v}' AS {c}" for c, v in fixed.items())
    return sql(
        with_("level_profile"), f"SELECT series AS source_label, {texts}, {PROFILE} FROM level_profile",
        "source_label observed_start observed_end " + " ".join(fixed), "observations nonpositive_observations", "missing_fraction max_abs_adjacent_log_change",
    )


@query(
    "ledger_template",
    _template({
        "panel": "A", "stable_security_id": "", "source_file": "levels", "source_vendor": "", "source_field": "", "data_type": "raw_price_unverified",
        "corporate_action_adjusted": "UNKNOWN", "delisting_return_policy": "UNKNOWN", "confirmatory_eligible": "UNKNOWN",
        "exclusion_reason": "Adjustment/provenance not yet documented", "reviewed_by": "", "reviewed_on": "",
    }),
)
def ledger_template(spark, sf):
    return Q.asset_ledger_template(D.series_profile(levels(spark, sf)), "A", "levels")


@query(
    "driver_ledger_template",
    _template({
        "economic_class": "", "suggested_transformation": "REVIEW_REQUIRED", "approved_transformation": "", "unit": "", "source_file": "levels", "source_vendor": "",
        "source_field": "", "availability_timestamp_or_timezone": "", "availability_lag_trading_days": "", "missing_value_rule": "", "sentinel_value_rule": "",
        "confirmatory_eligible": "UNKNOWN", "exclusion_reason": "Point-in-time metadata not yet documented", "reviewed_by": "", "reviewed_on": "",
    }),
)
def driver_ledger_template(spark, sf):
    return Q.driver_ledger_template(D.series_profile(levels(spark, sf)), "levels")


@query(
    "schema_difference",
    sql(
        "",
        "SELECT k AS custkey, 'present' AS missing_from FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) a UNION ALL "
        "SELECT k, 'required' FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer) b",
        "missing_from", "custkey",
    ),
)
def schema_difference(spark, sf):
    """Required keys that are absent and present keys nobody required (customers with and without orders)."""
    required = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    return Q.set_difference(required, I.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), "custkey")
