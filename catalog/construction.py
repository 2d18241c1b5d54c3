"""Queries: reading, returns reconstruction, drivers, alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.inputs import with_
from catalog.registry import query, sql
import catalog.pieces  # noqa: F401
from foldwise.functions import expr as X
from foldwise.operators import align as A
from foldwise.operators import calendar as C
from foldwise.operators import drivers as D
from foldwise.operators import returns as R
from foldwise.session import checkpoint_dir, materialize
from foldwise.sources import panels as P

# ---------------------------------------------------------------- sources


def ship_wide(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.avg("l_quantity").alias("quantity"), F.avg("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
    )


SHIP_WIDE = (
    "SELECT CAST(l_shipdate AS DATE) AS dt, avg(l_quantity) AS quantity, avg(l_extendedprice) AS price, "
    "avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1"
)


@query(
    "panel_scan_long",
    sql(
        f"WITH w AS ({SHIP_WIDE})",
        "SELECT 'ship' AS panel_id, dt, 'quantity' AS series, quantity AS value FROM w UNION ALL "
        "SELECT 'ship', dt, 'price', price FROM w UNION ALL SELECT 'ship', dt, 'discount', discount FROM w UNION ALL "
        "SELECT 'ship', dt, 'tax', tax FROM w",
        "panel_id dt series", num="value",
    ),
)
def panel_scan_long(spark, sf):
    return P.wide_to_long(ship_wide(spark, sf), "date", "ship")


def even_brands(panel):
    """Universe of the brands with an even number, in number order (a data rule, not a row filter)."""
    k = F.regexp_extract("series", r"(\d+)$", 1).cast("int")
    return panel.select("panel_id", "series").distinct().filter(k % 2 == 0).withColumn("ord", k)


@query(
    "universe_projection",
    sql(
        with_("px_brand_w"),
        "SELECT panel_id, dt, series, CAST(regexp_extract(series, '([0-9]+)$', 1) AS INTEGER) AS ord, value FROM px_brand_w "
        "WHERE CAST(regexp_extract(series, '([0-9]+)$', 1) AS INTEGER) % 2 = 0",
        "panel_id dt series", "ord", "value",
    ),
)
def universe_projection(spark, sf):
    px = I.px_brand_w(spark, sf)
    return P.require_universe(px, even_brands(px)).select("panel_id", "dt", "series", "ord", "value")


@query(
    "mixed_date_parse",
    sql(
        "",
        "SELECT d AS dt, form, count(*) AS n FROM (SELECT o_orderkey % 4 AS form, CASE WHEN o_orderkey % 4 = 3 THEN NULL "
        "ELSE CAST(o_orderdate AS DATE) END AS d FROM orders) q GROUP BY 1, 2",
        "dt", "form n",
    ),
)
def mixed_date_parse(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    d = F.to_date("o_orderdate")
    form = F.col("o_orderkey") % 4
    text = (
        F.when(form == 0, F.date_format(d, "yyyyMMdd"))
        .when(form == 1, F.concat(F.date_format(d, "yyyyMMdd"), F.lit(".0")))
        .when(form == 2, F.date_format(d, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    )
    return o.select(X.parse_mixed_date(text).alias("dt"), form.alias("form")).groupBy("dt", "form").agg(F.count("*").alias("n"))


@query("panel_sink", sql(with_("px_two"), "SELECT * FROM px_two", "panel_id dt series", num="value"))
def panel_sink(spark, sf):
    path = f"{checkpoint_dir(spark)}/panel-sink-{uuid.uuid4().hex}"
    P.write_panel(I.px_two(spark, sf), path)
    return P.read_panel(spark, path).select("panel_id", "dt", "series", "value")


def brand_events(spark, sf):
    return R.price_events(R.synchronous_pairs(materialize(I.px_brand_w(spark, sf))), I.event_ledger(spark))


def brand_assets(spark, sf):
    """Repaired weekly brand returns."""
    return R.adjusted_returns(brand_events(spark, sf))


REPORT = (
    "SELECT 'px' AS panel_id, (SELECT count(DISTINCT dt) FROM px_brand_w) AS source_rows_in_range, "
    "(SELECT count(DISTINCT series) FROM px_brand_w) AS assets, count(DISTINCT dt) AS synchronous_rows, "
    "count(*) FILTER (is_candidate) AS automatic_large_move_candidates, count(rule_status) AS event_audit_rows, "
    "count(*) FILTER (rule_status = 'ADJUSTED_VERIFIED_FACTOR') AS verified_factor_adjustments, "
    "count(*) FILTER (rule_status = 'ADJUSTED_MECHANICAL_SPLIT_CANDIDATE') AS mechanical_split_adjustments, "
    "count(*) FILTER (rule_status = 'UNMATCHED_LARGE_MOVE') AS unmatched_large_candidates, "
    "count(*) FILTER (rule_status = 'RETAINED_VERIFIED_MARKET_MOVE') AS verified_market_moves_retained, "
    "(SELECT count(*) FROM excluded) AS verified_distribution_dates_excluded, "
    "(SELECT count(DISTINCT dt) FROM kept_events) AS retained_return_rows, "
    "(SELECT min(dt) FROM kept_events) AS first_return_date, (SELECT max(dt) FROM kept_events) AS last_return_date, "
    "(SELECT count(*) FROM kept_events WHERE disposition IS NULL AND abs(adjusted_log_return) > 0.4) AS unresolved_post_adjustment_moves, "
    "(SELECT count(DISTINCT dt) FROM px_brand_w) - 1 - count(DISTINCT dt) AS dropped_return_rows_due_to_missing_or_invalid_endpoint, "
    "false AS dividends_included, false AS missing_prices_imputed, false AS return_across_missing_source_observation, true AS survivorship_conditioned_fixed_universe, "
    "(SELECT count(*) FROM excluded) AS dropped_return_rows_due_to_verified_distribution, 'fixed-universe split-adjusted log price returns' AS data_product, "
    "CASE WHEN (SELECT count(*) FROM kept_events WHERE disposition IS NULL AND abs(adjusted_log_return) > 0.4) = 0 "
    "THEN 'READY_FOR_FIXED_UNIVERSE_PRICE_RETURN_ANALYSIS' ELSE 'PROVISIONAL_PENDING_EVENT_REVIEW' END AS publication_status "
    "FROM events"
)


REPORT_TEXT = (
    "panel_id first_return_date last_return_date dividends_included missing_prices_imputed return_across_missing_source_observation "
    "survivorship_conditioned_fixed_universe data_product publication_status"
)
REPORT_COUNTS = (
    "source_rows_in_range assets synchronous_rows automatic_large_move_candidates event_audit_rows "
    "verified_factor_adjustments mechanical_split_adjustments unmatched_large_candidates verified_market_moves_retained "
    "verified_distribution_dates_excluded retained_return_rows unresolved_post_adjustment_moves "
    "dropped_return_rows_due_to_missing_or_invalid_endpoint dropped_return_rows_due_to_verified_distribution"
)
REPORT_WITH = with_("px_brand_w", "events", "excluded", "kept_events")


@query("construction_report", sql(REPORT_WITH, REPORT, REPORT_TEXT, REPORT_COUNTS))
def construction_report(spark, sf):
    px = I.px_brand_w(spark, sf)
    return R.construction_report(px, brand_events(spark, sf))


@query(
    "construction_report_rows",
    sql(
        REPORT_WITH + f", report AS ({REPORT})",
        " UNION ALL ".join(f"SELECT panel_id, '{c}' AS metric, CAST({c} AS VARCHAR) AS value FROM report" for c in (REPORT_TEXT + " " + REPORT_COUNTS).split()[1:]),
        "panel_id metric value",
    ),
)
def construction_report_rows(spark, sf):
    """The report as one row per metric."""
    return R.report_rows(construction_report(spark, sf))


@query("file_manifest_check")
def file_manifest_check(spark, sf):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    expected = spark.createDataFrame([(f"{n}.parquet", None) for n in names + ["absent"]], "name string, sha256 string")
    return P.check_manifest(P.file_digests(spark, sf, "*.parquet"), expected)


# ---------------------------------------------------------------- projections and filters


@query(
    "date_range_slice",
    sql(
        with_("px_brand_w"), "SELECT * FROM px_brand_w WHERE dt BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'",
        "panel_id dt series", num="value",
    ),
)
def date_range_slice(spark, sf):
    return C.date_slice(I.px_brand_w(spark, sf), "1997-01-01", "1999-12-31")


@query(
    "numeric_coerce",
    sql(
        "",
        "SELECT l_returnflag, count(*) AS n, count(x) AS parsed, sum(x) AS total FROM (SELECT l_returnflag, "
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS x FROM lineitem) q GROUP BY 1",
        "l_returnflag", "n parsed", "total",
    ),
)
def numeric_coerce(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_quantity")
    text = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("n/a "), F.col("l_returnflag"))).otherwise(
        F.col("l_quantity").cast("string")
    )
    x = X.numeric_coerce(text)
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count(x).alias("parsed"), F.sum(x).alias("total"))


@query(
    "valid_price_predicate",
    sql(
        "",
        "SELECT nation, count(*) AS n, count(*) FILTER (bal > 0 AND k % 7 <> 0 AND k % 5 <> 0) AS valid FROM ("
        "SELECT c_nationkey AS nation, c_acctbal AS bal, c_custkey AS k FROM customer) q GROUP BY 1",
        "", "nation n valid",
    ),
)
def valid_price_predicate(spark, sf):
    c = I.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    k = F.col("c_custkey")
    price = F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 5 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal"))
    return c.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count("*").alias("n"), F.count_if(X.valid_price(price)).alias("valid")
    )


@query(
    "log_return",
    sql(
        with_("px_brand_d_pairs"),
        "SELECT panel_id, dt, series, ln(price / prior_price) AS value FROM px_brand_d_pairs WHERE price > 0 AND prior_price > 0",
        "panel_id dt series", num="value",
    ),
)
def log_return(spark, sf):
    return R.log_returns(I.px_brand_d(spark, sf))


@query("synchronous_return_filter", sql(with_("px_two_ret"), "SELECT * FROM px_two_ret", "panel_id dt series", num="value"))
def synchronous_return_filter(spark, sf):
    return R.synchronous_returns(I.px_two(spark, sf))


@query(
    "log_to_simple",
    sql(with_("assets"), "SELECT panel_id, dt, series, exp(value) - 1 AS value FROM assets", "panel_id dt series", num="value"),
)
def log_to_simple(spark, sf):
    return R.to_simple(brand_assets(spark, sf))


@query(
    "key_order_guards",
    sql(
        "",
        "SELECT 'duplicate order line' AS guard, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) "
        "UNION ALL SELECT 'duplicate date and brand', count(*) FROM (SELECT CAST(l_shipdate AS DATE) d, p_brand FROM lineitem "
        "JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING count(*) > 1) "
        "UNION ALL SELECT 'unsorted date', count(*) FROM (SELECT CAST(o_orderdate AS DATE) d, lag(CAST(o_orderdate AS DATE)) "
        "OVER (PARTITION BY o_custkey ORDER BY o_orderkey) p FROM orders) WHERE p >= d",
        "guard", "n",
    ),
)
def key_order_guards(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    part = I.table(spark, sf, "part").select("p_partkey", "p_brand")
    dated = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.to_date("l_shipdate").alias("dt"), "p_brand")
    o = I.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("dt"))
    counts = [
        ("duplicate order line", C.duplicate_keys(li, ["l_orderkey", "l_linenumber"])),
        ("duplicate date and brand", C.duplicate_keys(dated, ["dt", "p_brand"])),
        ("unsorted date", C.unsorted_steps(o, ["o_custkey"], "o_orderkey")),
    ]
    out = None
    for name, bad in counts:
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("guard"), "n")
        out = row if out is None else out.unionByName(row)
    return out


LABEL_SQL = (
    "CASE c_custkey % 16 WHEN 0 THEN 'Generic 1st ' || c_mktsegment || ' Future' WHEN 1 THEN 'US Initial Jobless Claims SA' "
    "WHEN 2 THEN 'Russian Ruble SPOT (TOM)' WHEN 3 THEN 'EUR SWAP ANN ' || c_mktsegment WHEN 4 THEN 'UK Gilts 10 Yr' "
    "WHEN 5 THEN c_mktsegment || ' GOVT BND' WHEN 6 THEN 'DB Euro Overnight Rate' WHEN 7 THEN 'USD-CLP RR 25D 3M' "
    "WHEN 8 THEN 'Cboe Volatility Index' WHEN 9 THEN c_mktsegment || ' Peso Spot' WHEN 10 THEN 'DOLLAR INDEX SPOT' "
    "WHEN 11 THEN c_mktsegment || ' INDEX' WHEN 12 THEN 'NIKKEI 225' WHEN 13 THEN 'LME ' || c_mktsegment "
    "WHEN 14 THEN 'Generic 2nd ' || c_mktsegment || ' Future' ELSE c_name END"
)

CLASS_SQL = """
CASE WHEN regexp_matches(label, '^Generic 1st .* Future$') THEN 'generic_future'
 WHEN label IN ('S&P CoreLogic Case-Shiller 20-', 'US Initial Jobless Claims SA') THEN 'macro_release'
 WHEN label IN ('Eonia Capitalization Index 7 D', 'Russian Ruble SPOT (TOM)') THEN 'discontinued_or_truncated_market_series'
 WHEN label LIKE '%EUR SWAP ANN%' THEN 'swap_rate'
 WHEN label IN ('UK Gilts 10 Yr') OR label LIKE '%GOVT BND%' THEN 'sovereign_yield'
 WHEN label = 'DB Euro Overnight Rate' THEN 'money_market_rate'
 WHEN label LIKE '%RR 25D%' THEN 'option_risk_reversal'
 WHEN label = 'Cboe Volatility Index' THEN 'volatility_index'
 WHEN label LIKE '%X-RATE%' OR label LIKE '%Peso Spot%' THEN 'foreign_exchange'
 WHEN label = 'DOLLAR INDEX SPOT' THEN 'currency_index'
 WHEN label LIKE '%INDEX%' OR label IN ('MSCI INDIA', 'NIKKEI 225', 'S&P/BMV IPC') THEN 'equity_index'
 WHEN label LIKE '%Commodity%' OR label LIKE '%Gold Spot%' OR label LIKE '%LME %' THEN 'commodity'
 ELSE 'bond_or_credit_index' END"""
TRANSFORM_SQL = (
    "CASE WHEN economic_class IN ('macro_release', 'discontinued_or_truncated_market_series') THEN 'EXCLUDE' "
    "WHEN economic_class IN ('swap_rate', 'sovereign_yield', 'money_market_rate', 'option_risk_reversal') THEN 'DIFFERENCE' "
    "ELSE 'LOG_DIFFERENCE' END"
)


def customer_labels(spark, sf):
    c = I.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.withColumn("label", F.expr(LABEL_SQL))


@query(
    "driver_classify",
    sql(
        f"WITH l AS (SELECT {LABEL_SQL} AS label FROM customer), c AS (SELECT label, {CLASS_SQL} AS economic_class FROM l)",
        f"SELECT label, economic_class, {TRANSFORM_SQL} AS transformation, ({TRANSFORM_SQL}) <> 'EXCLUDE' AS pilot_eligible, "
        "count(*) AS n FROM c GROUP BY ALL",
        "label economic_class transformation pilot_eligible", "n",
    ),
)
def driver_classify(spark, sf):
    return D.classify_labels(customer_labels(spark, sf), "label").groupBy(
        "label", "economic_class", "transformation", "pilot_eligible"
    ).agg(F.count("*").alias("n"))


FLAG_SQL = (
    "CASE o_orderkey % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'FALSE' WHEN 2 THEN '1' WHEN 3 THEN 'n' WHEN 4 THEN o_orderstatus END"
)


@query(
    "tri_state_bool",
    sql(
        f"WITH t AS (SELECT {FLAG_SQL} AS x FROM orders)",
        "SELECT CASE WHEN lower(trim(x)) IN ('true', 'yes', 'y', '1') THEN true WHEN lower(trim(x)) IN ('false', 'no', 'n', '0') "
        "THEN false END AS flag, count(*) AS n FROM t GROUP BY 1",
        "flag", "n",
    ),
)
def tri_state_bool(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return o.groupBy(X.tri_state_bool(F.expr(FLAG_SQL)).alias("flag")).agg(F.count("*").alias("n"))


@query(
    "split_factor_match",
    sql(
        with_("events_all"),
        "SELECT dt, series, ratio, near_factor, near_err, near_err <= 0.05 AS accepted FROM events_all WHERE is_candidate",
        "dt series accepted", num="ratio near_factor near_err",
    ),
)
def split_factor_match(spark, sf):
    big = R.synchronous_pairs(I.px_brand_w(spark, sf)).filter(F.abs("raw_log") >= 0.5)
    near = X.nearest_split(F.col("ratio"))
    return big.withColumn("near", near).select(
        "dt", "series", "ratio", F.col("near.factor").alias("near_factor"), F.col("near.relative_error").alias("near_err"),
        (F.col("near.relative_error") <= 0.05).alias("accepted"),
    )


AUDIT_SQL = (
    "SELECT panel_id, dt AS date, series AS ticker, prior_dt AS prior_source_date, prior_price, price AS current_price, "
    "ratio AS raw_price_ratio, raw_log AS raw_log_return, matched_split_factor, relative_error, rule_status, verification_status, "
    "coalesce(event_type, '') AS event_type, coalesce(source_url, '') AS source_url, coalesce(rationale, '') AS rationale, "
    "adjusted_log_return, is_candidate FROM events WHERE rule_status IS NOT NULL"
)
AUDIT_KEEP = "panel_id date ticker prior_source_date rule_status verification_status event_type source_url rationale is_candidate"
AUDIT_NUM = "prior_price current_price raw_price_ratio raw_log_return matched_split_factor relative_error adjusted_log_return"


@query("event_disposition", sql(with_("events"), AUDIT_SQL, AUDIT_KEEP, num=AUDIT_NUM))
def event_disposition(spark, sf):
    return R.event_audit(brand_events(spark, sf))


@query("event_subthreshold", sql(with_("events"), AUDIT_SQL + " AND NOT is_candidate", AUDIT_KEEP, num=AUDIT_NUM))
def event_subthreshold(spark, sf):
    return R.event_audit(brand_events(spark, sf)).filter("NOT is_candidate")


@query(
    "unresolved_moves",
    sql(
        with_("kept_events"),
        "SELECT panel_id, dt AS date, series AS ticker, adjusted_log_return, exp(adjusted_log_return) - 1 AS adjusted_simple_return, "
        "'REVIEW_REQUIRED' AS status FROM kept_events WHERE abs(adjusted_log_return) > 0.4 AND disposition IS NULL",
        "panel_id date ticker status", num="adjusted_log_return adjusted_simple_return",
    ),
)
def unresolved_moves(spark, sf):
    return R.unresolved_moves(brand_events(spark, sf))


@query(
    "event_day_sensitivity",
    sql(
        with_("events"),
        "SELECT panel_id, dt, series, adjusted_log_return AS value FROM events WHERE dt NOT IN (SELECT dt FROM events WHERE rule_status "
        "IN ('ADJUSTED_VERIFIED_FACTOR', 'ADJUSTED_MECHANICAL_SPLIT_CANDIDATE', 'EXCLUDED_VERIFIED_DISTRIBUTION_DATE'))",
        "panel_id dt series", num="value",
    ),
)
def event_day_sensitivity(spark, sf):
    return R.without_event_days(brand_events(spark, sf))


@query(
    "ledger_lookup",
    sql(
        with_("px_brand_w_sync", "ledger"),
        "SELECT s.dt, s.series, s.raw_log, l.disposition, l.factor FROM px_brand_w_sync s LEFT JOIN ledger l "
        "ON s.dt = l.dt AND s.series = l.series",
        "dt series disposition", num="raw_log factor",
    ),
)
def ledger_lookup(spark, sf):
    return brand_events(spark, sf).select("dt", "series", "raw_log", "disposition", "factor")


@query("exclude_dates_anti", sql(with_("assets"), "SELECT * FROM assets", "panel_id dt series", num="value"))
def exclude_dates_anti(spark, sf):
    return brand_assets(spark, sf)


@query(
    "union_events",
    sql(
        with_("events"),
        "SELECT rule_status, is_candidate, count(*) AS n, sum(adjusted_log_return) AS total FROM events WHERE rule_status IS NOT NULL GROUP BY 1, 2",
        "rule_status is_candidate", "n", "total",
    ),
)
def union_events(spark, sf):
    audit = R.event_audit(brand_events(spark, sf))
    both = audit.filter("is_candidate").unionByName(audit.filter("NOT is_candidate"))
    return both.groupBy("rule_status", "is_candidate").agg(F.count("*").alias("n"), F.sum("adjusted_log_return").alias("total"))


# ---------------------------------------------------------------- a delivered CSV with broken records

# every 7th day of the year a field too many, every 11th no date, every 13th a word where a number belongs
_DAY = "CAST(strftime(dt, '%j') AS INTEGER)"
CSV_ROWS = (
    "SELECT CAST(o_orderdate AS DATE) AS dt, count(*) AS orders, sum(o_totalprice) AS price, max(o_totalprice) AS top FROM orders GROUP BY 1"
)
_CSV_KIND = f"CASE WHEN {_DAY} % 7 = 0 THEN 'long' WHEN {_DAY} % 11 = 0 THEN 'undated' WHEN {_DAY} % 13 = 0 THEN 'worded' ELSE 'good' END"


def delivered_csv(spark, sf):
    """Daily order totals as gzip CSV files, as they might come in, some records broken."""
    o = I.table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("dt"), "o_totalprice")
    day = F.dayofyear("dt")
    rows = o.groupBy("dt").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("price"), F.max("o_totalprice").alias("top"))
    text = lambda c: F.col(c).cast("string")
    kind = F.when(day % 7 == 0, "long").when(day % 11 == 0, "undated").when(day % 13 == 0, "worded").otherwise("good")
    made = rows.withColumn("kind", kind).select(
        F.when(F.col("kind") == "undated", F.lit("n/a")).otherwise(text("dt")).alias("date"), text("orders").alias("orders"),
        F.when(F.col("kind") == "worded", F.lit("none")).otherwise(text("price")).alias("price"),
        F.when(F.col("kind") == "long", F.concat(text("top"), F.lit(",extra"))).otherwise(text("top")).alias("top"),
    )
    path = f"{checkpoint_dir(spark)}/delivered-{uuid.uuid4().hex}"
    lines = made.select(F.concat_ws(",", "date", "orders", "price", "top").alias("value"))
    # a header in every file, as separate deliveries have
    head = F.lit("date,orders,price,top\n")
    files = lines.withColumn("file", F.pmod(F.xxhash64("value"), F.lit(6))).groupBy("file").agg(F.concat(head, F.array_join(F.collect_list("value"), "\n")).alias("value"))
    files.write.partitionBy("file").option("compression", "gzip").text(path)
    return P.read_wide_checked(spark, f"{path}/*", "date", "orders")


_CSV_CELLS = " UNION ALL ".join(
    f"SELECT 'orders' AS panel_id, dt, '{c}' AS series, {x} AS value FROM w WHERE kind IN ('good', 'worded')"
    for c, x in (("orders", "CAST(orders AS DOUBLE)"), ("price", "CASE WHEN kind = 'worded' THEN NULL ELSE price END"), ("top", "top"))
)


@query("panel_scan_csv", sql(f"WITH w AS (SELECT *, {_CSV_KIND} AS kind FROM ({CSV_ROWS}) q)", _CSV_CELLS, "panel_id dt series", num="value"))
def panel_scan_csv(spark, sf):
    """Gzip CSV files read back permissively; broken records go to panel_scan_rejects."""
    return delivered_csv(spark, sf)[0]


@query(
    "panel_scan_rejects",
    sql(
        f"WITH w AS (SELECT *, {_CSV_KIND} AS kind FROM ({CSV_ROWS}) q)",
        "SELECT CASE kind WHEN 'undated' THEN 'date' WHEN 'worded' THEN 'price' END AS column_name, CASE kind WHEN 'long' THEN 'wrong number of fields' WHEN 'undated' THEN 'not a date' ELSE 'not a number' END AS reason, "
        "count(*) AS records FROM w WHERE kind <> 'good' GROUP BY 1, 2",
        "column_name reason", "records",
    ),
)
def panel_scan_rejects(spark, sf):
    rejects = delivered_csv(spark, sf)[1]
    return rejects.groupBy(F.col("column").alias("column_name"), "reason").agg(F.count("record").alias("records"))


def sink_round_trip(spark, sf, kind):
    path = f"{checkpoint_dir(spark)}/panel-sink-{uuid.uuid4().hex}"
    P.write_panel(I.px_two(spark, sf), path, kind, gzip=True)
    return P.read_panel(spark, path, kind)


@query("panel_sink_csv", sql(with_("px_two"), "SELECT * FROM px_two", "panel_id dt series", num="value"))
def panel_sink_csv(spark, sf):
    """Partitioned gzip CSV, written and read back."""
    return sink_round_trip(spark, sf, "csv")


@query("panel_sink_json", sql(with_("px_two"), "SELECT * FROM px_two", "panel_id dt series", num="value"))
def panel_sink_json(spark, sf):
    """Partitioned gzip JSON lines, written and read back."""
    return sink_round_trip(spark, sf, "json")
