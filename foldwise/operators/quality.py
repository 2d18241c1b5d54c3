"""Data-quality gates as aggregates: one pass per table, unknown fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.expr import all_of, is_finite, tri_state_bool

# Ledger columns; gate names and details below are fixed too.
ASSET_COLUMNS = [
    "panel", "source_label", "stable_security_id", "source_vendor", "source_field", "data_type", "corporate_action_adjusted",
    "delisting_return_policy", "confirmatory_eligible", "exclusion_reason",
]
DRIVER_COLUMNS = [
    "source_label", "economic_class", "approved_transformation", "unit", "source_vendor", "source_field",
    "availability_timestamp_or_timezone", "availability_lag_trading_days", "missing_value_rule", "sentinel_value_rule",
    "confirmatory_eligible", "exclusion_reason",
]
DRIVER_METADATA = DRIVER_COLUMNS[1:10]
GATE_SCHEMA = "gate string, passed boolean, detail string"


def missing_columns(df: DataFrame, required) -> list[str]:
    return sorted(set(required) - set(df.columns))


def set_difference(required: DataFrame, present: DataFrame, column: str) -> DataFrame:
    """Values only on one side, with the side they are missing from."""
    r, p = required.select(column).distinct(), present.select(column).distinct()
    lacking = r.exceptAll(p).withColumn("missing_from", F.lit("present"))
    return lacking.unionByName(p.exceptAll(r).withColumn("missing_from", F.lit("required")))


def _filled(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) != ""


def _schema_gate(df: DataFrame, gate: str, required) -> tuple[DataFrame, bool]:
    missing = missing_columns(df, required)
    detail = f"Missing columns: {missing}" if missing else "Complete"
    return df.sparkSession.createDataFrame([(gate, not missing, detail)], GATE_SCHEMA), not missing


def _gate_rows(counts: DataFrame, gates) -> DataFrame:
    """One row of counts to gate rows; ``gates``: (name, applies, passed, detail) columns."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("gate"), applies.alias("applies"), passed.alias("passed"), detail.alias("detail"))
        for n, applies, passed, detail in gates
    ])
    return counts.select(F.explode(rows).alias("g")).filter("g.applies").select("g.gate", "g.passed", "g.detail")


def _verdict(ok: Column, good: str, bad: str) -> Column:
    return F.when(ok, good).otherwise(bad)


def asset_ledger_gates(ledger: DataFrame) -> DataFrame:
    schema, usable = _schema_gate(ledger, "asset_ledger_schema", ASSET_COLUMNS)
    if not usable:
        return schema
    eligible = F.coalesce(tri_state_bool(F.col("confirmatory_eligible")), F.lit(False))
    fails = lambda ok: F.count_if(eligible & ~F.coalesce(ok, F.lit(False)))
    counts = ledger.agg(
        F.count_if(eligible).alias("n"),
        fails(tri_state_bool(F.col("corporate_action_adjusted"))).alias("unadjusted"),
        fails(_filled("stable_security_id")).alias("unmapped"),
        fails(_filled("source_vendor") & _filled("source_field")).alias("unsourced"),
    )
    some = F.col("n") > 0
    rows_text = F.concat(F.col("n").cast("string"), F.lit(" eligible rows"))
    clean = lambda c: F.col(c) == 0
    return schema.unionByName(_gate_rows(counts, [
        ("asset_confirmatory_universe_nonempty", F.lit(True), some, rows_text),
        ("asset_returns_adjusted", some, clean("unadjusted"),
         _verdict(clean("unadjusted"), "All eligible rows verified", "Unverified adjustment status")),
        ("asset_stable_ids", some, clean("unmapped"), _verdict(clean("unmapped"), "All eligible rows mapped", "Stable IDs missing")),
        ("asset_source_provenance", some, clean("unsourced"),
         _verdict(clean("unsourced"), "All eligible rows documented", "Vendor/field missing")),
    ]))


def driver_ledger_gates(ledger: DataFrame) -> DataFrame:
    schema, usable = _schema_gate(ledger, "driver_ledger_schema", DRIVER_COLUMNS)
    if not usable:
        return schema
    status = tri_state_bool(F.col("confirmatory_eligible"))
    eligible = F.coalesce(status, F.lit(False))
    counts = ledger.agg(
        F.count(F.lit(1)).alias("rows"), F.count(status).alias("resolved"), F.count_if(eligible).alias("n"),
        F.count_if(eligible & ~all_of([_filled(c) for c in DRIVER_METADATA])).alias("undocumented"),
    )
    some, whole = F.col("n") > 0, F.col("undocumented") == 0
    text = F.concat(F.col("resolved").cast("string"), F.lit("/"), F.col("rows").cast("string"), F.lit(" rows resolved"))
    return schema.unionByName(_gate_rows(counts, [
        ("driver_eligibility_resolved", F.lit(True), F.col("resolved") == F.col("rows"), text),
        ("driver_confirmatory_universe_nonempty", F.lit(True), some,
         F.concat(F.col("n").cast("string"), F.lit(" eligible rows"))),
        ("driver_point_in_time_metadata_complete", some, whole,
         _verdict(whole, "All eligible rows documented", "Required point-in-time fields missing")),
    ]))


def presence_gates(manifest: DataFrame) -> DataFrame:
    """Gate rows from a manifest check: every expected input must be there."""
    there = F.col("status") != "MISSING"
    return manifest.filter(F.col("status") != "UNLISTED").select(
        F.concat(F.lit("input_present:"), "name").alias("gate"), there.alias("passed"), _verdict(there, "Present", "Missing").alias("detail")
    )


def preflight_decision(gates: DataFrame) -> DataFrame:
    """GO only when every gate passed; no gates at all is a NO-GO."""
    ok = F.coalesce(F.bool_and(F.coalesce("passed", F.lit(False))), F.lit(False))
    return gates.agg(
        _verdict(ok, "GO", "NO-GO").alias("decision"), F.count(F.lit(1)).alias("gates"), F.count_if(~F.col("passed")).alias("failed")
    )


def results_checks(
    results: DataFrame, methods: DataFrame, folds_by_design: dict, *, long_only: bool = False,
    numeric=("predicted_variance", "realized_variance", "qlike", "gross_exposure", "turnover"),
) -> DataFrame:
    """Release gates over a fold-result table (gate, passed, detail)."""
    seen = results.groupBy("design").agg(F.countDistinct("fold_id").alias("n"))
    wanted = results.sparkSession.createDataFrame([(k, v) for k, v in folds_by_design.items()], "design string, want long")
    folds_off = seen.join(wanted, "design", "full_outer").agg(
        F.count_if(~F.coalesce(F.col("n") == F.col("want"), F.lit(False))).alias("bad")
    )
    named = set_difference(methods, results, "method").agg(F.count(F.lit(1)).alias("bad"))
    finite = all_of([F.coalesce(is_finite(F.col(c)), F.lit(False)) for c in numeric])
    values = results.agg(
        F.count_if(~finite).alias("nonfinite metric"),
        F.count_if(~F.coalesce(F.col("predicted_variance") > 0, F.lit(False))).alias("non-positive forecast variance"),
        *([F.count_if(F.abs(F.col("gross_exposure") - 1.0) > 1e-8).alias("gross exposure not one")] if long_only else []),
    )
    parts = values.unpivot([], values.columns, "gate", "bad")
    for name, df in (("method mismatch", named), ("fold mismatch", folds_off)):
        parts = parts.unionByName(df.select(F.lit(name).alias("gate"), "bad"))
    return parts.select("gate", (F.col("bad") == 0).alias("passed"), F.col("bad").cast("string").alias("detail"))


def constraint_gates(results: DataFrame, expected: str) -> DataFrame:
    """Gates over the constraint a result table was made under; long-only books must hold exactly their capital."""
    off = F.count_if(~F.coalesce(F.col("portfolio_constraint") == expected, F.lit(False)))
    parts = results.agg(F.count(F.lit(1)).alias("n"), off.alias("bad")).select(
        F.lit(f"constraint is {expected}").alias("gate"), ((F.col("bad") == 0) & (F.col("n") > 0)).alias("passed"), F.col("bad").cast("string").alias("detail")
    )
    if expected != "long_only":
        return parts
    unheld = F.count_if(~F.coalesce(F.abs(F.col("gross_exposure") - 1.0) <= 1e-8, F.lit(False)))
    return parts.unionByName(results.agg(unheld.alias("bad")).select(
        F.lit("gross exposure not one").alias("gate"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("string").alias("detail")
    ))


def inference_gates(
    inference: DataFrame, families, column: str = "family",
    numeric=("mean_difference", "simultaneous_ci_lower", "simultaneous_ci_upper"),
) -> DataFrame:
    """Release gates over an inference table: every family is there, every named number is finite; no rows fail both."""
    finite = all_of([F.coalesce(is_finite(F.col(c)), F.lit(False)) for c in numeric])
    there = [F.count_if(F.col(column) == f).alias(f"f{k}") for k, f in enumerate(families)]
    counts = inference.agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite).alias("nonfinite"), *there)
    lacking = F.array_join(F.filter(F.array(*[F.when(F.col(f"f{k}") == 0, F.lit(f)) for k, f in enumerate(families)]), lambda x: x.isNotNull()), ", ")
    return _gate_rows(counts.withColumn("lacking", lacking), [
        ("inference families present", F.lit(True), F.col("lacking") == "", F.col("lacking")),
        ("inference values finite", F.lit(True), (F.col("nonfinite") == 0) & (F.col("n") > 0), F.col("nonfinite").cast("string")),
    ])


def improvement_gate(results: DataFrame, delta: str = "delta_s_f") -> DataFrame:
    bad = F.count_if(~F.coalesce(F.col(delta) < 0, F.lit(False)))
    return results.agg(bad.alias("bad")).select(
        F.lit("every fold improves").alias("gate"), (F.col("bad") == 0).alias("passed"), F.col("bad").cast("string").alias("detail")
    )


def panel_validation(panel: DataFrame, sensitivity: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Shape, duplicates, missing and non-finite cells, and where |value| is largest.

    ``sensitivity`` adds the shape of the panel without event days, ``events`` the number of events by
    status as ``STATUS=n`` in the order of the names; panels that have none get zeros and an empty text.
    """
    keys = panel.groupBy("panel_id", "dt", "series").agg(
        F.count(F.lit(1)).alias("copies"), F.count("value").alias("present"),
        F.count_if(F.col("value").isNotNull() & ~is_finite(F.col("value"))).alias("bad"),
        F.max(F.when(is_finite(F.col("value")), F.abs("value"))).alias("size"),
    )
    top = F.max(F.struct("size", "series", "dt"))
    out = keys.groupBy("panel_id").agg(
        F.countDistinct("dt").alias("n_rows"), F.countDistinct("series").alias("n_columns"),
        F.count_if(F.col("present") > 0).alias("cells"), F.count_if(F.col("copies") > 1).alias("duplicate_cells"),
        F.sum("bad").alias("nonfinite_cells"), top.alias("top"),
    ).select(
        "panel_id", "n_rows", "n_columns", "duplicate_cells", "nonfinite_cells",
        (F.col("n_rows") * F.col("n_columns") - F.col("cells")).alias("missing_cells"),
        F.col("top.size").alias("max_abs_value"), F.col("top.series").alias("max_abs_series"), F.col("top.dt").alias("max_abs_date"),
    )
    if sensitivity is not None:
        shape = sensitivity.groupBy("panel_id").agg(F.countDistinct("dt").alias("sensitivity_rows"), F.countDistinct("series").alias("sensitivity_columns"))
        out = out.join(shape, "panel_id", "left").fillna(0, ["sensitivity_rows", "sensitivity_columns"])
    if events is not None:
        each = events.filter("rule_status IS NOT NULL").groupBy("panel_id", "rule_status").agg(F.count(F.lit(1)).alias("n"))
        named = F.concat_ws("=", "rule_status", F.col("n").cast("string"))
        counts = each.groupBy("panel_id").agg(F.array_join(F.sort_array(F.collect_list(named)), ", ").alias("event_status_counts"))
        out = out.join(counts, "panel_id", "left").fillna("", ["event_status_counts"])
    return out


def asset_ledger_template(profile: DataFrame, panel: str, source_file: str) -> DataFrame:
    """Review rows with measured facts and UNKNOWN for what nobody documented."""
    return profile.select(
        F.lit(panel).alias("panel"), F.col("series").alias("source_label"), F.lit("").alias("stable_security_id"),
        F.lit(source_file).alias("source_file"), F.lit("").alias("source_vendor"), F.lit("").alias("source_field"),
        F.lit("raw_price_unverified").alias("data_type"), F.lit("UNKNOWN").alias("corporate_action_adjusted"),
        F.lit("UNKNOWN").alias("delisting_return_policy"), "observed_start", "observed_end", "observations", "missing_fraction",
        "nonpositive_observations", "max_abs_adjacent_log_change", F.lit("UNKNOWN").alias("confirmatory_eligible"),
        F.lit("Adjustment/provenance not yet documented").alias("exclusion_reason"), F.lit("").alias("reviewed_by"),
        F.lit("").alias("reviewed_on"),
    )


def driver_ledger_template(profile: DataFrame, source_file: str) -> DataFrame:
    blank = [
        "economic_class", "approved_transformation", "unit", "source_vendor", "source_field",
        "availability_timestamp_or_timezone", "availability_lag_trading_days", "missing_value_rule", "sentinel_value_rule",
        "reviewed_by", "reviewed_on",
    ]
    return profile.select(
        F.col("series").alias("source_label"), *[F.lit("").alias(c) for c in blank],
        F.lit("REVIEW_REQUIRED").alias("suggested_transformation"), F.lit(source_file).alias("source_file"),
        "observed_start", "observed_end", "observations", "missing_fraction", "nonpositive_observations",
        "max_abs_adjacent_log_change", F.lit("UNKNOWN").alias("confirmatory_eligible"),
        F.lit("Point-in-time metadata not yet documented").alias("exclusion_reason"),
    )
