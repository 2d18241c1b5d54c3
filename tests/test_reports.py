"""Ledgers with a caller's provenance, reports, and release gates, against hand-counted fixtures."""

import pytest

from conftest import day
from foldwise.operators import drivers as D
from foldwise.operators import quality as Q
from foldwise.plans import backtest as B


@pytest.fixture
def ledger(panel):
    return D.driver_ledger(panel({"DAX INDEX": [1, 2, 3], "US Initial Jobless Claims SA": [1, 2, 3], "CLA Comdty 1": [4, 5, 6]}))


def test_provenance_comes_from_the_caller(spark, panel):
    levels = panel({"DAX INDEX": [1, 2, 3]})
    blank = D.driver_ledger(levels).first()
    assert [blank[c] for c in D.PROVENANCE] == [""] * 7 and blank["availability_lag_trading_days"] == 1
    given = spark.createDataFrame([(blank["panel_id"], "maker", None), ("other", "x", "y")], "panel_id string, source_vendor string, reviewed_by string")
    row = D.driver_ledger(levels, given, lag=2).first()
    assert (row["source_vendor"], row["reviewed_by"], row["source_field"], row["availability_lag_trading_days"]) == ("maker", "", "", 2)
    with pytest.raises(Exception, match="two provenance rows"):
        D.driver_ledger(levels, given.unionByName(given)).collect()
    with pytest.raises(ValueError):
        D.driver_ledger(levels, lag=-1)


def test_undocumented_ledgers_do_not_pass(ledger):
    gates = {r["gate"]: r["passed"] for r in Q.driver_ledger_gates(ledger).collect()}
    assert not gates["driver_point_in_time_metadata_complete"] and gates["driver_eligibility_resolved"]


def test_driver_panel_report_counts_by_hand(panel, ledger):
    assets = panel({"a": [1, 2, 3, float("nan")], "b": [1, 2, None, 4]})
    moves = panel({"x": [None, 1, 2, 3], "y": [1, 1, float("inf"), None]})
    r = D.driver_panel_report(ledger, assets, moves, lag=2).first()
    assert (r["source_drivers"], r["pilot_eligible_drivers"], r["excluded_low_frequency_releases"]) == (3, 2, 1)
    assert (r["asset_return_rows_before_driver_intersection"], r["common_complete_rows"]) == (4, 2)
    assert (r["common_start"], r["common_end"], r["asset_count"]) == (day(1), day(2), 2)
    assert (r["asset_missing_cells_common"], r["innovation_missing_cells_common"]) == (1, 0)
    assert (r["nonfinite_innovation_cells_common"], r["nonfinite_asset_cells_common"], r["availability_lag_asset_sessions"]) == (1, 0, 2)


def test_driver_panel_report_without_common_dates(panel, ledger):
    assets = panel({"a": [1, 2]})
    r = D.driver_panel_report(ledger, assets, assets.filter("false")).first()
    assert (r["common_complete_rows"], r["common_start"], r["status"]) == (0, None, "NO_COMMON_COMPLETE_ROWS")
    r = D.driver_panel_report(ledger, assets.filter("false"), assets).first()
    assert (r["asset_count"], r["common_complete_rows"], r["asset_missing_cells_common"]) == (0, 0, 0)


def results(spark, rows):
    return spark.createDataFrame(rows, "panel_id string, design string, fold_id long, method string, portfolio_constraint string, gross_exposure double")


def test_backtest_report(spark, panel):
    y = panel({"a": [1, 2, 3], "b": [1, 2, 3]})
    name = y.first()["panel_id"]
    rows = [(name, d, f, m, "free", 1.0) for d, n in (("52", 3), ("104", 1)) for f in range(n) for m in ("z", "a")]
    r = B.backtest_report(y, results(spark, rows)).first()
    assert (r["common_dates"], r["first_date"], r["last_date"], r["assets"]) == (3, day(0), day(2), 2)
    assert (r["estimators"], r["folds_by_training_design"]) == ("a, z", "52=3, 104=1")


def test_constraint_gates(spark):
    good = [("p", "52", 0, "a", "long_only", 1.0), ("p", "52", 1, "a", "long_only", 1.0 + 1e-10)]
    verdicts = lambda rows, name="long_only": [r["passed"] for r in Q.constraint_gates(results(spark, rows), name).collect()]
    assert verdicts(good) == [True, True]
    assert verdicts([*good, ("p", "52", 2, "a", "long_only", 1.1)]) == [True, False]
    assert verdicts([*good, ("p", "52", 2, "a", "long_only", None)]) == [True, False]
    assert verdicts(good, "unconstrained") == [False]
    assert verdicts([], "unconstrained") == [False]


def test_inference_gates(spark):
    rows = [("f", 0.1, 0.0, 0.2), ("g", 0.1, 0.0, 0.2)]
    frame = lambda rows: spark.createDataFrame(rows, "family string, mean_difference double, simultaneous_ci_lower double, simultaneous_ci_upper double")
    verdicts = lambda rows: [(r["passed"], r["detail"]) for r in Q.inference_gates(frame(rows), ["f", "g", "h"][:2]).collect()]
    assert verdicts(rows) == [(True, ""), (True, "0")]
    assert verdicts(rows[:1]) == [(False, "g"), (True, "0")]
    assert verdicts([*rows, ("f", float("nan"), None, 1.0)]) == [(True, ""), (False, "1")]
    assert verdicts([]) == [(False, "f, g"), (False, "0")]


def test_validation_counts_events_and_the_quiet_panel(spark, panel):
    y = panel({"a": [1, 2, -5], "b": [1, None, 3]})
    name = y.first()["panel_id"]
    events = spark.createDataFrame([(name, "X"), (name, "A"), (name, "X"), (name, None)], "panel_id string, rule_status string")
    r = Q.panel_validation(y, y.filter(f"dt <> date'{day(0)}'"), events).first()
    assert (r["n_rows"], r["n_columns"], r["missing_cells"], r["max_abs_series"]) == (3, 2, 1, "a")
    assert (r["sensitivity_rows"], r["sensitivity_columns"], r["event_status_counts"]) == (2, 2, "A=1, X=2")
    none = Q.panel_validation(y, y.filter("false"), events.filter("false")).first()
    assert (none["sensitivity_rows"], none["event_status_counts"]) == (0, "")
