import math

import pytest

from conftest import day
from foldwise.operators import returns as R
from foldwise.sources import panels as P

LEDGER = "panel_id string, date date, ticker string, disposition string, factor double, verification_status string, event_type string, source_url string, rationale string"


def ledger(spark, *rows):
    return spark.createDataFrame([("p", day(k), t, d, f, "V", "e", "u", "r") for k, t, d, f in rows], LEDGER)


def events(spark, prices, *rows):
    return R.price_events(R.synchronous_pairs(prices), ledger(spark, *rows))


def values(df):
    return {(r["dt"], r["series"]): r["value"] for r in df.collect()}


def test_gap_is_not_bridged(spark, panel):
    px = panel({"AAA": [100, 102, 25.5, 26, 26.5, 27], "BBB": [50, 51, None, 52, 53, 54]})
    assert sorted({d for d, _ in values(R.synchronous_returns(px))}) == [day(1), day(4), day(5)]


def test_mechanical_split_gives_zero_return(spark, panel):
    e = events(spark, panel({"AAA": [100, 102, 25.5, 26]}))
    assert values(R.adjusted_returns(e))[day(2), "AAA"] == pytest.approx(0.0)


def test_verified_factor_below_threshold_is_applied_and_audited(spark, panel):
    e = events(spark, panel({"AAA": [100, 66, 67]}), (1, "AAA", "APPLY_FACTOR", 2 / 3))
    assert values(R.adjusted_returns(e))[day(1), "AAA"] == pytest.approx(math.log(0.66 / (2 / 3)))
    audit = R.event_audit(e).collect()
    assert [(r["rule_status"], r["is_candidate"]) for r in audit] == [("ADJUSTED_VERIFIED_FACTOR", False)]


def test_distribution_removes_the_date(spark, panel):
    e = events(spark, panel({"AAA": [100, 50.5, 51], "BBB": [10, 10, 11]}), (1, "AAA", "EXCLUDE_DATE", None))
    assert {d for d, _ in values(R.adjusted_returns(e))} == {day(2)}
    assert R.unresolved_moves(e).count() == 0


def test_kept_market_move(spark, panel):
    e = events(spark, panel({"AAA": [100, 200, 201]}), (1, "AAA", "KEEP_OBSERVED", None))
    assert values(R.adjusted_returns(e))[day(1), "AAA"] == pytest.approx(math.log(2))
    assert R.unresolved_moves(e).count() == 0


def test_unmatched_move_needs_review(spark, panel):
    e = events(spark, panel({"AAA": [100, 170, 171]}))
    assert [r["status"] for r in R.unresolved_moves(e).collect()] == ["REVIEW_REQUIRED"]


def test_ledger_problems(spark):
    bad = ledger(spark, (1, "A", "APPLY_FACTOR", 0.0), (1, "A", "NONSENSE", None))
    assert {r["problem"] for r in R.ledger_problems(bad).collect()} == {"unknown disposition", "factor not positive", "duplicate key"}
    assert R.ledger_problems(bad.drop("factor")).count() == 1


def test_wide_csv_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("20200101", "1.5", "n/a"), ("2020-01-02", "2", "3")], "date string, A string, B string")
    P.write_csv(wide, str(tmp_path / "w"), gzip=True)
    long = P.read_wide_csv(spark, str(tmp_path / "w"))
    assert values(long) == {(day(0), "A"): 1.5, (day(0), "B"): None, (day(1), "A"): 2.0, (day(1), "B"): 3.0}


def test_date_with_no_price_at_all_is_not_bridged(spark):
    wide = spark.createDataFrame([("2020-01-01", "1"), ("2020-01-02", None), ("2020-01-03", "2"), ("2020-01-04", "4")], "date string, A string")
    assert values(R.synchronous_returns(P.wide_to_long(wide))) == {(day(3), "A"): pytest.approx(math.log(2))}


def test_universe_keeps_the_calendar_of_all_rows(spark, panel):
    px = panel({"A": [1, None, 2, 4], "B": [1, 1, 1, None]})
    universe = spark.createDataFrame([("p", "A")], "panel_id string, series string")
    assert values(R.synchronous_returns(px, universe)) == {(day(3), "A"): pytest.approx(math.log(2))}
