import math

import pytest

from conftest import day
from foldwise.operators import calendar as C
from foldwise.operators import drivers as D


def innovations(levels, **options):
    led = D.driver_ledger(levels)
    out = D.driver_innovations(levels, led, C.calendar(levels), **options)
    return {(r["dt"], r["series"]): r["value"] for r in out.collect()}


def test_sentinel_and_lag(panel):
    z = innovations(panel({"CSI 300 INDEX": [100, -1, 102, 104, 108]}), lag=1)
    assert (day(2), "CSI 300 INDEX") not in z
    assert z[day(4), "CSI 300 INDEX"] == pytest.approx(math.log(104 / 102))


def test_holiday_gap_is_carried_before_the_difference(panel):
    z = innovations(panel({"DAX INDEX": [100, None, 102, 103, 104], "OTHER INDEX": [1, 1, 1, 1, 1]}), lag=0)
    assert z[day(1), "DAX INDEX"] == pytest.approx(0.0)
    assert z[day(2), "DAX INDEX"] == pytest.approx(math.log(102 / 100))


def test_carry_stops_after_the_limit(panel):
    levels = panel({"A": [1, None, None, None, None, None], "B": [1, 1, 1, 1, 1, 1]})
    got = D.carry_to_target(levels, C.calendar(levels), carry=3).filter("series = 'A'")
    assert sorted(r["dt"] for r in got.collect()) == [day(k) for k in range(4)]


def test_difference_rule_and_excluded_series(panel):
    z = innovations(panel({"UK Gilts 10 Yr": [-1, 2, 4], "US Initial Jobless Claims SA": [1, 2, 3]}), lag=0)
    assert z == {(day(1), "UK Gilts 10 Yr"): 3.0, (day(2), "UK Gilts 10 Yr"): 2.0}


def test_negative_settings_are_refused(panel):
    levels = panel({"A": [1, 2]})
    with pytest.raises(ValueError):
        D.carry_to_target(levels, C.calendar(levels), carry=-1)
    with pytest.raises(ValueError):
        innovations(levels, lag=-1)


@pytest.mark.parametrize("label,cls,rule", [
    ("Generic 1st Corn Future", "generic_future", "LOG_DIFFERENCE"), ("DOLLAR INDEX SPOT", "currency_index", "LOG_DIFFERENCE"),
    ("DB Euro Overnight Rate", "money_market_rate", "DIFFERENCE"), ("Gold Spot   $/Oz", "commodity", "LOG_DIFFERENCE"),
    ("U.S. Treasury", "bond_or_credit_index", "LOG_DIFFERENCE"), ("Russian Ruble SPOT (TOM)", "discontinued_or_truncated_market_series", "EXCLUDE"),
])
def test_classes(spark, label, cls, rule):
    r = D.classify_labels(spark.createDataFrame([(label,)], "source_label string")).first()
    assert (r["economic_class"], r["transformation"]) == (cls, rule)
