"""Inputs that would give wrong numbers stop the job; no setting drops rows by itself."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import expr
from foldwise.operators import inference, kernels, moments, profile, returns, selection
from foldwise.operators.folds import two_segment
from foldwise.sources import panels


def test_series_names_may_hold_dots(spark):
    wide = spark.createDataFrame([("20200131", "1.5", "x")], "date string, `U.S. Treasury` string, `a b` string")
    rows = {(r.series, r.value) for r in panels.wide_to_long(wide).collect()}
    assert rows == {("U.S. Treasury", 1.5), ("a b", None)}


@pytest.mark.parametrize("text, day", [("2.0200131E7", (2020, 1, 31)), ("20200131.0", (2020, 1, 31)), ("31/12/2020", (2020, 12, 31)), ("3/4/2020", (2020, 3, 4)), ("n/a", None)])
def test_written_dates(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(expr.parse_mixed_date(F.col("t"))).first()[0]
    assert got == (dt.date(*day) if day else None)


def test_dates_held_as_double(spark):
    assert spark.createDataFrame([(20200131.0,)], "t double").select(expr.parse_mixed_date(F.col("t"))).first()[0] == dt.date(2020, 1, 31)


def test_universe_error_names_every_series(spark, panel):
    universe = spark.createDataFrame([("p", f"s{k:02d}", k) for k in range(30)], "panel_id string, series string, ord int")
    with pytest.raises(ValueError, match="30 universe series") as e:
        panels.require_universe(panel({"other": [1.0, 2.0]}), universe)
    assert "s29" in str(e.value)


def ledger(spark, *rows):
    schema = "panel_id string, date date, ticker string, disposition string, factor double, verification_status string, event_type string, source_url string, rationale string"
    return spark.createDataFrame([("p", dt.date(2020, 1, 2), "A", d, f, "", "", "", "") for d, f in rows], schema)


def test_ledger_with_missing_disposition_stops(spark):
    with pytest.raises(ValueError, match="unknown disposition"):
        returns.require_ledger(ledger(spark, (None, None)))


def test_ledger_with_doubled_key_stops(spark):
    with pytest.raises(ValueError, match="duplicate key"):
        returns.require_ledger(ledger(spark, ("KEEP_OBSERVED", None), ("KEEP_OBSERVED", None)))


def test_good_ledger_passes(spark):
    returns.require_ledger(ledger(spark, ("KEEP_OBSERVED", None)))


def test_block_long_gap_stops_the_covariance(spark):
    rng = np.random.default_rng(3)
    rows = [("p", k, i, 2, 60, float(rng.normal())) for k in range(60) for i in range(2) if not (i == 1 and k < 20)]
    df = spark.createDataFrame(rows, "panel_id string, pos int, idx int, n_series int, n_dates int, value double")
    with pytest.raises(Exception, match="window is incomplete"):
        moments.fold_covariance(df, two_segment(40, 20, first_id=0)).collect()


def test_all_assets_by_default(spark):
    index = spark.createDataFrame([("p", "asset", f"a{k}", k, 300) for k in range(300)], "panel_id string, role string, series string, idx int, n_assets int")
    assert selection.even_subset(index, None).count() == 300
    assert selection.even_subset(index, 220).count() == 220


def test_date_column_beyond_the_third(spark):
    wide = spark.createDataFrame([(1, 2, 3, 4, f"2020-01-0{k}") for k in range(1, 9)], "a int, b int, c int, d int, e string")
    assert profile.detect_date_column(wide).first()["date_column"] == "e"


def test_move_from_zero_counts(panel):
    assert profile.panel_audit(panel({"a": [0.0, 5.0, 5.0]})).first()["columns_with_simple_move"] == 1


def test_sign_flip_modes_agree(spark):
    rows = [("f", "c", k, float(v)) for k, v in enumerate([-1.0, -0.5, -0.7, 0.1, -0.4, -0.9, -0.2, -0.6])]
    df = spark.createDataFrame(rows, "family string, comparison string, pos int, diff double").withColumn("n", F.lit(8))
    exact = inference.sign_flip_one_sided(df, ["family"], mode="exact").first()
    drawn = inference.sign_flip_one_sided(df, ["family"], mode="random", draws=20000).first()
    assert exact["patterns"] == 256 and drawn["patterns"] == 20000
    assert abs(exact["p_value"] - drawn["p_value"]) < 0.02


def quadratic_inverse_by_loops(values, n_obs):
    """The estimator's eigenvalues as the paper states them, one sum at a time."""
    p, n = len(values), n_obs - 1
    live = [v for v in values][max(p - n, 0):]
    c = p / n
    h = min(c * c, 1 / (c * c)) ** 0.35 / p**0.35
    out = []
    for x in live:
        a = b = 0.0
        for y in live:
            d = 1 / y - 1 / x
            down = d * d + h * h / (y * y)
            a += (1 / y) * d / down / len(live)
            b += (1 / y) * (h / y) / down / len(live)
        out.append(x / ((1 - c) ** 2 + 2 * c * (1 - c) * a + c * c * (a * a + b * b)) if p <= n else x / (a * a + b * b))
    if p > n:
        out = [1 / ((c - 1) * sum(1 / v for v in live) / len(live))] * (p - n) + out
    scale = sum(max(v, 0) for v in values) / sum(out)
    return [v * scale for v in out]


@pytest.mark.parametrize("n_obs", [8, 40])
def test_quadratic_inverse_equals_the_sums(n_obs):
    x = np.random.default_rng(n_obs).normal(size=(n_obs, 12)) @ np.diag(np.linspace(0.5, 3, 12))
    lam, q = np.linalg.eigh(np.cov(x, rowvar=False))
    got = kernels.quadratic_inverse((lam, q), n_obs)
    want = (q * np.array(quadratic_inverse_by_loops(lam, n_obs))) @ q.T
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_repeated_missing_and_absent_rows_stop_a_plan(panel, planted):
    """The guards ride on the write of the prepared rows."""
    from foldwise.plans import screening as SC

    y, x = planted
    a, d = panel({f"a{j}": y[:, j] for j in range(3)}), panel({f"d{j}": x[:, j] for j in range(2)})
    rows, _ = SC.prepare(a, d)
    assert rows.count() == 120 * 5
    with pytest.raises(ValueError, match="repeated"):
        SC.prepare(a.unionByName(a.limit(1)), d)
    with pytest.raises(ValueError, match="no rows"):
        SC.prepare(a.limit(0), d.limit(0))
    with pytest.raises(ValueError, match="without a value"):
        SC.prepare(a.withColumn("value", F.when(F.col("series") != "a1", F.col("value"))), d)
    with pytest.raises(Exception, match="incomplete"):
        SC.evaluate_representation(a.filter("NOT (series = 'a0' AND dt = '2020-01-10')"), d, train=60, test=20, spectrum=False)[0].collect()


def test_wide_csv_rejects(spark, tmp_path):
    from foldwise.sources import panels as P

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("date,x.y,b\n2020-01-01,1.5,2\n20200102,,3\n2020-01-03,one,4\nnever,1,1\n2020-01-04,1,2,3\n2020-01-05,7\n")
    (tmp_path / "in" / "b.csv").write_text("date,x.y,b\n2020-01-06,-1,1e3\n")
    rows, rejects = P.read_wide_checked(spark, str(tmp_path / "in"), "date", "p")
    got = {(r["dt"].isoformat(), r["series"]): r["value"] for r in rows.collect()}
    assert got == {
        ("2020-01-01", "x.y"): 1.5, ("2020-01-01", "b"): 2, ("2020-01-02", "x.y"): None, ("2020-01-02", "b"): 3, ("2020-01-03", "x.y"): None,
        ("2020-01-03", "b"): 4, ("2020-01-06", "x.y"): -1, ("2020-01-06", "b"): 1000,
    }
    why = sorted((r["column"] or "", r["reason"]) for r in rejects.collect())
    assert why == [("", "wrong number of fields")] * 2 + [("date", "not a date"), ("x.y", "not a number")]


def test_order_of_a_long_table_is_judged_across_ranges(spark):
    from foldwise.operators import profile as PR

    rows = [("up", k, k // 3) for k in range(200)] + [("dip", k, k if k != 150 else 3) for k in range(200)] + [("one", 0, 5), ("gap", 0, 4), ("gap", 1, None), ("gap", 2, 4)]
    df = spark.createDataFrame(rows, "t string, n long, v long")
    for buckets in (1, 17):
        got = {r["t"]: r["sorted"] for r in PR.order_summary(df, ["t"], "n", "v", buckets).collect()}
        assert got == {"up": True, "dip": False, "one": True, "gap": True}


def test_shared_labels_with_hot_lists(spark):
    """Lists cut into pieces of two against all pairs."""
    from foldwise.plans import screening as SC

    rows = [(f"p{p}", l) for p in range(11) for l in range(9) if l == 0 or (p * 7 + l * 3) % 4 == 0] + [("lone", 99)]
    df = spark.createDataFrame(rows, "panel_id string, series long")
    sets = {}
    for p, l in rows:
        sets.setdefault(p, set()).add(l)
    want = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b}
    for width in (2, 256):
        got = {(r["panel_a"], r["panel_b"]): r["shared"] for r in SC.shared_labels(df.toDF("p", "l"), width).collect()}
        assert got == {k: n for k, n in want.items() if n}
    every = {(r[0], r[1]): r[2] for r in SC.jaccard_selected(df).collect()}
    assert every == {k: n / len(sets[k[0]] | sets[k[1]]) for k, n in want.items()}
    assert "CartesianProduct" not in SC.jaccard_selected(df)._jdf.queryExecution().toString()
