import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import day
from foldwise.operators import align as A
from foldwise.operators import calendar as C
from foldwise.operators import folds as FD
from foldwise.operators import moments as M


def dates(spark, n):
    return C.positions(spark.createDataFrame([("p", day(k)) for k in range(n)], "panel_id string, dt date"))


def test_rolling_fold_count_and_order(spark):
    f = FD.fold_calendar(dates(spark, 20), FD.two_segment(8, 4)).orderBy("fold_id").collect()
    assert len(f) == 3
    assert all(r["training_end"] < r["test_start"] for r in f)
    assert all(a["test_end"] < b["test_start"] for a, b in zip(f, f[1:]))


def test_too_short_calendar_has_no_folds(spark):
    assert FD.fold_spans(dates(spark, 11), FD.two_segment(8, 4)).count() == 0


def test_lengths_must_be_positive():
    with pytest.raises(ValueError):
        FD.two_segment(0, 4)


def test_assignment_matches_spans(spark):
    d = FD.Design("x", [("training", 7), ("test", 3)], step=2)
    pos = dates(spark, 23)
    got = {(r["fold_id"], r["segment"], r["pos"]) for r in FD.assign_folds(pos, d).collect()}
    want = {
        (r["fold_id"], r["segment"], p) for r in FD.fold_spans(pos, d).collect() for p in range(r["pos_lo"], r["pos_hi"] + 1)
    }
    assert got == want


def test_block_sums_end_on_the_last_date(panel):
    p = panel({"a": [0, 2, 4, 6, 8, 10, 12], "b": [1, 3, 5, 7, 9, 11, 13]})
    got = {(r["dt"], r["series"]): r["value"] for r in A.nonoverlap_sum(p, [2]).collect()}
    assert got == {(day(2), "a"): 6, (day(4), "a"): 14, (day(6), "a"): 22, (day(2), "b"): 8, (day(4), "b"): 16, (day(6), "b"): 24}


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_fold_covariance_equals_numpy_for_any_tiling(panel, planted, tile):
    y, _ = planted
    rows = M.indexed(panel({f"s{j}": y[:, j] for j in range(6)}))
    d = FD.two_segment(40, 20)
    cov = M.fold_covariance(rows, d, tile=tile).collect()
    assert len(cov) == 4 * 21
    for r in cov:
        lo = (r["fold_id"] - 1) * 20
        assert r["v"] == pytest.approx(np.cov(y[lo:lo + 40, r["i"]], y[lo:lo + 40, r["j"]])[0, 1], abs=1e-12)


@pytest.mark.parametrize("tile", [2, 256])
def test_scores_do_not_depend_on_tiles_or_partitions(panel, planted, tile):
    y, _ = planted
    p = panel({f"s{j}": y[:, j] for j in range(6)}).repartition(5).orderBy(F.rand(3))
    rows = FD.assign_folds(M.indexed(p), FD.two_segment(100, 20))
    got = {r["segment"]: r for r in M.offdiag_scores(rows, [*M.KEYS, "segment"], tile=tile).collect()}
    r = np.corrcoef(y[:100], rowvar=False)
    off = r[np.triu_indices(6, 1)]
    assert got["training"]["s_f"] == pytest.approx(np.sqrt((off ** 2).mean()))
    assert got["training"]["s_inf"] == pytest.approx(np.abs(off).max())


def test_independent_residuals_score_zero(panel):
    y = np.vstack([np.eye(3), -np.eye(3)])
    rows = M.indexed(panel({f"s{j}": y[:, j] for j in range(3)})).withColumn("design", F.lit("d")).withColumn("fold_id", F.lit(1))
    assert M.offdiag_scores(rows, M.KEYS).first()["s_f"] == pytest.approx(0.0, abs=1e-12)


def test_incomplete_window_stops_the_job(panel):
    rows = M.indexed(panel({"a": [1, 2, 3, 4], "b": [1, None, 3, 4]})).withColumn("design", F.lit("d")).withColumn("fold_id", F.lit(1))
    with pytest.raises(Exception, match="incomplete"):
        M.offdiag_scores(rows, M.KEYS).collect()


def test_alignment_rules(panel):
    y = panel({"a": range(1, 11)})
    full = {f"d{k}": list(range(1, 11)) for k in range(8)}
    full["sparse"] = [1, None, None, None, 5, 6, 7, 8, 9, 10]
    _, x = A.complete_alignment(y, panel(full))
    assert {r["series"] for r in x.select("series").distinct().collect()} == {f"d{k}" for k in range(8)}
    assert x.select("dt").distinct().count() == 10
