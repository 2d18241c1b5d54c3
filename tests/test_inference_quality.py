import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import expr as X
from foldwise.operators import inference as IN
from foldwise.operators import quality as Q


def diffs(spark, x, family="f"):
    rows = [(family, f"c{j}", k, float(x[k, j]), k, len(x)) for k in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "family string, comparison string, fold_id long, diff double, pos long, n long")


def test_strong_effect(spark):
    x = np.random.default_rng(1).normal([-1.0, -0.6], 0.2, size=(30, 2))
    r = IN.family_inference(diffs(spark, x), ["family"], bootstrap_reps=1000, sign_reps=2000).collect()
    assert len(r) == 2
    assert all(row["simultaneous_ci_upper"] < 0 and row["sign_flip_p_familywise"] < 0.01 for row in r)


def test_draws_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(2).normal(size=(9, 2))
    d = diffs(spark, x)
    a = IN.bootstrap_means(d, ["family"], 300, 7).orderBy("comparison", "rep").collect()
    b = IN.bootstrap_means(d.repartition(7), ["family"], 300, 7).orderBy("comparison", "rep").collect()
    assert a == b and len(a) == 600


def test_exact_sign_flip_equals_enumeration(spark):
    x = np.random.default_rng(3).normal(-0.2, 1, size=(8, 1))
    signs = np.array(np.meshgrid(*[[-1, 1]] * 8)).reshape(8, -1).T
    want = (1 + ((signs * x[:, 0]).mean(axis=1) <= x.mean() + 1e-12).sum()) / 257
    assert IN.sign_flip_one_sided(diffs(spark, x), ["family"]).first()["p_value"] == pytest.approx(want)


def test_random_sign_flip_beyond_the_limit(spark):
    x = np.full((20, 1), -1.0) + np.random.default_rng(4).normal(0, 0.01, size=(20, 1))
    r = IN.sign_flip_one_sided(diffs(spark, x), ["family"], draws=5000).first()
    assert r["patterns"] == 5000 and r["p_value"] < 0.001


def test_too_few_folds_and_no_variation_stop(spark):
    with pytest.raises(Exception, match="three finite folds"):
        IN.paired_summary(diffs(spark, np.ones((2, 1))), ["family"]).collect()
    with pytest.raises(Exception, match="zero sampling variation"):
        IN.paired_summary(diffs(spark, np.ones((4, 1))), ["family"]).collect()


def test_holm(spark):
    t = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, comparison string, p_value double")
    got = {r["comparison"]: r["holm_p"] for r in IN.holm(t, ["family"]).collect()}
    assert got == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})


def test_moving_blocks(spark):
    d = spark.createDataFrame([("s", 17)], "k string, length long")
    rows = IN.moving_block_positions(d, ["k"], 5, 20, 3).orderBy("rep", "slot").collect()
    assert len(rows) == 20 * 17 and all(0 <= r["pos"] < 17 for r in rows)
    assert all(b["pos"] == a["pos"] + 1 for a, b in zip(rows, rows[1:]) if b["slot"] % 5 and a["rep"] == b["rep"])
    with pytest.raises(Exception, match="block length"):
        IN.moving_block_positions(d, ["k"], 18, 2, 3).collect()


@pytest.mark.parametrize("buckets", [2, 64])
def test_spearman_with_ties_in_a_hot_group(spark, buckets):
    rng = np.random.default_rng(6)
    x, y = rng.integers(0, 9, 400), rng.integers(0, 50, 400)
    df = spark.createDataFrame([("hot" if k % 3 else "b", int(a), int(b)) for k, (a, b) in enumerate(zip(x, y))], "g string, x int, y int")
    import pandas as pd

    want = df.toPandas().groupby("g").apply(lambda p: p["x"].rank().corr(p["y"].rank()), include_groups=False)
    ranked = IN.average_ranks(IN.average_ranks(df, ["g"], "x", "rx", buckets), ["g"], "y", "ry", buckets)
    got = {r["g"]: r["c"] for r in ranked.groupBy("g").agg(F.corr("rx", "ry").alias("c")).collect()}
    assert got == pytest.approx(dict(want)) and isinstance(want, pd.Series)


def test_wilson_contains_the_share(spark):
    lo, hi = X.wilson_bounds(F.lit(60), F.lit(100))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert r["lo"] < 0.6 < r["hi"]
    bad, _ = X.wilson_bounds(F.lit(5), F.lit(3))
    with pytest.raises(Exception, match="invalid binomial"):
        spark.range(1).select(bad).collect()


def test_unknown_ledger_fails_closed(spark):
    row = ["B", "AAA", "", "", "", "raw", "UNKNOWN", "UNKNOWN", "UNKNOWN", ""]
    led = spark.createDataFrame([tuple(row)], ", ".join(f"{c} string" for c in Q.ASSET_COLUMNS))
    gates = Q.asset_ledger_gates(led)
    assert any(not g["passed"] for g in gates.collect())
    assert Q.preflight_decision(gates).first()["decision"] == "NO-GO"
    assert not Q.asset_ledger_gates(led.drop("panel")).first()["passed"]
