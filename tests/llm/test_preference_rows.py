"""The quality model is learned from every labelled row, in groups that meet in tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import preference

SIZE = len(preference.NAMES)


def table(spark, n, every=3):
    """Feature rows whose label leans on two features, and the labels; one kind has about 1 row of ``every``."""
    draw = lambda k: (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(10007)) / 10007.0)
    rows = spark.range(n).select(F.col("id").alias("doc_id"))
    y = F.when(F.pmod(F.xxhash64("doc_id", F.lit(-1)), F.lit(every)) == 0, 0).otherwise(1)
    x = F.array(*[draw(k) + (0.4 * F.col("y") if k < 2 else F.lit(0.0)) for k in range(SIZE)])
    rows = rows.withColumn("y", y).withColumn("x", x)
    return rows.select("doc_id", "x"), rows.select("doc_id", F.col("y").alias("quality"))


def learned(featured, labels):
    got = sorted((r.doc_id, r.quality, tuple(r.x)) for r in featured.filter(~preference.held_out()).join(labels, "doc_id").collect())
    return np.array([g[2] for g in got]), np.array([g[1] for g in got])


def close(a, b):
    np.testing.assert_allclose([*a.mean, *a.scale, *a.weights, a.threshold, a.slope], [*b.mean, *b.scale, *b.weights, b.threshold, b.slope], rtol=1e-8, atol=1e-10)


def test_one_group_equals_the_arrays(spark):
    featured, labels = table(spark, 700)
    close(preference.fit(featured, labels), preference.fit_arrays(*learned(featured, labels)))


def test_every_labelled_row_is_learned_from(spark):
    featured, labels = table(spark, 32_000)
    x, y = learned(featured, labels)
    m = preference.fit(featured, labels)
    assert len(x) > 25_000
    np.testing.assert_allclose(m.mean, x.mean(axis=0), rtol=1e-10)
    whole = preference.fit_arrays(x, y)
    np.testing.assert_allclose(m.weights, whole.weights, atol=0.05)
    # the quantiles and their errors are those of all rows
    s = ((x - m.mean) / m.scale) @ np.array(m.weights)
    cuts = np.quantile(s, np.linspace(0, 1, 401))
    wrong = np.array([np.sum((s >= c) != (y == 1)) for c in cuts])
    best = cuts[wrong == wrong.min()]
    assert m.threshold == pytest.approx((best[0] + best[-1]) / 2, abs=1e-9)


@pytest.mark.parametrize("every", [3, 200])
def test_all_rows_of_both_kinds_are_in_a_group(spark, every):
    featured, labels = table(spark, 1500, every)
    train = featured.join(labels.withColumnRenamed("quality", "y"), "doc_id").select("doc_id", "y", "x")
    good, bad = train.filter("y = 1").count(), train.filter("y = 0").count()
    packed = preference.groups(train, good, bad, 100).collect()
    rows = [(y, tuple(r.x[k * SIZE : (k + 1) * SIZE])) for r in packed for k, y in enumerate(r.y)]
    assert len(packed) == 15 and set(rows) == {(r.y, tuple(r.x)) for r in train.collect()}
    assert sum(y == 1 for y, _ in rows) == good
    assert all(sum(y == 0 for y in r.y) >= min(preference.PARTNERS, bad) for r in packed)
