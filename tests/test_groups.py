"""Functions on groups, many small groups to a call."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import covariance as CV
from foldwise.operators.groups import per_group


@pytest.mark.parametrize("batch", [3, 10_000])
def test_groups_are_those_of_apply_in_pandas(spark, batch):
    """Groups of one row, groups over several batches, null keys."""
    rows = spark.range(700).select(
        F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string")).alias("a"), F.floor(F.sqrt("id")).alias("b"), F.col("id").cast("double").alias("v"),
    )

    def told(key, pdf):
        same = all((pd.isna(k) and pdf[c].isna().all()) or (pdf[c] == k).all() for c, k in zip(["a", "b"], key))
        return pd.DataFrame({"a": [None if pd.isna(key[0]) else key[0]], "b": [key[1]], "n": [len(pdf)], "s": [pdf["v"].sum()], "same": [same]})

    schema = "a string, b long, n long, s double, same boolean"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        got = per_group(rows, ["a", "b"], told, schema).collect()
    finally:
        spark.conf.set(name, before)
    want = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    assert sorted(map(str, want.withColumn("same", F.lit(True)).collect())) == sorted(map(str, got)) and len(got) > 100
    assert per_group(rows.filter("false"), ["a", "b"], told, schema).count() == 0


def test_small_matrices_share_calls(spark):
    cells = ["'p' AS panel_id", "'d' AS design", "id div 3 AS fold_id", "if(id % 3 = 2, 1, 0) AS i", "if(id % 3 = 0, 0, 1) AS j", "if(id % 3 = 1, 0.5D, 1D) AS v"]
    out = CV.eigen_floor(spark.range(900).selectExpr(*cells), 0.9)
    plan = out._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan
    assert {(r.i, r.j, round(r.v, 9), r.n) for r in out.groupBy("i", "j", "v").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 0, 1.2, 300), (1, 1, 1.2, 300), (0, 1, 0.3, 300)}


def test_groups_of_joined_rows_are_whole(spark):
    """The join turns into a broadcast while it runs, and its other side is read by mapper."""
    setting = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in setting}
    rows = spark.range(0, 60_000, 1, 8).select((F.col("id") % 50).alias("a"), (F.col("id") % 7).alias("v"))
    joined = rows.join(rows.select("a").distinct().withColumn("k", F.lit(5)), "a")

    def told(key, pdf):
        return pd.DataFrame({"a": [key[0]], "n": [len(pdf)]})

    try:
        for k, v in setting.items():
            spark.conf.set(k, v)
        got = sorted((r.a, r.n) for r in per_group(joined, ["a"], told, "a long, n long").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == [(a, 1_200) for a in range(50)]
