"""Tables in the shared folder."""

import time

from pyspark.sql import functions as F

from foldwise.session import SHUFFLE_CLEANUP_CONF, materialize


def shuffle_blocks(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return {b for b in blocks.split() if b.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_blocks(spark), spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    df = spark.range(10_000).groupBy((F.col("id") % 700).alias("k")).agg(F.collect_list("id").alias("l"))
    out = materialize(df.join(df.select("k", F.size("l").alias("n")), "k"))
    for _ in range(50):
        if not shuffle_blocks(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_blocks(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP_CONF, None) == setting
    assert out.count() == 700 and df.count() == 700


def test_a_failed_write_restores_the_setting(spark):
    setting = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    try:
        materialize(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("x")))
    except Exception as e:
        assert "no" in str(e)
    else:
        raise AssertionError("the write did not fail")
    assert spark.conf.get(SHUFFLE_CLEANUP_CONF, None) == setting
