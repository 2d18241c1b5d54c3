"""Session helpers: tables in the shared checkpoint folder and a parallelism hint."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a cluster must name it itself.

    Only a local session without the setting (tests) gets a scratch folder,
    because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="foldwise-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back.

    Used before a table is read several times or a loop goes on.  The files
    outlive a lost executor, later reads prune columns, and their size tells
    Catalyst whether a join side may be broadcast.  The shuffle files of the
    write go with it: they would stay until the driver collects its garbage,
    and a job of many tables would hold the shuffles of all of them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/foldwise-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(df: DataFrame) -> int:
    """Task count for spreading compute-heavy generated rows over the cluster."""
    sc = df.sparkSession.sparkContext
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sc.defaultParallelism)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package (once per application), wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="foldwise-lib-"), "foldwise.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
