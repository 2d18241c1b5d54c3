import datetime as dt
import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from foldwise.session import ship_package

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


def day(k):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(k))


@pytest.fixture(scope="session")
def panel(spark):
    """Long panel from {series: [values]}; None is an absent row."""

    def make(columns, panel_id="p", start=0):
        rows = [
            (panel_id, day(start + k), s, float(v)) for s, vs in columns.items() for k, v in enumerate(vs) if v is not None
        ]
        return spark.createDataFrame(rows, "panel_id string, dt date, series string, value double")

    return make


@pytest.fixture(scope="session")
def planted():
    """Assets driven by the first of five drivers."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 5))
    load = rng.normal(size=(1, 6)) + 0.5
    y = x[:, :1] @ load + 0.4 * rng.normal(size=(120, 6))
    return y, x
