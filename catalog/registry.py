"""Collects queries and their check SQL; keeps types and rounding alike on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.session import ship_package

QUERIES: dict = {}
ORACLES: dict = {}
DIGITS = 6
# Added before rounding on both sides: decimals of up to six digits stay as they are, and
# values such as x.xxxxxx5, which two engines may round apart, no longer lie on an edge.
NUDGE = 1.2345678e-7


def tidy(df, digits: int | None = None):
    """Integers as BIGINT, doubles rounded (sums may differ in the last bits); with ``digits`` without the shift."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            shifted = c.cast("double") + F.lit(0.0 if digits else NUDGE)
            c = F.round(shifted, digits or DIGITS) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


def sql(with_clause: str, body: str, keep: str = "", ints: str = "", num: str = "", digits: int | None = None) -> str:
    cols = [f"{c}" for c in keep.split()]
    cols += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    shift = "" if digits else f" + {NUDGE!r}"
    cols += [f"round(CAST({c} AS DOUBLE){shift}, {digits or DIGITS}) + 0.0 AS {c}" for c in num.split()]
    return f"{with_clause}\nSELECT {', '.join(cols)} FROM (\n{body}\n) answer"


def query(name: str, oracle: str | None = None, digits: int | None = None):
    def wrap(fn):
        assert name not in QUERIES, name

        def run(spark, sf_dir):
            ship_package(spark)
            return tidy(fn(spark, sf_dir), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap
