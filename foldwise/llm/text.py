"""Shared text helpers: words, UTF-8 sizes, row keys and Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words: space and the five controls from tab to carriage return.
SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of words; a null or blank text has none."""
    return F.array_remove(F.split(whole(text), SPACE_CLASS), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of the text are one of ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def text_key(text: Column) -> Column:
    """128 bits that stand for a text (null: empty)."""
    return F.unhex(F.md5(whole(text)))


def row_key(*cols: str) -> Column:
    """128 bits that stand for a row's values; nulls differ from empty strings."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(cols)]), {"ignoreNullFields": "false"})))


def small_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Bound the bytes of an Arrow batch, so that very long texts don't add up in a Python worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) in (None, "-1", str(2**63 - 1), str(2**31 - 1)):
        spark.conf.set(name, str(megabytes << 20))
