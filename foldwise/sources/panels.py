"""Reading wide and long panels, writing tables and reports, file manifests."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.functions.expr import numeric_coerce, parse_date_strict, parse_mixed_date


def wide_to_long(wide: DataFrame, date_col: str = "date", panel_id: str = "panel", keep_missing: bool = True) -> DataFrame:
    """Wide dated table (one column per series) to (panel_id, dt, series, value).

    Text that is no number becomes NULL.  NULL cells are kept by default: a date on
    which every series is missing must stay in the calendar, or returns would be
    taken across it.  Drop them only where other rows keep the dates.
    """
    names = [c for c in wide.columns if c != date_col]
    cells = wide.select(
        F.lit(panel_id).alias("panel_id"), parse_date_strict(F.col(f"`{date_col}`")).alias("dt"),
        *[numeric_coerce(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(names)],
    ).unpivot(["panel_id", "dt"], [f"c{k}" for k in range(len(names))], "nth", "value")
    # by number, as a name may hold a dot
    series = F.array(*[F.lit(c) for c in names])[F.substring("nth", 2, 9).cast("int")]
    cells = cells.select("panel_id", "dt", series.alias("series"), "value")
    return cells if keep_missing else cells.filter("value IS NOT NULL")


def read_wide_csv(spark: SparkSession, path: str, date_col: str = "date", panel_id: str = "panel", keep_missing: bool = True) -> DataFrame:
    """Wide CSV (plain or gzip); every cell is read as text, so no inference pass."""
    wide = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return wide_to_long(wide, date_col, panel_id, keep_missing)


def read_wide_checked(spark: SparkSession, path: str, date_col: str = "date", panel_id: str = "panel") -> tuple[DataFrame, DataFrame]:
    """Wide CSV (plain or gzip, one file or many) as a long panel, and a table of what was rejected.

    Rejects: ``record`` (the text), ``column``, ``reason``.  A record with the wrong number of fields or an
    unreadable date is rejected whole; a field that is neither empty nor a number becomes NULL and is listed.
    """
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([*[T.StructField(f"c{k}", T.StringType()) for k in range(len(names))], T.StructField("broken", T.StringType())])
    read = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").csv(path)
    date, cells = f"c{names.index(date_col)}", [f"c{k}" for k, c in enumerate(names) if c != date_col]
    dt = parse_mixed_date(F.col(date))
    rows = read.withColumn("dt", F.when(F.col("broken").isNull(), dt))
    record = F.coalesce("broken", F.concat_ws(",", *[F.coalesce(f"c{k}", F.lit("")) for k in range(len(names))]))
    title = F.array(*[F.lit(c) for c in names])
    wrong = F.filter(F.array(*[
        F.when((F.trim(c) != "") & numeric_coerce(F.col(c)).isNull(), F.struct(title[int(c[1:])].alias("column"), F.lit("not a number").alias("reason"))) for c in cells
    ]), lambda x: x.isNotNull())
    whole = lambda column, reason: F.array(F.struct(F.lit(column).cast("string").alias("column"), F.lit(reason).alias("reason")))
    faults = F.when(F.col("broken").isNotNull(), whole(None, "wrong number of fields")).when(F.col("dt").isNull(), whole(date_col, "not a date")).otherwise(wrong)
    rejects = rows.select(record.alias("record"), F.explode(faults).alias("f")).select("record", "f.column", "f.reason")
    long = rows.filter("dt IS NOT NULL").select("dt", *[numeric_coerce(F.col(c)).alias(c) for c in cells]).unpivot(["dt"], cells, "nth", "value")
    panel = long.select(F.lit(panel_id).alias("panel_id"), "dt", title[F.substring("nth", 2, 9).cast("int")].alias("series"), "value")
    return panel, rejects


PANEL = "panel_id string, dt date, series string, value double"


def read_panel(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Long panel written by :func:`write_panel`; filters on panel_id prune partitions, NaN is read as missing."""
    read = spark.read.schema(PANEL)
    panel = read.option("header", True).csv(path) if kind == "csv" else read.json(path) if kind == "json" else read.parquet(path)
    return panel.withColumn("value", F.when(~F.isnan("value"), F.col("value"))).select("panel_id", "dt", "series", "value")


def project_universe(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Only the universe's series, with their order."""
    return panel.join(universe.select("panel_id", "series", "ord"), ["panel_id", "series"])


def missing_from_panel(panel: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.join(panel.select("panel_id", "series").distinct(), ["panel_id", "series"], "left_anti")


def require_universe(panel: DataFrame, universe: DataFrame) -> DataFrame:
    n, absent = missing_from_panel(panel, universe).agg(F.count(F.lit(1)), F.sort_array(F.collect_set("series"))).first()
    if n:
        raise ValueError(f"{n} universe series missing from the panel: {absent}")
    return project_universe(panel, universe)


def write_panel(panel: DataFrame, path: str, kind: str = "parquet", gzip: bool = False) -> None:
    """Long panel, one folder per panel (a hot one still spreads over many files), as Parquet, CSV or JSON lines."""
    w = panel.select("panel_id", "dt", "series", "value").write.mode("overwrite").partitionBy("panel_id")
    w = w.option("compression", "gzip") if gzip else w
    if kind == "csv":
        w.option("header", True).csv(path)
    elif kind == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.option("compression", "gzip") if gzip else w).csv(path)


WHOLE = 128 << 20
STREAMS = 4


def _streamed_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any size, read through Spark's file systems with a buffer of 1 MB."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = jvm.java.io.BufferedInputStream(at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at), 1 << 20)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def file_digests(spark: SparkSession, path: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """Name, size and SHA-256 of each input file.

    Files of up to ``whole`` bytes are hashed in the tasks, which hold a file as one cell.  A cell has at most
    2 GB, and no Spark source gives a file's bytes in pieces; so larger files, whose hash is one chain over all
    bytes in any case, go through a digest in the driver's JVM, a few at a time and a buffer of each.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    held = files.filter(F.col("length") <= whole).select(name, F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > whole).select(name, "length", "path").collect()
    if not large:
        return held
    with ThreadPoolExecutor(STREAMS) as pool:
        digests = list(pool.map(lambda r: _streamed_digest(spark, r.path), large))
    rows = [(r.name, r.length, d) for r, d in zip(large, digests, strict=True)]
    return held.unionByName(spark.createDataFrame(rows, "name string, size_bytes long, sha256 string"))


def check_manifest(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Full outer comparison with (name, sha256); a NULL expected hash asks for presence only."""
    e = expected.select("name", F.col("sha256").alias("expected_sha256"), F.lit(True).alias("is_expected"))
    status = (
        F.when(F.col("sha256").isNull(), "MISSING")
        .when(F.col("is_expected").isNull(), "UNLISTED")
        .when(F.col("expected_sha256").isNull() | (F.col("expected_sha256") == F.col("sha256")), "OK")
        .otherwise("CHANGED")
    )
    return found.join(e, "name", "full_outer").select("name", "size_bytes", "sha256", status.alias("status"))
