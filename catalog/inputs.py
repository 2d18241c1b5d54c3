"""Panels derived from the supplied tables, in Spark and as check SQL.

Only the needed columns are read; weeks and months are truncated on DATE.
"""

from __future__ import annotations

from pyspark.sql import functions as F


_STAGED: dict = {}


def staged(name):
    """Keep the tables a preparation step has written, as later steps of a study read them.

    One copy per session and input folder; :func:`forget` makes the next query prepare again.
    """

    def wrap(build):
        def get(spark, sf):
            key = (spark.sparkContext.applicationId, id(spark), sf, name)
            if key not in _STAGED:
                _STAGED[key] = build(spark, sf)
            return _STAGED[key]

        return get

    return wrap


def forget():
    _STAGED.clear()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _price_rows(spark, sf, series, unit):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", F.col(series).alias("series"))
    d = F.to_date("l_shipdate")
    return (
        li.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy((F.trunc(d, unit) if unit else d).alias("dt"), "series")
        .agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    )


def _order_rows(spark, sf, series, unit):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    if series == "o_orderpriority":
        rows = o.withColumn("series", F.col("o_orderpriority"))
    else:
        c = table(spark, sf, "customer").select("c_custkey", F.col(series).cast("string").alias("series"))
        rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    d = F.to_date("o_orderdate")
    return rows.groupBy((F.trunc(d, unit) if unit else d).alias("dt"), "series").agg(F.avg("o_totalprice").alias("value"))


def _named(df, panel_id):
    return df.select(F.lit(panel_id).alias("panel_id"), "dt", "series", "value")


def px_type_w(spark, sf):
    return _named(_price_rows(spark, sf, "p_type", "week"), "px")


def px_brand_w(spark, sf):
    return _named(_price_rows(spark, sf, "p_brand", "week"), "px")


def px_brand_m(spark, sf):
    return _named(_price_rows(spark, sf, "p_brand", "month"), "px")


def px_brand_d(spark, sf):
    return _named(_price_rows(spark, sf, "p_brand", None), "px")


def px_two(spark, sf):
    """Two panels under one roof: types and brands, weekly."""
    return _named(_price_rows(spark, sf, "p_type", "week"), "types").unionByName(
        _named(_price_rows(spark, sf, "p_brand", "week"), "brands")
    )


def drv_w(spark, sf):
    """Ten weekly driver levels: order priorities and market segments."""
    return _named(
        _order_rows(spark, sf, "o_orderpriority", "week").unionByName(_order_rows(spark, sf, "c_mktsegment", "week")), "px"
    )


def drv_seg_d(spark, sf):
    return _named(_order_rows(spark, sf, "c_mktsegment", None), "px")


def drv_nation_m(spark, sf):
    return _named(_order_rows(spark, sf, "c_nationkey", "month"), "px")


def evt_day(spark, sf):
    e = table(spark, sf, "events").select("ts", "event_type", "value")
    return _named(
        e.groupBy(F.to_date("ts").alias("dt"), F.col("event_type").alias("series")).agg(F.avg("value").alias("value")), "evt"
    )


def emb(spark, sf):
    """Embedding coordinates as a return-like panel: one date per vector."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "x"))
    return e.select(
        F.lit("emb").alias("panel_id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("vec_id").cast("int")).alias("dt"),
        F.lpad(F.col("k").cast("string"), 3, "0").alias("series"), F.col("x").cast("double").alias("value"),
    )


def event_ledger(spark, panel_id="px"):
    """Hand-made ledger rows for the weekly brand panel, one per disposition and edge case."""
    rows = [(panel_id, *r) for r in LEDGER_ROWS]
    schema = (
        "panel_id string, date string, ticker string, disposition string, factor double, verification_status string, "
        "event_type string, source_url string, rationale string"
    )
    return spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("date"))


LEDGER_ROWS = [
    ("1996-03-04", "Brand#1", "APPLY_FACTOR", 2 / 3, "PRIMARY_SOURCE_VERIFIED", "3-for-2 split", "doc:1", "adjusted"),
    ("1996-05-06", "Brand#2", "EXCLUDE_DATE", None, "PRIMARY_SOURCE_VERIFIED", "spin-off", "doc:2", "date removed"),
    ("1997-01-06", "Brand#3", "KEEP_OBSERVED", None, "PRIMARY_SOURCE_VERIFIED", "market move", "doc:3", "kept"),
    ("1997-06-02", "Brand#4", "APPLY_FACTOR", 2.0, "SECONDARY_SOURCE", "reverse split", "doc:4", "adjusted"),
    ("1998-02-02", "Brand#5", "KEEP_OBSERVED", None, "PRIMARY_SOURCE_VERIFIED", "market move", "doc:5", "kept"),
    ("1998-09-07", "Brand#6", "EXCLUDE_DATE", None, "PRIMARY_SOURCE_VERIFIED", "distribution", "doc:6", "date removed"),
    ("2031-01-06", "Brand#7", "APPLY_FACTOR", 0.5, "PRIMARY_SOURCE_VERIFIED", "off panel", "doc:7", "not in range"),
    ("1999-03-01", "Brand#99", "APPLY_FACTOR", 0.5, "PRIMARY_SOURCE_VERIFIED", "off universe", "doc:8", "unknown series"),
]


def _values(rows):
    def lit(v):
        return "NULL" if v is None else repr(v) if isinstance(v, float) else "'" + v + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _trunc(col, unit):
    return f"CAST(date_trunc('{unit}', {col}) AS DATE)" if unit else f"CAST({col} AS DATE)"


def _px_sql(panel, series, unit):
    return (
        f"SELECT '{panel}' AS panel_id, {_trunc('l_shipdate', unit)} AS dt, {series} AS series, "
        "avg(l_extendedprice / l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 2, 3"
    )


def _ord_sql(panel, series, unit):
    src = "orders" if series == "o_orderpriority" else "orders JOIN customer ON o_custkey = c_custkey"
    return (
        f"SELECT '{panel}' AS panel_id, {_trunc('o_orderdate', unit)} AS dt, CAST({series} AS VARCHAR) AS series, "
        f"avg(o_totalprice) AS value FROM {src} GROUP BY 2, 3"
    )


# name -> (names it needs, SQL)
CTE: dict[str, tuple[str, str]] = {
    "px_type_w": ("", _px_sql("px", "p_type", "week")),
    "px_brand_w": ("", _px_sql("px", "p_brand", "week")),
    "px_brand_m": ("", _px_sql("px", "p_brand", "month")),
    "px_brand_d": ("", _px_sql("px", "p_brand", None)),
    "px_two": ("", _px_sql("types", "p_type", "week") + " UNION ALL " + _px_sql("brands", "p_brand", "week")),
    "drv_w": ("", _ord_sql("px", "o_orderpriority", "week") + " UNION ALL " + _ord_sql("px", "c_mktsegment", "week")),
    "drv_seg_d": ("", _ord_sql("px", "c_mktsegment", None)),
    "drv_nation_m": ("", _ord_sql("px", "c_nationkey", "month")),
    "evt_day": ("", "SELECT 'evt' AS panel_id, CAST(ts AS DATE) AS dt, event_type AS series, avg(value) AS value FROM events GROUP BY 2, 3"),
    "emb": (
        "",
        "SELECT 'emb' AS panel_id, CAST(DATE '2000-01-01' + CAST(vec_id AS INTEGER) AS DATE) AS dt, "
        "lpad(CAST(k - 1 AS VARCHAR), 3, '0') AS series, CAST(embedding[k] AS DOUBLE) AS value "
        "FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)",
    ),
    "ledger": (
        "",
        "SELECT 'px' AS panel_id, CAST(d AS DATE) AS dt, t AS series, disposition, CAST(factor AS DOUBLE) AS factor, "
        "verification_status, event_type, source_url, rationale FROM (VALUES " + _values(LEDGER_ROWS) + ") "
        "v(d, t, disposition, factor, verification_status, event_type, source_url, rationale)",
    ),
}


def with_(*names: str, **extra: str) -> str:
    """WITH clause holding the named pieces, what they need, and extra pieces in order."""
    order: list[str] = []

    def visit(n):
        deps, _ = CTE[n]
        for d in deps.split():
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTE[n][1]})" for n in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    return "WITH " + ",\n".join(parts)


def cte(name: str, deps: str, body: str) -> None:
    CTE[name] = (deps, body)
