"""Mixing sources to target weights by entropy balancing.

Every source gets a token target.  The rates closest (in relative entropy) to one copy of each
document that meet the targets and never exceed ``cap`` are exponentially tilted in the
document's tokens: ``min(cap, exp(lambda_source * size))``.  The multipliers solve a convex dual,
one per source; Newton steps with a bracket run as aggregations over the table of sizes
(source, size, count), which is all that the rates depend on, so a hot source or a hot group of
copies is one row with a large count.  The tilted rates become whole copies by rounding along the
sizes, and what is left of a source's target is met by changing the copies of a few sizes.

Only DataFrame expressions are used.  Defined results: a null or blank text has size 0 and is
taken 0 times (a source without words has target 0); a null source is a source of its own, last
in order; repeated rows share their size's copies; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.llm.text import word_count
from foldwise.session import materialize

WEIGHTS = (1, 2, 3)
CAP = 3
BUCKETS = 4096
STEPS = 60
TOLERANCE = 1e-7


def source_key(source: str = "source") -> Column:
    """A join key that also stands for the missing source."""
    return F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))


def size_table(docs: DataFrame) -> DataFrame:
    """Documents per (source, size); ``docs`` has ``_fw_source``, ``_fw_size`` and ``_fw_bucket``."""
    return docs.groupBy("_fw_source", "_fw_size", "_fw_bucket").agg(F.count(F.lit(1)).alias("n"))


def targets(cells: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: its size and its target.

    Weights repeat along the sources in code-point order, the missing one last.  A target stops at
    ``cap`` times the source's size and the excess goes to the others by weight: all targets lie
    at one level per unit of weight, or at their cap.  The windows run over one row per source.
    """
    per = cells.groupBy("_fw_source").agg(F.sum(F.col("_fw_size") * F.col("n")).alias("source_size"))
    order = Window.orderBy((F.col("_fw_source") == "n"), "_fw_source")
    every = Window.partitionBy(F.lit(1))
    nth = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = per.withColumn("w", nth).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("r", F.col("most") / F.col("w"))
    rising = Window.orderBy("r", "_fw_source")
    level = (F.sum("source_size").over(every) - (F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))) / (
        F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing))
    )
    lv = w.withColumn("level", level)
    top = F.max(F.when(F.col("level") <= F.col("r") * (1 + 1e-12), F.col("level"))).over(every)
    return lv.select("_fw_source", "source_size", F.least(F.col("most"), F.coalesce(top, F.lit(0.0)) * F.col("w")).alias("target"))


def _rate(lam: Column, x: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def multipliers(sizes: DataFrame, goal: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """Multiplier of every source by bracketed Newton steps on the dual, one aggregation per step for all sources."""
    free = (F.col("source_size") > 0) & (F.col("target") < F.lit(float(cap)) * F.col("source_size") * (1 - 1e-12))
    bounds = sizes.filter("_fw_size > 0").groupBy("_fw_source").agg(F.min("_fw_size").alias("least"), F.sum("n").alias("docs"))
    state = materialize(
        goal.join(bounds, "_fw_source", "left").select(
            "_fw_source", "source_size", "target", (F.col("source_size") / F.greatest(F.col("docs"), F.lit(1))).alias("mean"),
            F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"),
            (F.lit(math.log(cap) + 1e-9) * F.col("source_size") / F.greatest(F.col("docs"), F.lit(1)) / F.col("least")).alias("hi"),
            free.alias("free"), (~free).alias("done"),
        ).coalesce(1)
    )
    for _ in range(steps):
        if state.filter("not done").limit(1).count() == 0:
            break
        x = F.col("_fw_size") / F.col("mean")
        rate = _rate(F.col("lam"), x, cap)
        tokens = F.col("n") * F.col("_fw_size")
        moved = sizes.filter("_fw_size > 0").join(state.filter("not done"), "_fw_source").groupBy("_fw_source").agg(
            F.sum(tokens * rate).alias("g"), F.sum(F.when(rate < cap, tokens * x * rate).otherwise(0.0)).alias("h")
        )
        gap = F.col("g") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - gap / F.when(F.col("h") > 0, F.col("h"))
        middle = F.when(F.col("lo2") < -1e5, F.col("lam") * 2 - 1).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        new = F.when((step > F.col("lo2")) & (step < F.col("hi2")), step).otherwise(middle)
        met = F.abs(gap) <= F.greatest(F.col("target") * TOLERANCE, F.lit(1e-6))
        state = materialize(
            state.join(moved, "_fw_source", "left").withColumn("lo2", lo).withColumn("hi2", hi).select(
                "_fw_source", "source_size", "target", "mean",
                F.when(F.col("done") | met, F.col("lam")).otherwise(new).alias("lam"), F.when(F.col("done"), F.col("lo")).otherwise(F.col("lo2")).alias("lo"),
                F.when(F.col("done"), F.col("hi")).otherwise(F.col("hi2")).alias("hi"), "free", (F.col("done") | met).alias("done"),
            ).coalesce(1)
        )
    # a source whose target is still missed stops the job where its row is read
    missed = F.raise_error(F.concat(F.lit("no multiplier found for source "), F.col("_fw_source"))).cast("double")
    return state.withColumn("lam", F.when(F.col("done"), F.col("lam")).otherwise(missed))


def whole_copies(sizes: DataFrame, state: DataFrame, cap: int = CAP, repairs: int = 3) -> DataFrame:
    """Copies per (source, size): rounded along falling sizes, then a few sizes changed to meet the target.

    A window holds the different sizes of a source, not its documents.
    """
    rate = F.when(~F.col("free"), F.when(F.col("source_size") > 0, F.lit(float(cap))).otherwise(0.0)).otherwise(
        _rate(F.col("lam"), F.col("_fw_size") / F.col("mean"), cap)
    )
    falling = Window.partitionBy("_fw_source").orderBy(F.desc("_fw_size"))
    run = F.sum("want").over(falling.rowsBetween(Window.unboundedPreceding, 0))
    cells = sizes.join(state.select("_fw_source", "source_size", "target", "mean", "lam", "free"), "_fw_source").withColumn(
        "want", F.when(F.col("_fw_size") > 0, F.col("n") * rate).otherwise(0.0)
    )
    cells = cells.withColumn("run", run).select(
        "_fw_source", "_fw_size", "n", "source_size", "target",
        F.least(F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("want") + 0.5), F.col("n") * cap).cast("long").alias("k"),
    )
    cells = materialize(cells)
    for _ in range(repairs):
        left = cells.groupBy("_fw_source").agg((F.max("target") - F.sum(F.col("k") * F.col("_fw_size"))).alias("left"))
        size = F.col("_fw_size")
        m = F.greatest(F.least(F.round(F.col("left") / size), F.col("n") * cap - F.col("k")), -F.col("k")).cast("long")
        tried = cells.filter("_fw_size > 0").join(left, "_fw_source").withColumn("m", m)
        best = tried.groupBy("_fw_source").agg(
            F.min(F.struct(F.abs(F.col("left") - F.col("m") * size).alias("e"), F.abs("m").alias("a"), size.alias("s"), F.col("m").alias("m"))).alias("b")
        ).select("_fw_source", F.col("b.s").alias("_fw_size"), F.col("b.m").alias("m"))
        cells = materialize(
            cells.join(best, ["_fw_source", "_fw_size"], "left").withColumn("k", F.col("k") + F.coalesce("m", F.lit(0))).drop("m")
        )
    return cells


def with_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP,
                size: str | None = None) -> DataFrame:
    """All rows and columns plus ``_fw_size``, ``_fw_source_size``, ``_fw_target`` and ``_fw_copies`` (names the input must not have).

    ``size`` names a column that already holds the word counts; ``text`` may then be any column that
    stands for the text.  Inside a size the copies go to the documents in the order of a hash of id
    and text, through at most ``BUCKETS`` hash buckets, so that a size with a third of all rows, or
    rows without ids, are ranked in pieces.  Rows that share all of this are alike.
    """
    rank = F.xxhash64(F.col(f"`{doc_id}`"), F.lit("mix"), F.col(f"`{text}`"))
    keyed = docs.select(
        "*", source_key(source).alias("_fw_source"), (F.col(size) if size else word_count(F.col(f"`{text}`"))).alias("_fw_size"),
        rank.alias("_fw_rank"),
    ).withColumn("_fw_bucket", F.pmod(F.col("_fw_rank"), F.lit(BUCKETS)).cast("int"))
    buckets = materialize(size_table(keyed))
    sizes = materialize(buckets.groupBy("_fw_source", "_fw_size").agg(F.sum("n").alias("n")))
    state = multipliers(sizes, targets(sizes, weights, cap), cap)
    cells = whole_copies(sizes, state, cap)
    along = Window.partitionBy("_fw_source", "_fw_size").orderBy("_fw_bucket").rowsBetween(Window.unboundedPreceding, 0)
    share = buckets.withColumnRenamed("n", "nb").join(cells, ["_fw_source", "_fw_size"]).withColumn("upto", F.sum("nb").over(along))
    share = share.select(
        "_fw_source", "_fw_size", "_fw_bucket", F.col("source_size").alias("_fw_source_size"), F.col("target").alias("_fw_target"),
        F.floor(F.col("k") / F.col("n")).cast("long").alias("_fw_base"),
        (F.expr("(upto * pmod(k, n)) div n - ((upto - nb) * pmod(k, n)) div n")).alias("_fw_extra"),
    )
    key = ["_fw_source", "_fw_size", "_fw_bucket"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_fw_rank", F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    out = keyed.join(share, key).withColumn("_fw_copies", F.col("_fw_base") + (place <= F.col("_fw_extra")).cast("long"))
    return out.drop("_fw_source", "_fw_rank", "_fw_bucket", "_fw_base", "_fw_extra")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixture itself: every document as often as it is taken, with its columns as they were."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    taken = with_copies(renamed, names[doc_id], names[text], names[source], weights, cap).filter("_fw_copies > 0")
    repeated = taken.select(*names.values(), F.explode(F.sequence(F.lit(1), F.col("_fw_copies").cast("int"))).alias("_fw_copy"))
    return repeated.select(*[F.col(n).alias(c) for c, n in names.items()])
