"""Paired fold inference with repeatable hash draws.

A family is a set of comparisons over the same test folds.  Its differences fit
one short row (folds x comparisons), so the replicates are generated where that
row is: replicate numbers are spread over the cluster in chunks and each task
turns a replicate into one mean per comparison.  Nothing is shuffled until the
means are summarised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.expr import hash_draw
from foldwise.session import materialize, parallelism

CHUNK = 500
TIE = 1e-9
EPS = 2.220446049250313e-16  # double machine epsilon


def paired_differences(results: DataFrame, family, reference: str, value: str, method: str = "method", fold: str = "fold_id") -> DataFrame:
    """Reference minus comparator per fold; only folds where every method has a value.

    Output: family columns, comparison, fold, pos (0-based fold number), n, diff.
    """
    family = list(family)
    usable = results.filter(F.col(value).isNotNull()).select(*family, fold, method, value)
    wanted = results.select(*family, method).distinct().groupBy(*family).agg(F.count(F.lit(1)).alias("wanted"))
    whole = usable.groupBy(*family, fold).agg(F.count(F.lit(1)).alias("present")).join(wanted, family).filter("present = wanted")
    ref = usable.filter(F.col(method) == reference).select(*family, fold, F.col(value).alias("ref_value"))
    w = Window.partitionBy(*family, "comparison")
    return (
        usable.filter(F.col(method) != reference).join(whole.select(*family, fold), [*family, fold], "left_semi")
        .join(ref, [*family, fold])
        .select(*family, F.col(method).alias("comparison"), fold, (F.col("ref_value") - F.col(value)).alias("diff"))
        .withColumn("pos", (F.row_number().over(w.orderBy(fold)) - 1).cast("long"))
        .withColumn("n", F.count(F.lit(1)).over(w))
    )


def paired_summary(diffs: DataFrame, family) -> DataFrame:
    """Mean, standard error, t and share below zero; too few folds or no variation stop the job."""
    base = diffs.groupBy(*family, "comparison").agg(
        F.count("diff").alias("folds"), F.avg("diff").alias("mean_difference"),
        (F.stddev_samp("diff") / F.sqrt(F.count("diff"))).alias("standard_error"),
        F.avg((F.col("diff") < 0).cast("int")).alias("fraction_reference_better"),
    )
    few = (F.col("folds") < 3) | F.isnan("mean_difference")
    flat = ~F.coalesce(F.col("standard_error") > 0, F.lit(False))
    checked = (
        F.when(few, F.raise_error(F.lit("paired inference needs at least three finite folds")).cast("double"))
        .when(flat, F.raise_error(F.lit("paired difference has zero sampling variation")).cast("double"))
        .otherwise(F.col("standard_error"))
    )
    return base.withColumn("standard_error", checked).withColumn("t", F.col("mean_difference") / F.col("standard_error"))


def family_rows(diffs: DataFrame, family, extra: DataFrame | None = None) -> DataFrame:
    """One row per family: fold count and, for each comparison, its value array and the columns of ``extra`` (family, comparison, ...)."""
    by = [*family, "comparison"]
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "diff"))), lambda s: s["diff"])
    per = diffs.groupBy(*by).agg(values.alias("x"), F.max("n").alias("n"))
    more = [c for c in extra.columns if c not in by] if extra is not None else []
    per = per.join(extra, by) if extra is not None else per
    return per.groupBy(*family, "n").agg(F.collect_list(F.struct("comparison", "x", *more)).alias("sets"))


def replicates(families: DataFrame, count: int, chunk: int = CHUNK) -> DataFrame:
    """Copies of each family row for replicate numbers 0..count-1, spread over tasks."""
    chunks = (count + chunk - 1) // chunk
    spread = families.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    spread = spread.repartition(parallelism(families), "chunk", "n")
    lo = F.col("chunk") * chunk
    return spread.withColumn("rep", F.explode(F.sequence(lo, F.least(lo + chunk, F.lit(count)) - 1))).drop("chunk")


def _seed(seed) -> Column:
    return seed if isinstance(seed, Column) else F.lit(seed)


def _places() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col("n") - 1)


def _resampled(families: DataFrame, reps: int, seed, tag: str) -> DataFrame:
    """Family rows per replicate, with the mean of every comparison over the folds drawn (shared by all of them) as ``means``."""
    draw = F.transform(_places(), lambda p: hash_draw(F.col("n"), F.lit(tag), _seed(seed), F.col("rep"), p))
    total = lambda x: F.aggregate("draw", F.lit(0.0), lambda acc, d: acc + F.get(x, d))
    return replicates(families, reps).withColumn("draw", draw).withColumn("means", F.transform("sets", lambda s: total(s["x"]) / F.col("n")))


def bootstrap_means(diffs: DataFrame, family, reps: int, seed, tag: str = "boot") -> DataFrame:
    """Mean of each resampled fold set: family, comparison, rep, mean.

    The folds drawn are shared by all comparisons of the family.
    """
    drawn = _resampled(family_rows(diffs, family), reps, seed, tag)
    return drawn.select(*family, "rep", F.explode(F.arrays_zip("sets.comparison", "means")).alias("s")).select(
        *family, F.col("s.comparison").alias("comparison"), "rep", F.col("s.means").alias("mean")
    )


def bootstrap_ci(means: DataFrame, family) -> DataFrame:
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return (
        means.groupBy(*family, "comparison").agg(q.alias("q"), F.stddev_samp("mean").alias("bootstrap_se"))
        .select(*family, "comparison", F.col("q")[0].alias("bootstrap_ci_lower"), F.col("q")[1].alias("bootstrap_ci_upper"), "bootstrap_se")
    )


def simultaneous_ci(diffs: DataFrame, means: DataFrame, family, reps: int, seed, tag: str = "boot") -> DataFrame:
    """Estimate +- critical x bootstrap error, critical from the family's largest |t|.

    ``means``: the replicates' means, as from :func:`bootstrap_means` with the same draws; they give the errors.
    The errors then ride on the family's row, so a replicate finds its own largest |t| where it is
    drawn and one number per replicate is left to summarise: nothing meets on the family's key.
    """
    family = list(family)
    spread = means.groupBy(*family, "comparison").agg(F.greatest(F.stddev_samp("mean"), F.lit(EPS)).alias("bse"))
    families = materialize(family_rows(diffs, family, spread))
    centre = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)
    off = F.zip_with("means", "sets", lambda m, s: F.abs((m - centre(s["x"])) / s["bse"]))
    critical = _resampled(families, reps, seed, tag).select(*family, F.array_max(off).alias("top")).groupBy(*family).agg(
        F.percentile("top", 0.95).alias("critical")
    )
    each = families.select(*family, F.explode("sets").alias("s")).join(critical, family)
    reach = F.col("critical") * F.col("s.bse")
    return each.select(
        *family, F.col("s.comparison").alias("comparison"), (centre(F.col("s.x")) - reach).alias("simultaneous_ci_lower"),
        (centre(F.col("s.x")) + reach).alias("simultaneous_ci_upper"),
    )


def sign_flip_p(diffs: DataFrame, family, reps: int, seed, tag: str = "sign") -> DataFrame:
    """Two-sided raw and familywise p-values from random signs per fold.

    Signs are shared within the family.  The sum of squares does not change with the signs, so a
    replicate only needs its means.  The family's row carries the observed |t| of every comparison;
    a replicate compares its own |t| and its largest one with them on the spot, so only counts
    leave a task.
    """
    family = list(family)
    add = lambda acc, v: acc + v

    def size_of_t(mean, squares, n):
        variance = (squares - n * mean * mean) / (n - 1)
        return F.abs(F.when(variance > 0, mean / F.sqrt(variance / n)).otherwise(0.0))

    def described(s):
        squares = F.aggregate(s["x"], F.lit(0.0), lambda acc, v: acc + v * v)
        mean = F.aggregate(s["x"], F.lit(0.0), add) / F.size(s["x"])
        return F.struct(s["comparison"].alias("comparison"), s["x"].alias("x"), squares.alias("ss"), (size_of_t(mean, squares, F.size(s["x"])) * (1 - TIE)).alias("seen"))

    families = materialize(family_rows(diffs, family).withColumn("sets", F.transform("sets", described)))
    sign = F.transform(_places(), lambda p: hash_draw(2, F.lit(tag), _seed(seed), F.col("rep"), p) * 2 - 1)
    flipped = lambda s: F.aggregate(F.zip_with("sign", s["x"], lambda a, b: a * b), F.lit(0.0), add) / F.col("n")
    drawn = replicates(families, reps).withColumn("sign", sign).withColumn(
        "t", F.transform("sets", lambda s: size_of_t(flipped(s), s["ss"], F.col("n")))
    ).withColumn("top", F.array_max("t"))
    hits = F.explode(F.zip_with("sets", "t", lambda s, t: F.struct(s["comparison"].alias("comparison"), (t >= s["seen"]).alias("raw"), (F.col("top") >= s["seen"]).alias("all"))))
    return drawn.select(*family, hits.alias("h")).groupBy(*family, F.col("h.comparison").alias("comparison")).agg(
        ((F.count_if(F.col("h.raw")) + 1) / (reps + 1)).alias("sign_flip_p_raw"),
        ((F.count_if(F.col("h.all")) + 1) / (reps + 1)).alias("sign_flip_p_familywise"),
    )


def family_inference(diffs: DataFrame, family, *, bootstrap_reps: int = 5000, sign_reps: int = 20000, seed=20260902) -> DataFrame:
    """All of the above in one table per family and comparison."""
    family = list(family)
    by = [*family, "comparison"]
    summary = paired_summary(diffs, family)
    means = materialize(bootstrap_means(diffs, family, bootstrap_reps, seed))
    return (
        summary.join(bootstrap_ci(means, family).drop("bootstrap_se"), by)
        .join(simultaneous_ci(diffs, means, family, bootstrap_reps, seed), by)
        .join(sign_flip_p(diffs, family, sign_reps, seed), by)
    )


def metric_families(results: DataFrame, by, metrics, reference: str, method: str = "method", fold: str = "fold_id") -> DataFrame:
    """Paired differences of every metric as families of their own: ``by``, metric, comparison, fold, pos, n, diff."""
    long = results.select(*by, fold, method, *[F.col(m).cast("double") for m in metrics]).unpivot([*by, fold, method], list(metrics), "metric", "value")
    return paired_differences(long, [*by, "metric"], reference, "value", method, fold)


def seeded(diffs: DataFrame, family, seed: int) -> Column:
    """A seed for each family: ``seed`` plus a hash of its names, the same on every run."""
    return F.lit(seed) + F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in family])), 1, 4), 16, 10).cast("long")


def sign_flip_one_sided(
    diffs: DataFrame, family, *, mode: str = "by_folds", exact_limit: int = 18, draws: int = 200000, seed=20260903,
) -> DataFrame:
    """P(mean <= observed) under sign flips.

    ``mode`` is ``exact`` (every pattern), ``random`` (``draws`` patterns) or ``by_folds``: exact
    up to ``exact_limit`` folds.  ``patterns`` tells how many were used.
    """
    if mode not in ("exact", "random", "by_folds"):
        raise ValueError(f"unknown mode {mode}")
    rows = family_rows(diffs, family).select(*family, "n", F.explode("sets").alias("s"))
    rows = rows.select(*family, F.col("s.comparison").alias("comparison"), "n", F.col("s.x").alias("x"))
    exact = F.lit(mode == "exact") if mode != "by_folds" else F.col("n") <= exact_limit
    size = F.when(exact, F.pow(F.lit(2.0), F.col("n")).cast("long")).otherwise(F.lit(draws).cast("long"))
    chunk = 4096
    spread = (
        rows.withColumn("patterns", size)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("patterns") - 1) / chunk))))
        .repartition(parallelism(diffs), "chunk", "comparison")
        .withColumn("id", F.explode(F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("patterns")) - 1)))
    )
    bit = lambda p: F.when(
        exact, F.pmod(F.floor(F.col("id") / F.pow(F.lit(2.0), p)), F.lit(2).cast("long"))
    ).otherwise(hash_draw(2, F.lit("one"), _seed(seed), F.col("id"), p))
    flipped = F.aggregate(F.zip_with("x", _places(), lambda v, p: v * (bit(p) * 2 - 1)), F.lit(0.0), lambda a, b: a + b)
    observed = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    slack = F.aggregate("x", F.lit(0.0), lambda a, b: a + F.abs(b)) * TIE
    return (
        spread.withColumn("hit", flipped <= observed + slack)
        .groupBy(*family, "comparison").agg(
            F.max("n").alias("folds"), F.max("patterns").alias("patterns"),
            ((1 + F.count_if(F.col("hit"))) / (1 + F.max("patterns"))).alias("p_value"),
        )
    )


def holm(tests: DataFrame, family, p: str = "p_value", order: str = "comparison") -> DataFrame:
    """Step-down adjusted p-values within each family."""
    w = Window.partitionBy(*family)
    ranked = w.orderBy(p, order)
    left = F.count(F.lit(1)).over(w) - F.row_number().over(ranked) + 1
    run = ranked.rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_step", left * F.col(p)).withColumn(
        "holm_p", F.least(F.max("_step").over(run), F.lit(1.0))
    ).drop("_step")


def moving_block_positions(lengths: DataFrame, keys, block: int, reps: int, seed) -> DataFrame:
    """Resampled positions of overlapping blocks, cut to the series length.

    ``lengths``: keys, length.  Output: keys, rep, slot, pos.
    """
    n = F.col("length").cast("long")
    ok = F.when((n >= block) & (F.lit(block) > 0), n).otherwise(
        F.raise_error(F.lit("block length must lie between one and the sample length")).cast("long")
    )
    return (
        lengths.withColumn("length", ok)
        .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
        .repartition(parallelism(lengths), *keys, "rep")
        .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))))
        .withColumn("start", hash_draw(F.col("length") - block + 1, F.lit("block"), F.lit(seed), F.col("rep"), F.col("b")))
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long"))))
        .withColumn("slot", F.col("b") * block + F.col("o"))
        .filter("slot < length")
        .select(*keys, "rep", "slot", (F.col("start") + F.col("o")).alias("pos"))
    )


def average_ranks(rows: DataFrame, keys, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Ranks with ties averaged, also when one group holds most rows.

    Equal values are counted first.  The distinct values are range-partitioned, so
    a hot group spreads over many ranges; each range is ranked by itself and starts
    after the total of the ranges before it.  The ranges are written down once, as
    both sides of the join must see the same ones.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    ranges = counts.repartitionByRange(buckets or parallelism(rows), *keys, value)
    placed = materialize(ranges.withColumn("bucket", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "bucket").agg(F.sum("c").alias("t")).select(
        *keys, "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(offsets, [*keys, "bucket"]).select(
        *keys, value,
        (F.col("offset") + F.coalesce(F.sum("c").over(inside), F.lit(0)) + (F.col("c") + 1) / 2).alias(name),
    )
    return rows.join(ranked, [*keys, value])


def spearman(rows: DataFrame, keys, x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(rows.select(*keys, x, y), keys, x, "rx"), keys, y, "ry")
    return ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def extended_inference(
    diffs: DataFrame, family, *, fold: str = "fold_id", bootstrap_reps: int = 20000, draws: int = 200000, seed=20260903, mode: str = "by_folds",
) -> DataFrame:
    """Bootstrap interval, one-sided sign-flip p (with the number of patterns and the ``mode`` of :func:`sign_flip_one_sided`) and Holm adjustment per family.

    ``diffs``: family, comparison, fold, diff (rows without a difference drop out).
    Comparisons of a family may cover different numbers of folds.
    """
    family = list(family)
    by = [*family, "comparison"]
    w = Window.partitionBy(*by)
    placed = (
        diffs.filter(F.col("diff").isNotNull())
        .withColumn("pos", (F.row_number().over(w.orderBy(fold)) - 1).cast("long"))
        .withColumn("n", F.count(F.lit(1)).over(w))
    )
    placed = materialize(placed)
    mean = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), F.avg("diff").alias("mean_delta"))
    ci = bootstrap_ci(bootstrap_means(placed, family, bootstrap_reps, seed), family).select(
        *by, F.col("bootstrap_ci_lower").alias("ci_low"), F.col("bootstrap_ci_upper").alias("ci_high")
    )
    p = sign_flip_one_sided(placed, family, mode=mode, draws=draws, seed=seed).select(*by, "patterns", "p_value")
    return holm(mean.join(ci, by).join(p, by), family)
