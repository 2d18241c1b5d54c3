"""Rolling screening: choose drivers on one segment, judge frozen fits on the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators import align, covariance, folds, moments, regress, selection
from foldwise.operators.calendar import KEY, stored
from foldwise.operators.moments import KEYS
from foldwise.session import materialize

FLOOR = 1e-18  # variance floor of the rolling screening score
UNCONDITIONED = {
    "selection_selected": "selection_no_conditioning",
    "certification_selected_frozen": "certification_no_conditioning",
    "test_selected_frozen": "test_no_conditioning",
}


def prepare(assets: DataFrame, drivers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered, positioned rows of both panels (written once: read many times) and their index.

    An empty panel, missing values and repeated (panel, date, series) rows stop the job here; a hole
    stops it where its window is read.
    """
    stacked = moments.stack_roles(assets, drivers).groupBy("panel_id", "dt", "role", "series").agg(
        F.max("value").alias("value"), F.count(F.lit(1)).alias("copies")
    )
    rows = stored(
        moments.indexed(stacked), "the panels have no rows", ("repeated (panel, date, series) rows", F.col("copies") > 1),
        ("rows without a value", F.col("value").isNull() | F.isnan("value")),
    ).drop("copies")
    return rows, moments.index_of(rows)


def split_roles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    y = rows.filter("role = 'asset'").withColumn("n_series", F.col("n_assets"))
    return y, rows.filter("role = 'driver'")


def selection_moments(rows: DataFrame, index: DataFrame, design, segments, asset_limit: int | None):
    """Packed training moments over the asset subset and all drivers, renumbered; and their index."""
    keep = selection.even_subset(index, asset_limit).select("panel_id", "role", "series")
    pool = index.filter("role = 'driver'").select("panel_id", "role", "series")
    narrow = moments.series_index(keep.unionByName(pool))
    slim = rows.drop("idx", "n_series", "n_assets").join(narrow, ["panel_id", "role", "series"])
    return moments.fold_tiles(slim, design, segments), narrow


def metrics(rows: DataFrame, keys, floor: float | None, spectrum: bool = True) -> DataFrame:
    if not spectrum:
        return moments.offdiag_scores(rows, keys, floor)
    rows = materialize(rows)
    wide = moments.window_spectrum(rows, keys).select(*keys, "effective_rank", "cov_offdiag_spectral")
    return moments.offdiag_scores(rows, keys, floor).join(wide, keys)


def stack_stages(stages: dict[str, DataFrame]) -> DataFrame:
    """Residuals of several models under a stage name, so that they are scored in one job."""
    return covariance.union_all([
        e.select(*KEYS, F.lit(name).alias("stage"), "pos", "idx", "n_series", "value") for name, e in stages.items()
    ])


def by_stage(rows: DataFrame, uses) -> DataFrame:
    """Copy rows to the stages that use their segment: ``uses`` is (stage, part, segment) triples."""
    segment = F.col("segment")
    copies = None
    for name in sorted({u[2] for u in uses}):
        array = F.array(*[
            F.struct(F.lit(stage).alias("stage"), F.lit(part).alias("part")) for stage, part, s in uses if s == name
        ])
        copies = F.when(segment == name, array) if copies is None else copies.when(segment == name, array)
    return rows.withColumn("_use", F.explode(copies)).withColumn("stage", F.col("_use.stage")).withColumn(
        "segment", F.col("_use.part")
    ).drop("_use")


def state_features(driver_rows: DataFrame, chosen: DataFrame, state: DataFrame, cal: DataFrame, design, slots: int):
    """Chosen drivers, a high-state indicator and their products; and the threshold per fold.

    The threshold is the median state of the training dates only.
    """
    placed = folds.assign_folds(state.join(cal, KEY), design)
    level = placed.filter("segment = 'training'").groupBy(*KEYS).agg(F.percentile("value", 0.5).alias("state_threshold"))
    high = placed.join(level, KEYS).select(
        *KEYS, "segment", "pos", (F.col("value") > F.col("state_threshold")).cast("double").alias("high")
    )
    plain = regress.selected_features(driver_rows, chosen)
    busy = chosen.select(*KEYS).distinct()
    alone = high.join(busy, KEYS, "left_semi").select(*KEYS, "segment", "pos", F.lit(slots).alias("slot"), F.col("high").alias("z"))
    product = plain.join(high, [*KEYS, "segment", "pos"]).select(
        *KEYS, "segment", "pos", (F.col("slot") + slots + 1).alias("slot"), (F.col("z") * F.col("high")).alias("z")
    )
    return plain.unionByName(alone).unionByName(product), level


def evaluate_representation(
    assets: DataFrame, drivers: DataFrame, *, train: int, test: int, max_drivers: int = 6, penalty: float = 0.006,
    asset_limit: int | None = None, state: DataFrame | None = None, spectrum: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Fold results and the chosen drivers (keys, slot, series).

    A fold with nothing chosen is judged on its baseline residuals.
    """
    design = folds.two_segment(train, test, first_id=0)
    rows, index = prepare(assets, drivers)
    tiles, narrow = selection_moments(rows, index, design, ["training"], asset_limit)
    chosen_state = selection.greedy_select(tiles, narrow, penalty=penalty, max_drivers=max_drivers, variance_floor=FLOOR)
    chosen = materialize(selection.named_selection(chosen_state, narrow))
    placed = folds.assign_folds(rows, design)
    y, x = split_roles(placed)
    stages = {"baseline": y.filter("segment = 'test'")}
    stages["selected"] = regress.frozen_residuals(y, regress.selected_features(x, chosen), max_drivers, "training", "test")
    names = ["s_f", "s_inf"] + (["effective_rank"] if spectrum else [])
    cal = rows.select(*KEY, "pos", "n_dates").distinct()
    count = chosen.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("selected_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "series"))), lambda s: s["series"]), " | ").alias("selected_drivers"),
    )
    if state is not None:
        z, level = state_features(x, chosen, align.state_on_dates(state, cal), cal, design, max_drivers)
        stages["state"] = regress.frozen_residuals(y, z, 2 * max_drivers + 1, "training", "test")
    scores = prefixed_metrics(metrics(stack_stages(stages), [*KEYS, "stage"], FLOOR, spectrum), list(stages), names)
    out = (
        folds.fold_calendar(cal, design).join(scores, KEYS)
        .withColumns({f"selected_{c}": F.coalesce(f"selected_{c}", f"baseline_{c}") for c in names})
        .join(count, KEYS, "left")
        .withColumn("selected_count", F.coalesce("selected_count", F.lit(0)))
        .withColumn("selected_drivers", F.coalesce("selected_drivers", F.lit("")))
        .withColumn("delta_s_f", F.col("selected_s_f") - F.col("baseline_s_f"))
        .withColumn("relative_reduction_s_f", -F.col("delta_s_f") / F.col("baseline_s_f"))
    )
    if state is not None:
        out = (
            out.join(level, KEYS, "left")
            .withColumn("state_threshold", F.when(F.col("selected_count") > 0, F.col("state_threshold")))
            .withColumn("state_delta_vs_constant_s_f", F.col("state_s_f") - F.col("selected_s_f"))
        )
    return out, chosen


def multi_horizon(assets: DataFrame, drivers: DataFrame, windows: dict[int, tuple[int, int]], **options) -> DataFrame:
    """Screening on sums over non-overlapping horizons; ``windows``: horizon -> (train, test)."""
    ya, xa = align.nonoverlap_sum(assets, windows), align.nonoverlap_sum(drivers, windows)
    ya, xa = materialize(ya), materialize(xa)
    parts = []
    for h, (train, test) in windows.items():
        at = lambda df: df.filter(F.col("horizon") == h).drop("horizon")  # noqa: B023, E731
        rows, _ = evaluate_representation(at(ya), at(xa), train=train, test=test, **options)
        parts.append(rows.withColumn("horizon_sessions", F.lit(h)))
    return covariance.union_all(parts)


def summarize_screening(rows: DataFrame, keys) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("folds"), F.avg("delta_s_f").alias("mean_delta_s_f"),
        F.percentile("relative_reduction_s_f", 0.5).alias("median_relative_reduction_s_f"),
        F.avg((F.col("delta_s_f") < 0).cast("int")).alias("improved_fraction"),
        F.percentile("selected_count", 0.5).alias("median_selected_count"),
    ]
    if "state_delta_vs_constant_s_f" in rows.columns:
        d = F.col("state_delta_vs_constant_s_f")
        aggs += [
            F.avg(d).alias("mean_state_delta_vs_constant_s_f"),
            # a fold without a state model counts as not improved
            F.avg(F.coalesce(d < 0, F.lit(False)).cast("int")).alias("state_improved_fraction"),
        ]
    return rows.groupBy(*keys).agg(*aggs)


LIST = 256


def shared_labels(pairs: DataFrame, width: int = LIST) -> DataFrame:
    """(panel_a, panel_b, shared) for the panels that share labels; ``pairs``: distinct (p, l).

    The panels of a label form its list.  A list longer than ``width`` is cut into pieces by hash and
    every two pieces meet in a group of their own, so a label that all panels have is no hot key.
    """
    length = pairs.groupBy("l").agg(F.ceil(F.count(F.lit(1)) / width).cast("int").alias("cuts"))
    own = F.pmod(F.xxhash64("p"), F.col("cuts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    placed = pairs.join(length, "l").withColumn("own", own).select("l", "p", "own", F.explode(meets).alias("at"))
    lists = placed.groupBy("l", "at").agg(
        F.collect_list(F.when(F.col("own") == F.col("at.i"), F.col("p"))).alias("left"), F.collect_list(F.when(F.col("own") == F.col("at.j"), F.col("p"))).alias("right")
    )
    a = lists.select("right", F.explode("left").alias("a"), (F.col("at.i") == F.col("at.j")).alias("same"))
    met = a.select("a", F.explode(F.filter("right", lambda b: ~F.col("same") | (b > F.col("a")))).alias("b"))
    return met.groupBy(F.least("a", "b").alias("panel_a"), F.greatest("a", "b").alias("panel_b")).agg(F.count(F.lit(1)).alias("shared"))


def jaccard_selected(selections: DataFrame, panel: str = "panel_id", label: str = "series", with_zero: bool = True) -> DataFrame:
    """Overlap of the distinct labels chosen in each pair of panels.

    Pairs that share a label come from the label lists.  ``with_zero`` adds all other pairs, whose number
    is that of the answer: panels are numbered and each one lists the numbers below its own.
    """
    pairs = materialize(selections.select(F.col(panel).alias("p"), F.col(label).alias("l")).distinct())
    size = materialize(pairs.groupBy("p").agg(F.count(F.lit(1)).alias("size")))
    shared = shared_labels(pairs)
    if with_zero:
        nth = materialize(size.select("p", (F.row_number().over(Window.orderBy("p")) - 1).alias("k")))
        below = nth.filter("k > 0").select(F.col("p").alias("panel_b"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("k"))
        every = below.join(nth.withColumnRenamed("p", "panel_a"), "k").select("panel_a", "panel_b")
        shared = every.join(shared, ["panel_a", "panel_b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    both = shared.join(size.toDF("panel_a", "na"), "panel_a").join(size.toDF("panel_b", "nb"), "panel_b")
    union = F.greatest(F.col("na") + F.col("nb") - F.col("shared"), F.lit(1))
    return both.select("panel_a", "panel_b", (F.col("shared") / union).alias("jaccard_selected_labels"))


def selection_frequency(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("panel_id", "series").agg(F.count(F.lit(1)).alias("folds_selected"))


def pca_features(rows: DataFrame, index: DataFrame, placed_x: DataFrame, design, fit_members, k: DataFrame) -> DataFrame:
    """Scores of the leading components of the standardised drivers, frozen on the fit dates.

    ``k``: keys, k (components per fold).
    """
    narrow = index.filter("role = 'driver'").withColumn("idx", F.col("idx") - F.col("n_assets")).withColumn(
        "n_series", F.col("n_series") - F.col("n_assets")
    )
    x = rows.filter("role = 'driver'").drop("idx", "n_series", "n_assets").join(narrow, ["panel_id", "role", "series"])
    cov = materialize(moments.fold_covariance(x, design, fit_members))
    diag = cov.filter("i = j").select(*KEYS, "i", "mi", F.sqrt("v").alias("s"))
    scale = F.when(F.col("s") > regress.SCALE_FLOOR, F.col("s")).otherwise(1.0)
    scales = diag.select(*KEYS, F.col("i").alias("idx"), F.col("mi").alias("m"), scale.alias("s"))
    corr = (
        cov.join(scales.select(*KEYS, F.col("idx").alias("i"), F.col("s").alias("si")), [*KEYS, "i"])
        .join(scales.select(*KEYS, F.col("idx").alias("j"), F.col("s").alias("sj")), [*KEYS, "j"])
        .withColumn("v", F.col("v") / (F.col("si") * F.col("sj")))
    )
    loadings = covariance.leading_vectors(corr, k).join(scales, [*KEYS, "idx"]).join(
        narrow.select("panel_id", "idx", "series"), ["panel_id", "idx"]
    )
    part = F.col("loading") * (F.col("value") - F.col("m")) / F.col("s")
    return (
        placed_x.select(*KEYS, "segment", "pos", "series", "value")
        .join(loadings.select(*KEYS, "series", "comp", "loading", "m", "s"), [*KEYS, "series"])
        .groupBy(*KEYS, "segment", "pos", F.col("comp").alias("slot")).agg(F.sum(part).alias("z"))
    )


def screen_certify_test(
    assets: DataFrame, drivers: DataFrame, *, selection_len: int, certification_len: int, test_len: int,
    penalty: float = 0.01, max_drivers: int = 8, observable=(), spectrum: bool = True,
) -> dict[str, DataFrame]:
    """Select, certify the frozen fit, refit on both and test, with comparators.

    Returns ``results`` (keys, stage, metrics, long), ``path``, ``ledger`` and ``chosen``.
    """
    design = folds.three_segment(selection_len, certification_len, test_len)
    segments = {
        "selection": ["selection"], "certification": ["certification"],
        "development": ["selection", "certification"], "test": ["test"],
    }
    rows, index = prepare(assets, drivers)
    tiles = moments.fold_tiles(rows, design, ["selection"])
    state = selection.greedy_select(tiles, index, penalty=penalty, max_drivers=max_drivers, backward=True)
    chosen = materialize(selection.named_selection(state, index))
    placed = folds.assign_folds(rows, design, segments)
    y, x = split_roles(placed)
    picked = regress.selected_features(x, chosen)
    # components beyond the number of drivers do not exist, as in a full decomposition
    k_folds = state.select(*KEYS, F.greatest(F.size("chosen"), F.lit(1)).alias("k"))
    k_two = k_folds.withColumn("k", F.col("k") + 2)
    scores = materialize(pca_features(rows, index, x, design, segments["development"], k_two))
    matched = scores.join(k_folds, KEYS).filter("slot < k").drop("k")
    models = {
        "selection_selected": ("picked", "selection", "selection"),
        "certification_selected_frozen": ("picked", "selection", "certification"),
        "test_selected_frozen": ("picked", "development", "test"),
        "test_pca_matched": ("matched", "development", "test"),
        "test_pca_plus_two": ("scores", "development", "test"),
    }
    features = {"picked": picked, "matched": matched, "scores": scores}
    if observable:
        models["test_observable_set"] = ("fixed", "development", "test")
        features["fixed"] = regress.selected_features(x, selection.fixed_selection(state.select(*KEYS), list(observable)))
    uses = lambda names: [
        (stage, part, seg) for stage, (f, a, b) in models.items() if f in names for part, seg in (("fit", a), ("judge", b))
    ]
    by = [*KEYS, "stage"]
    z = covariance.union_all([by_stage(f, uses([name])) for name, f in features.items()])
    slots = max(max_drivers + 2, len(observable))
    # every model of every fold in one regression job
    e = regress.frozen_residuals(by_stage(y, uses(list(features))), z, slots, "fit", "judge", by)
    raw = ["selection", "certification", "test"]
    bare = y.filter(F.col("segment").isin(raw)).withColumn("stage", F.concat("segment", F.lit("_no_conditioning")))
    columns = [*by, "pos", "idx", "n_series", "value"]
    results = metrics(bare.select(*columns).unionByName(e.select(*columns)), by, None, spectrum)
    if spectrum:
        results = results.drop("effective_rank")
    results = materialize(results)
    # a fold that chose nothing is judged on its baseline
    idle = state.filter(F.size("chosen") == 0).select(*KEYS)
    names = F.explode(F.array(*[F.struct(F.lit(b).alias("stage"), F.lit(s).alias("as_stage")) for s, b in UNCONDITIONED.items()]))
    alias = idle.select(*KEYS, names.alias("n")).select(*KEYS, "n.*")
    same = results.join(alias, by).drop("stage").withColumnRenamed("as_stage", "stage")
    results = results.unionByName(same.select(*results.columns))
    cal = rows.select(*KEY, "pos", "n_dates").distinct()
    pool = index.filter("role = 'driver'").groupBy("panel_id").agg(F.count(F.lit(1)).alias("driver_pool_count"))
    names = chosen.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "series"))), lambda s: s["series"]).alias("selected_drivers")
    )
    ledger = (
        folds.fold_calendar(cal, design).join(names, KEYS, "left").join(pool, "panel_id")
        .withColumn("selected_drivers", F.coalesce("selected_drivers", F.array().cast("array<string>")))
        .withColumn("selected_count", F.size("selected_drivers"))
        .withColumn("penalty", F.lit(penalty)).withColumn("max_drivers", F.lit(max_drivers))
        .withColumn("selection_dates_used", F.lit(selection_len)).withColumn("certification_dates_used", F.lit(certification_len))
        .withColumn("test_dates_used", F.lit(test_len))
    )
    objective = state.select(*KEYS, (F.col("score") + penalty * F.size("chosen")).alias("selection_objective"))
    return {
        "results": results, "path": selection.selection_path(state, index), "ledger": ledger.join(objective, KEYS), "chosen": chosen,
    }


def selection_report(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counts and test score reductions over folds."""
    test = results.filter(F.col("stage").isin("test_no_conditioning", "test_selected_frozen")).groupBy(*KEYS).pivot(
        "stage", ["test_no_conditioning", "test_selected_frozen"]
    ).agg(F.max("s_f"))
    d = F.col("test_no_conditioning") - F.col("test_selected_frozen")
    return test.join(ledger.select(*KEYS, "selected_count"), KEYS).groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("folds"), F.percentile("selected_count", 0.5).alias("median_selected_count"),
        F.avg("selected_count").alias("mean_selected_count"), F.percentile(d, 0.5).alias("median_test_s_f_reduction"),
        F.avg(d).alias("mean_test_s_f_reduction"), F.avg((d > 0).cast("int")).alias("fraction_test_folds_improved"),
    )


def group_summary(results: DataFrame, keys, medians=(), means=()) -> DataFrame:
    """Medians and means of a result table by key."""
    return results.groupBy(*keys).agg(
        *[F.percentile(c, 0.5).alias(f"median_{c}") for c in medians], *[F.avg(c).alias(f"mean_{c}") for c in means]
    )


def prefixed_metrics(results: DataFrame, stages, columns) -> DataFrame:
    """Wide fold rows <stage>_<metric> for reports; stages are a fixed short list."""
    aggs = [F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{s}_{c}") for s in stages for c in columns]
    return results.groupBy(*KEYS).agg(*aggs)
