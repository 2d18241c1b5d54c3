"""Queries: rolling screening, its summaries and comparators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.alignment import state_level
from catalog.estimation import (
    GREEDY_PENALTY, GREEDY_ROUNDS, OBSERVABLE, PATH_SQL, SCREEN, aligned_panels, aligned_rows, assigned, greedy_state, observable_features, score_sql,
    sweep_rounds,
)
from catalog.inference import BOOT, SEED, SIGN, strategy_results
from catalog.inputs import CTE, cte, with_
from catalog.registry import query, sql
from foldwise.operators import align as A
from foldwise.operators import folds as FD
from foldwise.operators import inference as IN
from foldwise.operators import moments as M
from foldwise.operators import regress as RG
from foldwise.operators import selection as S
from foldwise.plans import screening as SC
from foldwise.session import materialize

# ---------------------------------------------------------------- SQL for "select, freeze, judge"


def window_rows(name, source, lo, length, total, step):
    cte(
        name, source,
        f"SELECT k + 1 AS fold_id, r.* FROM {source} r JOIN (SELECT unnest(range(0, (max(n_dates) - {total}) // {step} + 1)) AS k FROM {source}) g "
        f"ON pos BETWEEN k * {step} + {lo} AND k * {step} + {lo + length - 1}",
    )


def covariance_of(name, rows):
    cte(
        name, rows,
        f"SELECT a.fold_id, a.idx AS i, b.idx AS j, covar_samp(a.value, b.value) AS v FROM {rows} a JOIN {rows} b ON a.fold_id = b.fold_id AND a.pos = b.pos AND a.idx <= b.idx "
        "GROUP BY 1, 2, 3",
    )


def assets_of(name, rows):
    cte(name, rows, f"SELECT * FROM {rows} WHERE role = 'asset'")


def choice(name, best):
    """Up to two drivers per fold from two forward rounds."""
    cte(
        name, f"{best}2 {best}0",
        f"SELECT z.fold_id, CASE WHEN a.better THEN a.q END AS q1, CASE WHEN b.better THEN b.q END AS q2 FROM {best}0 z LEFT JOIN {best}1 a ON a.fold_id = z.fold_id LEFT JOIN {best}2 b ON b.fold_id = z.fold_id",
    )


def frozen(name, fit, judge, pick):
    """Residuals of the assets on ``judge`` rows, coefficients from ``fit`` rows."""
    cte(
        f"{name}m", f"{fit} {pick}",
        "SELECT y.fold_id, y.idx, s.q1, s.q2, avg(y.value) AS my, avg(a.value) AS ma, avg(b.value) AS mb, covar_samp(y.value, a.value) AS ya, covar_samp(y.value, b.value) AS yb, "
        f"var_samp(a.value) AS aa, var_samp(b.value) AS bb, covar_samp(a.value, b.value) AS ab FROM {fit} y JOIN {pick} s ON s.fold_id = y.fold_id "
        f"LEFT JOIN {fit} a ON a.fold_id = y.fold_id AND a.pos = y.pos AND a.idx = s.q1 LEFT JOIN {fit} b ON b.fold_id = y.fold_id AND b.pos = y.pos AND b.idx = s.q2 WHERE y.role = 'asset' GROUP BY 1, 2, 3, 4",
    )
    cte(
        name, f"{name}m {judge}",
        "SELECT y.fold_id, y.dt, y.pos, y.series, y.idx, y.value - (my + coalesce(CASE WHEN q2 IS NULL THEN ya / aa ELSE (bb * ya - ab * yb) / (aa * bb - ab * ab) END * (a.value - ma), 0) "
        f"+ coalesce((aa * yb - ab * ya) / (aa * bb - ab * ab) * (b.value - mb), 0)) AS value FROM {judge} y JOIN {name}m p ON p.fold_id = y.fold_id AND p.idx = y.idx "
        f"LEFT JOIN {judge} a ON a.fold_id = y.fold_id AND a.pos = y.pos AND a.idx = p.q1 LEFT JOIN {judge} b ON b.fold_id = y.fold_id AND b.pos = y.pos AND b.idx = p.q2 WHERE y.role = 'asset'",
    )
    covariance_of(f"{name}c", name)


def screening(name, rows_tr, rows_te, best):
    """Baseline and frozen test scores per fold: piece <name>."""
    choice(f"{name}sel", best)
    frozen(f"{name}res", rows_tr, rows_te, f"{name}sel")
    assets_of(f"{name}tea", rows_te)
    covariance_of(f"{name}base", f"{name}tea")
    cte(
        name, f"{name}resc {name}base {name}sel al",
        f"SELECT b.fold_id - 1 AS fold_id, CAST(q1 IS NOT NULL AS INTEGER) + CAST(q2 IS NOT NULL AS INTEGER) AS selected_count, "
        "concat_ws(' | ', (SELECT DISTINCT series FROM al WHERE idx = q1), (SELECT DISTINCT series FROM al WHERE idx = q2)) AS selected_drivers, "
        "b.s_f AS baseline_s_f, b.s_inf AS baseline_s_inf, r.s_f AS selected_s_f, r.s_inf AS selected_s_inf, r.s_f - b.s_f AS delta_s_f, (b.s_f - r.s_f) / b.s_f AS relative_reduction_s_f "
        f"FROM ({score_sql(name + 'base')}) b JOIN {name}sel s ON s.fold_id = b.fold_id JOIN (SELECT r.fold_id, CASE WHEN z.q1 IS NULL THEN c.s_f ELSE r.s_f END AS s_f, CASE WHEN z.q1 IS NULL THEN c.s_inf ELSE r.s_inf END AS s_inf "
        f"FROM ({score_sql(name + 'resc')}) r JOIN ({score_sql(name + 'base')}) c ON c.fold_id = r.fold_id JOIN {name}sel z ON z.fold_id = r.fold_id) r ON r.fold_id = b.fold_id",
    )


screening("scr1", "str", "ste", "gbest")
SCREEN_KEEP, SCREEN_INT = "selected_drivers", "fold_id selected_count"
SCREEN_NUM = "baseline_s_f baseline_s_inf selected_s_f selected_s_inf delta_s_f relative_reduction_s_f"
SCREEN_COLS = (SCREEN_KEEP + " " + SCREEN_INT + " " + SCREEN_NUM).split()
OPTIONS = dict(max_drivers=2, penalty=GREEDY_PENALTY, spectrum=False)


@query("evaluate_representation", sql(with_("scr1"), "SELECT * FROM scr1", SCREEN_KEEP, SCREEN_INT, SCREEN_NUM))
def evaluate_representation(spark, sf):
    y, x = aligned_panels(spark, sf)
    return SC.evaluate_representation(y, x, train=104, test=26, **OPTIONS)[0].select(*SCREEN_COLS)


@query("evaluate_representation_state")
def evaluate_representation_state(spark, sf):
    """Published settings with state model and spectra; the models are checked by brute force in the tests."""
    y, x = aligned_panels(spark, sf)
    r, _ = SC.evaluate_representation(y, x, train=104, test=26, max_drivers=6, penalty=GREEDY_PENALTY, state=state_level(spark, sf))
    return r.drop("panel_id", "design")


# five-week sums, ending on the last date
cte(
    "al5", "al",
    "SELECT max(dt) AS dt, role, series, sum(value) AS value, block AS pos, max(nb) AS n_dates, idx, max(n_assets) AS n_assets FROM (SELECT *, n_dates // 5 AS nb, n_dates // 5 - 1 - (n_dates - 1 - pos) // 5 AS block FROM al) q "
    "WHERE block >= 0 GROUP BY role, series, block, idx",
)
window_rows("v5tr", "al5", 0, 36, 42, 6)
window_rows("v5te", "al5", 36, 6, 42, 6)
covariance_of("v5trcov", "v5tr")
sweep_rounds("h", "v5trcov", 2, GREEDY_PENALTY)
screening("scr5", "v5tr", "v5te", "hbest")
HORIZON_SQL = "SELECT 1 AS horizon_sessions, * FROM scr1 UNION ALL SELECT 5, * FROM scr5"


def horizons(spark, sf):
    y, x = aligned_panels(spark, sf)
    return SC.multi_horizon(y, x, {1: (104, 26), 5: (36, 6)}, **OPTIONS)


@query("multi_horizon_screen", sql(with_("scr1", "scr5"), HORIZON_SQL, SCREEN_KEEP, "horizon_sessions " + SCREEN_INT, SCREEN_NUM))
def multi_horizon_screen(spark, sf):
    return horizons(spark, sf).select("horizon_sessions", *SCREEN_COLS)


@query(
    "screening_summary",
    sql(
        with_("scr1", "scr5", h=HORIZON_SQL),
        "SELECT horizon_sessions, count(*) AS folds, avg(delta_s_f) AS mean_delta_s_f, quantile_cont(relative_reduction_s_f, 0.5) AS median_relative_reduction_s_f, "
        "avg(CASE WHEN delta_s_f < 0 THEN 1.0 ELSE 0.0 END) AS improved_fraction, quantile_cont(selected_count, 0.5) AS median_selected_count FROM h GROUP BY 1",
        "", "horizon_sessions folds", "mean_delta_s_f median_relative_reduction_s_f improved_fraction median_selected_count",
    ),
)
def screening_summary(spark, sf):
    return SC.summarize_screening(horizons(spark, sf), ["horizon_sessions"])


@query(
    "selection_frequency",
    sql(with_(f"gbest{GREEDY_ROUNDS}", path=PATH_SQL), "SELECT driver AS series, count(*) AS folds_selected FROM path GROUP BY 1", "series", "folds_selected"),
)
def selection_frequency(spark, sf):
    state, index = greedy_state(spark, sf)
    return SC.selection_frequency(S.named_selection(state, index)).drop("panel_id")


JACCARD = (
    "SELECT a.p AS panel_a, b.p AS panel_b, (SELECT count(*) FROM s x JOIN s y ON x.l = y.l WHERE x.p = a.p AND y.p = b.p) / greatest((SELECT count(DISTINCT l) FROM s z WHERE z.p = a.p OR z.p = b.p), 1) "
    "AS jaccard_selected_labels FROM (SELECT DISTINCT p FROM s) a JOIN (SELECT DISTINCT p FROM s) b ON a.p < b.p"
)


@query(
    "jaccard_selected",
    sql("WITH s AS (SELECT DISTINCT o_orderpriority AS p, o_custkey AS l FROM orders)", JACCARD, "panel_a panel_b", num="jaccard_selected_labels"),
)
def jaccard_selected(spark, sf):
    o = I.table(spark, sf, "orders").select("o_orderpriority", "o_custkey")
    return SC.jaccard_selected(o, "o_orderpriority", "o_custkey")


@query(
    "ordered_pair_join",
    sql(
        "WITH s AS (SELECT DISTINCT p_brand AS p, l_suppkey AS l FROM lineitem JOIN part ON l_partkey = p_partkey)", JACCARD,
        "panel_a panel_b", num="jaccard_selected_labels",
    ),
)
def ordered_pair_join(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    part = I.table(spark, sf, "part").select("p_partkey", "p_brand")
    return SC.jaccard_selected(li.join(part, F.col("l_partkey") == F.col("p_partkey")), "p_brand", "l_suppkey")


# ---------------------------------------------------------------- state features

cte("stt", "state both_dt", (
    "SELECT dt, pos, coalesce(last_value(value IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(value IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM (SELECT d.dt, d.pos, s.value FROM both_dt d LEFT JOIN state s ON s.dt = d.dt) q"
))
cte(
    "stf", "stt str ste",
    "SELECT r.fold_id, r.segment, r.dt, CAST(s.value > t.threshold AS DOUBLE) AS high, t.threshold FROM (SELECT DISTINCT fold_id, 'training' AS segment, dt FROM str UNION ALL SELECT DISTINCT fold_id, 'test', dt FROM ste) r "
    "JOIN stt s ON s.dt = r.dt JOIN (SELECT f.fold_id, quantile_cont(s.value, 0.5) AS threshold FROM (SELECT DISTINCT fold_id, dt FROM str) f JOIN stt s ON s.dt = f.dt GROUP BY 1) t ON t.fold_id = r.fold_id",
)
_obs = "(SELECT fold_id, 'training' AS segment, dt, series, value FROM str UNION ALL SELECT fold_id, 'test', dt, series, value FROM ste)"


@query(
    "state_interaction_features",
    sql(
        with_("stf"),
        "SELECT f.fold_id, f.segment, f.dt, f.threshold, a.value AS z0, b.value AS z1, high AS z2, a.value * high AS z3, b.value * high AS z4 FROM stf f "
        f"JOIN {_obs} a ON a.fold_id = f.fold_id AND a.segment = f.segment AND a.dt = f.dt AND a.series = '1-URGENT' JOIN {_obs} b ON b.fold_id = f.fold_id AND b.segment = f.segment AND b.dt = f.dt AND b.series = 'BUILDING'",
        "segment dt", "fold_id", "threshold z0 z1 z2 z3 z4",
    ),
)
def state_interaction_features(spark, sf):
    y, x, rows, _ = assigned(spark, sf)
    cal = rows.select("panel_id", "dt", "pos", "n_dates").distinct()
    chosen = S.fixed_selection(y.select(*M.KEYS).distinct(), OBSERVABLE)
    z, level = SC.state_features(x, chosen, A.state_on_dates(state_level(spark, sf), cal), cal, SCREEN, 2)
    wide = RG.feature_columns(z, 5).join(level, M.KEYS).join(cal.select("panel_id", "pos", "dt"), ["panel_id", "pos"])
    return wide.select("fold_id", "segment", "dt", F.col("state_threshold").alias("threshold"), *RG.slot_columns(5))


# ---------------------------------------------------------------- select, certify, test

for _name, _lo, _len in (("csel", 0, 104), ("ccer", 104, 52), ("cdev", 0, 156), ("ctst", 156, 26)):
    window_rows(_name, "al", _lo, _len, 182, 26)
covariance_of("cselcov", "csel")
sweep_rounds("k", "cselcov", 2, GREEDY_PENALTY)
choice("kpick", "kbest")
cte("opick", "kbest0 al", "SELECT fold_id, (SELECT DISTINCT idx FROM al WHERE series = '1-URGENT') AS q1, (SELECT DISTINCT idx FROM al WHERE series = 'BUILDING') AS q2 FROM kbest0")
STAGE_PIECES = {}
for _stage, _fit, _judge, _pick in (
    ("selection_selected", "csel", "csel", "kpick"), ("certification_selected_frozen", "csel", "ccer", "kpick"),
    ("test_selected_frozen", "cdev", "ctst", "kpick"), ("test_observable_set", "cdev", "ctst", "opick"),
):
    frozen("r" + _stage.replace("_", ""), _fit, _judge, _pick)
    STAGE_PIECES[_stage] = "r" + _stage.replace("_", "") + "c"
for _stage, _rows in (("selection_no_conditioning", "csel"), ("certification_no_conditioning", "ccer"), ("test_no_conditioning", "ctst")):
    assets_of(_rows + "a", _rows)
    covariance_of(_rows + "ac", _rows + "a")
    STAGE_PIECES[_stage] = _rows + "ac"
cte("stages0", " ".join(STAGE_PIECES.values()), " UNION ALL ".join(f"SELECT '{s}' AS stage, q.* FROM ({score_sql(c)}) q" for s, c in STAGE_PIECES.items()))
# folds that chose nothing take the scores of the unconditioned stage
cte(
    "stages", "stages0 kpick",
    "SELECT s.stage, s.fold_id, CASE WHEN k.q1 IS NULL AND b.stage IS NOT NULL THEN b.s_f ELSE s.s_f END AS s_f, CASE WHEN k.q1 IS NULL AND b.stage IS NOT NULL THEN b.s_inf ELSE s.s_inf END AS s_inf, "
    "CASE WHEN k.q1 IS NULL AND b.stage IS NOT NULL THEN b.cov_offdiag_f ELSE s.cov_offdiag_f END AS cov_offdiag_f FROM stages0 s JOIN kpick k ON k.fold_id = s.fold_id LEFT JOIN stages0 b ON b.fold_id = s.fold_id "
    "AND b.stage = CASE s.stage " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SC.UNCONDITIONED.items()) + " END",
)
SCORES = "s_f s_inf cov_offdiag_f"


def certified(spark, sf, spectrum=False, **options):
    y, x = aligned_panels(spark, sf)
    settings = dict(penalty=GREEDY_PENALTY, max_drivers=2) | options
    return SC.screen_certify_test(
        y, x, selection_len=104, certification_len=52, test_len=26, observable=OBSERVABLE, spectrum=spectrum, **settings
    )


@query("screen_certify_test", sql(with_("stages"), "SELECT * FROM stages", "stage", "fold_id", SCORES))
def screen_certify_test(spark, sf):
    """All stages are computed; those with component regressions are in screen_certify_all."""
    r = certified(spark, sf)["results"]
    return r.filter(~F.col("stage").contains("pca")).select("stage", "fold_id", *SCORES.split())


@I.staged("certified_all")
def certified_all(spark, sf):
    return materialize(certified(spark, sf, spectrum=True, max_drivers=8, penalty=0.0001)["results"])


@query("screen_certify_all")
def screen_certify_all(spark, sf):
    r = certified_all(spark, sf)
    return r.select("stage", "fold_id", *SCORES.split(), "cov_offdiag_spectral")


@query(
    "prefixed_metrics",
    sql(
        with_("stages"),
        "SELECT fold_id, " + ", ".join(
            f"max({c}) FILTER (stage = '{s}') AS {s}_{c}" for s in STAGE_PIECES for c in SCORES.split()
        ) + " FROM stages GROUP BY 1",
        "", "fold_id", " ".join(f"{s}_{c}" for s in STAGE_PIECES for c in SCORES.split()),
    ),
)
def prefixed_metrics(spark, sf):
    return SC.prefixed_metrics(certified(spark, sf)["results"], list(STAGE_PIECES), SCORES.split()).drop("panel_id", "design")


LEDGER_SPAN = ", ".join(
    f"(SELECT dt FROM both_dt WHERE pos = (p.fold_id - 1) * 26 + {at}) AS {n}"
    for n, at in (("selection_start", 0), ("selection_end", 103), ("certification_start", 104), ("certification_end", 155), ("test_start", 156), ("test_end", 181))
)


@query(
    "fold_ledger",
    sql(
        with_("kpick", "al"),
        f"SELECT p.fold_id, {LEDGER_SPAN}, CAST(q1 IS NOT NULL AS INTEGER) + CAST(q2 IS NOT NULL AS INTEGER) AS selected_count, "
        "concat_ws(' | ', (SELECT DISTINCT series FROM al WHERE idx = q1), (SELECT DISTINCT series FROM al WHERE idx = q2)) AS selected_drivers, 10 AS driver_pool_count, "
        f"{GREEDY_PENALTY!r} AS penalty, 2 AS max_drivers, 104 AS selection_dates_used, 52 AS certification_dates_used, 26 AS test_dates_used FROM kpick p",
        "selection_start selection_end certification_start certification_end test_start test_end selected_drivers",
        "fold_id selected_count driver_pool_count max_drivers selection_dates_used certification_dates_used test_dates_used", "penalty",
    ),
)
def fold_ledger(spark, sf):
    led = certified(spark, sf)["ledger"]
    return led.withColumn("selected_drivers", F.array_join("selected_drivers", " | ")).drop("panel_id", "design", "selection_objective")


@query(
    "selection_report",
    sql(
        with_("stages", "kpick", d=(
            "SELECT a.fold_id, a.s_f - b.s_f AS d, CAST(q1 IS NOT NULL AS INTEGER) + CAST(q2 IS NOT NULL AS INTEGER) AS c FROM stages a JOIN stages b ON a.fold_id = b.fold_id AND a.stage = 'test_no_conditioning' "
            "AND b.stage = 'test_selected_frozen' JOIN kpick p ON p.fold_id = a.fold_id"
        )),
        "SELECT count(*) AS folds, quantile_cont(c, 0.5) AS median_selected_count, avg(c) AS mean_selected_count, quantile_cont(d, 0.5) AS median_test_s_f_reduction, avg(d) AS mean_test_s_f_reduction, "
        "avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END) AS fraction_test_folds_improved FROM d",
        "", "folds", "median_selected_count mean_selected_count median_test_s_f_reduction mean_test_s_f_reduction fraction_test_folds_improved",
    ),
)
def selection_report(spark, sf):
    c = certified(spark, sf)
    return SC.selection_report(c["results"], c["ledger"]).drop("panel_id")


# family per metric: selected drivers against no conditioning and the fixed set, with the pieces of the covariance family
cte(
    "sdiffs", "stages",
    "SELECT u.metric AS design, replace(u.stage, 'test_', '') AS comparison, u.fold_id, r.v - u.v AS diff, row_number() OVER (PARTITION BY u.metric, u.stage ORDER BY u.fold_id) - 1 AS pos, "
    "count(*) OVER (PARTITION BY u.metric, u.stage) AS n FROM (UNPIVOT stages ON s_f, s_inf, cov_offdiag_f INTO NAME metric VALUE v) u JOIN (UNPIVOT stages ON s_f, s_inf, cov_offdiag_f INTO NAME metric VALUE v) r "
    "ON r.fold_id = u.fold_id AND r.metric = u.metric AND r.stage = 'test_selected_frozen' WHERE u.stage IN ('test_no_conditioning', 'test_observable_set')",
)
for _n in ("psum", "boot", "flips", "maxt"):
    _deps, _body = CTE[_n]
    for _o in ("diffs", "psum", "boot", "flips"):
        import re as _re

        _body = _re.sub(rf"\b{_o}\b(?! AS)", "s" + _o, _body)
        _deps = _re.sub(rf"\b{_o}\b", "s" + _o, _deps)
    cte("s" + _n, _deps, _body.replace("'sboot'", "'boot'"))


def _renamed(text):
    for o in ("psum", "boot", "flips", "maxt"):
        text = _re.sub(rf"\b{o}\b", "s" + o, text)
    return text


from catalog.inference import CI_SQL, P_SQL, SIM_SQL  # noqa: E402


@query(
    "inference_selection_family",
    sql(
        with_("smaxt", "sflips", ci=_renamed(CI_SQL), sim=_renamed(SIM_SQL), pv=_renamed(P_SQL)),
        "SELECT p.design AS metric, p.comparison, p.folds, p.mean_difference, p.standard_error, ci.bootstrap_ci_lower, ci.bootstrap_ci_upper, sim.simultaneous_ci_lower, sim.simultaneous_ci_upper, "
        "pv.sign_flip_p_raw, pv.sign_flip_p_familywise, p.fraction_reference_better FROM spsum p JOIN ci ON ci.design = p.design AND ci.comparison = p.comparison "
        "JOIN sim ON sim.design = p.design AND sim.comparison = p.comparison JOIN pv ON pv.design = p.design AND pv.comparison = p.comparison",
        "metric comparison", "folds",
        "mean_difference standard_error bootstrap_ci_lower bootstrap_ci_upper simultaneous_ci_lower simultaneous_ci_upper sign_flip_p_raw sign_flip_p_familywise fraction_reference_better",
    ),
)
def inference_selection_family(spark, sf):
    """Chosen drivers against no conditioning and the named set, a family per metric."""
    r = certified(spark, sf)["results"]
    test = r.filter(F.col("stage").isin("test_selected_frozen", "test_no_conditioning", "test_observable_set"))
    long = test.select("stage", "fold_id", *SCORES.split()).unpivot(["stage", "fold_id"], SCORES.split(), "metric", "value")
    long = materialize(long.withColumn("method", F.regexp_replace("stage", "^test_", "")))
    d = materialize(IN.paired_differences(long, ["metric"], "selected_frozen", "value"))
    return IN.family_inference(d, ["metric"], bootstrap_reps=BOOT, sign_reps=SIGN, seed=SEED).drop("t")


@query(
    "experiment_summary",
    sql(
        with_("strat"),
        "SELECT design, method, quantile_cont(realized_variance, 0.5) AS median_realized_variance, quantile_cont(predicted_variance, 0.5) AS median_predicted_variance, avg(qlike) AS mean_qlike FROM strat GROUP BY 1, 2",
        "design method", num="median_realized_variance median_predicted_variance mean_qlike",
    ),
)
def experiment_summary(spark, sf):
    return SC.group_summary(
        strategy_results(spark, sf), ["design", "method"], ["realized_variance", "predicted_variance"], ["qlike"]
    )


# ---------------------------------------------------------------- component regression

N_ASSETS, N_DRIVERS = 25, 10
cte("x0", "strcov", "SELECT fold_id, i, j, v FROM strcov UNION ALL SELECT fold_id, j, i, v FROM strcov WHERE i <> j")
for _k in range(N_DRIVERS):
    _q = N_ASSETS + _k
    cte(
        f"x{_k + 1}", f"x{_k}",
        f"SELECT a.fold_id, a.i, a.j, a.v - r.v * c.v / d.v AS v FROM x{_k} a JOIN x{_k} d ON d.fold_id = a.fold_id AND d.i = {_q} AND d.j = {_q} "
        f"JOIN x{_k} r ON r.fold_id = a.fold_id AND r.i = a.i AND r.j = {_q} JOIN x{_k} c ON c.fold_id = a.fold_id AND c.i = {_q} AND c.j = a.j WHERE a.i <> {_q} AND a.j <> {_q}",
    )
cte("xall", f"x{N_DRIVERS}", f"SELECT * FROM x{N_DRIVERS} WHERE i <= j")


@query("pca_scores", sql(with_("xall"), score_sql("xall"), "", "fold_id", SCORES))
def pca_scores(spark, sf):
    """Certificate: all components together explain what all drivers explain (training residuals)."""
    rows, index = aligned_rows(spark, sf)
    y, x = SC.split_roles(FD.assign_folds(rows, SCREEN))
    k = y.select(*M.KEYS).distinct().withColumn("k", F.lit(N_DRIVERS))
    z = SC.pca_features(rows, index, x, SCREEN, ["training"], k)
    e = RG.frozen_residuals(y, z, N_DRIVERS, "training", "training")
    return M.offdiag_scores(e, M.KEYS).select("fold_id", *SCORES.split())


# ---------------------------------------------------------------- families over the published comparisons


@query("inference_selection_all")
def inference_selection_all(spark, sf):
    """Four metrics x four comparators: the chosen drivers, frozen, against no conditioning, components and the named set."""
    family, metrics_ = ["metric"], [*SCORES.split(), "cov_offdiag_spectral"]
    stages = ["selected_frozen", "no_conditioning", "pca_matched", "pca_plus_two", "observable_set"]
    test = certified_all(spark, sf).withColumn("method", F.regexp_replace("stage", "^test_", "")).filter(F.col("stage").startswith("test_") & F.col("method").isin(stages))
    d = materialize(IN.metric_families(test, [], metrics_, "selected_frozen"))
    return IN.family_inference(d, family, seed=IN.seeded(d, family, SEED))


@query("inference_extended_families")
def inference_extended_families(spark, sf):
    """The three families of the screening study (panels, horizons, state model) at 20,000 and 200,000 draws."""
    y, x = aligned_panels(spark, sf)
    settings = dict(max_drivers=6, penalty=GREEDY_PENALTY)
    one, _ = SC.evaluate_representation(y, x, train=104, test=26, state=state_level(spark, sf), **settings)
    one = materialize(one)
    many = materialize(SC.multi_horizon(y, x, {1: (104, 26), 5: (36, 6)}, spectrum=False, **settings))
    rows = lambda family, comparison, df, c: df.select(F.lit(family).alias("family"), comparison.alias("comparison"), "fold_id", F.col(c).alias("diff"))
    d = (
        rows("multiasset", F.col("panel_id"), one, "delta_s_f")
        .unionByName(rows("multihorizon", F.concat("panel_id", F.lit("_h"), F.col("horizon_sessions").cast("string")), many, "delta_s_f"))
        .unionByName(rows("state_interaction", F.col("panel_id"), one, "state_delta_vs_constant_s_f"))
    )
    return IN.extended_inference(d, ["family"], seed=SEED + 1)
