"""Queries: paired inference, resampling, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.alignment import fold_sql, type_returns
from catalog.inputs import cte, with_
from catalog.registry import query, sql
from foldwise.functions import expr as X
from foldwise.operators import calendar as C
from foldwise.operators import folds as FD
from foldwise.operators import inference as IN
from foldwise.operators import moments as M
from foldwise.operators import returns as R
from foldwise.session import materialize

# Each type of part as a one-asset strategy: predicted variance from training, realised from test.
FAMILY = ["design"]
SEED = 20260902
REFERENCE = "ECONOMY"


@I.staged("strategy_results")
def strategy_results(spark, sf):
    rows = C.with_positions(materialize(type_returns(spark, sf)))
    parts = None
    for train in (52, 104):
        f = FD.assign_folds(rows, FD.two_segment(train, 26))
        on = lambda s: F.when(F.col("segment") == s, F.col("value"))
        r = f.groupBy("design", "fold_id", F.col("series").alias("method")).agg(
            F.var_samp(on("training")).alias("predicted_variance"), F.var_samp(on("test")).alias("realized_variance")
        )
        parts = r if parts is None else parts.unionByName(r)
    q = F.ln("predicted_variance") + F.col("realized_variance") / F.col("predicted_variance")
    return materialize(parts.withColumn("qlike", q))


def _strat(train):
    return (
        f"SELECT '{train}' AS design, fold_id, method, predicted_variance, realized_variance, ln(predicted_variance) + realized_variance / predicted_variance AS qlike FROM ("
        f"SELECT f.fold_id, t.series AS method, var_samp(t.value) FILTER (t.dt <= f.training_end) AS predicted_variance, var_samp(t.value) FILTER (t.dt > f.training_end) AS realized_variance "
        f"FROM tw t JOIN ({fold_sql('tw_pos', [('training', train), ('test', 26)], 26, 1)}) f ON t.dt BETWEEN f.training_start AND f.test_end GROUP BY 1, 2) q"
    )


cte("strat", "tw tw_pos", _strat(52) + " UNION ALL " + _strat(104))
cte(
    "diffs", "strat",
    "SELECT c.design, c.method AS comparison, c.fold_id, r.qlike - c.qlike AS diff, row_number() OVER (PARTITION BY c.design, c.method ORDER BY c.fold_id) - 1 AS pos, "
    f"count(*) OVER (PARTITION BY c.design, c.method) AS n FROM strat c JOIN strat r ON r.design = c.design AND r.fold_id = c.fold_id AND r.method = '{REFERENCE}' WHERE c.method <> '{REFERENCE}'",
)
cte(
    "psum", "diffs",
    "SELECT design, comparison, count(*) AS folds, avg(diff) AS mean_difference, stddev_samp(diff) / sqrt(count(*)) AS standard_error, "
    "avg(CASE WHEN diff < 0 THEN 1.0 ELSE 0.0 END) AS fraction_reference_better, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM diffs GROUP BY 1, 2",
)


def draw_sql(n, *parts):
    text = ", ".join(f"'{p}'" if isinstance(p, str) and not p.startswith("$") else str(p).lstrip("$") for p in parts)
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT) % {n})"


def boot_cte(name, diffs, reps, seed, by="design"):
    cte(
        name, diffs,
        f"SELECT d.{by}, d.comparison, r.rep, avg(v.diff) AS mean FROM {diffs} d JOIN (SELECT unnest(range(0, {reps})) AS rep) r ON true JOIN {diffs} v ON v.{by} = d.{by} "
        f"AND v.comparison = d.comparison AND v.pos = {draw_sql('d.n', 'boot', seed, '$r.rep', '$d.pos')} GROUP BY 1, 2, 3",
    )


# Replicates as published, for the families and for the extended ones.
BOOT, SIGN, MORE_BOOT = 5000, 20000, 20000
boot_cte("boot", "diffs", BOOT, SEED)
cte(
    "flips", "psum",
    "SELECT d.design, d.comparison, r.rep, coalesce(abs(avg(d.diff * s) / nullif(stddev_samp(d.diff * s) / sqrt(count(*)), 0)), 0) AS t FROM (SELECT q.*, r.rep, "
    f"{draw_sql(2, 'sign', SEED, '$r.rep', '$q.pos')} * 2 - 1 AS s FROM diffs q JOIN (SELECT unnest(range(0, {SIGN})) AS rep) r ON true) d JOIN (SELECT 1) x ON true "
    "JOIN (SELECT 1 AS one) r2 ON true GROUP BY 1, 2, 3".replace("r.rep, coalesce", "d.rep, coalesce"),
)
cte(
    "maxt", "boot psum",
    "SELECT b.design, quantile_cont(top, 0.95) AS critical FROM (SELECT b.design, b.rep, max(abs((b.mean - p.mean_difference) / s.bse)) AS top FROM boot b "
    "JOIN psum p ON p.design = b.design AND p.comparison = b.comparison JOIN (SELECT design, comparison, stddev_samp(mean) AS bse FROM boot GROUP BY 1, 2) s "
    "ON s.design = b.design AND s.comparison = b.comparison GROUP BY 1, 2) b GROUP BY 1",
)
CI_SQL = "SELECT design, comparison, quantile_cont(mean, 0.025) AS bootstrap_ci_lower, quantile_cont(mean, 0.975) AS bootstrap_ci_upper FROM boot GROUP BY 1, 2"
SIM_SQL = (
    "SELECT p.design, p.comparison, mean_difference - critical * bse AS simultaneous_ci_lower, mean_difference + critical * bse AS simultaneous_ci_upper FROM psum p "
    "JOIN maxt m ON m.design = p.design JOIN (SELECT design, comparison, stddev_samp(mean) AS bse FROM boot GROUP BY 1, 2) s ON s.design = p.design AND s.comparison = p.comparison"
)
P_SQL = (
    f"SELECT p.design, p.comparison, (count(*) FILTER (f.t >= abs(p.t) * (1 - 1e-9)) + 1) / ({SIGN} + 1) AS sign_flip_p_raw, "
    f"(count(*) FILTER (x.top >= abs(p.t) * (1 - 1e-9)) + 1) / ({SIGN} + 1) AS sign_flip_p_familywise FROM psum p JOIN flips f ON f.design = p.design AND f.comparison = p.comparison "
    "JOIN (SELECT design, rep, max(t) AS top FROM flips GROUP BY 1, 2) x ON x.design = f.design AND x.rep = f.rep GROUP BY 1, 2"
)
ID = "design comparison"


def diffs(spark, sf):
    return materialize(IN.paired_differences(strategy_results(spark, sf), FAMILY, REFERENCE, "qlike"))


@query("paired_differences", sql(with_("diffs"), "SELECT * FROM diffs", ID, "fold_id pos n", "diff"))
def paired_differences(spark, sf):
    return diffs(spark, sf)


SUM_NUM = "mean_difference standard_error fraction_reference_better t"


@query("paired_summary", sql(with_("psum"), "SELECT * FROM psum", ID, "folds", SUM_NUM))
def paired_summary(spark, sf):
    return IN.paired_summary(diffs(spark, sf), FAMILY)


@query("fold_bootstrap_ci", sql(with_("boot"), CI_SQL, ID, num="bootstrap_ci_lower bootstrap_ci_upper"))
def fold_bootstrap_ci(spark, sf):
    return IN.bootstrap_ci(IN.bootstrap_means(diffs(spark, sf), FAMILY, BOOT, SEED), FAMILY).drop("bootstrap_se")


@query("maxt_simultaneous_ci", sql(with_("maxt"), SIM_SQL, ID, num="simultaneous_ci_lower simultaneous_ci_upper"))
def maxt_simultaneous_ci(spark, sf):
    d = diffs(spark, sf)
    means = materialize(IN.bootstrap_means(d, FAMILY, BOOT, SEED))
    return IN.simultaneous_ci(d, means, FAMILY, BOOT, SEED)


@query("signflip_maxt", sql(with_("flips"), P_SQL, ID, num="sign_flip_p_raw sign_flip_p_familywise"))
def signflip_maxt(spark, sf):
    d = diffs(spark, sf)
    return IN.sign_flip_p(d, FAMILY, SIGN, SEED)


def exact_sql(diffs_name, by):
    return (
        f"SELECT {by}, comparison, max(n) AS folds, pow(2, max(n)) AS patterns, (1 + count(*) FILTER (s <= o + slack)) / (1 + pow(2, max(n))) AS p_value FROM ("
        f"SELECT d.{by}, d.comparison, g.id, max(d.n) AS n, sum(d.diff * (((g.id >> d.pos) & 1) * 2 - 1)) AS s, sum(d.diff) AS o, sum(abs(d.diff)) * 1e-9 AS slack "
        f"FROM {diffs_name} d JOIN (SELECT unnest(range(0, 262144)) AS id) g ON g.id < pow(2, d.n) GROUP BY 1, 2, 3) q GROUP BY 1, 2"
    )


@query("signflip_exact", sql(with_("diffs"), exact_sql("diffs", "design"), ID, "folds patterns", "p_value"))
def signflip_exact(spark, sf):
    return IN.sign_flip_one_sided(diffs(spark, sf), FAMILY)


cte("exactp", "diffs", exact_sql("diffs", "design"))


def holm_sql(tests, by):
    return (
        f"SELECT {by}, comparison, p_value, least(max(step) OVER (PARTITION BY {by} ORDER BY p_value, comparison), 1) AS holm_p FROM (SELECT *, "
        f"(count(*) OVER (PARTITION BY {by}) - row_number() OVER (PARTITION BY {by} ORDER BY p_value, comparison) + 1) * p_value AS step FROM {tests}) q"
    )


@query("holm_adjust", sql(with_("exactp"), holm_sql("exactp", "design"), ID, num="p_value holm_p"))
def holm_adjust(spark, sf):
    p = IN.sign_flip_one_sided(diffs(spark, sf), FAMILY)
    return IN.holm(p, FAMILY).select("design", "comparison", "p_value", "holm_p")


@query(
    "inference_cov_family",
    sql(
        with_("maxt", "flips", ci=CI_SQL, sim=SIM_SQL, pv=P_SQL),
        "SELECT p.design, p.comparison, p.folds, p.mean_difference, p.standard_error, ci.bootstrap_ci_lower, ci.bootstrap_ci_upper, sim.simultaneous_ci_lower, sim.simultaneous_ci_upper, "
        "pv.sign_flip_p_raw, pv.sign_flip_p_familywise, p.fraction_reference_better FROM psum p JOIN ci ON ci.design = p.design AND ci.comparison = p.comparison "
        "JOIN sim ON sim.design = p.design AND sim.comparison = p.comparison JOIN pv ON pv.design = p.design AND pv.comparison = p.comparison",
        ID, "folds",
        "mean_difference standard_error bootstrap_ci_lower bootstrap_ci_upper simultaneous_ci_lower simultaneous_ci_upper sign_flip_p_raw sign_flip_p_familywise fraction_reference_better",
    ),
)
def inference_cov_family(spark, sf):
    out = IN.family_inference(diffs(spark, sf), FAMILY, bootstrap_reps=BOOT, sign_reps=SIGN, seed=SEED)
    return out.drop("t")


# ---------------------------------------------------------------- screening-like families on two panels

cte(
    "twocov", "px_two_ret px_two_ret_pos",
    "SELECT a.panel_id, a.seg, a.fold_id, a.series AS i, b.series AS j, covar_samp(a.value, b.value) AS v FROM F a JOIN F b ON a.panel_id = b.panel_id AND a.fold_id = b.fold_id "
    "AND a.seg = b.seg AND a.dt = b.dt AND a.series <= b.series GROUP BY 1, 2, 3, 4, 5".replace(
        "F a", "(SELECT r.*, k + 1 AS fold_id, CASE WHEN pos < k * 26 + 104 THEN 'training' ELSE 'test' END AS seg FROM px_two_ret r JOIN px_two_ret_pos p ON p.panel_id = r.panel_id AND p.dt = r.dt "
        "JOIN (SELECT unnest(range(0, 100)) AS k) g ON pos BETWEEN k * 26 AND k * 26 + 129 AND k * 26 + 130 <= n_dates) a"
    ).replace(
        "F b", "(SELECT r.*, k + 1 AS fold_id, CASE WHEN pos < k * 26 + 104 THEN 'training' ELSE 'test' END AS seg FROM px_two_ret r JOIN px_two_ret_pos p ON p.panel_id = r.panel_id AND p.dt = r.dt "
        "JOIN (SELECT unnest(range(0, 100)) AS k) g ON pos BETWEEN k * 26 AND k * 26 + 129 AND k * 26 + 130 <= n_dates) b"
    ),
)
cte(
    "twosf", "twocov",
    "SELECT c.panel_id, c.seg, c.fold_id, sqrt(avg(c.v * c.v / (a.v * b.v))) AS s_f FROM twocov c JOIN twocov a ON a.panel_id = c.panel_id AND a.seg = c.seg AND a.fold_id = c.fold_id AND a.i = c.i AND a.j = c.i "
    "JOIN twocov b ON b.panel_id = c.panel_id AND b.seg = c.seg AND b.fold_id = c.fold_id AND b.i = c.j AND b.j = c.j WHERE c.i < c.j GROUP BY 1, 2, 3",
)
cte(
    "twodiff", "twosf",
    "SELECT 'training_vs_test' AS family, a.panel_id AS comparison, a.fold_id, a.s_f - b.s_f AS diff, row_number() OVER (PARTITION BY a.panel_id ORDER BY a.fold_id) - 1 AS pos, count(*) OVER (PARTITION BY a.panel_id) AS n "
    "FROM twosf a JOIN twosf b ON a.panel_id = b.panel_id AND a.fold_id = b.fold_id AND a.seg = 'training' AND b.seg = 'test'",
)
boot_cte("twoboot", "twodiff", MORE_BOOT, SEED + 1, "family")
cte("twop", "twodiff", exact_sql("twodiff", "family"))


@query(
    "inference_extended",
    sql(
        with_("twoboot", "twop", h=holm_sql("twop", "family")),
        "SELECT h.family, h.comparison, d.folds, d.mean_delta, c.ci_low, c.ci_high, h.p_value, h.holm_p FROM h JOIN (SELECT comparison, count(*) AS folds, avg(diff) AS mean_delta FROM twodiff GROUP BY 1) d "
        "ON d.comparison = h.comparison JOIN (SELECT comparison, quantile_cont(mean, 0.025) AS ci_low, quantile_cont(mean, 0.975) AS ci_high FROM twoboot GROUP BY 1) c ON c.comparison = h.comparison",
        "family comparison", "folds", "mean_delta ci_low ci_high p_value holm_p",
    ),
)
def inference_extended(spark, sf):
    """Training score against test score per fold, for the type and the brand panel."""
    r = materialize(R.synchronous_returns(materialize(I.px_two(spark, sf))))
    rows = FD.assign_folds(M.indexed(r), FD.two_segment(104, 26))
    s = M.offdiag_scores(rows, [*M.KEYS, "segment"])
    at = lambda seg: s.filter(F.col("segment") == seg).select("panel_id", "fold_id", F.col("s_f").alias(seg))
    d = at("training").join(at("test"), ["panel_id", "fold_id"]).select(
        F.lit("training_vs_test").alias("family"), F.col("panel_id").alias("comparison"), "fold_id",
        (F.col("training") - F.col("test")).alias("diff"),
    )
    return IN.extended_inference(d, ["family"], bootstrap_reps=MORE_BOOT, seed=SEED + 1).drop("patterns")


@query(
    "moving_block_bootstrap",
    sql(
        with_("evt_day", "evt_day_pos"),
        "SELECT e.series, r.rep, avg(v.value) AS mean, min(q.pos) AS first_pos, max(q.pos) AS last_pos FROM (SELECT l.n_dates AS n, r.rep, s.slot, "
        f"{draw_sql('(l.n_dates - 5 + 1)', 'block', 7, '$r.rep', '$(s.slot // 5)')} + s.slot % 5 AS pos FROM (SELECT max(n_dates) AS n_dates FROM evt_day_pos) l "
        "JOIN (SELECT unnest(range(0, 200)) AS rep) r ON true JOIN (SELECT unnest(range(0, 100000)) AS slot) s ON s.slot < l.n_dates) q "
        "JOIN (SELECT DISTINCT series FROM evt_day) e ON true JOIN (SELECT 0 AS z) z ON true JOIN (SELECT a.series, a.value, p.pos FROM evt_day a JOIN evt_day_pos p ON p.dt = a.dt) v "
        "ON v.series = e.series AND v.pos = q.pos JOIN (SELECT unnest(range(0, 200)) AS rep) r ON r.rep = q.rep GROUP BY 1, 2",
        "series", "rep first_pos last_pos", "mean",
    ),
)
def moving_block_bootstrap(spark, sf):
    panel = materialize(I.evt_day(spark, sf))
    rows = C.with_positions(panel)
    lengths = rows.select("panel_id", F.col("n_dates").alias("length")).distinct()
    draws = IN.moving_block_positions(lengths, ["panel_id"], 5, 200, 7)
    return draws.join(rows, ["panel_id", "pos"]).groupBy("series", "rep").agg(
        F.avg("value").alias("mean"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )


@query(
    "wilson_interval",
    sql(
        "",
        "SELECT l_shipmonth, trials, successes, ((successes / trials + z * z / (2 * trials)) - z * sqrt(successes / trials * (1 - successes / trials) / trials + z * z / (4.0 * trials * trials))) / (1 + z * z / trials) AS lower, "
        "((successes / trials + z * z / (2 * trials)) + z * sqrt(successes / trials * (1 - successes / trials) / trials + z * z / (4.0 * trials * trials))) / (1 + z * z / trials) AS upper FROM ("
        "SELECT month(l_shipdate) AS l_shipmonth, count(*)::DOUBLE AS trials, (count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS successes, 1.959963984540054::DOUBLE AS z FROM lineitem GROUP BY 1) q",
        "", "l_shipmonth trials successes", "lower upper",
    ),
)
def wilson_interval(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_shipdate", "l_returnflag")
    c = li.groupBy(F.month("l_shipdate").alias("l_shipmonth")).agg(
        F.count("*").alias("trials"), F.count_if(F.col("l_returnflag") == "R").alias("successes")
    )
    lo, hi = X.wilson_bounds(F.col("successes"), F.col("trials"))
    return c.withColumn("lower", lo).withColumn("upper", hi)


@query(
    "spearman_rank",
    sql(
        "",
        "SELECT l_returnflag, corr(rx, ry) AS spearman, count(*) AS n FROM (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rx, "
        "rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS ry FROM lineitem) q GROUP BY 1",
        "l_returnflag", "n", "spearman",
    ),
)
def spearman_rank(spark, sf):
    li = I.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return IN.spearman(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
