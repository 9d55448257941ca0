"""Queries: fitted learner, local models, reproduction checks, replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from partcast import config as C
from partcast.catalog import sql_parts as Q
from partcast.catalog.registry import REGISTRY
from partcast.catalog.rounding import r
from partcast.config import CLEAN, MODELS, QUANTILE_LEVELS
from partcast.functions import arrays as A, smoothing as S
from partcast.operators.learner import TwoHead, size_quantiles, training_table
from partcast.plans import analyses as N, compare as P, distribution as D, reproduction as R
from partcast.sources import fixtures as X
from partcast.sources.fixtures import KEYS

add = REGISTRY.add


@add("forecast_moments", Q.query(Q.panel() + "," + Q.forecasts(models=("ZIP", "HURDLE_NB")), """
SELECT item_id, site_id, rd6(z_pi) AS z_pi, rd6(z_lam) AS z_lam, rd6(f_ZIP) AS z_mean, rd6(h_p) AS h_p, rd6(h_mu) AS h_mu, rd6(h_disp) AS h_disp, rd6(f_HURDLE_NB) AS h_mean,
  rd4(h_p * (h_mu + h_disp * h_mu * h_mu) + h_p * (1 - h_p) * h_mu * h_mu) AS h_var FROM fc"""))
def forecast_moments(spark, sf):
    d = S.with_forecasts(P.prepared_panel(spark, sf), models=("ZIP", "HURDLE_NB"))
    return d.select(*KEYS, *[r(c) for c in ("z_pi", "z_lam", "z_mean", "h_p", "h_mu", "h_disp", "h_mean")], r("h_var", 4))


def _remap_sql() -> str:
    grid = (0.0, *QUANTILE_LEVELS)
    outs = []
    for a in QUANTILE_LEVELS:
        u = f"(({Q.num(a)} - (1 - p)) / p)"
        steps = " ".join(
            f"WHEN {u} < {Q.num(grid[i + 1])} THEN {'0' if i == 0 else f'q[{i}]'} + (q[{i + 1}] - {'0' if i == 0 else f'q[{i}]'}) * (({u} - {Q.num(grid[i])}) / ({Q.num(grid[i + 1])} - {Q.num(grid[i])}))"
            for i in range(len(grid) - 1))
        outs.append(f"rd6(CASE WHEN {Q.num(a)} <= 1 - p THEN 0 {steps} ELSE q[5] END) AS q{int(a * 100)}")
    return ", ".join(outs)


@add("hurdle_quantile_remap", Q.query(Q.with_external(Q.panel("part") + "," + Q.forecasts(models=("HURDLE_NB",))),
     f"SELECT item_id, {_remap_sql()} FROM (SELECT item_id, h_p AS p, q FROM fc JOIN ext USING (item_id, site_id)) WHERE p > 0"))
def hurdle_quantile_remap(spark, sf):
    p = P.prepared_panel(spark, sf, "part")
    d = S.with_forecasts(p, models=("HURDLE_NB",)).where("h_p > 0").join(X.external_forecasts(p), KEYS)
    d = d.withColumn("q", F.expr(D.hurdle_remap(QUANTILE_LEVELS, "h_p", "quantiles")))
    return d.select("item_id", *[r(f"q[{i}]", 6, f"q{int(a * 100)}") for i, a in enumerate(QUANTILE_LEVELS)])


REPRO = Q.panel("part") + """,
wp AS (SELECT item_id, site_id, segment, sba_alpha, ses_alpha, 20 + item_id % 9 AS wl, y[1:20 + item_id % 9] AS y FROM panel),
w0 AS (SELECT *, len(list_filter(y, lambda x: x > 0)) AS nz, coalesce(list_sum(y), 0) AS s FROM wp),
st AS (SELECT item_id, site_id, segment, sba_alpha, ses_alpha, wl, y, 1 AS t, s / greatest(nz, 1) AS level, wl::DOUBLE / greatest(nz, 1) AS period, wl::DOUBLE / greatest(nz, 1) AS gap, y[1] AS ses, y[1] AS ma FROM w0
  UNION ALL SELECT item_id, site_id, segment, sba_alpha, ses_alpha, wl, y, t + 1,
    CASE WHEN y[t] > 0 THEN sba_alpha * y[t] + (1 - sba_alpha) * level ELSE level END,
    CASE WHEN y[t] > 0 THEN sba_alpha * gap + (1 - sba_alpha) * period ELSE period END,
    CASE WHEN y[t + 1] > 0 THEN 1 ELSE gap + 1 END,
    CASE WHEN t = 1 THEN y[2] ELSE ses_alpha * y[t] + (1 - ses_alpha) * ses END,
    CASE WHEN t = 1 THEN y[2] ELSE (y[t] + y[t - 1]) / 2 END
  FROM st WHERE t < wl),
pf AS (SELECT item_id, segment, t, unnest(['SBA', 'SES', 'MA']) AS model, unnest([(1 - sba_alpha / 2) * level / greatest(period, 1e-12::DOUBLE), ses, ma]) AS f FROM st),
gv AS (SELECT *, rd2(f + CASE WHEN model = 'SBA' AND item_id % 7 = 2 AND t > 10 OR model = 'SES' AND item_id % 11 = 3 OR model = 'MA' AND item_id % 13 = 5 THEN 0.02::DOUBLE ELSE 0 END) AS g FROM pf),
df AS (SELECT item_id, segment, model, max(abs(f - g)) AS mx, avg(abs(f - g)) AS mn FROM gv GROUP BY ALL)"""


@add("baseline_reproduction", Q.query(REPRO, """
SELECT model, segment, count(*) AS n, rd6(avg(CASE WHEN mx <= 0.0051 THEN 1.0::DOUBLE ELSE 0 END)) AS share_ok, rd6(avg(mn)) AS mean_diff, rd6(median(mx)) AS p50, rd6(quantile_cont(mx, 0.95)) AS p95 FROM df GROUP BY ALL"""))
def baseline_reproduction(spark, sf):
    """Supplied columns carry two decimals and some faults; our paths are checked against them."""
    p = P.prepared_panel(spark, sf, "part").withColumn("window", F.expr("CAST(20 + item_id % 9 AS INT)"))
    d = R.with_paths(R.supplied_paths(p))
    s = R.reproduction_summary(R.path_differences(d), 0.0051, ["model", "segment"])
    return s.select("model", "segment", "n", r("share_ok"), r("mean_diff"), r("p50"), r("p95"))


@add("local_vs_global", Q.query(Q.panel() + "," + Q.forecasts(models=("SBA", "TSB")) + """,
lc AS (SELECT item_id, site_id, count(*)::DOUBLE AS n, sum(x) AS sx, sum(z) AS sz, sum(x * x) AS sxx, sum(x * z) AS sxz FROM (
  SELECT item_id, site_id, y[i] AS x, y[i + 1] AS z FROM panel, (SELECT unnest(range(1, 16)) AS i)) GROUP BY ALL),
fl AS (SELECT f.*, CASE WHEN n * sxx - sx * sx > 0 THEN (sz - (n * sxz - sx * sz) / (n * sxx - sx * sx) * sx) / n + (n * sxz - sx * sz) / (n * sxx - sx * sx) * f.y[16] ELSE m END AS f_LOCAL
  FROM fc f JOIN lc USING (item_id, site_id)),""" + Q.long_rows(models=("SBA", "TSB", "LOCAL"), fc="fl"), """
SELECT segment, model, count(*) AS n, rd6(avg(mae)) AS mae, rd6(median(mae)) AS mae_median FROM lr GROUP BY ALL"""))
def local_vs_global(spark, sf):
    from partcast.operators.quantiles import quantile_columns
    d = S.extend(S.with_forecasts(P.prepared_panel(spark, sf), models=("SBA", "TSB")), N.lag_regression(16))
    rows = P.with_errors(P.explode_models(d, ("SBA", "TSB", "LOCAL"), CLEAN), CLEAN)
    base = rows.groupBy("segment", "model").agg(F.count("*").alias("n"), r(F.avg("mae"), 6, "mae"))
    med = quantile_columns(rows, ["segment", "model"], "mae", {"mae_median": 0.5})
    return base.join(med.select("segment", "model", r("mae_median")), ["segment", "model"])


# --- published error tables -----------------------------------------------------------------------

RM = ("SBA", "SES", "MA", "TSB")
ERR = Q.panel("part") + "," + Q.forecasts(models=RM) + f""",
et AS (SELECT item_id, site_id, segment, y[1:20] AS y, list_avg(y[17:20]) AS oos_mean, list_median(y[17:20]) = 0 AS m0, {', '.join(f'greatest(f_{m}, 0) AS lv_{m}' for m in RM)} FROM fc)"""


def error_table(spark, sf):
    """Published form of a comparison: per-series error and bias per model."""
    d = S.with_forecasts(P.prepared_panel(spark, sf, "part"), models=RM)
    it = S.items("y", 16, 20)
    mean = S.total(it) + " / 4.0D"
    return S.extend(d, {
        "oos_mean": mean, **{f"bias_{m}": f"greatest(f_{m}, 0.0D) - oos_mean" for m in RM},
        **{f"mae_{m}": S.total([f"abs(greatest(f_{m}, 0.0D) - {x})" for x in it]) + " / 4.0D" for m in RM},
    }).withColumn("hist", F.slice("y", 1, 20))


@add("replication_horizon", Q.query(ERR, """
SELECT h::INTEGER AS h, rd6(avg(CASE WHEN abs(list_avg(y[21 - h:20]) - oos_mean) < 1e-6::DOUBLE THEN 1.0::DOUBLE ELSE 0 END)) AS share FROM et, (SELECT unnest(range(1, 13)) AS h) GROUP BY h"""))
def replication_horizon(spark, sf):
    return R.trailing_match(error_table(spark, sf), "hist", 12).select("h", r("share"))


@add("replication_rho", Q.query(ERR + """,
el AS (SELECT item_id, site_id, segment, m0, unnest(['SBA', 'SES', 'MA', 'TSB']) AS model, unnest([lv_SBA, lv_SES, lv_MA, lv_TSB]) AS level, y[17:20] AS t FROM et),
em AS (SELECT *, (abs(level - t[1]) + abs(level - t[2]) + abs(level - t[3]) + abs(level - t[4])) / 4 AS mae FROM el),""" + Q.series_rho("em", {"lm": ("level", "mae")}, carry="segment, m0") + """,
sg AS (SELECT *, 'all' AS grp FROM sr UNION ALL SELECT *, segment FROM sr UNION ALL SELECT *, CASE WHEN m0 THEN 'condition_met' ELSE 'condition_not_met' END FROM sr)""",
    "SELECT grp, n, mean, median, share_plus1, share_gt90 FROM (" + Q.rho_summary("sg", "rho_lm", "grp") + ")"))
def replication_rho(spark, sf):
    t = R.recover_levels(error_table(spark, sf), list(RM)).withColumn("m0", A.median(F.slice("y", 17, 4)) == 0)
    snap6 = lambda c: F.expr(f"floor({c} * 1e6D + 0.50001D) / 1e6D")
    t = t.withColumns({"lv": F.array(*[snap6(f"level_{m}") for m in RM]), "er": F.array(*[snap6(f"mae_{m}") for m in RM])})
    t = t.withColumn("rho", A.spearman(F.col("lv"), F.col("er")))
    g = t.selectExpr("rho", "explode(array('all', segment, if(m0, 'condition_met', 'condition_not_met'))) AS grp")
    s = N.rho_summary(g, "rho", ["grp"])
    return s.select("grp", "n", r("mean"), r("median"), r("share_plus1"), r("share_gt90"))


# --- learner (Spark ML; no SQL form) --------------------------------------------------------------

STATICS = ["price", "lead_days"]


def learner_panel(spark, sf):
    return P.prepared_panel(spark, sf, "part").select(*KEYS, "segment", "y", *STATICS)


@add("learner_forecast")
def learner_forecast(spark, sf):
    p = learner_panel(spark, sf)
    model = TwoHead.fit(p, 16, STATICS)
    d = model.recursive(p, 16, 4)
    rows = S.extend(d, {"level": "greatest(path[0], 0.0D)", "test": "slice(y, 17, 4)"} | P.error_exprs(CLEAN))
    return rows.groupBy("segment").agg(
        F.count("*").alias("n"), F.avg("mae").alias("mae"), F.min("first_p").alias("p_min"), F.max("first_p").alias("p_max"))


@add("learner_importance")
def learner_importance(spark, sf):
    return TwoHead.fit(learner_panel(spark, sf), 16, STATICS, trees=5).importances(spark)


@add("learner_quantiles")
def learner_quantiles(spark, sf):
    """Size quantiles by predicted size, mapped through the zero mass."""
    p = learner_panel(spark, sf)
    model = TwoHead.fit(p, 16, STATICS, trees=5)
    hist = p.select(*STATICS, F.slice("y", 1, 15).alias("hist"), F.expr("y[15] AS target"))
    buckets = size_quantiles(model.step(hist), QUANTILE_LEVELS)
    now = model.step(p.withColumn("hist", F.slice("y", 1, 16)))
    cuts = "array(2.0D, 5.0D, 10.0D, 20.0D, 40.0D, 80.0D)"
    now = now.withColumn("bucket", F.expr(f"size(filter({cuts}, e -> size_hat >= e))"))
    # one row per size bucket: bounded by the bucket edges
    d = now.join(F.broadcast(buckets), "bucket").withColumn("size_q", D.uncross("size_q"))
    d = d.withColumn("q", F.expr(D.hurdle_remap(QUANTILE_LEVELS, "p_occurs", "size_q")))
    d = d.withColumn("x", F.expr("y[16]"))
    return d.selectExpr("x", "posexplode(q) AS (i, q)").groupBy("i").agg(
        F.avg("q").alias("q_mean"), F.expr("avg(if(x <= q, 1.0D, 0.0D))").alias("coverage"), F.count("*").alias("n"))


# --- composite ledger -----------------------------------------------------------------------------

M10 = MODELS + ("EXT",)
LEDGER = (Q.with_external(Q.panel() + "," + Q.forecasts()) + "," + Q.long_rows(models=M10, fc="fcx") + "," + Q.policy() + ","
          + Q.replay(CLEAN.horizon, "item_id, site_id, model") + "," + Q.costs() + "," + Q.tau("sc", "mae", "cost", carry="test_demand"))


@add("comparison_ledger", Q.query(LEDGER, """
SELECT 'model' AS analysis, model AS grp, 'mae' AS metric, rd6(avg(mae)) AS value FROM sc GROUP BY model
UNION ALL SELECT 'model', model, 'cost', rd3(avg(cost)) FROM sc GROUP BY model
UNION ALL SELECT 'model', model, 'fill', rd6(avg(fill)) FROM sc GROUP BY model
UNION ALL SELECT 'tau', CASE WHEN test_demand > 0 THEN 'active' ELSE 'zero' END, 'mean', rd6(avg(tau)) FROM tau_t GROUP BY ALL
UNION ALL SELECT 'tau', 'pooled', 'mean', rd6(avg(tau)) FROM tau_t
UNION ALL SELECT 'tau', CASE WHEN test_demand > 0 THEN 'active' ELSE 'zero' END, 'n', count(tau)::DOUBLE FROM tau_t GROUP BY ALL
UNION ALL SELECT 'tau', 'pooled', 'n', count(tau)::DOUBLE FROM tau_t"""))
def comparison_ledger(spark, sf):
    """Per-model table and rank agreement with a supplied tenth model."""
    panel = P.prepared_panel(spark, sf)
    given = panel.join(X.external_forecasts(panel).select(*KEYS, "point"), KEYS, "left").fillna({"point": 0.0})
    series = P.series_scores(given, ["mae", "cost", "fill"], ["test_demand"], models=M10, supplied="point")
    model = P.by_model(series, ["mae", "cost", "fill"], [], M10).groupBy("model").agg(r(F.avg("mae"), 6, "mae"), r(F.avg("cost"), 3, "cost"), r(F.avg("fill"), 6, "fill")).selectExpr(
        "'model' AS analysis", "model AS grp", "inline(array(struct('mae' AS metric, mae AS value), struct('cost' AS metric, cost AS value), struct('fill' AS metric, fill AS value)))")
    t = N.series_stats(series, {"mc": ("mae", "cost")}, ["test_demand"], "tau").selectExpr(
        "explode(array('pooled', if(test_demand > 0, 'active', 'zero'))) AS grp", "tau_mc")
    tau = t.groupBy("grp").agg(r(F.avg("tau_mc"), 6, "m"), F.count("tau_mc").cast("double").alias("n")).selectExpr(
        "'tau' AS analysis", "grp", "inline(array(struct('mean' AS metric, m AS value), struct('n' AS metric, n AS value)))")
    return model.unionByName(tau)


@add("pseudonymise_blake2b")
def pseudonymise_blake2b(spark, sf):
    from partcast.operators import privacy
    df = X.table(spark, sf, "customer").select("c_custkey", "c_name")
    return privacy.pseudonymise(df, {"c_name": "customer"}, {"customer": "CUS_"}, "pepper", encode=privacy.surrogate_blake2b)
