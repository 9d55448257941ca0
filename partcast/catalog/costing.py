"""Queries: policies, replay, cost grids, regimes, deployed comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from partcast import config as C
from partcast.catalog import sql_parts as Q
from partcast.catalog.registry import REGISTRY
from partcast.catalog.rounding import r
from partcast.config import CLEAN, CostTerms
from partcast.functions import smoothing as S
from partcast.functions.guarded import guarded_corr
from partcast.functions.resampling import mix_columns
from partcast.operators.policy import with_normal_policy, with_quantile_policy
from partcast.operators.quantiles import quantile_columns
from partcast.operators.replay import replay, with_costs
from partcast.plans import analyses as N, compare as P, costing as K, distribution as D
from partcast.sources import fixtures as X
from partcast.sources.fixtures import KEYS

add = REGISTRY.add
IDS = "item_id, site_id, model"
H = CLEAN.horizon


def rows_of(spark, sf, models=C.MODELS, **kw):
    return P.forecast_rows(P.prepared_panel(spark, sf), models=models, **kw)


ROWS = Q.panel() + "," + Q.forecasts() + "," + Q.long_rows()
ONE = ("SBA",)
ROWS1 = Q.panel() + "," + Q.forecasts(models=ONE) + "," + Q.long_rows(models=ONE)


@add("normal_policy", Q.query(ROWS1 + "," + Q.policy(), """
SELECT item_id, site_id, lead_q, rd6(rp) AS rp, rd6(eoq) AS eoq, rd6(up_to) AS up_to FROM pl"""))
def normal_policy(spark, sf):
    return with_normal_policy(rows_of(spark, sf, ONE)).select(*KEYS, "lead_q", r("rp"), r("eoq"), r("up_to"))


@add("replay_normal", Q.query(ROWS1 + "," + Q.policy() + "," + Q.replay(H, IDS) + "," + Q.costs(), """
SELECT item_id, site_id, rd4(on_hand_sum) AS on_hand_sum, rd4(short_units) AS short_units, n_orders, demand_units,
  rd4(end_on_hand) AS end_on_hand, rd4(hold_cost) AS hold_cost, order_cost, rd4(short_cost) AS short_cost, rd4(cost) AS cost, rd6(fill) AS fill FROM sc"""))
def replay_normal(spark, sf):
    d = P.scored_from(spark, sf, models=ONE)
    return d.select(*KEYS, r("on_hand_sum", 4), r("short_units", 4), "n_orders", "demand_units", r("end_on_hand", 4),
                    r("hold_cost", 4), "order_cost", r("short_cost", 4), r("cost", 4), r("fill"))


LONG_ROWS = Q.panel() + "," + Q.forecasts(12, models=ONE) + "," + Q.long_rows(C.LONG_TEST, models=ONE)


@add("replay_long_horizon", Q.query(LONG_ROWS + "," + Q.policy() + "," + Q.replay(8, IDS) + "," + Q.costs(), """
SELECT lead_q, count(*) AS n, rd4(sum(on_hand_sum)) AS on_hand, rd4(sum(short_units)) AS short_units, sum(n_orders)::BIGINT AS n_orders, rd4(avg(cost)) AS cost, rd6(avg(fill)) AS fill FROM sc GROUP BY lead_q"""))
def replay_long_horizon(spark, sf):
    d = P.scored_from(spark, sf, models=ONE, window=C.LONG_TEST)
    return d.groupBy("lead_q").agg(
        F.count("*").alias("n"), r(F.sum("on_hand_sum"), 4, "on_hand"), r(F.sum("short_units"), 4, "short_units"),
        F.sum("n_orders").alias("n_orders"), r(F.avg("cost"), 4, "cost"), r(F.avg("fill"), 6, "fill"))


@add("fleet_rank_table", Q.query(Q.scored(grain="part"), "SELECT model, count(*) AS n, rd6(avg(mae)) AS mae, rd3(avg(cost)) AS cost, rd6(avg(fill)) AS fill FROM sc GROUP BY model"))
def fleet_rank_table(spark, sf):
    return P.scored_from(spark, sf, "part").groupBy("model").agg(
        F.count("*").alias("n"), r(F.avg("mae"), 6, "mae"), r(F.avg("cost"), 3, "cost"), r(F.avg("fill"), 6, "fill"))


GRID = f"""
gr AS (SELECT * FROM lr CROSS JOIN (SELECT unnest([{', '.join(Q.num(h) for h in C.HOLDING_RATES)}]) AS h) CROSS JOIN (SELECT unnest([{', '.join(Q.num(k) for k in C.ORDER_COSTS)}]) AS k))"""
SWEEP = (Q.panel("part") + "," + Q.forecasts() + "," + Q.long_rows() + "," + GRID + ","
         + Q.policy(src="gr", k="k", h="h") + "," + Q.replay(H, IDS + ", h, k") + f""",
swc AS (SELECT h, k, p, model, avg(on_hand_sum * price * (h / 4) + n_orders * k + short_units * p) AS cost
  FROM rep CROSS JOIN (SELECT unnest([{', '.join(Q.num(p) for p in C.STOCKOUT_COSTS)}]) AS p) GROUP BY ALL)""")


def _sweep(spark, sf):
    return K.cost_config_sweep(P.forecast_rows(P.prepared_panel(spark, sf, "part")), H)


@add("cost_config_sweep", Q.query(SWEEP, "SELECT h, k, p, model, rd3(cost) AS cost FROM swc"))
def cost_config_sweep(spark, sf):
    return _sweep(spark, sf).select("h", "k", "p", "model", r("cost", 3))


@add("cost_config_winners", Q.query(SWEEP + """,
m AS (SELECT model, avg(mae) AS mae FROM lr GROUP BY model),
cm AS (SELECT c.h, c.k, c.p, c.model, rd6(c.cost) AS cost, rd6(m.mae) AS mae, 1 AS n FROM swc c JOIN m USING (model)),""" + Q.rho("h, k, p", "mae", "cost", "cm") + """,
b AS (SELECT h, k, p, arg_min(model, struct_pack(a := cost, b := model)) AS winner, (max(cost) - min(cost)) / min(cost) AS spread FROM cm GROUP BY ALL)""", """
SELECT winner, count(*) AS cells, rd6(min(rho)) AS rho_min, rd6(median(rho)) AS rho_median, rd6(max(rho)) AS rho_max,
  count_if(abs(rho) <= 0.3) AS weak, rd6(max(spread)) AS spread_max FROM b JOIN rho_t USING (h, k, p) GROUP BY winner"""))
def cost_config_winners(spark, sf):
    from partcast.functions import arrays as A
    panel = P.prepared_panel(spark, sf, "part")
    rows = P.forecast_rows(panel)
    mae = rows.groupBy("model").agg(F.avg("mae").alias("mae"))
    cells = K.cost_config_sweep(rows, H).join(mae, "model").withColumn("n", F.lit(1))
    v = N.vectors_of(cells, ["h", "k", "p"], ["mae", "cost"]).withColumns({
        "rho": A.spearman(F.col("mae"), F.col("cost")), "winner": A.argmin(F.col("cost"), F.col("models")),
        "spread": F.expr("(array_max(cost) - array_min(cost)) / array_min(cost)")})
    return v.groupBy("winner").agg(
        F.count("*").alias("cells"), r(F.min("rho"), 6, "rho_min"), r(F.median("rho"), 6, "rho_median"),
        r(F.max("rho"), 6, "rho_max"), F.expr("count_if(abs(rho) <= 0.3D) AS weak"), r(F.max("spread"), 6, "spread_max"))


ZS = "UNION ALL ".join(
    f"SELECT '{n}' AS scenario, {Q.num(Q.z_of(a))} AS zh, {Q.num(Q.z_of(b))} AS zm, {Q.num(Q.z_of(c))} AS zl " for n, a, b, c in C.SERVICE_SCENARIOS)


@add("service_scenarios", Q.query(ROWS + f", gr AS (SELECT * FROM lr CROSS JOIN ({ZS})),"
     + Q.policy(src="gr", z="(CASE tier WHEN 'high' THEN zh WHEN 'low' THEN zl ELSE zm END)") + "," + Q.replay(H, IDS + ", scenario") + "," + Q.costs(),
     "SELECT scenario, model, rd3(avg(cost)) AS cost, rd6(avg(fill)) AS fill FROM sc GROUP BY ALL"))
def service_scenarios(spark, sf):
    return K.service_scenarios(P.prepared_panel(spark, sf)).select("scenario", "model", r("cost", 3), r("fill"))


@add("lead_cv_sensitivity", Q.query(ROWS + ", gr AS (SELECT * FROM lr CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]) AS cv)),"
     + Q.policy(src="gr", cv="cv") + "," + Q.replay(H, IDS + ", cv") + "," + Q.costs(),
     "SELECT cv, model, rd3(cost) AS cost, rd6(fill) AS fill, row_number() OVER (PARTITION BY cv ORDER BY cost, model)::BIGINT AS cost_rank FROM (SELECT cv, model, rd3(avg(cost)) AS cost, avg(fill) AS fill FROM sc GROUP BY ALL)"))
def lead_cv_sensitivity(spark, sf):
    d = K.lead_cv_sensitivity(P.prepared_panel(spark, sf)).select("cv", "model", r("cost", 3), r("fill"))
    return d.withColumn("cost_rank", N.ordinal("cost", ["cv"]))


DEP = """
dep0 AS (SELECT item_id, site_id, CASE WHEN item_id % 70 <> 0 THEN floor(list_sum(list_filter(y, lambda x: x > 0)) / len(list_filter(y, lambda x: x > 0))) END AS new_min,
    ceil(list_max(y)) AS new_max, ceil(list_max(y) * 1.5::DOUBLE) AS in_stock FROM panel WHERE item_id % 10 = 0),
dep1 AS (SELECT p.item_id, p.site_id, price, lead_q, segment, y[17:20] AS test, in_stock, coalesce(new_min, 0) AS rp,
    greatest(coalesce(new_max, 0), coalesce(new_min, 0) + 1) AS up_to, greatest(coalesce(new_max, 0), coalesce(new_min, 0) + 1) AS opening
  FROM panel p JOIN dep0 USING (item_id, site_id)),"""
DEPLOYED = DEP + Q.replay(H, "item_id, site_id", src="dep1", out="drep") + "," + Q.costs(src="drep", out="dsc")


@add("deployed_replay", Q.query(Q.panel() + "," + DEPLOYED, """
SELECT item_id, site_id, rp, up_to, rd4(cost) AS cost, rd6(fill) AS fill, n_orders FROM dsc"""))
def deployed_replay(spark, sf):
    p = P.prepared_panel(spark, sf)
    return K.deployed_replay(p, X.deployed_policy(p)).select(*KEYS, "rp", "up_to", r("cost", 4), r("fill"), "n_orders")


@add("deployed_compare", Q.query(Q.scored() + "," + DEPLOYED, """
SELECT model, n, rd3(cost) AS cost, rd3(deployed) AS deployed, rd4(100 * (cost - deployed) / deployed) AS gap_pct, rd6(share) AS share_cheaper FROM (
  SELECT s.model, count(*) AS n, avg(s.cost) AS cost, avg(d.cost) AS deployed, avg(CASE WHEN rd6(s.cost) < rd6(d.cost) THEN 1.0::DOUBLE ELSE 0 END) AS share
  FROM sc s JOIN dsc d USING (item_id, site_id) GROUP BY s.model)"""))
def deployed_compare(spark, sf):
    p = P.prepared_panel(spark, sf)
    dep = K.deployed_replay(p, X.deployed_policy(p)).select(*KEYS, F.col("cost").alias("dcost"))
    d = P.scored(p).join(dep, KEYS).groupBy("model").agg(
        F.count("*").alias("n"), F.avg("cost").alias("cost"), F.avg("dcost").alias("deployed"),
        F.expr("avg(if(floor(cost * 1e6D + 0.50001D) < floor(dcost * 1e6D + 0.50001D), 1.0D, 0.0D))").alias("share"))
    return d.select("model", "n", r("cost", 3), r("deployed", 3), r("100.0D * (cost - deployed) / deployed", 4, "gap_pct"), r("share", 6, "share_cheaper"))


@add("stock_consistency", Q.query(Q.panel() + "," + DEPLOYED, """
SELECT count(*) AS n, rd6(corr(ln(1 + on_hand_sum / 4), ln(1 + in_stock))) AS corr, rd6(median(on_hand_sum / 4 / greatest(in_stock, 1e-9::DOUBLE))) AS ratio FROM dsc WHERE in_stock > 0"""))
def stock_consistency(spark, sf):
    p = P.prepared_panel(spark, sf)
    d = K.deployed_replay(p, X.deployed_policy(p)).where("in_stock > 0").withColumn("_g", F.lit(1)).withColumn(
        "ratio", F.expr("mean_on_hand / greatest(in_stock, 1e-9D)"))
    agg = d.groupBy("_g").agg(F.count("*").alias("n"), guarded_corr(F.log1p("mean_on_hand"), F.log1p("in_stock"), 11).alias("corr"))
    med = quantile_columns(d, ["_g"], "ratio", {"ratio": 0.5})
    return agg.join(med, "_g").select("n", r("corr"), r("ratio"))


QCOLS = ("0.5", "0.8", "0.9", "0.95", "0.99")
COUNT_Q = f"""
qp AS (SELECT item_id, site_id, 'ZIP' AS model, 1 - z_pi AS w, z_lam AS mu, 0.0::DOUBLE AS a FROM fc
  UNION ALL SELECT item_id, site_id, 'HURDLE_NB', h_p, h_mu, h_disp FROM fc),
qs AS (
  SELECT *, 0 AS k, CASE WHEN mu <= 0 THEN 0 WHEN a < 1e-5 THEN -mu ELSE -1 / a * ln(1 + a * mu) END AS lp,
    CASE WHEN mu <= 0 THEN 1.0::DOUBLE WHEN a < 1e-5 THEN exp(-mu) ELSE exp(-1 / a * ln(1 + a * mu)) END AS cdf FROM qp
  UNION ALL
  SELECT item_id, site_id, model, w, mu, a, k + 1, lp + ln(st), cdf + exp(lp + ln(st)) FROM (
    SELECT *, CASE WHEN a < 1e-5 THEN mu / (k + 1) ELSE (a * mu / (1 + a * mu)) * (k + 1 / a) / (k + 1) END AS st
    FROM qs WHERE w > 0 AND mu > 0 AND w * cdf < 0.99::DOUBLE - (1.0::DOUBLE - w))),
ql AS (SELECT item_id, site_id, model, lv, coalesce(min(CASE WHEN w * cdf >= lv - (1.0::DOUBLE - w) THEN k END), 0)::DOUBLE AS q
  FROM qs CROSS JOIN (SELECT unnest([{', '.join(c + '::DOUBLE' for c in QCOLS)}]) AS lv) GROUP BY ALL),
qa AS (SELECT item_id, site_id, model, list(q ORDER BY lv) AS quantiles FROM ql GROUP BY ALL)"""

QM = ("ZIP", "HURDLE_NB")
QFC = Q.panel() + "," + Q.forecasts(models=QM)
QROWS = Q.with_external(QFC) + "," + COUNT_Q + """,
qr AS (SELECT f.* EXCLUDE (level), m.model, greatest(CASE m.model WHEN 'ZIP' THEN f_ZIP WHEN 'HURDLE_NB' THEN f_HURDLE_NB ELSE f_EXT END, 0) AS level,
    CASE m.model WHEN 'EXT' THEN coalesce(e.q, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) ELSE a.quantiles END AS quantiles,
    y[17:20] AS test, y[1:16] AS train
  FROM fcx f CROSS JOIN (SELECT unnest(['ZIP', 'HURDLE_NB', 'EXT']) AS model) m
  LEFT JOIN qa a ON a.item_id = f.item_id AND a.site_id = f.site_id AND a.model = m.model
  LEFT JOIN ext e ON e.item_id = f.item_id AND e.site_id = f.site_id)"""


def quantile_rows(spark, sf, extra=()):
    p = P.prepared_panel(spark, sf)
    fc = D.with_count_quantiles(S.with_forecasts(p, models=QM)).join(X.external_forecasts(p), KEYS, "left")
    return D.explode_quantile_models(fc, CLEAN, [*P.ATTRS, *extra])


@add("predictive_quantiles", Q.query(QFC + "," + COUNT_Q, """
SELECT item_id, site_id, model, array_to_string(list_transform(quantiles, lambda v: v::BIGINT), ',') AS q FROM qa"""))
def predictive_quantiles(spark, sf):
    p = D.with_count_quantiles(S.with_forecasts(P.prepared_panel(spark, sf), models=QM))
    return p.selectExpr(*KEYS, "inline(array(struct('ZIP' AS model, q_ZIP AS q), struct('HURDLE_NB' AS model, q_HURDLE_NB AS q)))").select(
        *KEYS, "model", F.expr("array_join(transform(q, v -> CAST(v AS BIGINT)), ',') AS q"))


NATIVE = """
np AS (SELECT *, rp + eoq AS up_to, rp + eoq AS opening FROM (
  SELECT *, greatest(lead_q * (CASE tier WHEN 'high' THEN quantiles[5] ELSE quantiles[4] END), 0) AS rp,
    greatest(sqrt(2 * (level * 4) * 50 / (0.25::DOUBLE * price)), 1) AS eoq FROM qr)),"""


@add("policy_compare", Q.query(QROWS + "," + Q.policy(src="qr") + "," + Q.replay(H, IDS) + "," + Q.costs()
     + "," + NATIVE + Q.replay(H, IDS, src="np", out="nrep") + "," + Q.costs(src="nrep", out="nsc"), """
SELECT model, rd3(a.c) AS cost_normal, rd3(b.c) AS cost_native, rd6(a.f) AS fill_normal, rd6(b.f) AS fill_native, rd4(100 * (b.c - a.c) / a.c) AS delta_pct
FROM (SELECT model, avg(cost) AS c, avg(fill) AS f FROM sc GROUP BY model) a JOIN (SELECT model, avg(cost) AS c, avg(fill) AS f FROM nsc GROUP BY model) b USING (model)"""))
def policy_compare(spark, sf):
    rows = quantile_rows(spark, sf)
    a = with_costs(replay(with_normal_policy(rows), H)).groupBy("model").agg(F.avg("cost").alias("c0"), F.avg("fill").alias("f0"))
    b = with_costs(replay(with_quantile_policy(rows), H)).groupBy("model").agg(F.avg("cost").alias("c1"), F.avg("fill").alias("f1"))
    return a.join(b, "model").select("model", r("c0", 3, "cost_normal"), r("c1", 3, "cost_native"), r("f0", 6, "fill_normal"),
                                     r("f1", 6, "fill_native"), r("100.0D * (c1 - c0) / c0", 4, "delta_pct"))


@add("fill_matched_policy")
def fill_matched_policy(spark, sf):
    return K.fill_matched(quantile_rows(spark, sf), H)


@add("quantile_coverage", Q.query(QROWS, """
SELECT model, lv AS level, rd6(avg(CASE WHEN x <= q THEN 1.0::DOUBLE ELSE 0 END)) AS coverage, count(*) AS n FROM (
  SELECT model, lv, q, unnest(test) AS x FROM (SELECT model, test, unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS lv, unnest(quantiles) AS q FROM qr)) GROUP BY ALL"""))
def quantile_coverage(spark, sf):
    return D.coverage(quantile_rows(spark, sf), CLEAN).select("model", "level", r("coverage"), "n")


CONF = QROWS + """,
cfac AS (SELECT model, lv AS level, quantile_cont(ratio, lv) AS factor FROM (
  SELECT model, lv, unnest(train) / greatest(q, 1e-9::DOUBLE) AS ratio FROM (SELECT model, train, unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS lv, unnest(quantiles) AS q FROM qr)) GROUP BY model, lv)"""
CONF_FAC = CONF.replace("quantile_cont(ratio, lv) AS factor", "CASE lv " + " ".join(f"WHEN {Q.num(v)} THEN quantile_cont(ratio, {v})" for v in C.QUANTILE_LEVELS) + " END AS factor")


@add("conformal_factors", Q.query(CONF_FAC, "SELECT model, level, rd4(factor) AS factor FROM cfac"))
def conformal_factors(spark, sf):
    return D.conformal_factors(quantile_rows(spark, sf)).select("model", "level", r("factor", 4))


QSIG = "greatest((quantiles[3] - quantiles[1]) / " + Q.num(Q.z_of(0.9)) + ", 0.1::DOUBLE * sigma)"


@add("quantile_sigma_cost", Q.query(QROWS + "," + Q.policy(src="qr") + "," + Q.replay(H, IDS) + "," + Q.costs() + ","
     + Q.policy(src="qr", out="pq", sigma=f"({QSIG})") + "," + Q.replay(H, IDS, src="pq", out="rq") + "," + Q.costs(src="rq", out="sq"), """
SELECT model, rd3(a) AS cost_residual, rd3(b) AS cost_quantile, rd4(100 * (b - a) / a) AS delta_pct FROM
  (SELECT model, avg(cost) AS a FROM sc GROUP BY model) JOIN (SELECT model, avg(cost) AS b FROM sq GROUP BY model) USING (model)"""))
def quantile_sigma_cost(spark, sf):
    from partcast.functions.guarded import normal_quantile
    rows = quantile_rows(spark, sf)
    both = rows.selectExpr("* EXCEPT (sigma)", f"inline(array(struct('residual' AS sig_kind, sigma AS sigma), struct('quantile' AS sig_kind, {D.quantile_sigma(normal_quantile(0.9))} AS sigma)))")
    d = with_costs(replay(with_normal_policy(both), H)).groupBy("model").agg(
        F.expr("avg(if(sig_kind = 'residual', cost, NULL))").alias("a"), F.expr("avg(if(sig_kind = 'quantile', cost, NULL))").alias("b"))
    return d.select("model", r("a", 3, "cost_residual"), r("b", 3, "cost_quantile"), r("100.0D * (b - a) / a", 4, "delta_pct"))


@add("price_proportional_recost", Q.query(Q.scored(), """
SELECT model, rd3(avg(cost)) AS cost, rd3(avg(hold_cost + order_cost + short_units * (0.0625::DOUBLE * price))) AS cost_flat FROM sc GROUP BY model"""))
def price_proportional_recost(spark, sf):
    h = CostTerms().holding_per_quarter
    return P.scored_from(spark, sf).groupBy("model").agg(
        r(F.avg("cost"), 3, "cost"), r(F.expr(f"avg(hold_cost + order_cost + short_units * ({h}D * price))"), 3, "cost_flat"))


@add("critical_fractile_summary", Q.query(Q.panel(), """
SELECT rd6(quantile_cont(q, 0.1)) AS p10, rd6(quantile_cont(q, 0.5)) AS p50, rd6(quantile_cont(q, 0.9)) AS p90, rd6(avg(CASE WHEN q > 0.5 THEN 1.0::DOUBLE ELSE 0 END)) AS share_above_half
FROM (SELECT 100 / (100 + 0.0625::DOUBLE * price) AS q FROM panel)"""))
def critical_fractile_summary(spark, sf):
    p = S.extend(P.prepared_panel(spark, sf).select("price"), {"g": "1", "q": "100.0D / (100.0D + 0.0625D * price)"})
    q = quantile_columns(p, ["g"], "q", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    share = p.groupBy("g").agg(F.expr("avg(if(q > 0.5D, 1.0D, 0.0D))").alias("share_above_half"))
    return q.join(share, "g").select(r("p10"), r("p50"), r("p90"), r("share_above_half"))


def arm_sql(grain: str = "sku") -> str:
    parts, tags = [Q.panel(grain)], []
    for i, win in enumerate(dict.fromkeys((a[1], a[2], a[3]) for a in C.ARMS)):
        w, tag = C.Window(*win), f"_w{i}"
        arms = [a for a in C.ARMS if (a[1], a[2], a[3]) == win]
        cols = ", ".join(f"{e} AS {n}" for n, e in mix_columns("item_id * 2147483647 + site_id", "0", 42).items())
        opening = "CASE init WHEN 'S' THEN up_to WHEN 's' THEN rp WHEN 'zero' THEN 0 ELSE rp + (_h4 / 2147483647.0::DOUBLE) * greatest(up_to - rp, 0) END"
        names = ", ".join(f"'{a[0]}'" for a in arms)
        inits = ", ".join(f"'{a[4]}'" for a in arms)
        parts += [Q.forecasts(w.train, True, C.MODELS, tag), Q.long_rows(w, C.MODELS, tag), Q.policy(tag),
                  f"op{tag} AS (SELECT * REPLACE ({opening} AS opening) FROM (SELECT *, {cols}, unnest([{names}]) AS arm, unnest([{inits}]) AS init FROM pl{tag}))",
                  Q.replay(w.horizon, "item_id, site_id, model, arm", tag, src=f"op{tag}"), Q.costs(tag)]
        tags.append(f"SELECT arm, model, item_id, site_id, segment, price, mae, cost, hold_cost, short_cost, order_cost, n_orders, fill, test_demand FROM sc{tag}")
    parts.append("arms AS (" + " UNION ALL ".join(tags) + ")")
    return ",".join(parts)


ARMS_SQL = arm_sql()


@add("specification_arms", Q.query(ARMS_SQL + """,
am AS (SELECT arm, model, avg(CASE WHEN n_orders > 0 THEN 1.0::DOUBLE ELSE 0 END) AS order_share, avg(n_orders) AS orders, sum(hold_cost) / sum(cost) AS hold_share,
  sum(short_cost) / sum(cost) AS short_share, avg(fill) AS fill, avg(cost) AS cost, avg(mae) AS mae FROM arms GROUP BY ALL)""", """
SELECT arm, rd6(avg(order_share)) AS order_share, rd6(avg(orders)) AS orders, rd6(avg(hold_share)) AS hold_share, rd6(avg(short_share)) AS short_share,
  rd6(avg(fill)) AS fill, rd3(avg(cost)) AS cost, arg_min(model, struct_pack(a := rd6(cost), b := model)) AS cheapest, arg_min(model, struct_pack(a := rd6(mae), b := model)) AS most_accurate
FROM am GROUP BY arm"""))
def specification_arms(spark, sf):
    d = K.arm_diagnostics(K.arm_rows(P.prepared_panel(spark, sf)))
    return d.select("arm", *[r(c) for c in ("order_share", "orders", "hold_share", "short_share", "fill")], r("cost", 3), "cheapest", "most_accurate")


@add("specification_regime_rho", Q.query(ARMS_SQL + """,
real AS (SELECT arm, item_id, site_id, avg(hold_cost) >= avg(short_cost) AS hi FROM arms GROUP BY ALL),
gg AS (SELECT arm, 'all' AS grp, model, mae, cost FROM arms
  UNION ALL SELECT arm, CASE WHEN price >= 1600 THEN 'fixed_holding' ELSE 'fixed_stockout' END, model, mae, cost FROM arms
  UNION ALL SELECT arm, CASE WHEN hi THEN 'realised_holding' ELSE 'realised_stockout' END, model, mae, cost FROM arms JOIN real USING (arm, item_id, site_id)),"""
  + Q.means("gg", "arm, grp", {"mae": "avg(mae)", "cost": "avg(cost)"}) + "," + Q.rho("arm, grp", "mae", "cost"), "SELECT arm, grp, n, rd6(rho) AS rho FROM rho_t"))
def specification_regime_rho(spark, sf):
    means = K.arm_means(P.prepared_panel(spark, sf))
    return N.vectors_rho(N.vectors_of(means, ["arm", "grp"], ["mae", "cost"])).select("arm", "grp", "n", r("rho"))
