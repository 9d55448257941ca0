"""Queries: bootstrap intervals from replicate matrices.

Each analysis stands here twice where SQL can follow it: with few replicates of
portable weights, on one row per part, against SQL; and on all series with as
many replicates as such studies publish, whose tests compare the two.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from partcast import config as C
from partcast.catalog import sql_parts as Q
from partcast.catalog.costing import DEPLOYED, arm_sql
from partcast.catalog.inference import DIST_PAIRS, QMODELS, WS, dist_rows, taus as series_taus, weighted_panel
from partcast.catalog.registry import REGISTRY
from partcast.catalog.rounding import r
from partcast.config import MODELS
from partcast.functions import smoothing as S
from partcast.operators import replicates as R
from partcast.plans import analyses as N, compare as P, costing as K, intervals as V
from partcast.sources import fixtures as X
from partcast.sources.fixtures import KEYS

add = REGISTRY.add
FEW = 200
SC = Q.scored(grain="part")
ENDS = "rd6(quantile_cont(rho, 0.025)) AS lo, rd6(quantile_cont(rho, 0.975)) AS hi, rd6(avg(CASE WHEN rho <= 0 THEN 1.0::DOUBLE WHEN rho > 0 THEN 0 END)) AS p_le_zero, count(rho) AS replicates"
SEGMENTS = (*C.SEGMENT_LEVELS, "Unknown")


def ends(df, *keys, digits=6):
    return df.select(*keys, *[r(c, digits) for c in ("point", "lo", "hi")], r("p_le_zero"), "replicates", "enough")


# --- price cells ----------------------------------------------------------------------------------

THR = ", ".join(str(t) for t in C.PRICE_THRESHOLDS)
CELLS = f"""
e AS (SELECT quantile_cont(price, [{', '.join(map(str, C.BAND_PROBS))}]) AS b FROM panel),
pc AS (SELECT *, 'sweep' AS kind, t || CASE WHEN price >= t THEN ' above' ELSE ' below' END AS cell, cost AS paid FROM sc CROSS JOIN (SELECT unnest([{THR}]) AS t)
  UNION ALL SELECT sc.*, 0, 'band', i::VARCHAR, cost FROM sc, e, (SELECT unnest(range(1, 8)) AS i) WHERE price >= b[i] AND (price < b[i + 1] OR (i = 7 AND price <= b[8]))
  UNION ALL SELECT *, 'flat', t || CASE WHEN price >= t THEN ' above' ELSE ' below' END, hold_cost + order_cost + short_units * (0.0625::DOUBLE * price) FROM sc CROSS JOIN (SELECT unnest({list(V.FALSIFIED)}) AS t)
  UNION ALL SELECT *, 0, 'flat', 'all', hold_cost + order_cost + short_units * (0.0625::DOUBLE * price) FROM sc),"""
PRICED = SC + "," + CELLS + Q.weights("pc", FEW) + """,
bms AS (SELECT kind, cell, b, model, rd6(sum(w * mae) / sum(w)) AS mae, rd6(sum(w * paid) / sum(w)) AS cost, count(*) AS n FROM bw GROUP BY ALL HAVING sum(w) > 0),""" + Q.means("pc", "kind, cell", {"mae": "avg(mae)", "cost": "avg(paid)"}) + "," + Q.rho("kind, cell", "mae", "cost", out="rp") + "," + Q.rho("kind, cell, b", "mae", "cost", "bms")


def localized(spark, sf, grain, replicates, draw):
    return V.price_localization(P.prepared_panel(spark, sf, grain), _scored_with_band, replicates, draw=draw)


def _scored_with_band(panel):
    from partcast.operators.policy import with_normal_policy
    from partcast.operators.replay import replay, with_costs
    rows = P.forecast_rows(panel, keep=[*P.ATTRS, "band"])
    return with_costs(replay(with_normal_policy(rows), C.CLEAN.horizon))


@add("price_localization", Q.query(PRICED, f"""
SELECT kind, cell, any_value(rp.n) AS n, rd6(any_value(rp.rho)) AS point, {ENDS.replace('rho', 'rho_t.rho')}, any_value(rp.n) >= {V.ENOUGH} AS enough
FROM rp LEFT JOIN rho_t USING (kind, cell) GROUP BY kind, cell"""))
def price_localization(spark, sf):
    return ends(localized(spark, sf, "part", FEW, R.portable_weights), "kind", "cell", "n")


@add("price_localization_1000")
def price_localization_1000(spark, sf):
    return ends(localized(spark, sf, "sku", 1_000, R.quick_weights), "kind", "cell", "n")


# --- arms -----------------------------------------------------------------------------------------

ARM_GROUPS = """
gg AS (SELECT *, 'fixed' AS label, 'all' AS grp FROM ar
  UNION ALL SELECT *, 'fixed', CASE WHEN price >= 1600 THEN 'holding' ELSE 'stockout' END FROM ar
  UNION ALL SELECT *, 'realised', CASE WHEN hi THEN 'holding' ELSE 'stockout' END FROM ar),"""
ARM_RHO = Q.weights("gg", FEW) + """,
bms AS (SELECT arm, label, grp, b, model, rd6(sum(w * mae) / sum(w)) AS mae, rd6(sum(w * cost) / sum(w)) AS cost, count(*) AS n FROM bw GROUP BY ALL HAVING sum(w) > 0),""" + Q.means(
    "gg", "arm, label, grp", {"mae": "avg(mae)", "cost": "avg(cost)"}) + "," + Q.rho("arm, label, grp", "mae", "cost", out="rp") + "," + Q.rho("arm, label, grp, b", "mae", "cost", "bms")
ARM_ENDS = f"""
SELECT arm, label, grp, any_value(rp.n) AS n, rd6(any_value(rp.rho)) AS point, {ENDS.replace('rho', 'rho_t.rho')}, any_value(rp.n) >= {V.ENOUGH} AS enough
FROM rp LEFT JOIN rho_t USING (arm, label, grp) GROUP BY arm, label, grp"""


@add("grid_inference", Q.query(arm_sql("part") + """,
ar AS (SELECT arms.*, hi FROM arms JOIN (SELECT arm, item_id, site_id, avg(hold_cost) >= avg(short_cost) AS hi FROM arms GROUP BY ALL) USING (arm, item_id, site_id)),"""
    + ARM_GROUPS + ARM_RHO, ARM_ENDS))
def grid_inference(spark, sf):
    return ends(V.specification_rho(P.prepared_panel(spark, sf, "part"), FEW, draw=R.portable_weights), "arm", "label", "grp", "n")


@add("grid_inference_2000")
def grid_inference_2000(spark, sf):
    return ends(V.specification_rho(P.prepared_panel(spark, sf), 2_000), "arm", "label", "grp", "n")


def information_arms(panel):
    """The comparison table before and after the last update of the smoothers, as two arms of a series row."""
    both, metrics = None, ["mae", "cost", "hold_cost", "short_cost"]
    for i, equal in enumerate((False, True)):
        both = P.with_scores(panel if both is None else both, metrics, f"_s{i}", equal_info=equal)
    held = lambda i: " + ".join(f"coalesce(get(_s{i}.hold_cost, {m}), 0.0D)" for m in range(len(MODELS)))
    arms = ", ".join(f"struct('{name}' AS arm, _s{i}.mae AS mae, _s{i}.cost AS cost, if({held(i)} >= "
                     f"{held(i).replace('hold_cost', 'short_cost')}, 'holding', 'stockout') AS realised)" for i, name in enumerate(INFO))
    return both.selectExpr(*KEYS, "price", f"inline(array({arms}))")


INFO = ["base", "equal_info"]


@add("information_set_rho", Q.query(Q.panel("part") + "," + Q.scored(tag="_a", with_panel=False) + "," + Q.scored(tag="_b", with_panel=False, equal_info=True) + """,
ab AS (SELECT 'base' AS arm, * FROM sc_a UNION ALL SELECT 'equal_info', * FROM sc_b),
ar AS (SELECT ab.*, hi FROM ab JOIN (SELECT arm, item_id, site_id, avg(hold_cost) >= avg(short_cost) AS hi FROM ab GROUP BY ALL) USING (arm, item_id, site_id)),"""
    + ARM_GROUPS + ARM_RHO, ARM_ENDS))
def information_set_rho(spark, sf):
    series = information_arms(P.prepared_panel(spark, sf, "part"))
    return ends(V.arms_rho(series, INFO, FEW, draw=R.portable_weights), "arm", "label", "grp", "n")


@add("information_set_rho_2000")
def information_set_rho_2000(spark, sf):
    return ends(V.arms_rho(information_arms(P.prepared_panel(spark, sf)), INFO, 2_000), "arm", "label", "grp", "n")


# --- means per series -----------------------------------------------------------------------------

TAU_VIEWS = {"all": (0, 2), "stockout": (0, 1), "holding": (1, 2)}


def taus(spark, sf, grain, carry):
    return series_taus(spark, sf, [*carry, "test_demand"], grain).where("test_demand > 0")


@add("cost_regime_tau", Q.query(SC + "," + Q.tau("sc", "mae", "cost", carry="price, test_demand") + """,
tv AS (SELECT *, 'all' AS grp FROM tau_t WHERE tau IS NOT NULL AND test_demand > 0
  UNION ALL SELECT *, CASE WHEN price >= 1600 THEN 'holding' ELSE 'stockout' END FROM tau_t WHERE tau IS NOT NULL AND test_demand > 0),"""
    + Q.weights("tv", FEW) + ", bm AS (SELECT grp, b, sum(w * tau) / sum(w) AS rho FROM bw GROUP BY ALL HAVING sum(w) > 0), pt AS (SELECT grp, avg(tau) AS point, count(*) AS n FROM tv GROUP BY grp)", f"""
SELECT grp, any_value(n) AS n, rd6(any_value(point)) AS point, {ENDS}, any_value(n) >= {V.ENOUGH} AS enough FROM bm JOIN pt USING (grp) GROUP BY grp"""))
def cost_regime_tau(spark, sf):
    return regime_tau(taus(spark, sf, "part", ["price"]), FEW, R.portable_weights)


def regime_tau(t, replicates, draw):
    got = V.mean_interval(t, "tau_mc", replicates, V.regime_cell(), TAU_VIEWS, draw=draw)
    return with_size(got, "grp")


def with_size(got, name):
    return ends(got.withColumn("n", F.col("n").cast("long")).withColumn("enough", F.col("n") >= V.ENOUGH), F.col("name").alias(name), "n")


@add("cost_regime_tau_1000")
def cost_regime_tau_1000(spark, sf):
    return regime_tau(taus(spark, sf, "sku", ["price"]), 1_000, R.quick_weights)


CELL = (f"(array_position(array({', '.join(repr(s) for s in SEGMENTS)}), segment) - 1) * {len(C.ABC_LEVELS) + 1}"
        f" + array_position(array({', '.join(repr(a) for a in C.ABC_LEVELS)}), abc)")
CELL_VIEWS = {f"{s}|{a}": (i * 4 + j, i * 4 + j + 1) for i, s in enumerate(SEGMENTS) for j, a in enumerate(("Unknown", *C.ABC_LEVELS))}


@add("cell_tau_interval_1000")
def cell_tau_interval_1000(spark, sf):
    t = taus(spark, sf, "sku", ["segment", "abc"])
    return with_size(V.mean_interval(t, "tau_mc", 1_000, CELL, {"all": (0, 100)} | CELL_VIEWS), "cell")


@add("pinball_common_set_10000")
def pinball_common_set_10000(spark, sf):
    pairs = {k: DIST_PAIRS[k] for k in ("mae_cost", "pin_cost", "crps_cost")}
    t = N.per_series_stats(dist_rows(spark, sf).where("test_demand > 0"), pairs, models=QMODELS)
    both = S.keep_if(t, "rho_mae_cost IS NOT NULL AND rho_pin_cost IS NOT NULL AND rho_crps_cost IS NOT NULL")
    long = both.selectExpr(*KEYS, "inline(array(struct(0 AS metric, rho_pin_cost - rho_mae_cost AS d), struct(1 AS metric, rho_crps_cost - rho_mae_cost AS d)))")
    return with_size(V.mean_interval(long, "d", 10_000, "metric", {"pinball": (0, 1), "crps": (1, 2)}), "metric")


# --- fleet ----------------------------------------------------------------------------------------

@add("bootstrap_model_cost_20000")
def bootstrap_model_cost_20000(spark, sf):
    d = V.model_cost(P.prepared_panel(spark, sf), 20_000)
    return d.select("model", r("lo", 3), r("hi", 3), r("diff_lo", 3), r("diff_hi", 3), "resolved")


@add("bootstrap_regime_rho_20000")
def bootstrap_regime_rho_20000(spark, sf):
    return with_size(V.regime_rho(P.prepared_panel(spark, sf), 20_000), "grp")


SEEDS = (1, 7, 42, 2024, 99991)


@add("bootstrap_seed_sweep_20000")
def bootstrap_seed_sweep_20000(spark, sf):
    """Do 2,000 and 20,000 replicates give the same interval whatever the seed?"""
    panel, out = P.prepared_panel(spark, sf, "part"), None
    for b in (2_000, 20_000):
        for s in SEEDS:
            one = with_size(V.regime_rho(panel, b, s), "grp").select(F.lit(b).alias("b"), F.lit(s).alias("seed"), "*")
            out = one if out is None else out.unionByName(one)
    return out


# --- deployed policy ------------------------------------------------------------------------------

def _gap_sql(b: str, w: str) -> str:
    """Best and deployed mean cost per arm, with the replicate's weight or without."""
    cols = lambda k: f"sum({k} * cost) / sum({k}) AS c, sum({k} * dcost) / sum({k}) AS d"
    one = " UNION ALL ".join(
        f"SELECT '{arm}' AS arm, {b}model, {cols(k)} FROM {'bw' if b else 'ov'} GROUP BY ALL" for arm, k in
        (("unweighted", w), ("weighted", f"({w} * weight)")))
    return f"SELECT arm, {b}100 * (min(c) - any_value(d)) / any_value(d) AS gap FROM ({one}) GROUP BY ALL"


@add("weighted_deployed_gap", Q.query(WS + DEPLOYED + """,
ov AS (SELECT s.*, d.cost AS dcost FROM ws s JOIN dsc d USING (item_id, site_id)),""" + Q.weights("ov", FEW) + f"""
, bg AS ({_gap_sql('b, ', 'w')}), pt AS ({_gap_sql('', '1.0::DOUBLE')}),
sz AS (SELECT 'unweighted' AS arm, count(*)::DOUBLE AS n FROM ov WHERE model = 'SBA' UNION ALL SELECT 'weighted', sum(weight) FROM ov WHERE model = 'SBA')""", """
SELECT arm, rd4(any_value(pt.gap)) AS point, rd4(quantile_cont(bg.gap, 0.025)) AS lo, rd4(quantile_cont(bg.gap, 0.975)) AS hi,
  rd6(avg(CASE WHEN bg.gap <= 0 THEN 1.0::DOUBLE ELSE 0 END)) AS p_le_zero, count(*) AS replicates, rd4(any_value(sz.n)) AS n
FROM bg JOIN pt USING (arm) JOIN sz USING (arm) GROUP BY arm"""))
def weighted_deployed_gap(spark, sf):
    return sampled_gap(spark, sf, FEW, R.portable_weights)


@add("weighted_deployed_gap_2000")
def weighted_deployed_gap_2000(spark, sf):
    return sampled_gap(spark, sf, 2_000, R.quick_weights)


def sampled_gap(spark, sf, replicates, draw):
    """On the stratified sample, with and without its design weights."""
    p = P.prepared_panel(spark, sf)
    dep = K.deployed_replay(p, X.deployed_policy(p)).select(*KEYS, F.col("cost").alias("deployed"))
    got = V.deployed_gap(P.wide_scores(weighted_panel(spark, sf), ["cost"], ["weight"]), dep, replicates, "weight", draw=draw)
    return got.select("arm", r("point", 4), r("lo", 4), r("hi", 4), r("p_le_zero"), "replicates", r("n", 4))


@add("bootstrap_deployed_gap_20000")
def bootstrap_deployed_gap_20000(spark, sf):
    p = P.prepared_panel(spark, sf)
    dep = K.deployed_replay(p, X.deployed_policy(p)).select(*KEYS, F.col("cost").alias("deployed"))
    got = V.deployed_gap(P.wide_scores(p, ["cost"]), dep, 20_000)
    return got.select(r("point", 4), r("lo", 4), r("hi", 4), r("p_le_zero"), "replicates", F.col("n").cast("long").alias("n"))
