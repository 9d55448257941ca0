"""The batch form of forecast, policy and replay against the column form."""

import math

import pytest
from pyspark.sql import functions as F

from partcast import config as C
from partcast.catalog import inference
from partcast.config import MODELS
from partcast.plans import analyses as N, compare as P, costing as K
from partcast.sources.fixtures import KEYS

METRICS = ["level", "mae", "rmse", "rp", "eoq", "up_to", "on_hand_sum", "short_units", "n_orders", "hold_cost", "order_cost",
           "short_cost", "fill", "cost"]


def by_key(df, names):
    return {(*(r[k] for k in KEYS), r["model"]): [r[n] for n in names] for r in df.collect()}


@pytest.mark.parametrize("window,equal", [(C.CLEAN, False), (C.SHORT, True), (C.LATE, False), (C.LONG_TEST, True)])
def test_batch_scores_equal_column_scores(spark, sf, window, equal):
    panel = P.prepared_panel(spark, sf)
    # a quarter without a number, as a table with missing quantities has it
    odd = panel.limit(40).withColumn("y", F.expr("transform(y, (v, i) -> if(i % 9 = item_id % 9, NULL, v))"))
    for p in (panel, odd):
        slow = by_key(P.scored(p, window, equal_info=equal), METRICS)
        fast = by_key(P.long_scores(p, METRICS, window=window, equal_info=equal), METRICS)
        assert slow.keys() == fast.keys() and len(fast) >= 40 * len(MODELS)
        for k, want in slow.items():
            for a, b in zip(want, fast[k]):
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)), (k, want, fast[k])


def test_series_statistics_equal_column_statistics(spark, sf):
    pairs = {"lm": ("level", "mae"), "mc": ("mae", "cost")}
    want = {tuple(r[:2]): r[2:] for r in N.per_series_stats(P.scored_from(spark, sf), pairs).collect()}
    series = P.series_scores(P.prepared_panel(spark, sf), ["level", "mae", "cost"])
    for kind, at in (("tau", 0), ("rho", 2)):
        got = {tuple(r[:2]): r[2:] for r in N.series_stats(series, pairs, kind=kind).collect()}
        assert got.keys() == want.keys()
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-12))
                   for k in got for a, b in zip(got[k], want[k][at:at + 2]))


def test_models_of_a_series_are_not_brought_together_again(spark, sf):
    """One aggregation by series builds the panel; carried labels must not make another one that sorts."""
    plan = inference.taus(spark, sf, ["segment", "abc", "test_demand"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("HashAggregate(") == 2 and plan.count("Exchange ") == 1


def test_arms_of_a_series_stay_in_its_row(spark, sf):
    panel = P.prepared_panel(spark, sf)
    arms = K.arm_series(panel, ("mae", "cost"))
    plan = arms._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("ArrowEvalPython") == 1
    got = by_key(K.arm_rows(panel).where("arm = 'S/H4'"), ["mae", "cost", "fill"])
    want = by_key(P.scored(panel, equal_info=True), ["mae", "cost", "fill"])
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) for k in got for a, b in zip(got[k], want[k]))
    held = panel.count()
    assert {r["arm"]: r["count"] for r in arms.groupBy("arm").count().collect()} == {a[0]: held for a in C.ARMS}


def test_loss_differences_are_pooled_in_the_tasks(spark, sf):
    panel = P.prepared_panel(spark, sf)
    plan = N.dm_matrix(panel, C.CLEAN)._jdf.queryExecution().executedPlan().toString()
    assert "flatten" not in plan and "SortAggregate" not in plan
    rows = [r.asDict() for r in P.scored(panel).select(*KEYS, "model", "level", "test").collect()]
    loss = {}
    for r in rows:
        loss.setdefault(r["model"], {})[tuple(r[k] for k in KEYS)] = [(r["level"] - x) ** 2 for x in r["test"]]
    got = {(r["a"], r["b"]): r for r in N.dm_matrix(panel.repartition(5), C.CLEAN).collect()}
    assert len(got) == len(MODELS) * (len(MODELS) - 1)
    for (a, b), r in got.items():
        d = [x - y for k in loss[a] for x, y in zip(loss[a][k], loss[b][k])]
        mean = sum(d) / len(d)
        sd = math.sqrt(sum((x - mean) ** 2 for x in d) / (len(d) - 1))
        assert r["n"] == len(d) and math.isclose(r["stat"], mean / (sd / math.sqrt(len(d))), rel_tol=1e-9)


def test_quarters_of_an_item_are_summed_once(spark, sf):
    from partcast.catalog.relational import quarter_vector_long
    d = quarter_vector_long(spark, sf)
    assert d._jdf.queryExecution().executedPlan().toString().count("HashAggregate(") == 2


def test_ledger_regroups_nothing(spark, sf):
    from partcast.catalog.learning import comparison_ledger
    plan = comparison_ledger(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "first(test_demand" not in plan and "v_cost_0" not in plan


def test_fill_curve_equals_replayed_grid(spark, sf):
    from partcast.catalog.costing import quantile_rows
    from partcast.operators.policy import with_quantile_policy
    from partcast.operators.replay import replay, with_costs
    from partcast.operators.scoring import fill_curve
    rows = with_quantile_policy(quantile_rows(spark, sf))
    grid = {"ZIP": [0.0, 0.5, 1.0], "EXT": [0.25, 2.0]}
    got = {(r["model"], r["kappa"]): r for r in fill_curve(rows, grid).collect()}
    assert sorted(got) == sorted((m, k) for m, ks in grid.items() for k in ks)
    for k in (0.5, 2.0):
        for r in with_costs(replay(with_quantile_policy(rows.drop("rp", "eoq", "up_to", "q_service"), kappa=f"{k}D"), 4)).groupBy("model").agg(
                F.avg("fill").alias("fill"), F.avg("cost").alias("cost")).collect():
            if (r["model"], k) in got:
                assert math.isclose(got[r["model"], k]["fill"], r["fill"], rel_tol=1e-12)
                assert math.isclose(got[r["model"], k]["cost"], r["cost"], rel_tol=1e-12)


def test_distributional_summary_counts_once_and_equals_columns(spark, sf):
    """One pass over the models' rows (the plan had three), and the numbers of the column form."""
    from partcast.catalog.costing import quantile_rows
    from partcast.catalog.inference import distributional_summary
    from partcast.config import CLEAN
    from partcast.plans.distribution import distributional_scores
    from partcast.plans.compare import prepared_panel
    from partcast.sources.fixtures import external_forecasts
    out = distributional_summary(spark, sf)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("struct(model, ZIP") == 1
    assert sum(r["n"] for r in rows) == 3 * prepared_panel(spark, sf).count()
    p = prepared_panel(spark, sf)
    got = distributional_scores(p, external_forecasts(p), CLEAN, 0.95, KEYS).collect()
    want = {(r["item_id"], r["site_id"], r["model"]): r for r in quantile_rows(spark, sf).collect()}
    assert len(got) == len(want)
    for r in got:
        w = want[r["item_id"], r["site_id"], r["model"]]
        assert r["quantile"] == w["quantiles"][3]
        assert math.isclose(r["mae"], sum(abs(w["level"] - x) for x in w["test"]) / 4, rel_tol=1e-12, abs_tol=1e-12)


def odd_panel(panel):
    """Some series of the panel, with a quarter without a number in most of them, and all the others."""
    return panel.withColumn("y", F.expr("if(item_id % 5 = 0, transform(y, (v, i) -> if(i % 9 = item_id % 9, NULL, v)), y)"))


def same_means(got, want, keys, values):
    got, want = ({tuple(r[k] for k in keys): [r[v] for v in values] for r in d.collect()} for d in (got, want))
    assert got.keys() == want.keys()
    for k, x in want.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-11, abs_tol=1e-11)) for a, b in zip(got[k], x)), k
    return got


def one_pass(df):
    """The scores are made and summed in one step: no models, grids or arms as rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan and "inline(" not in plan


def test_lead_cv_grid_is_summed_in_the_tasks(spark, sf):
    panel = odd_panel(P.prepared_panel(spark, sf))
    got = K.lead_cv_sensitivity(panel)
    assert one_pass(got)
    rows = K.with_grid(P.forecast_rows(panel), [{"cv": v} for v in C.LEAD_CV_GRID])
    want = K.with_costs(K.replay(K.with_normal_policy(rows, lead_cv="cv"), 4)).groupBy("cv", "model").agg(
        F.avg("cost").alias("cost"), F.avg("fill").alias("fill"))
    assert len(same_means(got, want, ["cv", "model"], ["cost", "fill"])) == 3 * len(MODELS)
    assert K.lead_cv_sensitivity(panel.limit(0)).count() == 0
    none = K.lead_cv_sensitivity(panel.limit(3).withColumn("y", F.expr("transform(y, v -> CAST(NULL AS DOUBLE))")))
    assert {(r["cost"], r["fill"]) for r in none.collect()} == {(None, 1.0)}


def test_service_scenarios_are_summed_in_the_tasks(spark, sf):
    from partcast.functions.guarded import normal_quantile
    panel = odd_panel(P.prepared_panel(spark, sf))
    got = K.service_scenarios(panel)
    assert one_pass(got)
    grid = [{"scenario": n} | {z: normal_quantile(p) for z, p in zip(("zh", "zm", "zl"), of)} for n, *of in C.SERVICE_SCENARIOS]
    rows = K.with_grid(P.forecast_rows(panel), grid)
    want = K.with_costs(K.replay(K.with_normal_policy(rows, z=K.by_tier("zh", "zm", "zl")), 4)).groupBy("scenario", "model").agg(
        F.avg("cost").alias("cost"), F.avg("fill").alias("fill"))
    assert len(same_means(got, want, ["scenario", "model"], ["cost", "fill"])) == 5 * len(MODELS)


def test_arm_means_are_summed_in_the_tasks(spark, sf):
    panel = odd_panel(P.prepared_panel(spark, sf))
    got = K.arm_means(panel)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    rows = K.arm_rows(panel).selectExpr("*", f"explode(array('all', concat('fixed_', {K.regime()}), concat('realised_', realised))) AS grp")
    want = rows.groupBy("arm", "grp", "model").agg(F.avg("mae").alias("mae"), F.avg("cost").alias("cost"), F.count("*").alias("n"))
    assert len(same_means(got, want, ["arm", "grp", "model"], ["mae", "cost", "n"])) >= 3 * len(C.ARMS) * len(MODELS)


def test_specification_bootstrap_scores_in_its_own_task(spark, sf):
    from partcast.plans import intervals as V
    panel = odd_panel(P.prepared_panel(spark, sf)).repartition(3)
    got = V.specification_rho(panel, 40)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()
    want = V.arms_rho(K.arm_series(panel, ("mae", "cost")), [a[0] for a in C.ARMS], 40)
    names = ["n", "point", "lo", "hi", "p_le_zero", "replicates", "enough"]
    assert len(same_means(got, want, ["arm", "label", "grp"], names)) == 5 * len(C.ARMS)
