"""Cost analyses: grids of assumptions, arms, fill matching, regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from partcast import config as C
from partcast.config import CLEAN, LEAD_CV, CostTerms, Window
from partcast.functions import smoothing as S
from partcast.functions.guarded import normal_quantile
from partcast.functions.resampling import uniform_sql
from partcast.operators.bootstrap import UNIT
from partcast.operators.policy import by_tier, service_z, with_deployed_policy, with_normal_policy, with_quantile_policy
from partcast.operators.replay import replay, with_costs
from partcast.operators.scoring import arm_cells, arms_udf, fill_curve, policy_means
from partcast.plans.compare import by_model
from partcast.sources.fixtures import KEYS


def with_grid(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Every row once per configuration (an array of literals, no join)."""
    def lit(v) -> str:
        return f"'{v}'" if isinstance(v, str) else f"{float(v)!r}D"
    structs = ", ".join(
        "struct(" + ", ".join(f"{lit(v)} AS {k}" for k, v in row.items()) + ")" for row in rows)
    return df.selectExpr("*", f"inline(array({structs}))")


def regime(price: str = "price", terms: CostTerms = CostTerms()) -> str:
    return f"if({price} >= {terms.crossover_price}D, 'holding', 'stockout')"


def cost_config_sweep(rows: DataFrame, horizon: int) -> DataFrame:
    """Mean cost per cost configuration and model: 5 x 4 x 4 cells.

    The order quantity depends on the holding rate and order cost only, so 20
    replays serve 80 cells: the stockout penalty enters the already summed
    components.
    """
    grid = [{"h": h, "k": k} for h in C.HOLDING_RATES for k in C.ORDER_COSTS]
    df = with_normal_policy(with_grid(rows, grid), order_cost="k", holding_rate="h")
    df = replay(df, horizon)
    sums = df.groupBy("h", "k", "model").agg(
        F.expr("avg(on_hand_sum * price) * (h / 4.0D)").alias("hold"),
        F.expr("avg(n_orders) * k").alias("orders"),
        F.avg("short_units").alias("short"),
    )
    cells = with_grid(sums, [{"p": p} for p in C.STOCKOUT_COSTS])
    return cells.selectExpr("h", "k", "p", "model", "hold + orders + short * p AS cost")


def service_scenarios(panel: DataFrame, window: Window = CLEAN, models: tuple[str, ...] = C.MODELS) -> DataFrame:
    """Mean cost and fill per service-level scenario and model."""
    factors = [by_tier(*[f"{normal_quantile(p)!r}D" for p in targets]) for _, *targets in C.SERVICE_SCENARIOS]
    means = policy_means(panel, [(z, LEAD_CV) for z in factors], window, models)
    names = ", ".join(f"'{n}'" for n, *_ in C.SERVICE_SCENARIOS)
    return means.selectExpr(f"get(array({names}), place) AS scenario", "model", "cost", "fill")


def lead_cv_sensitivity(panel: DataFrame, window: Window = CLEAN, models: tuple[str, ...] = C.MODELS) -> DataFrame:
    """Mean cost and fill per variation of the lead time and model."""
    means = policy_means(panel, [(service_z(), v) for v in C.LEAD_CV_GRID], window, models)
    return means.selectExpr(f"get(array({', '.join(f'{v!r}D' for v in C.LEAD_CV_GRID)}), place) AS cv", "model", "cost", "fill")


def deployed_replay(panel: DataFrame, deployed: DataFrame, window: Window = CLEAN, terms: CostTerms = CostTerms()) -> DataFrame:
    """Replay of the deployed policy on the items that have one."""
    df = panel.selectExpr(
        *KEYS, "price", "lead_q", "segment", f"slice(y, {window.start + 1}, {window.horizon}) AS test")
    df = with_deployed_policy(df.join(deployed, KEYS))
    return with_costs(replay(df, window.horizon), terms)


ARM_METRICS = ("mae", "cost", "hold_cost", "short_cost", "order_cost", "n_orders", "fill")


def arm_series(panel: DataFrame, metrics: tuple[str, ...] = ARM_METRICS, arms=C.ARMS, models: tuple[str, ...] = C.MODELS,
               terms: CostTerms = CostTerms()) -> DataFrame:
    """The specification arms (train/test windows x opening stock), a row per series and arm: arrays over the models.

    Arms that share a window share forecasts and policy.  One uniform draw per
    series places every model at the same point of its ordering cycle.  The
    realised label says which cost prevails on average over the models.
    """
    done = S.extend(panel, uniform_sql(UNIT, 42)).withColumn("_s", arms_udf(metrics, list(arms), models, terms)(
        *[F.expr(x) for x in arm_inputs(terms)]))
    per = ", ".join(
        f"struct('{a[0]}' AS arm, " + ", ".join(f"_s.{m}_{i} AS {m}" for m in metrics)
        + f", if(_s.holding_{i} > 0, 'holding', 'stockout') AS realised)" for i, a in enumerate(arms))
    return done.selectExpr(*KEYS, "segment", "price", f"inline(array({per}))")


def arm_inputs(terms: CostTerms = CostTerms()) -> list[str]:
    """What the scores of the arms are made of; u is the draw of `uniform_sql`."""
    return ["y", "sba_alpha", "ses_alpha", "price", "lead_days", "lead_q", service_z(terms), "u"]


def arm_columns(panel: DataFrame, *keys: str, terms: CostTerms = CostTerms()) -> DataFrame:
    """Keys, the price regime (1 is holding) and the inputs of the arms."""
    return S.extend(panel, uniform_sql(UNIT, 42)).selectExpr(
        *keys, f"if({regime(terms=terms)} = 'holding', 1, 0) AS own", *[f"{x} AS x{i}" for i, x in enumerate(arm_inputs(terms))])


def arm_means(panel: DataFrame, metrics: tuple[str, ...] = ("mae", "cost"), arms=C.ARMS, models: tuple[str, ...] = C.MODELS,
              terms: CostTerms = CostTerms()) -> DataFrame:
    """(arm, grp, model, n, metrics): the means of :func:`arm_rows` over all series and per regime, by price (fixed) and by the
    cost that prevails in the arm (realised); tasks send sums."""
    cells = arm_cells(arm_columns(panel, terms=terms), list(arms), models, metrics, terms)
    side = lambda bit: f"if({bit} = 1, 'holding', 'stockout')"
    groups = cells.selectExpr(
        "*", f"explode(array('all', concat('fixed_', {side('shiftright(cell, 1)')}), concat('realised_', {side('cell & 1')}))) AS grp")
    names = ", ".join(f"'{a[0]}'" for a in arms)
    return groups.groupBy("arm", "grp", "model").agg(
        F.sum("n").alias("n"), *[F.expr(f"try_divide(sum(sum_{m}), sum(n_{m})) AS {m}") for m in metrics]
    ).withColumn("arm", F.expr(f"get(array({names}), arm)"))


def arm_rows(panel: DataFrame, metrics: tuple[str, ...] = ARM_METRICS, models: tuple[str, ...] = C.MODELS) -> DataFrame:
    """:func:`arm_series` with a row per model."""
    return by_model(arm_series(panel, metrics, models=models), list(metrics), ["arm", *KEYS, "segment", "price", "realised"], models)


def arm_diagnostics(rows: DataFrame) -> DataFrame:
    """Did the policy run: order share, orders per series, cost mix, fill."""
    per = rows.groupBy("arm", "model").agg(
        F.expr("avg(if(n_orders > 0, 1.0D, 0.0D))").alias("order_share"), F.avg("n_orders").alias("orders"),
        F.expr("sum(hold_cost) / greatest(sum(cost), 1e-9D)").alias("hold_share"),
        F.expr("sum(short_cost) / greatest(sum(cost), 1e-9D)").alias("short_share"),
        F.avg("fill").alias("fill"), F.avg("cost").alias("cost"), F.avg("mae").alias("mae"),
    )
    best = lambda m: F.expr(f"min_by(model, struct(rint({m} * 1e6D) AS v, model))")
    return per.groupBy("arm").agg(
        *[F.avg(c).alias(c) for c in ("order_share", "orders", "hold_share", "short_share", "fill", "cost")],
        best("cost").alias("cheapest"), best("mae").alias("most_accurate"))


def fill_matched(
    rows: DataFrame, horizon: int, points: tuple[int, ...] = (65, 17, 17, 17), top: float = 8.0,
) -> DataFrame:
    """Scale each model's quantile policy to the fill of its normal policy.

    Each round replays a grid of scale factors, aggregates to one fill per
    (model, factor), and narrows to the first bracket that reaches the target
    (final width top / 64 / 16^3 = 3e-5); the brackets, one per model, enter
    the next round as numbers.  The fitted rows are kept between rounds.
    Fill is not monotone in the factor for every series, so the first crossing
    is taken and further crossings are reported.
    """
    rows = rows.persist()
    target_rows = with_costs(replay(with_normal_policy(rows), horizon))
    target = target_rows.groupBy("model").agg(F.avg("fill").alias("target"), F.avg("cost").alias("cost_normal"))
    base = with_quantile_policy(rows)
    brackets = {r["model"]: (0.0, top, r["target"], r["cost_normal"]) for r in target.collect()}
    state: dict[str, dict] = {}
    for step, n in enumerate(points):
        curve = fill_curve(base, {m: [lo + (hi - lo) * i / (n - 1.0) for i in range(n)] for m, (lo, hi, *_) in brackets.items()})
        points_of: dict[str, list] = {}
        for row in curve.collect():  # models x grid points
            points_of.setdefault(row["model"], []).append((row["kappa"], row["fill"], row["cost"]))
        for m in list(brackets):
            lo, hi, goal, normal = brackets[m]
            pts = sorted(points_of[m])
            reach = [i for i, p in enumerate(pts) if p[1] >= goal]
            if step == 0:
                state[m] = {"capped": not reach or pts[-1][1] < goal, "crossings": sum(
                    (a[1] >= goal) != (b[1] >= goal) for a, b in zip(pts, pts[1:]))}
            at = pts[-1] if state[m]["capped"] else pts[reach[0]]
            state[m] |= {"kappa": at[0], "fill": at[1], "cost": at[2], "target": goal, "cost_normal": normal}
            if state[m]["capped"]:
                brackets[m] = (hi, hi, goal, normal)
            elif reach[0] > 0:
                brackets[m] = (pts[reach[0] - 1][0], pts[reach[0]][0], goal, normal)
            else:
                brackets[m] = (lo, lo, goal, normal)
    rows.unpersist()
    out = [(m, float(s["kappa"]), bool(s["capped"]), int(s["crossings"]), s["target"], s["fill"],
            s["cost_normal"], s["cost"], 100.0 * (s["cost"] - s["cost_normal"]) / s["cost_normal"])
           for m, s in sorted(state.items())]
    return rows.sparkSession.createDataFrame(
        out, "model string, kappa double, capped boolean, crossings int, target double, fill double,"
             " cost_normal double, cost_matched double, delta_pct double")
