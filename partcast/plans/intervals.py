"""Intervals from replicate matrices: cost, rank agreement, price cells, arms, deployed gap.

Each analysis is one pass over the series: rows per series and arm, matrices per
cell, statistics per view (see `operators.replicates`).  `draw` picks the
weights: quick ones for thousands of replicates, portable ones where SQL checks
the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from partcast import config as C
from partcast.config import MODELS, CostTerms
from partcast.operators import replicates as R
from partcast.operators.replicates import Arm
from partcast.operators.scoring import arm_groups
from partcast.plans.analyses import with_price_band
from partcast.plans.compare import wide_scores
from partcast.plans.costing import arm_columns, regime
from partcast.plans.inference import paired_differences, wide_metrics
from partcast.sources.fixtures import KEYS

#: Groups of fewer series have an interval too, and are marked as too small.
ENOUGH = 30
REGIMES = {"all": (0, 2), "stockout": (0, 1), "holding": (1, 2)}


def regime_cell(price: str = "price") -> str:
    return f"if({regime(price)} = 'holding', 1, 0)"


def columns(metric: str, models=MODELS) -> tuple[str, ...]:
    return tuple(f"{metric}_{m}" for m in models)


def _run(df: DataFrame, arms: dict[str, Arm], views: dict, statistic, replicates: int, seed: int = 42, draw=R.quick_weights) -> DataFrame:
    sums = R.matrices(R.arm_rows(df, KEYS, arms), replicates, seed, draw=draw)
    return R.statistics(sums, list(arms), views, statistic, replicates)


def regime_rho(panel: DataFrame, replicates: int, seed: int = 42, draw=R.quick_weights) -> DataFrame:
    """Interval of the accuracy-cost rank correlation, over all series and per price regime."""
    wide = wide_scores(panel, ["mae", "cost"], ["price"])
    arm = Arm(regime_cell(), columns("mae") + columns("cost"))
    return R.interval(_run(wide, {"base": arm}, REGIMES, R.fleet_rho(len(MODELS)), replicates, seed, draw)).drop("arm")


def model_cost(panel: DataFrame, replicates: int, seed: int = 42, draw=R.quick_weights) -> DataFrame:
    """Mean cost per model with its interval, and that of its difference to the model that is cheapest overall."""
    wide = wide_scores(panel, ["cost"])
    stats = _run(wide, {"base": Arm("0", columns("cost"))}, {"all": (0, 1)}, lambda v: {n: R.means(s) for n, s in v.items()},
                 replicates, seed, draw)
    return paired_differences(stats.select("b", *[F.col("values")[i].alias(f"cost_{m}") for i, m in enumerate(MODELS)]), list(MODELS))


def mean_interval(df: DataFrame, value: str, replicates: int, cell: str = "0", views: dict | None = None, seed: int = 42,
                  draw=R.quick_weights) -> DataFrame:
    """Mean of a per-series value with its interval, per view; series without the value are left out."""
    def mean(sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {n: np.vstack([R.means(s), s[:1]]) for n, s in sums.items()}
    return R.interval(_run(df, {"base": Arm(cell, (value,))}, views or {"all": (0, 1)}, mean, replicates, seed, draw)).drop("arm")


def deployed_gap(wide: DataFrame, deployed: DataFrame, replicates: int, weight: str = "1.0D", seed: int = 42, draw=R.quick_weights) -> DataFrame:
    """Percent by which the cheapest model's mean cost differs from the deployed policy's, on the series that have both.

    Both sides are drawn with the same weights, and each replicate picks its own cheapest model.
    """
    wide = wide.join(deployed, KEYS)

    def gap(sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for n, s in sums.items():
            m = R.means(s)
            out[n] = np.vstack([100.0 * (m[:-1].min(axis=0) - m[-1]) / m[-1], m[:-1].min(axis=0), m[-1], s[0]])
        return out
    arms = {"unweighted": Arm("0", (*columns("cost"), "deployed"))}
    if weight != "1.0D":
        arms["weighted"] = Arm("0", (*columns("cost"), "deployed"), weight)
    return R.interval(_run(wide, arms, {"all": (0, 1)}, gap, replicates, seed, draw)).drop("name")


# -- price cells

BANDS = len(C.BAND_PROBS) - 1
FALSIFIED = (400, 1600, 3200)


def price_localization(panel: DataFrame, rows_of, replicates: int, seed: int = 42, draw=R.quick_weights) -> DataFrame:
    """(kind, cell, n, point, lo, hi, p_le_zero, replicates, enough) for each side of each price threshold, each band
    between price quantiles, and the sides and the whole with a flat critical fractile.

    One set of matrices: the cell of a series is its place among thresholds and bands together (a bounded product), the
    metrics are error, cost, and cost with a penalty in proportion to the price.
    """
    edges = ", ".join(str(t) for t in C.PRICE_THRESHOLDS)
    rows = rows_of(with_price_band(panel)).withColumn(
        "flat", F.expr("hold_cost + order_cost + short_units * (0.0625D * price)"))
    wide = wide_metrics(rows, list(MODELS), ["mae", "cost", "flat"], ["price", "band"])
    places = len(C.PRICE_THRESHOLDS) + 1
    arms = {"base": Arm(f"size(filter(array({edges}), t -> price >= t)) * {BANDS} + band - 1",
                        columns("mae") + columns("cost") + columns("flat"))}
    views: dict[str, R.View] = {}
    for i, t in enumerate(C.PRICE_THRESHOLDS, 1):
        views |= {f"sweep|{t} above": (i * BANDS, places * BANDS), f"sweep|{t} below": (0, i * BANDS)}
        if t in FALSIFIED:
            views |= {f"flat|{t} above": (i * BANDS, places * BANDS), f"flat|{t} below": (0, i * BANDS)}
    views |= {f"band|{b + 1}": [p * BANDS + b for p in range(places)] for b in range(BANDS)}
    views["flat|all"] = (0, places * BANDS)
    m = len(MODELS)

    def rho(sums: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {}
        for name, s in sums.items():
            x = R.means(s)
            y = x[2 * m:] if name.startswith("flat|") else x[m: 2 * m]
            out[name] = np.vstack([R.rank_correlation(x[:m], y), s[0]])
        return out
    got = R.interval(_run(wide, arms, views, rho, replicates, seed, draw))
    return got.selectExpr("split(name, '[|]')[0] AS kind", "split(name, '[|]')[1] AS cell", "CAST(n AS BIGINT) AS n", "point", "lo", "hi",
                          "p_le_zero", "replicates", f"n >= {ENOUGH} AS enough")


# -- arms

#: The cell of a series is twice its price regime and 1 more where holding costs prevail in the arm.
ARM_VIEWS: dict[str, R.View] = {"fixed|all": (0, 4), "fixed|stockout": (0, 2), "fixed|holding": (2, 4),
                                "realised|stockout": [0, 2], "realised|holding": [1, 3]}


def arms_rho(series: DataFrame, arms: list[str], replicates: int, seed: int = 42, draw=R.quick_weights) -> DataFrame:
    """(arm, label, grp, n, point, lo, hi, p_le_zero, replicates, enough): rank correlation per arm, over all series and per
    regime, by price (fixed) and by which cost prevails in that arm (realised).

    series: keys, arm, price, realised, and mae and cost as arrays over the models; the arms of a series side by side share
    its weights.  The realised label is the arm's own, so a replicate decides with it which series its regimes hold.
    """
    place = {a: i for i, a in enumerate(arms)}
    number = "CASE arm " + " ".join(f"WHEN '{a}' THEN {i}" for a, i in place.items()) + " END"
    long = series.where("NOT exists(mae, e -> e IS NULL) AND NOT exists(cost, e -> e IS NULL)").selectExpr(
        f"CAST({KEYS[0]} AS BIGINT) AS u0", f"CAST({KEYS[1]} AS BIGINT) AS u1", f"{number} AS arm",
        f"2 * {regime_cell()} + if(realised = 'holding', 1, 0) AS cell", "concat(array(1.0D), mae, cost) AS x")
    return _arms_interval(R.matrices(long, replicates, seed, draw=draw), arms, replicates)


def specification_rho(panel: DataFrame, replicates: int, seed: int = 42, draw=R.quick_weights, arms=C.ARMS, terms: CostTerms = CostTerms()) -> DataFrame:
    """:func:`arms_rho` of the specification arms of `costing.arm_series`, whose scores don't leave the task."""
    rows = arm_columns(panel, *[f"CAST({k} AS BIGINT) AS u{i}" for i, k in enumerate(KEYS)], terms=terms)
    read = arm_groups(list(arms), MODELS, ("mae", "cost"), terms)
    return _arms_interval(R.matrices(rows, replicates, seed, draw=draw, read=read), [a[0] for a in arms], replicates)


def _arms_interval(sums: DataFrame, arms: list[str], replicates: int) -> DataFrame:
    return R.interval(R.statistics(sums, arms, ARM_VIEWS, R.fleet_rho(len(MODELS)), replicates)).selectExpr(
        "arm", "split(name, '[|]')[0] AS label", "split(name, '[|]')[1] AS grp", "CAST(n AS BIGINT) AS n", "point", "lo", "hi",
        "p_le_zero", "replicates", f"n >= {ENOUGH} AS enough")
