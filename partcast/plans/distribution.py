"""Predictive quantiles: exact count quantiles, shaping, conformal scaling."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from partcast.config import QUANTILE_LEVELS, Window
from partcast.functions import smoothing as S
from partcast.operators.quantiles import exact_quantiles
from partcast.operators.scoring import distributional_udf
from partcast.sources.fixtures import KEYS


def uncross(quantiles: str) -> Column:
    """Running maximum along the level grid, so quantiles never decrease."""
    return F.expr(f"transform({quantiles}, (v, i) -> array_max(slice({quantiles}, 1, i + 1)))")


def count_levels(weight: np.ndarray, mean: np.ndarray, disp: np.ndarray) -> np.ndarray:
    """Smallest k with CDF(k) >= level, for 0 mixed with a count distribution.

    With probability ``weight`` the count is Poisson(mean), or negative
    binomial with that mean when ``disp`` > 0; otherwise it is 0.  The mass
    function is advanced in log space for the whole batch, one k at a time,
    dropping rows once their last level is reached; equal distributions are
    counted once.
    """
    different, which = np.unique(np.column_stack([weight, mean, disp]), axis=0, return_inverse=True)
    w, mu, a = np.ascontiguousarray(different.T)
    n = len(w)
    out = np.zeros((n, len(QUANTILE_LEVELS)))
    # a level at or below the zero mass needs no counting
    target = np.array(QUANTILE_LEVELS)[None, :] - (1.0 - w)[:, None]
    rows = np.flatnonzero((w > 0) & (mu > 0) & (target[:, -1] > 0))
    poisson = a < 1e-5
    size = 1.0 / np.maximum(a, 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        logp = np.where(poisson, -mu, -size * np.log1p(a * mu))
        odds = np.where(poisson, mu, a * mu / (1.0 + a * mu))
    cdf = np.exp(logp)
    k = 0
    while rows.size:
        done = w[rows, None] * cdf[rows, None] >= target[rows]
        out[rows] = np.where(done, out[rows], k + 1.0)
        rows = rows[~done[:, -1]]
        k += 1
        step = np.where(poisson[rows], odds[rows] / k, odds[rows] * (k - 1 + size[rows]) / k)
        logp[rows] += np.log(step)
        cdf[rows] += np.exp(logp[rows])
        # numerical exhaustion of the tail
        rows = rows[(cdf[rows] < 1.0 - 1e-15) | (k < 2 * mu[rows] + 10)]
    return out[which.ravel()]


@F.pandas_udf(ArrayType(DoubleType()))
def count_quantiles(weight: pd.Series, mean: pd.Series, disp: pd.Series) -> pd.Series:
    """:func:`count_levels` as an array over the level grid."""
    return pd.Series(list(count_levels(*[x.to_numpy(np.float64) for x in (weight, mean, disp)])))


def with_count_quantiles(df: DataFrame) -> DataFrame:
    """Add q_ZIP and q_HURDLE_NB (arrays over the level grid) to fitted series."""
    return df.withColumns({
        "q_ZIP": count_quantiles(F.lit(1.0) - F.col("z_pi"), F.col("z_lam"), F.lit(0.0)),
        "q_HURDLE_NB": count_quantiles(F.col("h_p"), F.col("h_mu"), F.col("h_disp")),
    })


def explode_quantile_models(df: DataFrame, window: Window, keep: list[str], external: bool = True) -> DataFrame:
    """One row per series and quantile-emitting model."""
    rows = [
        "struct('ZIP' AS model, greatest(f_ZIP, 0.0D) AS level, q_ZIP AS quantiles)",
        "struct('HURDLE_NB' AS model, greatest(f_HURDLE_NB, 0.0D) AS level, q_HURDLE_NB AS quantiles)",
    ]
    if external:
        rows.append("struct('EXT' AS model, greatest(coalesce(point, 0.0D), 0.0D) AS level,"
                    " coalesce(quantiles, array(0.0D, 0.0D, 0.0D, 0.0D, 0.0D)) AS quantiles)")
    return df.selectExpr(
        *KEYS, *keep, "sqrt(w_var) AS sigma",
        f"slice(y, {window.start + 1}, {window.horizon}) AS test",
        f"slice(y, 1, {window.train}) AS train",
        f"inline(array({', '.join(rows)}))",
    )


def distributional_scores(panel: DataFrame, external: DataFrame, window: Window, level: float, keep: list[str]) -> DataFrame:
    """(keep..., model, mae, rmse, quantile) per series and quantile-emitting model: its errors and its quantile at a level.

    The numbers of :func:`explode_quantile_models`, without the models' column arithmetic, whose generated method is too
    long for the JVM.
    """
    place = QUANTILE_LEVELS.index(level)
    udf = distributional_udf(window, count_levels, place)
    rows = panel.select(*dict.fromkeys([*KEYS, *keep, "y"])).join(external, KEYS, "left").withColumn("_s", udf("y", F.expr("coalesce(point, 0.0D)")))
    at = lambda i: f"get(_s.mae, {i}) AS mae, get(_s.rmse, {i}) AS rmse"
    return rows.selectExpr(*keep, "inline(array("
                           f"struct('ZIP' AS model, {at(0)}, get(_s.quantile, 0) AS quantile),"
                           f"struct('HURDLE_NB' AS model, {at(1)}, get(_s.quantile, 1) AS quantile),"
                           f"struct('EXT' AS model, {at(2)}, coalesce(get(quantiles, {place}), 0.0D) AS quantile)))")


def pinball(q: str, level: str, items: list[str]) -> str:
    """Mean pinball loss of forecast ``q`` at quantile level ``level``."""
    loss = [f"if({x} >= {q}, {level} * ({x} - {q}), ({level} - 1.0D) * ({x} - {q}))" for x in items]
    return S.total(loss) + f" / {len(items)}.0D"


def crps(quantiles: str, items: list[str]) -> str:
    """Mean pinball loss over the level grid."""
    parts = [pinball(f"greatest(get({quantiles}, {i}), 0.0D)", f"{a}D", items) for i, a in enumerate(QUANTILE_LEVELS)]
    return S.total(parts) + f" / {len(parts)}.0D"


def coverage(rows: DataFrame, window: Window) -> DataFrame:
    """Share of test quarters at or below each predicted quantile."""
    long = rows.selectExpr("model", "test", "posexplode(quantiles) AS (i, q)").selectExpr(
        "model", "i", "greatest(q, 0.0D) AS q", "explode(test) AS x")
    levels = "array(" + ", ".join(f"{a}D" for a in QUANTILE_LEVELS) + ")"
    return long.groupBy("model", "i").agg(
        F.expr("avg(if(x <= q, 1.0D, 0.0D))").alias("coverage"), F.count("*").alias("n"),
    ).selectExpr("model", f"{levels}[i] AS level", "coverage", "n")


def conformal_factors(rows: DataFrame) -> DataFrame:
    """Per model and level: the level-quantile of pooled train / predicted quantile."""
    levels = "array(" + ", ".join(f"{a}D" for a in QUANTILE_LEVELS) + ")"
    ratios = rows.selectExpr("model", "train", "posexplode(quantiles) AS (i, q)").selectExpr(
        "model", f"{levels}[i] AS level", "greatest(q, 1e-9D) AS q", "explode(train) AS x",
    ).selectExpr("model", "level", "x / q AS ratio")
    found = exact_quantiles(ratios, ["model", "level"], "ratio", list(QUANTILE_LEVELS), only="prob = level")
    return found.select("model", "level", F.col("value").alias("factor"))


def conformalise(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """Multiply each model's quantiles by its factors.

    One row of factors per model, so the broadcast is bounded by the models.
    """
    f = factors.groupBy("model").agg(
        F.array_sort(F.collect_list(F.struct("level", "factor"))).alias("_f"))
    return rows.join(F.broadcast(f), "model").withColumn(
        "quantiles", F.expr("zip_with(quantiles, _f, (q, e) -> greatest(q * e.factor, 0.0D))")).drop("_f")


def hurdle_remap(levels: tuple[float, ...], p: str, quantiles: str) -> str:
    """Quantiles of a zero/size mixture from quantiles of the size part.

    A level inside the zero mass gives 0; otherwise the size quantile at
    (level - (1 - p)) / p, linear between grid points, anchored at (0, 0) and
    held at the top level.
    """
    grid = (0.0, *levels)

    def at(a: float) -> str:
        u = f"(({a}D - (1.0D - {p})) / greatest({p}, 1e-12D))"
        out = f"get({quantiles}, {len(levels) - 1})"
        for i in range(len(grid) - 2, -1, -1):
            lo, hi = grid[i], grid[i + 1]
            left = "0.0D" if i == 0 else f"get({quantiles}, {i - 1})"
            right = f"get({quantiles}, {i})"
            out = (f"if({u} < {hi}D, {left} + ({right} - {left}) * (({u} - {lo}D) / ({hi}D - {lo}D)), {out})")
        return f"if({a}D <= 1.0D - {p}, 0.0D, {out})"

    return "array(" + ", ".join(at(a) for a in levels) + ")"


def quantile_sigma(z90: float, quantiles: str = "quantiles", sigma: str = "sigma") -> str:
    """Spread from the predictive distribution, floored at a tenth of ``sigma``."""
    return f"greatest((get({quantiles}, 2) - get({quantiles}, 0)) / {z90!r}D, 0.1D * {sigma})"
