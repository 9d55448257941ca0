"""Checks of supplied forecasts and published error tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from partcast.functions import paths
from partcast.functions.smoothing import extend
from partcast.operators.quantiles import quantile_columns
from partcast.sources.fixtures import KEYS


def with_paths(df: DataFrame, window: str = "window") -> DataFrame:
    """SBA, SES and MA paths over the first ``window`` quarters of y."""
    return extend(df, {
        "wy": f"slice(y, 1, {window})",
        "path_SBA": paths.sba_path("wy", "sba_alpha"),
        "path_SES": paths.ses_path("wy", "ses_alpha"),
        "path_MA": paths.ma2_path("wy"),
    })


def supplied_paths(df: DataFrame, window: str = "window", digits: int = 2) -> DataFrame:
    """given_SBA, given_SES and given_MA as another system would supply them: from closed forms, rounded, with planted faults.

    Every value is a weighted sum over the quarters before it, without a recurrence, so that nothing of `with_paths` is
    in it.  Faults of 0.02 stand in one of seven items (SBA, after quarter 10), eleven (SES) and thirteen (MA).
    """
    def fold(values: str) -> str:
        return f"aggregate({values}, 0.0D, (s, v) -> s + v)"

    y, a = "_y", "sba_alpha"
    pos = f"filter(sequence(1, t - 1), i -> t > 1 AND {y}[i - 1] > 0)"
    weight = f"{a} * pow(1 - {a}, size(_x.p) - 1 - k)"
    level0, gap0 = f"({fold(f'filter({y}, x -> x > 0)')} / greatest(size(filter({y}, x -> x > 0)), 1))", f"(CAST(size({y}) AS DOUBLE) / greatest(size(filter({y}, x -> x > 0)), 1))"
    level = f"(pow(1 - {a}, size(_x.p)) * _l0 + {fold(f'transform(_x.p, (i, k) -> {weight} * {y}[i - 1])')})"
    gap = f"(pow(1 - {a}, size(_x.p)) * _g0 + {fold(f'transform(_x.p, (i, k) -> {weight} * if(i = 1, _g0, 1.0D))')})"
    sba = (f"transform(transform(sequence(1, size({y})), t -> named_struct('t', t, 'p', {pos})), _x -> "
           f"(1 - {a} / 2) * {level} / greatest({gap}, 1e-12D) + if(item_id % 7 = 2 AND _x.t > 10, 0.02D, 0.0D))")
    b = "ses_alpha"
    terms = f"transform(filter(sequence(2, greatest(t - 1, 2)), j -> j < t), j -> {b} * pow(1 - {b}, t - 1 - j) * {y}[j - 1])"
    ses = (f"transform(sequence(1, size({y})), t -> if(t <= 2, {y}[t - 1], pow(1 - {b}, t - 2) * {y}[1] + {fold(terms)})"
           " + if(item_id % 11 = 3, 0.02D, 0.0D))")
    ma = (f"transform(sequence(1, size({y})), t -> if(t <= 2, {y}[t - 1], {fold(f'slice({y}, greatest(t - 2, 1), 2)')} / 2)"
          " + if(item_id % 13 = 5, 0.02D, 0.0D))")
    rounded = lambda path: f"transform({path}, v -> floor(v * 1e{digits}D + 0.50001D) / 1e{digits}D)"
    return extend(df, {"_y": f"slice(y, 1, {window})", "_l0": level0, "_g0": gap0, "given_SBA": rounded(sba), "given_SES": rounded(ses),
                       "given_MA": rounded(ma)}).drop("_y", "_l0", "_g0")


def path_differences(df: DataFrame, models=("SBA", "SES", "MA")) -> DataFrame:
    """Largest and mean absolute gap to the supplied path, per series and model."""
    rows = ", ".join(
        f"struct('{m}' AS model, zip_with(path_{m}, given_{m}, (a, b) -> abs(a - b)) AS d)" for m in models)
    long = df.selectExpr(*KEYS, "segment", f"inline(array({rows}))")
    return extend(long, {
        "max_diff": "array_max(d)",
        "mean_diff": "aggregate(d, 0.0D, (s, x) -> s + x) / size(d)",
    }).drop("d")


def reproduction_summary(diffs: DataFrame, tolerance: float, by: list[str]) -> DataFrame:
    base = diffs.groupBy(*by).agg(
        F.count("*").alias("n"), F.expr(f"avg(if(max_diff <= {tolerance}D, 1.0D, 0.0D))").alias("share_ok"),
        F.avg("mean_diff").alias("mean_diff"))
    q = quantile_columns(diffs, by, "max_diff", {"p50": 0.5, "p95": 0.95})
    return base.join(q, by)


def recover_levels(table: DataFrame, models: list[str]) -> DataFrame:
    """Forecast levels from published bias, choosing the sign convention.

    Demand is non-negative, so the convention with fewer negative levels is
    the right one; both shares come from one aggregate.
    """
    def neg(sign: str) -> str:
        return "avg(" + " + ".join(f"if(oos_mean {sign} bias_{m} < -1e-9D, 1.0D, 0.0D)" for m in models) + f") / {len(models)}.0D"
    pick = table.agg(F.expr(f"if({neg('+')} <= {neg('-')}, 1.0D, -1.0D)")).scalar()
    return table.withColumn("_sign", pick).withColumns({
        f"level_{m}": F.expr(f"oos_mean + _sign * bias_{m}") for m in models}).drop("_sign")


def trailing_match(df: DataFrame, y: str, horizons: int) -> DataFrame:
    """Share of series whose trailing mean over H periods equals oos_mean, per H."""
    long = df.selectExpr("oos_mean", y, f"explode(sequence(1, {horizons})) AS h")
    return long.groupBy("h").agg(F.expr(
        f"avg(if(abs(aggregate(slice({y}, -h, h), 0.0D, (s, x) -> s + x) / h - oos_mean) < 1e-6D, 1.0D, 0.0D))").alias("share"))
