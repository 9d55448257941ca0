"""Intermittent-demand smoothers as plain column arithmetic.

Every smoother here is a first-order linear recurrence, so a window of known
length unrolls into one chain ``keep * state + gain`` in which each state is
referenced once.  The chains stay inside generated code and need no lambda,
no shuffle and no Python worker.  They are written as SQL expression text:
one parse instead of one driver call per arithmetic operator.

Level and period use the quarter *before* the one they are reported for, so a
base forecast has consumed all but the last training quarter; the "next" form
applies the same step once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from partcast.config import MODELS


def extend(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Append named expressions; a later one may use an earlier name."""
    return df.selectExpr("*", *[f"{e} AS {name}" for name, e in exprs.items()])


def keep_if(df: DataFrame, condition: str) -> DataFrame:
    """Rows where ``condition`` holds, for conditions on costly computed columns.

    A plain filter is pushed below the projections that compute its columns,
    which repeats their whole expression; a generator is not.
    """
    kept = df.selectExpr("*", f"explode(if({condition}, array(1), array())) AS _kept")
    return kept.drop("_kept")


def items(y: str, start: int, end: int) -> list[str]:
    """Elements [start, end) of an array column."""
    return [f"get({y}, {i})" for i in range(start, end)]


def total(values: list[str]) -> str:
    return "(" + " + ".join(values) + ")"


def smooth(start: str, values: list[str], alpha: str) -> str:
    """Exponential smoothing from ``start`` over ``values``."""
    state = start
    for v in values:
        state = f"({alpha} * {v} + (1.0D - {alpha}) * {state})"
    return state


def block_sums(values: list[str], k: int) -> list[str]:
    """Sums over k consecutive quarters, aligned to the newest quarter."""
    n = len(values) // k
    first = len(values) - n * k
    return [total(values[first + i * k: first + (i + 1) * k]) for i in range(n)]


def demand_level(values: list[str], alpha: str, start: str) -> str:
    level = start
    for v in values:
        level = f"(if({v} > 0, 1.0D - {alpha}, 1.0D) * {level} + if({v} > 0, {alpha} * {v}, 0.0D))"
    return level


def demand_period(values: list[str], alpha: str, start: str) -> str:
    """Smoothed demand interval.

    The interval paired with a demand quarter is 1 once the series is running
    (it is reset by that same demand); only the first quarter still carries
    the initial interval.
    """
    period = start
    for i, v in enumerate(values):
        gap = start if i == 0 else "1.0D"
        period = f"(if({v} > 0, 1.0D - {alpha}, 1.0D) * {period} + if({v} > 0, {alpha} * {gap}, 0.0D))"
    return period


def demand_probability(values: list[str], beta: str, start: str) -> str:
    prob = start
    for v in values:
        prob = f"((1.0D - {beta}) * {prob} + if({v} > 0, {beta}, 0.0D))"
    return prob


def window_stats(y: str, train: int) -> dict[str, str]:
    """Count, total and moments of the training window."""
    v = items(y, 0, train)
    gaps = total([f"({x} - w_mean) * ({x} - w_mean)" for x in v])
    size_gaps = total([f"if({x} > 0, ({x} - w_size) * ({x} - w_size), 0.0D)" for x in v])
    return {
        "w_nz": total([f"if({x} > 0, 1.0D, 0.0D)" for x in v]),
        "w_sum": total(v),
        "w_pos": total([f"if({x} > 0, {x}, 0.0D)" for x in v]),
        "w_mean": f"w_sum / {train}.0D",
        "w_size": "if(w_nz > 0, w_pos / greatest(w_nz, 1.0D), 0.0D)",
        "w_adi": f"if(w_nz > 0, {train}.0D / greatest(w_nz, 1.0D), {train}.0D)",
        "w_var": f"{gaps} / {train}.0D",
        "w_size_var": f"{size_gaps} / greatest(w_nz, 1.0D)",
    }


# Zero-inflated Poisson by moments: mixing weight, rate, mean.
ZIP_FIT = {
    "z_over": "w_var > w_mean + 1e-12D AND w_mean > 0",
    "z_pi": "if(z_over, least((w_var - w_mean) / greatest(w_mean * w_mean + w_var - w_mean, 1e-12D),"
            " 1.0D - 1e-6D), 0.0D)",
    "z_lam": "greatest(if(z_over, w_mean + (w_var - w_mean) / greatest(w_mean, 1e-12D), w_mean), 1e-6D)",
    "z_mean": "(1.0D - z_pi) * z_lam",
}


def hurdle_fit(train: int) -> dict[str, str]:
    """Hurdle negative binomial by moments: probability, size mean, dispersion."""
    return {
        "h_p": f"w_nz / {train}.0D",
        "h_mu": "w_size",
        "h_disp": "least(greatest(if(w_size_var > w_size AND w_size > 0,"
                  " (w_size_var - w_size) / greatest(w_size * w_size, 1e-12D), 1e-6D), 1e-6D), 1e6D)",
        "h_mean": "h_p * h_mu",
        "h_var": "h_p * (h_mu + h_disp * h_mu * h_mu) + h_p * (1.0D - h_p) * h_mu * h_mu",
    }


def forecast_exprs(
    y: str, train: int, a: str, e: str, equal_info: bool, models: tuple[str, ...],
) -> dict[str, str]:
    v = items(y, 0, train)
    seen = v if equal_info else v[:-1]
    top = max(train // 3, 2)
    ks = range(1, top + 1)
    out = window_stats(y, train)
    want = set(models)
    if want & {"SBA", "CROSTON", "TSB"}:
        out["w_level"] = demand_level(seen, a, "w_size")
        out["w_period"] = demand_period(seen, a, "w_adi")
    if "TSB" in want:
        out["w_prob"] = demand_probability(seen, a, f"(w_nz / {train}.0D)")
    if want & {"ADIDA", "IMAPA"}:
        out["w_k"] = f"least(greatest(rint(w_adi), 1.0D), {max(train // 3, 1)}.0D)"
        out["w_kmax"] = f"least(greatest(rint(w_adi), 2.0D), {top}.0D)"
        for k in ks:
            b = block_sums(v, k)
            out[f"w_block{k}"] = f"{smooth(b[0], b, e)} / {k}.0D"
    if "ZIP" in want:
        out |= ZIP_FIT
    if "HURDLE_NB" in want:
        out |= hurdle_fit(train)
    final = {
        "SBA": f"(1.0D - {a} / 2.0D) * w_level / greatest(w_period, 1e-12D)",
        "SES": smooth(v[1], v[1:], e),
        "MA": f"({v[-1]} + {v[-2]}) / 2.0D",
        "CROSTON": "w_level / greatest(w_period, 1e-12D)",
        "TSB": "w_level * w_prob",
        "ADIDA": "CASE w_k " + " ".join(f"WHEN {k}.0D THEN w_block{k}" for k in ks) + " END",
        "IMAPA": total([f"if(w_kmax >= {k}.0D, w_block{k}, 0.0D)" for k in ks]) + " / w_kmax",
        "ZIP": "z_mean",
        "HURDLE_NB": "h_mean",
    }
    return out | {f"f_{m}": final[m] for m in models}


def with_forecasts(
    df: DataFrame,
    y: str = "y",
    train: int = 16,
    sba_alpha: str = "sba_alpha",
    ses_alpha: str = "ses_alpha",
    equal_info: bool = False,
    models: tuple[str, ...] = MODELS,
) -> DataFrame:
    """Add one ``f_<MODEL>`` column per forecaster, plus the window moments.

    ``equal_info`` applies the terminal update to SBA, CROSTON and TSB so that
    they, too, have seen the last training quarter.
    """
    return extend(df, forecast_exprs(y, train, sba_alpha, ses_alpha, equal_info, models))


def with_window_stats(df: DataFrame, y: str = "y", train: int = 16) -> DataFrame:
    return extend(df, window_stats(y, train))


def folded_level(y: str = "y", alpha: str = "sba_alpha"):
    """SBA level over a series of any length, as one array fold.

    For long or ragged series, where unrolling is not practical; equals
    :func:`demand_level` on a fixed window.
    """
    pos = f"filter({y}, x -> x > 0)"
    start = (f"if(size({pos}) > 0, aggregate({pos}, 0.0D, (a, x) -> a + x) / greatest(size({pos}), 1), 0.0D)")
    return F.expr(
        f"aggregate(slice({y}, 1, size({y}) - 1), {start}, "
        f"(s, x) -> if(x > 0, {alpha} * x + (1.0D - {alpha}) * s, s))")
