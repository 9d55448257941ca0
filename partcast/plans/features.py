"""Per-quarter features of a series, each from past quarters only.

Windows run inside one series, whose length is the number of quarters, so no
window partition grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W


def long_series(df: DataFrame, key: list[str], carry: list[str] = (), y: str = "y") -> DataFrame:
    return df.select(*key, *carry, F.posexplode(y).alias("_p", "v")).select(
        *key, *carry, (F.col("_p") + 1).alias("q"), "v")


def _past(key: list[str], rows: int | None = None):
    return W.partitionBy(*key).orderBy("q").rowsBetween(
        W.unboundedPreceding if rows is None else -rows, -1)


def with_lags(df: DataFrame, key: list[str], lags: tuple[int, ...]) -> DataFrame:
    """Value k quarters back, zero before the series starts."""
    w = W.partitionBy(*key).orderBy("q")
    return df.withColumns({f"lag{k}": F.lag("v", k, 0.0).over(w) for k in lags})


def with_rolling(df: DataFrame, key: list[str], widths: tuple[int, ...]) -> DataFrame:
    """Mean, population deviation and demand count over the previous quarters."""
    out = {}
    for n in widths:
        w = _past(key, n)
        out[f"mean{n}"] = F.coalesce(F.avg("v").over(w), F.lit(0.0))
        out[f"std{n}"] = F.coalesce(F.stddev_pop("v").over(w), F.lit(0.0))
        out[f"nz{n}"] = F.count(F.when(F.col("v") > 0, 1)).over(w)
    return df.withColumns(out)


def with_recency(df: DataFrame, key: list[str]) -> DataFrame:
    """Quarters since the last demand, demands so far, mean positive size."""
    w = _past(key)
    hit = F.when(F.col("v") > 0, F.col("q"))
    return df.withColumns({
        "since_last": F.col("q") - 1 - F.coalesce(F.max(hit).over(w), F.lit(0)),
        "n_demand": F.count(hit).over(w),
        "mean_size": F.coalesce(F.avg(F.when(F.col("v") > 0, F.col("v"))).over(w), F.lit(0.0)),
    })
