"""Resampling inference on model comparisons.

Replicate sums are additive over series, so every analysis reduces the
weighted metric block of each partition to one row per replicate and group;
only those rows are exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from partcast.functions import arrays as A
from partcast.functions.guarded import snap
from partcast.operators.bootstrap import UNIT, interval, replicate_sums
from partcast.sources.fixtures import KEYS


def wide_metrics(rows: DataFrame, models: list[str], metrics: list[str], carry: list[str]) -> DataFrame:
    """One row per series with columns <metric>_<model> (no exchange: the rows
    already sit with their series)."""
    aggs = [F.expr(f"max(if(model = '{m}', {x}, NULL)) AS {x}_{m}") for x in metrics for m in models]
    return rows.groupBy(*KEYS).agg(*[F.first(c).alias(c) for c in carry], *aggs)


def bootstrap_means(wide: DataFrame, models: list[str], metrics: list[str], replicates: int,
                    by: list[str] = (), seed: int = 42, engine: str = "numpy", point: bool = False) -> DataFrame:
    """Replicate means of every metric and model, the same weight for all models."""
    cols = [f"{x}_{m}" for x in metrics for m in models]
    sums = replicate_sums(wide, cols, replicates, by, seed, UNIT, engine, point).where("w > 0")
    return sums.select(*by, "b", *[(F.col(c) / F.col("w")).alias(c) for c in cols])


def _vector(metric: str, models: list[str]):
    return F.array(*[snap(F.col(f"{metric}_{m}"), 6) for m in models])


def bootstrap_rho(means: DataFrame, models: list[str], by: list[str] = (), x: str = "mae", y: str = "cost") -> DataFrame:
    """Interval of the fleet rank correlation, and the share of replicates at or below zero."""
    v = means.select(*by, "b", _vector(x, models).alias("_x"), _vector(y, models).alias("_y"))
    return interval(v.withColumn("_rho", A.spearman(F.col("_x"), F.col("_y"))), "_rho", by)


def paired_differences(means: DataFrame, models: list[str], metric: str = "cost") -> DataFrame:
    """Interval of each model's mean minus the cheapest model's, same replicate.

    ``means`` holds the plain estimate as replicate -1, which names the
    cheapest model; the table has one row per replicate.
    """
    pairs = ", ".join(
        f"struct(floor({metric}_{m} * 1e6D + 0.50001D) AS v, '{m}' AS model)" for m in sorted(models))
    best = F.max(F.expr(f"if(b = -1, array_min(array({pairs})).model, NULL)")).over(W.partitionBy(F.lit(0)))
    case = "CASE _best " + " ".join(f"WHEN '{m}' THEN {metric}_{m}" for m in models) + " END"
    diffs = ", ".join(
        f"struct('{m}' AS model, {metric}_{m} AS value, {metric}_{m} - {case} AS diff)" for m in models)
    long = means.withColumn("_best", best).where("b >= 0").selectExpr("b", f"inline(array({diffs}))")
    return long.groupBy("model").agg(
        F.percentile("value", 0.025).alias("lo"), F.percentile("value", 0.975).alias("hi"),
        F.percentile("diff", 0.025).alias("diff_lo"), F.percentile("diff", 0.975).alias("diff_hi"),
    ).withColumn("resolved", F.expr("diff_lo > 0 OR diff_hi < 0"))


def stratified_sums(wide: DataFrame, models: list[str], metrics: list[str], replicates: int, strata: list[str],
                    by: list[str] = (), seed: int = 42, engine: str = "numpy") -> DataFrame:
    """Design-consistent replicate means: resample within strata, fixed weights.

    Within a stratum the replicate mean estimates the stratum mean, and strata
    are combined with their population sizes (column ``pop_h``).
    """
    cols = [f"{x}_{m}" for x in metrics for m in models]
    keys = [*by, *strata]
    sums = replicate_sums(wide, cols, replicates, keys, seed, UNIT, engine).where("w > 0")
    size = wide.groupBy(*keys).agg(F.sum("weight").alias("pop_h"))
    joined = sums.join(size, keys)
    return joined.groupBy(*by, "b").agg(*[
        F.expr(f"sum(pop_h * {c} / w) / sum(pop_h)").alias(c) for c in cols])
