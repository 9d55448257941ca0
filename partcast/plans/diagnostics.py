"""Selection-bias and error-decomposition diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from partcast.operators.quantiles import quantile_columns
from partcast.sources.fixtures import KEYS


def with_overlap(panel: DataFrame, policy: DataFrame) -> DataFrame:
    members = policy.select(*KEYS).distinct().withColumn("_in", F.lit(True))
    return panel.join(members, KEYS, "left").withColumn("overlap", F.col("_in").isNotNull()).drop("_in")


def overlap_categories(panel: DataFrame, policy: DataFrame, cols: list[str]) -> DataFrame:
    """Category counts and shares inside and outside the policy overlap."""
    structs = ", ".join(f"struct('{c}' AS col, {c} AS value)" for c in cols)
    long = with_overlap(panel, policy).selectExpr("overlap", f"inline(array({structs}))")
    n = long.groupBy("col", "value").agg(
        F.count_if("overlap").alias("n_overlap"), F.count_if(~F.col("overlap")).alias("n_rest"))
    per = W.partitionBy("col")  # one row per category level
    return n.withColumns({
        "pct_overlap": 100.0 * F.col("n_overlap") / F.sum("n_overlap").over(per),
        "pct_rest": 100.0 * F.col("n_rest") / F.sum("n_rest").over(per),
    })


def overlap_numbers(panel: DataFrame, policy: DataFrame, cols: list[str]) -> DataFrame:
    structs = ", ".join(f"struct('{c}' AS col, CAST({c} AS DOUBLE) AS v)" for c in cols)
    long = with_overlap(panel, policy).selectExpr("overlap", f"inline(array({structs}))")
    base = long.groupBy("overlap", "col").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    q = quantile_columns(long, ["overlap", "col"], "v", {"median": 0.5, "p95": 0.95})
    return base.join(q, ["overlap", "col"])


def zero_buckets(rows: DataFrame, first: str, second: str, cut: float = 0.5) -> DataFrame:
    """Split the error gap between two models by which of them forecasts ~zero."""
    pick = lambda m, c, a: F.expr(f"max(if(model = '{m}', {c}, NULL)) AS {a}")
    per = rows.groupBy(*KEYS).agg(
        pick(first, "level", "la"), pick(second, "level", "lb"), pick(first, "mae", "ma"), pick(second, "mae", "mb"))
    per = per.selectExpr(
        f"CASE WHEN la < {cut}D AND lb < {cut}D THEN 'both_zero' WHEN la < {cut}D THEN 'only_second'"
        f" WHEN lb < {cut}D THEN 'only_first' ELSE 'both_nonzero' END AS bucket", "ma - mb AS d")
    out = per.groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg("d").alias("delta_mean"), F.sum("d").alias("delta_sum"))
    total = out.agg(F.sum("delta_sum")).scalar()
    return out.withColumn("pct", F.lit(100.0) * F.col("delta_sum") / total)
