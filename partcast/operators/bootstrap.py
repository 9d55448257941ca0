"""Bootstrap sums: one row per replicate (and group)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from partcast.functions.resampling import mix_columns, mix_numpy, poisson_numpy, poisson_sql
from partcast.functions.smoothing import extend, keep_if

#: One number per series; unique for site_id below 2^31 - 1.
UNIT = "item_id * 2147483647 + site_id"
CHUNK = 128


def replicate_sums(
    df: DataFrame, metrics: list[str], replicates: int, by: list[str] = (), seed: int = 42,
    key: str = UNIT, engine: str = "numpy", point: bool = False,
) -> DataFrame:
    """Poisson-weighted sums of ``metrics`` per replicate: columns b, w, metric...

    ``w`` is the sum of weights, so a replicate mean is metric / w.  Units with
    a null metric carry weight in ``w``; give each metric set its own call or
    filter first.

    ``point`` adds replicate -1 with every weight 1: the plain estimate from
    the same pass.

    engine "numpy": every Arrow batch multiplies its (replicates x units)
    weights by its (units x metrics) block and a task emits one partial row
    per replicate and group; the exchange carries partial sums only.
    engine "sql": explodes replicates and lets the map-side aggregate do the
    same; no Python, best for few replicates.
    """
    src = df.selectExpr(*by, f"CAST({key} AS BIGINT) AS _k", *metrics)
    if engine == "sql":
        rows = src.selectExpr("*", f"explode(sequence(0L, {replicates - 1}L)) AS b")
        if point:
            rows = src.selectExpr("*", f"explode(sequence(-1L, {replicates - 1}L)) AS b")
        w = f"if(b < 0, 1.0D, {poisson_sql()})" if point else poisson_sql()
        rows = extend(rows, mix_columns("_k", "greatest(b, 0L)", seed) | {"_w": w})
        return rows.groupBy(*by, "b").agg(
            F.sum("_w").alias("w"), *[F.expr(f"sum(_w * {m})").alias(m) for m in metrics])

    by = list(by)
    plain = 1 if point else 0
    fields = [src.schema[c] for c in by] + [StructField("b", LongType())]
    fields += [StructField(c, DoubleType()) for c in ["w", *metrics]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(by, sort=False, dropna=False) if by else [((), pdf)]
            for g, part in groups:
                x = np.column_stack([np.ones(len(part)), part[metrics].to_numpy(np.float64)])
                acc = sums.setdefault(g, np.zeros((replicates + plain, x.shape[1])))
                keys = part["_k"].to_numpy()
                for lo in range(0, replicates, CHUNK):
                    b = np.arange(lo, min(lo + CHUNK, replicates))
                    w = poisson_numpy(mix_numpy(keys, b, seed))
                    acc[lo:lo + len(b)] += w.T @ x
                if point:
                    acc[-1] += x.sum(axis=0)
        for g, acc in sums.items():
            out = pd.DataFrame(acc, columns=["w", *metrics])
            ids = np.arange(replicates + plain, dtype=np.int64)
            ids[replicates:] = -1
            out.insert(0, "b", ids)
            for name, value in zip(by, g if isinstance(g, tuple) else (g,)):
                out.insert(0, name, value)
            yield out[[f.name for f in fields]]

    parts = src.mapInPandas(partial, StructType(fields))
    return parts.groupBy(*by, "b").agg(
        F.sum("w").alias("w"), *[F.sum(m).alias(m) for m in metrics])


def interval(stats: DataFrame, value: str, by: list[str] = (), lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """Percentile interval over replicates; a group holds one row per replicate."""
    return stats.groupBy(*by).agg(
        F.percentile(value, lo).alias("lo"), F.percentile(value, hi).alias("hi"),
        F.expr(f"avg(if({value} <= 0, 1.0D, 0.0D))").alias("p_le_zero"),
        F.count(value).alias("replicates"))


def mean_interval(df: DataFrame, value: str, replicates: int = 1000, by: list[str] = (), seed: int = 42,
                  key: str = UNIT, engine: str = "numpy") -> DataFrame:
    """Mean of a per-unit value with its bootstrap interval, nulls excluded."""
    keys = list(by) or ["_all"]
    valid = keep_if(df.withColumn("_all", F.lit("all")), f"{value} IS NOT NULL")
    sums = replicate_sums(valid, [value], replicates, keys, seed, key, engine)
    ci = interval(sums.where("w > 0").withColumn("_m", F.col(value) / F.col("w")), "_m", keys)
    point = valid.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return point.join(ci, keys).select(*by, "mean", "n", "lo", "hi", "p_le_zero", "replicates")
