"""Named analyses over the comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from partcast import config as C
from partcast.config import BAND_PROBS
from partcast.functions import arrays as A, smoothing as S
from partcast.functions.guarded import normal_deviate, snap, t_two_sided_p
from partcast.operators.quantiles import quantile_columns
from partcast.operators.scoring import loss_differences, ranks_udf
from partcast.plans.compare import series_scores
from partcast.plans.costing import regime
from partcast.sources.fixtures import KEYS


def fleet_means(rows: DataFrame, by: list[str] = (), metrics=("mae", "cost")) -> DataFrame:
    return rows.groupBy(*by, "model").agg(*[F.avg(m).alias(m) for m in metrics])


def ordinal(metric: str, by: list[str] = ()):
    """Position by metric, model name breaking ties; groups hold one row per model."""
    return F.row_number().over(W.partitionBy(*by).orderBy(metric, "model")).cast("bigint")


def accuracy_vs_cost_rank(rows: DataFrame) -> DataFrame:
    """Fleet means per model with accuracy rank and cost rank."""
    fleet = fleet_means(rows, metrics=("mae", "rmse", "cost", "fill"))
    return fleet.withColumns({"mae_rank": ordinal("mae"), "cost_rank": ordinal("cost")})


def naive_scales(train: int, y: str = "y") -> dict[str, str]:
    """In-sample naive errors: mean |diff| and root mean squared diff."""
    diffs = [f"(get({y}, {i}) - get({y}, {i - 1}))" for i in range(1, train)]
    n = f"{train - 1}.0D"
    return {
        "naive_mad": "(" + " + ".join(f"abs({d})" for d in diffs) + f") / {n}",
        "naive_rmsd": "sqrt((" + " + ".join(f"{d} * {d}" for d in diffs) + f") / {n})",
    }


def with_price_band(df: DataFrame, price: str = "price") -> DataFrame:
    """Band 1..7 between exact price quantiles, the last band closed."""
    edges = quantile_columns(df, [], price, {f"e{i}": p for i, p in enumerate(BAND_PROBS)})
    row = edges.select(F.array(*[f"e{i}" for i in range(len(BAND_PROBS))]).alias("e"))
    inner = len(BAND_PROBS) - 2
    return df.withColumn("_edges", row.scalar()).withColumn(
        "band", F.expr(f"1 + size(filter(slice(_edges, 2, {inner}), e -> {price} >= e))")).drop("_edges")


def regime_groups(rows: DataFrame) -> DataFrame:
    """Each row under 'all' and under its price regime."""
    return rows.selectExpr("*", f"explode(array('all', {regime()})) AS grp")


def fleet_vectors(rows: DataFrame, by: list[str], metrics: list[str], weight: str | None = None) -> DataFrame:
    """Model means as arrays, one row per group (models in name order)."""
    if weight is None:
        means = rows.groupBy(*by, "model").agg(
            *[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n"))
    else:
        means = rows.groupBy(*by, "model").agg(
            *[F.expr(f"sum({weight} * {m}) / sum({weight})").alias(m) for m in metrics], F.count("*").alias("n"))
    return vectors_of(means, by, metrics)


def vectors_of(means: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    fields = [F.col("model")] + [snap(F.col(m), 6).alias(m) for m in metrics]
    packed = means.groupBy(*by).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(*fields))).alias("_v"))
    return packed.select(
        *by, "n", F.expr("transform(_v, e -> e.model)").alias("models"),
        *[F.expr(f"transform(_v, e -> e.{m})").alias(m) for m in metrics])


def fleet_rho(rows: DataFrame, by: list[str], x: str = "mae", y: str = "cost", weight: str | None = None) -> DataFrame:
    """Rank correlation of model means with its p-value, per group."""
    return vectors_rho(fleet_vectors(rows, by, [x, y], weight), x, y)


def vectors_rho(v: DataFrame, x: str = "mae", y: str = "cost") -> DataFrame:
    """:func:`fleet_rho` of arrays over the models."""
    v = v.withColumn("rho", A.spearman(F.col(x), F.col(y)))
    return v.withColumn("p", rho_p_value("rho", "size(models)"))


def rho_p_value(rho: str, n: str):
    df = F.expr(f"({n}) - 2")
    t = F.expr(f"{rho} * sqrt((({n}) - 2) / greatest(1.0D - {rho} * {rho}, 1e-12D))")
    return F.when(F.abs(F.col(rho)) >= 1.0 - 1e-12, 0.0).otherwise(t_two_sided_p(t, df))


def per_series_stats(
    rows: DataFrame, pairs: dict[str, tuple[str, str]], carry: list[str] = (), models: tuple[str, ...] = C.MODELS,
) -> DataFrame:
    """Per series: tau-b and Spearman of each named metric pair over the models.

    Values are snapped to a 1e-6 grid before they are compared.  A model that is
    missing, or lacks one of the metrics, is left out of its series; fewer than
    three models give null.
    """
    metrics = sorted({m for p in pairs.values() for m in p})
    whole = " AND ".join(f"{x} IS NOT NULL" for x in metrics)
    wide = rows.groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in carry],
        *[F.expr(f"max(if(model = '{m}' AND {whole}, floor({x} * 1e6D + 0.50001D) / 1e6D, NULL)) AS v_{x}_{i}")
          for x in metrics for i, m in enumerate(models)])
    ix = range(len(models))
    cols = {x: [f"v_{x}_{i}" for i in ix] for x in metrics}
    ranks = {x: [f"r_{x}_{i}" for i in ix] for x in metrics}
    wide = S.extend(wide, {k: e for x in metrics for k, e in A.rank_columns(f"r_{x}_", cols[x]).items()})
    out = {f"tau_{n}": A.tau_text(cols[x], cols[y]) for n, (x, y) in pairs.items()}
    out |= {f"rho_{n}": A.spearman_text(ranks[x], ranks[y]) for n, (x, y) in pairs.items()}
    return wide.selectExpr(*KEYS, *carry, *[f"{e} AS {n}" for n, e in out.items()])


def series_stats(
    series: DataFrame, wanted: dict[str, tuple[str, str]], carry: list[str] = (), kind: str = "rho",
) -> DataFrame:
    """:func:`per_series_stats` of rows that hold an array over the models per metric: <kind>_<name>, tau or rho."""
    metrics = sorted({m for p in wanted.values() for m in p})
    names = [f"{kind}_{n}" for n in wanted]
    udf = ranks_udf(metrics, {f"{kind}_{n}": (kind, *p) for n, p in wanted.items()})
    out = series.withColumn("_s", udf(*metrics))
    return out.selectExpr(*KEYS, *carry, *[f"_s.{n} AS {n}" for n in names])


def rho_summary(df: DataFrame, col: str, by: list[str] = ()) -> DataFrame:
    """n, mean, median and shares at the ends of a per-series rank statistic."""
    keys = list(by) or ["_all"]
    src = df.withColumn("_all", F.lit(1)).withColumn("_s", snap(F.col(col), 9))
    counts = src.groupBy(*keys, "_s").agg(F.count("_s").alias("_k"))
    return counts.groupBy(*keys).agg(
        F.sum("_k").alias("n"), F.expr("sum(_s * _k) / sum(_k)").alias("mean"),
        F.percentile("_s", 0.5, F.col("_k")).alias("median"),  # the null cell has count 0
        F.expr("sum(if(_s > 0.999D, _k, 0)) / sum(_k)").alias("share_plus1"),
        F.expr("sum(if(_s < -0.999D, _k, 0)) / sum(_k)").alias("share_minus1"),
        F.expr("sum(if(abs(_s) > 0.99D, _k, 0)) / sum(_k)").alias("share_abs99"),
        F.expr("sum(if(_s > 0.9D, _k, 0)) / sum(_k)").alias("share_gt90"),
    ).drop("_all")


def mechanical(rows: DataFrame) -> DataFrame:
    """Accuracy-cost correlation with and without the forecast level, per regime."""
    v = fleet_vectors(regime_groups(rows), ["grp"], ["level", "mae", "cost", "hold_cost", "short_cost"])
    pair = lambda a, b: A.spearman(F.col(a), F.col(b))
    v = v.withColumns({
        "mae_cost": pair("mae", "cost"), "mae_level": pair("mae", "level"), "level_cost": pair("level", "cost"),
        "mae_hold": pair("mae", "hold_cost"), "mae_short": pair("mae", "short_cost"),
    })
    return v.withColumn("partial", F.expr(
        "(mae_cost - mae_level * level_cost) / sqrt(greatest(1.0D - mae_level * mae_level, 1e-12D)"
        " * greatest(1.0D - level_cost * level_cost, 1e-12D))"))


def dm_matrix(panel: DataFrame, window: C.Window, models: tuple[str, ...] = C.MODELS) -> DataFrame:
    """Diebold-Mariano statistics of every ordered model pair.

    Pairs are formed inside the series row, so the table never joins to
    itself; each loss difference is pooled over series and quarters.
    """
    rows = series_scores(panel, ["level"], ["y"], window, models).selectExpr("level", f"slice(y, {window.start + 1}, {window.horizon}) AS test")
    half = loss_differences(rows, models)
    half = half.selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "n", "if(a < b, mean, -mean) AS mean", "sd")
    half = half.withColumn("stat", F.expr("if(sd > 0, mean / (sd / sqrt(n)), 0.0D)"))
    # p < 0.05 on n - 1 degrees of freedom: where the normal deviate of the same tail is beyond its 0.975 quantile
    beyond = normal_deviate(F.abs("stat"), F.col("n") - 1.0) > 1.959963984540054
    half = half.withColumn("sign", F.when((F.col("n") > 1) & beyond, F.signum("stat").cast("int")).otherwise(0))
    flip = half.selectExpr("b AS a", "a AS b", "n", "-stat AS stat", "-sign AS sign")
    return half.select("a", "b", "n", "stat", "sign").unionByName(flip)


def lag_regression(train: int, y: str = "y") -> dict[str, str]:
    """Per-series regression on the previous quarter, as column arithmetic.

    Falls back to the training mean when the lagged values do not vary.
    """
    x, z = S.items(y, 0, train - 1), S.items(y, 1, train)
    return {
        "_sx": S.total(x), "_sz": S.total(z), "_sxx": S.total([f"{a} * {a}" for a in x]),
        "_sxz": S.total([f"{a} * {b}" for a, b in zip(x, z)]),
        "_den": f"{train - 1}.0D * _sxx - _sx * _sx",
        "_slope": f"if(_den > 0, ({train - 1}.0D * _sxz - _sx * _sz) / greatest(_den, 1e-300D), 0.0D)",
        "f_LOCAL": f"if(_den > 0, (_sz - _slope * _sx) / {train - 1}.0D + _slope * get({y}, {train - 1}), w_mean)",
    }
