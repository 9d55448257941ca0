"""Forecast -> policy -> replay comparison, one row per (series, model).

Everything after the panel is narrow: forecasts are columns of the series
row, exploding to one row per model keeps the panel's hash partitioning on
the series key, and regrouping by that key therefore needs no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from partcast.config import CLEAN, MODELS, CostTerms, Window
from partcast.functions import smoothing as S
from partcast.functions.guarded import snap
from partcast.operators.cleaning import with_defaults
from partcast.operators.policy import service_z, with_normal_policy
from partcast.operators.replay import replay, with_costs
from partcast.operators.scoring import arms_udf, scores_udf
from partcast.sources.fixtures import KEYS, external_forecasts, raw_panel

ATTRS = ["segment", "abc", "strategy", "tier", "price", "lead_days", "lead_q"]


def prepared_panel(spark: SparkSession, sf_dir: str, grain: str = "sku") -> DataFrame:
    return with_defaults(raw_panel(spark, sf_dir, grain))


def explode_models(df: DataFrame, models: tuple[str, ...], window: Window, keep: list[str] | None = None) -> DataFrame:
    """One row per series and model: level clipped at zero, sigma, test array."""
    rows = ", ".join(f"struct('{m}' AS model, greatest(f_{m}, 0.0D) AS level)" for m in models)
    return df.selectExpr(
        *KEYS, *(ATTRS if keep is None else keep), "sqrt(w_var) AS sigma",
        f"slice(y, {window.start + 1}, {window.horizon}) AS test",
        f"inline(array({rows}))",
    )


def error_exprs(window: Window, level: str = "level", test: str = "test") -> dict[str, str]:
    it = S.items(test, 0, window.horizon)
    h = window.horizon
    return {
        "mae": S.total([f"abs({level} - {x})" for x in it]) + f" / {h}.0D",
        "rmse": "sqrt(" + S.total([f"({level} - {x}) * ({level} - {x})" for x in it]) + f" / {h}.0D)",
        "test_demand": S.total(it),
    }


def with_errors(df: DataFrame, window: Window) -> DataFrame:
    return S.extend(df, error_exprs(window))


def forecast_rows(
    panel: DataFrame,
    window: Window = CLEAN,
    models: tuple[str, ...] = MODELS,
    equal_info: bool = False,
    external: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Long forecasts with errors; ``external`` adds a supplied model EXT.

    A series without a supplied forecast counts as zero.
    """
    df = S.with_forecasts(panel, train=window.train, equal_info=equal_info, models=models)
    names = models
    if external is not None:
        df = df.join(external.withColumnRenamed("point", "f_EXT"), KEYS, "left")
        df = df.fillna({"f_EXT": 0.0})
        names = models + ("EXT",)
    return with_errors(explode_models(df, names, window, keep), window)


def scored(
    panel: DataFrame,
    window: Window = CLEAN,
    models: tuple[str, ...] = MODELS,
    equal_info: bool = False,
    external: DataFrame | None = None,
    terms: CostTerms = CostTerms(),
) -> DataFrame:
    """The comparison table: errors, policy, replayed cost per series and model."""
    df = forecast_rows(panel, window, models, equal_info, external)
    df = with_normal_policy(df, terms)
    df = replay(df, window.horizon)
    return with_costs(df, terms)


def scored_from(spark: SparkSession, sf_dir: str, grain: str = "sku", with_external: bool = False, **kw) -> DataFrame:
    panel = prepared_panel(spark, sf_dir, grain)
    ext = external_forecasts(panel, kw.get("window", CLEAN).train) if with_external else None
    if ext is not None:
        ext = ext.select(*KEYS, "point")
    return scored(panel, external=ext, **kw)


def with_scores(panel: DataFrame, metrics: list[str], name: str, window: Window = CLEAN, models: tuple[str, ...] = MODELS,
                equal_info: bool = False, terms: CostTerms = CostTerms(), supplied: str | None = None) -> DataFrame:
    """The panel with a struct of arrays over the models, one per metric; model EXT is the column ``supplied``."""
    udf = scores_udf(tuple(metrics), window, models, equal_info, terms)
    return panel.withColumn(name, udf("y", "sba_alpha", "ses_alpha", "price", "lead_days", "lead_q", F.expr(service_z(terms)),
                                      *([supplied] if supplied else [])))


def series_scores(
    panel: DataFrame,
    metrics: list[str],
    carry: list[str] = (),
    window: Window = CLEAN,
    models: tuple[str, ...] = MODELS,
    equal_info: bool = False,
    terms: CostTerms = CostTerms(),
    supplied: str | None = None,
) -> DataFrame:
    """The comparison table with a row per series: an array over the models for each metric.

    ``carry`` names panel columns or test_demand.  The same numbers as :func:`scored`, without exploding the models and
    bringing them together again.
    """
    demand = {"test_demand": S.total(S.items("y", window.start, window.end)) + " AS test_demand"}
    out = with_scores(panel, metrics, "_s", window, models, equal_info, terms, supplied)
    return out.selectExpr(*KEYS, *[demand.get(c, c) for c in carry], *[f"_s.{m} AS {m}" for m in metrics])


def wide_scores(panel: DataFrame, metrics: list[str], carry: list[str] = (), models: tuple[str, ...] = MODELS, **kw) -> DataFrame:
    """:func:`series_scores` with columns <metric>_<model>."""
    return series_scores(panel, metrics, carry, models=models, **kw).selectExpr(
        *KEYS, *carry, *[f"get({x}, {i}) AS {x}_{m}" for x in metrics for i, m in enumerate(models)])


def long_scores(panel: DataFrame, metrics: list[str], carry: list[str] = (), models: tuple[str, ...] = MODELS, **kw) -> DataFrame:
    """:func:`series_scores` with a row per series and model."""
    return by_model(series_scores(panel, metrics, carry, models=models, **kw), metrics, [*KEYS, *carry], models)


def by_model(series: DataFrame, metrics: list[str], carry: list[str], models: tuple[str, ...] = MODELS) -> DataFrame:
    rows = ", ".join(f"struct('{m}' AS model, {', '.join(f'get({x}, {i}) AS {x}' for x in metrics)})" for i, m in enumerate(models))
    return series.selectExpr(*carry, f"inline(array({rows}))")


def model_vectors(rows: DataFrame, metrics: list[str], carry: list[str], digits: int = 6) -> DataFrame:
    """Regroup to one row per series with one array per metric, models in name order.

    Metrics are snapped to a grid, because rank statistics compare them for
    equality.  The group is bounded by the number of models.
    """
    fields = [F.col("model")] + [snap(F.col(m), digits).alias(m) for m in metrics]
    out = rows.groupBy(*KEYS).agg(
        *[F.first(c).alias(c) for c in carry],
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_v"),
    )
    return out.select(
        *KEYS, *carry,
        F.expr("transform(_v, e -> e.model) AS models"),
        *[F.expr(f"transform(_v, e -> e.{m}) AS {m}") for m in metrics],
    )
