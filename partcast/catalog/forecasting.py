"""Queries: forecasters, moments, accuracy metrics."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from partcast.catalog import sql_parts as Q
from partcast.catalog.registry import REGISTRY
from partcast.catalog.rounding import r, rs
from partcast.config import CLEAN, LATE, MODELS, SHORT
from partcast.functions import smoothing as S
from partcast.plans import analyses as N, compare as P
from partcast.sources.fixtures import KEYS

add = REGISTRY.add


CLASSICAL = ("SBA", "SES", "MA", "CROSTON", "TSB", "ADIDA", "IMAPA")


def _forecast_query(models, **kw):
    def run(spark, sf):
        df = S.with_forecasts(P.prepared_panel(spark, sf), models=models, **kw)
        return df.select(*KEYS, *[r(f"f_{m}", 6, f"f_{m.lower()}") for m in models])
    return run


def _forecast_sql(models, train=16, equal_info=False):
    cols = ", ".join(rs(f"f_{m}", 6, f"f_{m.lower()}") for m in models)
    return Q.query(Q.panel() + "," + Q.forecasts(train, equal_info, models),
                   f"SELECT item_id, site_id, {cols} FROM fc")


add("forecast_classical", _forecast_sql(CLASSICAL))(_forecast_query(CLASSICAL))
add("forecast_classical_next", _forecast_sql(("SBA", "CROSTON", "TSB"), equal_info=True))(
    _forecast_query(("SBA", "CROSTON", "TSB"), equal_info=True))
add("forecast_train12", _forecast_sql(CLASSICAL, 12))(_forecast_query(CLASSICAL, train=12))
add("forecast_train20", _forecast_sql(CLASSICAL, 20))(_forecast_query(CLASSICAL, train=20))


@add("accuracy_vs_cost_rank", Q.query(Q.scored(), """,
fleet AS (SELECT model, rd6(avg(mae)) AS mae, rd6(avg(rmse)) AS rmse, rd3(avg(cost)) AS cost, rd6(avg(fill)) AS fill
          FROM sc GROUP BY model)
SELECT *, row_number() OVER (ORDER BY mae, model)::BIGINT AS mae_rank,
  row_number() OVER (ORDER BY cost, model)::BIGINT AS cost_rank
FROM fleet"""))
def accuracy_vs_cost_rank(spark, sf):
    return N.accuracy_vs_cost_rank(P.scored_from(spark, sf)).select(
        "model", r("mae"), r("rmse"), r("cost", 3), r("fill"), "mae_rank", "cost_rank")
