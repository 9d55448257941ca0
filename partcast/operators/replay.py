"""Replay of observed demand through an (s, S) policy.

Each quarter: receive, serve what is on hand, lose the rest, then order up to
S when the inventory position is below s; the order arrives ``lead_q``
quarters later.  The horizon is a handful of quarters, so each quarter's
figures are columns computed from the previous quarter's: the replay of a row
is a chain of narrow projections in one generated stage, with no shuffle and
no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partcast.config import CostTerms
from partcast.functions.smoothing import extend, total


def replay(
    df: DataFrame,
    horizon: int,
    demand: str = "test",
    start: str = "up_to",
    offset: int = 0,
) -> DataFrame:
    """Add on_hand_sum, short_units, n_orders, demand_units, end_on_hand.

    ``demand`` is an array column, read from element ``offset`` on; ``start``
    is the opening stock.  Money is left to :func:`with_costs`, so one replay
    serves many price assumptions.
    """
    x: dict[str, str] = {}
    for t in range(horizon):
        before = f"({start})" if t == 0 else f"_stock{t - 1}"
        landed = "".join(f" + if(lead_q = {t - j}, _order{j}, 0.0D)" for j in range(t))
        due = "".join(f" + if(lead_q > {t - j}, _order{j}, 0.0D)" for j in range(t))
        x[f"_d{t}"] = f"get({demand}, {offset + t})"
        x[f"_have{t}"] = before + landed
        x[f"_served{t}"] = f"least(_have{t}, _d{t})"
        x[f"_stock{t}"] = f"_have{t} - _served{t}"
        x[f"_position{t}"] = f"_stock{t}{due}"
        x[f"_order{t}"] = f"if(_position{t} < rp, greatest(up_to - _position{t}, 0.0D), 0.0D)"
    ts = range(horizon)
    out = {
        "on_hand_sum": total([f"_stock{t}" for t in ts]),
        "short_units": total([f"(_d{t} - _served{t})" for t in ts]),
        "n_orders": "CAST(" + total([f"if(_position{t} < rp, 1, 0)" for t in ts]) + " AS BIGINT)",
        "demand_units": total([f"_d{t}" for t in ts]),
        "end_on_hand": f"_stock{horizon - 1}",
    }
    out["mean_on_hand"] = f"on_hand_sum / {horizon}.0D"
    return extend(df, x | out).drop(*x)


def fill_rate() -> Column:
    """Served share of demand, 1 when there was none."""
    return F.expr("if(demand_units > 0, 1.0D - short_units / greatest(demand_units, 1e-12D), 1.0D)")


def with_costs(
    df: DataFrame,
    terms: CostTerms = CostTerms(),
    holding_rate: str | None = None,
    order_cost: str | None = None,
    stockout_cost: str | None = None,
) -> DataFrame:
    """Price a replay: holding, ordering, stockout, total cost and fill rate.

    Each money parameter may name a column, for grids of assumptions.
    """
    h = holding_rate or f"{terms.holding_rate}D"
    k = order_cost or f"{terms.order_cost}D"
    p = stockout_cost or f"{terms.stockout_cost}D"
    return extend(df, {
        "hold_cost": f"on_hand_sum * price * ({h} / {terms.quarters_per_year}.0D)",
        "order_cost": f"n_orders * {k}",
        "short_cost": f"short_units * {p}",
        "fill": "if(demand_units > 0, 1.0D - short_units / greatest(demand_units, 1e-12D), 1.0D)",
        "cost": "hold_cost + order_cost + short_cost",
    })
