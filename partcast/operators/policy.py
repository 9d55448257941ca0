"""Stocking policies (s, S) from forecasts, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from partcast.config import DAYS_PER_QUARTER, LEAD_CV, QUANTILE_LEVELS, CostTerms
from partcast.functions.guarded import normal_quantile
from partcast.functions.smoothing import extend


def by_tier(high: str, mid: str, low: str) -> str:
    return f"CASE tier WHEN 'high' THEN {high} WHEN 'low' THEN {low} ELSE {mid} END"


def service_level(terms: CostTerms = CostTerms()) -> str:
    return by_tier(f"{terms.sl_high}D", f"{terms.sl_mid}D", f"{terms.sl_low}D")


def service_z(terms: CostTerms = CostTerms()) -> str:
    """Normal quantile of the tier's target; three levels, resolved on the driver."""
    z = [f"{normal_quantile(p)!r}D" for p in (terms.sl_high, terms.sl_mid, terms.sl_low)]
    return by_tier(*z)


def economic_order(level: str, order_cost: str, holding_rate: str) -> str:
    """Economic order quantity, at least one unit."""
    h = f"if({holding_rate} * price > 0, {holding_rate} * price, 1e-9D)"
    return f"greatest(sqrt(2.0D * ({level} * 4.0D) * {order_cost} / {h}), 1.0D)"


def with_normal_policy(
    df: DataFrame,
    terms: CostTerms = CostTerms(),
    level: str = "level",
    sigma: str = "sigma",
    z: str | None = None,
    lead_cv: str = f"{LEAD_CV}D",
    order_cost: str | None = None,
    holding_rate: str | None = None,
) -> DataFrame:
    """Add ``rp`` (reorder point), ``eoq`` and ``up_to`` (order-up-to level)."""
    spread = f"(lead_days * {lead_cv} / {DAYS_PER_QUARTER}D)"
    safety = (f"({z or service_z(terms)}) * sqrt(lead_q * ({sigma} * {sigma})"
              f" + ({level} * {level}) * ({spread} * {spread}))")
    return extend(df, {
        "rp": f"greatest({level} * lead_q + {safety}, 0.0D)",
        "eoq": economic_order(level, order_cost or f"{terms.order_cost}D",
                              holding_rate or f"{terms.holding_rate}D"),
        "up_to": "rp + eoq",
    })


def nearest_level_index(target: float, levels: tuple[float, ...] = QUANTILE_LEVELS) -> int:
    """Position (1-based) of the fitted level closest to ``target``, first on ties."""
    return 1 + min(range(len(levels)), key=lambda i: abs(levels[i] - target))


def quantile_at_service(quantiles: str = "quantiles", terms: CostTerms = CostTerms()) -> str:
    """The fitted quantile a service tier reads."""
    pick = [f"element_at({quantiles}, {nearest_level_index(p)})"
            for p in (terms.sl_high, terms.sl_mid, terms.sl_low)]
    return by_tier(*pick)


def with_quantile_policy(
    df: DataFrame,
    terms: CostTerms = CostTerms(),
    quantiles: str = "quantiles",
    level: str = "level",
    kappa: str = "1.0D",
) -> DataFrame:
    """Reorder point = kappa x lead quarters x the model's one-quarter quantile."""
    return extend(df, {
        "q_service": quantile_at_service(quantiles, terms),
        "rp": f"{kappa} * greatest(lead_q * q_service, 0.0D)",
        "eoq": economic_order(level, f"{terms.order_cost}D", f"{terms.holding_rate}D"),
        "up_to": "rp + eoq",
    })


def with_deployed_policy(df: DataFrame, low: str = "new_min", high: str = "new_max") -> DataFrame:
    return extend(df, {
        "rp": f"coalesce({low}, 0.0D)",
        "up_to": f"greatest(coalesce({high}, 0.0D), rp + 1.0D)",
    })
