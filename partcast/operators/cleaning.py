"""Column cleaning: defaults, category levels, casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partcast import config as C
from partcast.functions.smoothing import extend


def whitelist(col: Column, levels: tuple[str, ...], other: str = "Unknown") -> Column:
    """Trimmed value when it is a known level, ``other`` otherwise."""
    t = F.trim(col.cast("string"))
    return F.when(t.isin(*levels), t).otherwise(other)


def first_positive(*cols: Column) -> Column:
    """First value above zero in priority order (zero means missing)."""
    return F.coalesce(*[F.when(c > 0, c) for c in cols])


def positive_or(col: Column, default: float) -> Column:
    return F.when(col > 0, col).otherwise(F.lit(default))


def service_tier(criticality: Column) -> Column:
    c = F.lower(F.trim(criticality.cast("string")))
    return (
        F.when(c.isin(*C.HIGH_CRITICALITY), "high")
        .when(c.isin(*C.LOW_CRITICALITY), "low").otherwise("mid")
    )


def quoted(levels: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in levels)


def with_defaults(df: DataFrame) -> DataFrame:
    """Analysis defaults for price, lead time, smoothing constants and strata."""
    level = lambda c, levels: (
        f"if(trim({c}) IN ({quoted(levels)}), trim({c}), 'Unknown')")
    return extend(df, {
        "price": f"if(price_raw > 0, price_raw, {C.DEFAULT_PRICE}D)",
        "lead_days": f"if(lead_raw > 0, lead_raw, {C.DEFAULT_LEAD_DAYS}D)",
        "lead_q": f"greatest(CAST(ceil(lead_days / {C.DAYS_PER_QUARTER}D) AS BIGINT), 1L)",
        "sba_alpha": f"coalesce(sba_alpha_raw, {C.DEFAULT_SBA_ALPHA}D)",
        "ses_alpha": f"coalesce(ses_alpha_raw, {C.DEFAULT_SES_ALPHA}D)",
        "tier": f"CASE WHEN lower(trim(criticality)) IN ({quoted(C.HIGH_CRITICALITY)}) THEN 'high' "
                f"WHEN lower(trim(criticality)) IN ({quoted(C.LOW_CRITICALITY)}) THEN 'low' ELSE 'mid' END",
        "segment": level("segment_raw", C.SEGMENT_LEVELS),
        "abc": level("abc_raw", C.ABC_LEVELS),
        "strategy": level("strategy_raw", C.STRATEGY_LEVELS),
    })
