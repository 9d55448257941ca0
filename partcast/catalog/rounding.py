"""Output rounding, identical on both engines.

Half-up with a small bias, so an exact decimal tie that carries one unit of
floating-point noise rounds the same way everywhere.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

BIAS = "0.50001"


def r(col: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded column (named after itself when given as a plain name)."""
    scale = f"{float(10**digits)!r}D"
    if isinstance(col, str):
        out = F.expr(f"floor(({col}) * {scale} + {BIAS}D) / {scale}")
        return out.alias(name or col)
    out = F.floor(col * float(10**digits) + float(BIAS)) / float(10**digits)
    return out.alias(name) if name else out


def rs(expr: str, digits: int = 6, name: str | None = None) -> str:
    scale = f"{float(10**digits)!r}::DOUBLE"
    out = f"floor(({expr}) * {scale} + {BIAS}::DOUBLE) / {scale}"
    return f"{out} AS {name}" if name else out


def expand(sql: str) -> str:
    """Replace each ``rd<digits>(expression)`` by the rounding formula."""
    while (m := re.search(r"\brd(\d+)\(", sql)):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        sql = sql[:m.start()] + "(" + rs(sql[m.end():i - 1], int(m.group(1))) + ")" + sql[i:]
    return sql
