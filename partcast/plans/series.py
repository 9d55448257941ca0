"""Assembling ordered series from long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def assemble(rows: DataFrame, key: list[str], t: str, value: str, first: int, last: int) -> DataFrame:
    """One array per key over the calendar [first, last], gaps as zero.

    Rows are summed per (key, period) before they are gathered, so an array
    never holds more than one entry per period.
    """
    cells = rows.groupBy(*key, t).agg(F.sum(value).alias("_v"))
    by_t = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(t, "_v"))).alias("_m"))
    return by_t.select(*key, F.expr(
        f"transform(sequence({first}, {last}), q -> coalesce(_m[q], 0.0D))").alias("y"))
