"""Velocity classes of parts per ship, from movements and the parts master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from partcast.config import RETIRED_STATUS
from partcast.operators.ordering import mode_of, running_share

STAMP = "yyyy-MM-dd HH:mm:ss.SSS"
PAIR = ["part_id", "ship_id"]


def parsed_date(col: str = "trans_date") -> Column:
    """Date of a text timestamp, null when it does not parse."""
    return F.try_to_timestamp(F.col(col), F.lit(STAMP)).cast("date")


def _shift(as_of: str, days: int) -> str:
    return f"date_sub(DATE'{as_of}', {days})"


def movement_counts(log: DataFrame, as_of: str, years: int = 5, quarters: int = 4) -> DataFrame:
    """Used movements per pair in the history window, and whether any is recent.

    One pass over the log serves both windows.
    """
    start = _shift(as_of, int(years * 365.25))
    recent = _shift(as_of, int(quarters * 365.25 / 4))
    used = log.where("code = 'Used'").withColumn("_d", parsed_date())
    used = used.where(f"_d >= {start} AND _d <= DATE'{as_of}'")
    return used.groupBy("part_id", "ship_id").agg(
        F.count("*").alias("n"), F.expr(f"max(_d >= {recent})").alias("recent"))


def base_classes(counts: DataFrame) -> DataFrame:
    """A/B/C by cumulative share of a ship's movements, busiest parts first."""
    shared = running_share(counts, "ship_id", "n", "part_id")
    return shared.withColumn(
        "base", F.expr("CASE WHEN share <= 0.5D THEN 'A' WHEN share <= 0.8D THEN 'B' ELSE 'C' END"))


def _rank(col: str) -> str:
    return f"CASE {col} WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END"


def velocity(log: DataFrame, master: DataFrame, as_of: str, years: int = 5, quarters: int = 4) -> DataFrame:
    """Final class per (part, ship).

    Base share classes; pairs without movements are C; A falls to B without
    recent use; a replacement part inherits its predecessor's better legacy
    class; retired or replaced parts are D whatever else holds.
    """
    classed = base_classes(movement_counts(log, as_of, years, quarters))
    retired = ", ".join(f"'{s}'" for s in RETIRED_STATUS)
    replaced = "(replaced_by IS NOT NULL AND replaced_by != '')"
    pairs = master.groupBy(*PAIR).agg(
        F.max("part_type").alias("part_type"),
        F.expr(f"max(status IN ({retired}) OR {replaced})").alias("is_d"),
    )
    heirs = mode_of(
        master.where(replaced).select(F.col("replaced_by").alias("part_type"), "legacy_velocity"),
        ["part_type"], ["legacy_velocity"],
    ).withColumnRenamed("legacy_velocity", "heir_class")
    out = (
        pairs.join(classed.select(*PAIR, "n", "share", "base", "recent"), PAIR, "full")
        .join(heirs, "part_type", "left")
        .fillna({"n": 0, "share": 1.0, "base": "C", "recent": False, "is_d": False})
    )
    return out.withColumn(
        "after_recent", F.expr("if(base = 'A' AND NOT recent, 'B', base)"),
    ).withColumn(
        "_top", F.expr(f"greatest({_rank('after_recent')}, {_rank('heir_class')})"),
    ).withColumn(
        "velocity",
        F.expr("CASE WHEN is_d THEN 'D' WHEN heir_class IS NULL THEN after_recent "
               "ELSE element_at(array('D', 'C', 'B', 'A'), _top) END"),
    ).drop("_top")


def _with_legacy(classes: DataFrame, master: DataFrame) -> DataFrame:
    """classes with the most frequent legacy class of each pair; repeated master rows don't repeat a pair."""
    return classes.join(mode_of(master, PAIR, ["legacy_velocity"]), PAIR, "left")


def coverage(classes: DataFrame, master: DataFrame) -> DataFrame:
    """Confusion matrix of computed against legacy classes (missing shown)."""
    both = _with_legacy(classes, master)
    return both.groupBy(F.coalesce("legacy_velocity", F.lit("(none)")).alias("legacy")).pivot(
        "velocity", ["A", "B", "C", "D"]).agg(F.count(F.lit(1))).fillna(0)


def agreement(classes: DataFrame, master: DataFrame) -> DataFrame:
    """Rows, rows with a legacy class, agreement share, coverage gained."""
    both = _with_legacy(classes, master)
    return both.agg(
        F.count("*").alias("n"), F.count("legacy_velocity").alias("n_legacy"),
        F.expr("avg(if(legacy_velocity IS NULL, NULL, if(legacy_velocity = velocity, 1.0D, 0.0D)))").alias("agree"),
        F.expr("count_if(legacy_velocity IS NULL AND velocity IS NOT NULL)").alias("gained"),
    )
