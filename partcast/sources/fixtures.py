"""Operational tables derived from the order/lineitem star schema.

The library works on four operational inputs (a transaction log, a parts
master, a supplied forecast table and a deployed stocking policy).  These
functions derive each of them from the star schema with deterministic
expressions, so the same rules can be stated in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from partcast.config import QUARTERS
from partcast.functions.smoothing import extend, items, total

KEYS = ["item_id", "site_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quarter_index(ts: Column, first_year: int = 1995) -> Column:
    return (F.year(ts) - first_year) * 4 + F.quarter(ts)


def site_of(grain: str) -> Column:
    if grain == "sku":
        return F.col("l_suppkey")
    if grain == "part":
        return F.lit(0).cast("bigint")
    raise ValueError(f"unknown grain {grain!r}")


def demand_series(spark: SparkSession, sf_dir: str, grain: str = "sku") -> DataFrame:
    """One row per series: y = 28 quarterly quantities, plus a unit price.

    One shuffle.  The quarters are fixed conditional sums, so a key with a
    third of all rows is already reduced to one row per map task before it is
    exchanged, and nothing is collected into lists.  Rows outside the 28 quarters
    count neither as demand nor towards the price; `calendar_audit` reports them.
    """
    # HotSpot compiles no method of more than 8000 bytes: Spark's documentation recommends its own limit to match
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    q = quarter_index(F.col("l_shipdate"))
    li = table(spark, sf_dir, "lineitem").where(q.between(1, QUARTERS)).select(
        F.col("l_partkey").alias("item_id"), site_of(grain).alias("site_id"),
        q.alias("q"), "l_quantity", "l_extendedprice",
    )
    sums = [
        F.expr(f"sum(if(q = {i}, l_quantity, 0.0D)) AS q{i:02d}") for i in range(1, QUARTERS + 1)
    ]
    wide = li.groupBy(*KEYS).agg(
        *sums, F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("rev"))
    quarters = ", ".join(f"q{i:02d}" for i in range(1, QUARTERS + 1))
    return wide.selectExpr(
        *KEYS, f"array({quarters}) AS y", "floor(rev / qty * 100.0D + 0.50001D) / 100.0D AS price0")


def calendar_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and quantity before, inside and after the panel's quarters, and without a date."""
    q = quarter_index(F.col("l_shipdate"))
    period = (F.when(q.isNull(), "undated").when(q < 1, "before").when(q > QUARTERS, "after").otherwise("inside"))
    return table(spark, sf_dir, "lineitem").groupBy(period.alias("period")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"))


def _mod(expr: Column, n: int) -> Column:
    return F.pmod(expr, F.lit(n))


def with_raw_attributes(df: DataFrame) -> DataFrame:
    """Attributes as an operational extract would carry them: gaps and all.

    The segment uses the published demand-pattern cut-offs (fixed values:
    average demand interval 1.32, squared coefficient of variation 0.49).
    """
    q = items("y", 0, QUARTERS)
    seg = ("CASE WHEN NOT seg_sparse AND NOT seg_varied THEN 'Smooth' WHEN NOT seg_sparse THEN 'Erratic' "
           "WHEN NOT seg_varied THEN 'Intermittent' ELSE 'Lumpy' END")
    return extend(df, {
        "price_raw": "CASE WHEN item_id % 29 = 0 THEN NULL WHEN item_id % 31 = 0 THEN 0.0D ELSE price0 END",
        "lead_raw": "if(item_id % 13 = 0, NULL, CAST(15 + (item_id * 37 + site_id * 11) % 300 AS DOUBLE))",
        "sba_alpha_raw": "if(item_id % 11 = 0, NULL, 0.05D + 0.05D * (item_id % 4))",
        "ses_alpha_raw": "if(item_id % 7 = 0, NULL, 0.2D + 0.1D * (site_id % 4))",
        "criticality": "CASE (item_id * 7 + site_id * 3) % 10 WHEN 0 THEN 'Critical' WHEN 1 THEN ' high ' "
                       "WHEN 2 THEN 'Low' WHEN 3 THEN '3' WHEN 4 THEN NULL ELSE 'Normal' END",
        "abc_raw": "CASE (item_id * 3 + site_id) % 7 WHEN 0 THEN 'A' WHEN 1 THEN ' A' WHEN 2 THEN 'B' "
                   "WHEN 3 THEN 'B ' WHEN 4 THEN 'C' WHEN 5 THEN 'X' END",
        "strategy_raw": "CASE WHEN item_id % 9 < 5 THEN concat('Strategy ', item_id % 9 + 1) WHEN item_id % 9 = 5 "
                        "THEN 'Other' WHEN item_id % 9 = 6 THEN ' Strategy 1 ' WHEN item_id % 9 = 7 THEN 'strategy 9' END",
        "seg_n": total([f"if({x} > 0, 1.0D, 0.0D)" for x in q]),
        "seg_s": total(q),
        "seg_ss": total([f"{x} * {x}" for x in q]),
        "seg_sparse": f"{QUARTERS}.0D / greatest(seg_n, 1e-9D) >= 1.32D",
        "seg_varied": "seg_n * seg_ss - seg_s * seg_s >= 0.49D * (seg_s * seg_s)",
        "segment_raw": f"CASE WHEN item_id % 17 = 0 THEN NULL WHEN item_id % 19 = 0 THEN concat(' ', {seg}, ' ') ELSE {seg} END",
    }).drop("seg_n", "seg_s", "seg_ss", "seg_sparse", "seg_varied")


def raw_panel(spark: SparkSession, sf_dir: str, grain: str = "sku") -> DataFrame:
    return with_raw_attributes(demand_series(spark, sf_dir, grain))


def deployed_policy(panel: DataFrame) -> DataFrame:
    """Deployed min/max for the overlap subset (items divisible by ten)."""
    pos = F.filter("y", lambda x: x > 0)
    mean_pos = F.aggregate(pos, F.lit(0.0), lambda a, x: a + x) / F.size(pos)
    return panel.where(_mod(F.col("item_id"), 10) == 0).select(
        *KEYS,
        F.when(_mod(F.col("item_id"), 70) != 0, F.floor(mean_pos).cast("double")).alias("new_min"),
        F.ceil(F.array_max("y")).cast("double").alias("new_max"),
        F.ceil(F.array_max("y") * 1.5).cast("double").alias("in_stock"),
    )


def external_forecasts(panel: DataFrame, train: int = 16) -> DataFrame:
    """A supplied forecast table with missing rows (items divisible by 7)."""
    s = F.array_sort(F.slice("y", 1, train))
    lo = F.element_at(s, train // 2)
    hi = F.element_at(s, train // 2 + 1)
    at = lambda k: F.element_at(s, k)
    return panel.where(_mod(F.col("item_id"), 7) != 0).select(
        *KEYS,
        ((lo + hi) / 2.0).alias("point"),
        F.array(at(train // 2), at(train - 3), at(train - 1), at(train), at(train)).alias("quantiles"),
    )


def transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spare-part movements with a text timestamp, some of them unusable."""
    li = table(spark, sf_dir, "lineitem")
    stamp = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss.SSS")
    odd = _mod(F.col("l_orderkey"), 101)
    return li.select(
        F.col("l_orderkey").alias("log_id"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("ship_id"),
        F.when(F.col("l_returnflag").isin("N", "R"), "Used").otherwise("Returned").alias("code"),
        F.when(odd == 0, "n/a").when(odd == 1, F.concat(F.lit("2090"), F.substring(stamp, 5, 30)))
        .otherwise(stamp).alias("trans_date"),
        F.col("l_quantity").alias("quantity"),
    )


def parts_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, ship) master rows; includes pairs that never moved."""
    seen = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("ship_id"))
    part = table(spark, sf_dir, "part")
    idle = part.select(
        F.col("p_partkey").alias("part_id"), _mod(F.col("p_partkey"), 10).alias("ship_id"))
    pairs = seen.union(idle).distinct()
    p, s = F.col("part_id"), F.col("ship_id")
    attrs = part.select(
        F.col("p_partkey").alias("part_id"),
        F.concat(F.lit("PT"), F.col("p_partkey").cast("string")).alias("part_type"),
        F.col("p_brand").alias("brand"),
        F.when(_mod(F.col("p_partkey"), 17) == 0, "Obsolete")
        .when(_mod(F.col("p_partkey"), 37) == 0, "Scrapped").otherwise("Active").alias("status"),
        F.when(_mod(F.col("p_partkey"), 23) == 0,
               F.concat(F.lit("PT"), (F.col("p_partkey") + 1).cast("string")))
        .when(_mod(F.col("p_partkey"), 5) == 0, "").alias("replaced_by"),
        F.when(F.col("p_size") <= 10, "A").when(F.col("p_size") <= 25, "B")
        .when(F.col("p_size") <= 40, "C").alias("legacy_velocity"),
        F.col("p_retailprice").alias("retail"),
    )
    return pairs.join(attrs, "part_id").withColumns({
        "price_brand": F.when(_mod(p + s, 4) == 0, F.col("retail") * 1.1).otherwise(0.0),
        "price_ship": F.when(_mod(p + s, 4) == 1, F.col("retail") + s.cast("double"))
        .when(_mod(p + s, 4) == 2, 0.0),
        "price_avg": F.when(_mod(p + s, 5) != 0, F.col("retail")).otherwise(0.0),
        "lead_days": F.when(_mod(p, 13) != 0, (15 + _mod(p * 37 + s * 11, 300)).cast("double")),
        "usage_year": F.when(_mod(s, 9) != 0, _mod(p + 2 * s, 40).cast("double")),
        "criticality": F.when(_mod(p * 7 + s * 3, 10) < 2, "Critical")
        .when(_mod(p * 7 + s * 3, 10) < 5, "Low").when(_mod(p * 7 + s * 3, 10) < 9, "Normal"),
        "stock_class": F.when(_mod(p + s, 3) != 0, F.concat(F.lit("SC"), _mod(p + s, 4).cast("string"))),
        "received": F.when(_mod(p + s, 6) != 0,
                           F.date_add(F.lit("1996-01-01").cast("date"), _mod(p * 13 + s * 7, 2000).cast("int"))),
    })


def forecast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplied forecast runs: several run ids per stock item."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(
        F.concat(F.lit("PT"), F.col("l_partkey").cast("string")).alias("stock_item"),
        (F.year("l_shipdate") - 1994).cast("bigint").alias("run_id"),
    ).agg(F.sum("l_quantity").alias("actual_total"), F.count("*").alias("n_lines")).withColumns({
        "segmentation": F.when(F.col("n_lines") % 5 == 0, " Lumpy").when(F.col("n_lines") % 5 == 1, "Smooth")
        .when(F.col("n_lines") % 5 == 2, "Erratic ").when(F.col("n_lines") % 5 == 3, "Intermittent"),
        "abc": F.when(F.col("n_lines") % 4 == 0, "A").when(F.col("n_lines") % 4 == 1, " B")
        .when(F.col("n_lines") % 4 == 2, "C").otherwise("Z"),
    })


def stockmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deployed stocking table at (part type, ship, region); every tenth part."""
    li = table(spark, sf_dir, "lineitem").where(_mod(F.col("l_partkey"), 10) == 0)
    base = li.groupBy("l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").alias("qty"), F.max("l_quantity").alias("top"),
        F.count("*").alias("n"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = table(spark, sf_dir, "region")
    return (
        base.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.concat(F.lit("PT"), F.col("l_partkey").cast("string")).alias("part_type"),
            F.col("l_suppkey").alias("ship_id"),
            F.when(F.col("r_regionkey") != 4, F.col("r_name")).alias("region"),
            F.when(_mod(F.col("l_suppkey"), 6) < 5, F.concat(
                F.lit("Strategy "), (_mod(F.col("l_suppkey"), 6) + 1).cast("string"))).alias("strategy"),
            (F.col("qty") / 28.0).alias("quarterly_forecast"),
            (F.col("top") - F.col("qty") / F.col("n")).alias("rmse"),
            F.floor(F.col("qty") / F.col("n")).cast("double").alias("new_min"),
            F.when(_mod(F.col("l_suppkey"), 7) != 0, F.col("top")).alias("new_max"),
            F.when(_mod(F.col("l_suppkey"), 5) == 0, "n/a")
            .otherwise(F.col("top").cast("string")).alias("in_stock"),
        )
    )
