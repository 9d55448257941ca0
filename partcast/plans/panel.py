"""Panel building: latest forecast run x parts master x deployed policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from partcast import config as C
from partcast.operators.cleaning import first_positive, whitelist
from partcast.operators.ordering import join_by, mode_of


def latest_run(df: DataFrame, key: str = "stock_item", run: str = "run_id") -> DataFrame:
    """Rows of the newest run per key, ties kept.

    The newest run is a map-side aggregate, so the join side is one row per key.
    """
    newest = df.groupBy(key).agg(F.max(run).alias(run))
    return df.join(newest, [key, run], "left_semi")


def master_per_item(master: DataFrame) -> DataFrame:
    """Parts master at part-type grain: price, lead time, usage, modal labels."""
    m = master.withColumn("price", first_positive(
        F.col("price_brand"), F.col("price_ship"), F.col("price_avg")))
    agg = m.groupBy("part_type").agg(
        F.count_distinct("brand").alias("n_brands"), F.count_distinct("ship_id").alias("n_ships"),
        F.median("price").alias("unit_price"), F.min("price").alias("price_min"),
        F.max("price").alias("price_max"), F.count("price").alias("n_prices"),
        F.max("received").alias("latest_purchase"),
        F.avg("lead_days").alias("lead_days"), F.avg("usage_year").alias("usage_year"),
    )
    modes = mode_of(m, ["part_type"], ["legacy_velocity", "criticality", "stock_class", "status"])
    return agg.join(modes, "part_type", "left").withColumn(
        "is_slow", F.coalesce(F.col("legacy_velocity") == "C", F.lit(False)))


def stockmax_per_item(sm: DataFrame) -> DataFrame:
    """Deployed policy at part-type grain, with its regions as a sorted list."""
    agg = sm.groupBy("part_type").agg(
        F.array_sort(F.collect_set("region")).alias("regions"),
        F.count_distinct("region").alias("n_regions"),
        F.avg("quarterly_forecast").alias("deployed_forecast"),
        F.avg("rmse").alias("deployed_rmse"),
        F.avg("new_min").alias("deployed_min"), F.avg("new_max").alias("deployed_max"),
        F.avg(F.expr("try_cast(in_stock AS DOUBLE)")).alias("in_stock"),
    )
    return agg.join(mode_of(sm, ["part_type"], ["strategy"]), "part_type", "left")


def build_panel(fcst: DataFrame, master: DataFrame, sm: DataFrame, brand: str | None = None) -> DataFrame:
    """Latest forecast x master (inner) x deployed policy (left), strata cleaned.

    ``brand`` keeps items that have any master row of that brand.
    """
    panel = (
        latest_run(fcst).withColumnRenamed("stock_item", "part_type")
        .join(master_per_item(master), "part_type")
        .join(stockmax_per_item(sm), "part_type", "left")
    )
    if brand is not None:
        focal = master.where(F.col("brand") == brand).select("part_type").distinct()
        panel = panel.join(focal, "part_type", "left_semi")
    return panel.withColumns({
        "segment": whitelist(F.col("segmentation"), C.SEGMENT_LEVELS),
        "abc": whitelist(F.col("abc"), C.ABC_LEVELS),
        "strategy": whitelist(F.col("strategy"), C.STRATEGY_LEVELS),
    })


def policy_panel(panel: DataFrame) -> DataFrame:
    """Items with a deployed policy in at least one region."""
    return panel.where("size(regions) > 0")


def design_weights(population: DataFrame, sample: DataFrame, strata: list[str]) -> DataFrame:
    """Stratum sizes, sample sizes and weights N_h / n_h."""
    pop = population.groupBy(*strata).agg(F.count("*").alias("pop_n"))
    smp = sample.groupBy(*strata).agg(F.count("*").alias("sample_n"))
    return join_by(pop, smp, strata).withColumn("weight", F.col("pop_n") / F.col("sample_n"))


def forecast_folds(demand: DataFrame, q: str = "q") -> DataFrame:
    """Fixed split and rolling-origin folds for the quarters present in the data."""
    n = demand.agg(F.max(q).cast("int").alias("n"))
    fixed = n.selectExpr("inline(array("
        "struct('fixed_train' AS name, 1 AS first_q, n - 8 AS last_q, CAST(NULL AS INT) AS horizon_first, CAST(NULL AS INT) AS horizon_last),"
        "struct('fixed_val' AS name, n - 7 AS first_q, n - 4 AS last_q, CAST(NULL AS INT) AS horizon_first, CAST(NULL AS INT) AS horizon_last),"
        "struct('fixed_test' AS name, n - 3 AS first_q, n AS last_q, CAST(NULL AS INT) AS horizon_first, CAST(NULL AS INT) AS horizon_last)))")

    def rolling(prefix: str, h: int) -> DataFrame:
        return n.selectExpr("n", f"explode(sequence(20, n - {h})) AS o").selectExpr(
            f"concat('{prefix}', lpad(CAST(o AS STRING), 2, '0')) AS name", "1 AS first_q", "o AS last_q",
            "o + 1 AS horizon_first", f"o + {h} AS horizon_last")
    return fixed.unionByName(rolling("roll_origin_", 1)).unionByName(rolling("roll4_origin_", 4))
