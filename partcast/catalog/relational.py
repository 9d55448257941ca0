"""Queries: scans, projections, joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from partcast import config as C
from partcast.catalog import sql_parts as Q
from partcast.catalog.registry import REGISTRY
from partcast.catalog.rounding import expand, r
from partcast.functions.guarded import guarded_corr
from partcast.functions.smoothing import extend
from partcast.operators import ordering as O, privacy
from partcast.operators.cleaning import first_positive, whitelist
from partcast.operators.quantiles import exact_quantiles, quantile_columns
from partcast.plans import compare as P, panel as PN, velocity as V
from partcast.sources import fixtures as X
from partcast.sources.fixtures import KEYS

AS_OF = "2000-12-31"


def add(name, sql=None):
    return REGISTRY.add(name, expand(sql) if sql else None)


# --- SQL counterparts of the derived operational tables -------------------------------------------

LOG = """
log AS (
  SELECT l_orderkey AS log_id, l_partkey AS part_id, l_suppkey AS ship_id,
    CASE WHEN l_returnflag IN ('N', 'R') THEN 'Used' ELSE 'Returned' END AS code,
    CASE WHEN l_orderkey % 101 = 0 THEN 'n/a'
         WHEN l_orderkey % 101 = 1 THEN '2090' || substr(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%g'), 5)
         ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%g') END AS trans_date, l_quantity AS quantity
  FROM lineitem)"""

MASTER = """
mpairs AS (
  SELECT l_partkey AS part_id, l_suppkey AS ship_id FROM lineitem
  UNION SELECT p_partkey, p_partkey % 10 FROM part),
master AS (
  SELECT p.part_id, p.ship_id, 'PT' || p_partkey::VARCHAR AS part_type, p_brand AS brand,
    CASE WHEN p_partkey % 17 = 0 THEN 'Obsolete' WHEN p_partkey % 37 = 0 THEN 'Scrapped' ELSE 'Active' END AS status,
    CASE WHEN p_partkey % 23 = 0 THEN 'PT' || (p_partkey + 1)::VARCHAR WHEN p_partkey % 5 = 0 THEN '' END AS replaced_by,
    CASE WHEN p_size <= 10 THEN 'A' WHEN p_size <= 25 THEN 'B' WHEN p_size <= 40 THEN 'C' END AS legacy_velocity,
    CASE WHEN (part_id + ship_id) % 4 = 0 THEN p_retailprice * 1.1::DOUBLE ELSE 0 END AS price_brand,
    CASE WHEN (part_id + ship_id) % 4 = 1 THEN p_retailprice + ship_id WHEN (part_id + ship_id) % 4 = 2 THEN 0 END AS price_ship,
    CASE WHEN (part_id + ship_id) % 5 <> 0 THEN p_retailprice ELSE 0 END AS price_avg,
    CASE WHEN part_id % 13 <> 0 THEN (15 + (part_id * 37 + ship_id * 11) % 300)::DOUBLE END AS lead_days,
    CASE WHEN ship_id % 9 <> 0 THEN ((part_id + 2 * ship_id) % 40)::DOUBLE END AS usage_year,
    CASE WHEN (part_id * 7 + ship_id * 3) % 10 < 2 THEN 'Critical' WHEN (part_id * 7 + ship_id * 3) % 10 < 5 THEN 'Low'
         WHEN (part_id * 7 + ship_id * 3) % 10 < 9 THEN 'Normal' END AS criticality,
    CASE WHEN (part_id + ship_id) % 3 <> 0 THEN 'SC' || ((part_id + ship_id) % 4)::VARCHAR END AS stock_class,
    CASE WHEN (part_id + ship_id) % 6 <> 0 THEN DATE '1996-01-01' + ((part_id * 13 + ship_id * 7) % 2000)::INTEGER END AS received
  FROM mpairs p JOIN part ON p_partkey = part_id)"""

FCST = """
fcst AS (
  SELECT *, CASE n_lines % 5 WHEN 0 THEN ' Lumpy' WHEN 1 THEN 'Smooth' WHEN 2 THEN 'Erratic ' WHEN 3 THEN 'Intermittent' END AS segmentation,
    CASE n_lines % 4 WHEN 0 THEN 'A' WHEN 1 THEN ' B' WHEN 2 THEN 'C' ELSE 'Z' END AS abc
  FROM (SELECT 'PT' || l_partkey::VARCHAR AS stock_item, (year(l_shipdate) - 1994)::BIGINT AS run_id,
          sum(l_quantity) AS actual_total, count(*) AS n_lines FROM lineitem GROUP BY ALL))"""

STOCKMAX = """
sm AS (
  SELECT 'PT' || l_partkey::VARCHAR AS part_type, l_suppkey AS ship_id,
    CASE WHEN r_regionkey <> 4 THEN r_name END AS region,
    CASE WHEN l_suppkey % 6 < 5 THEN 'Strategy ' || (l_suppkey % 6 + 1)::VARCHAR END AS strategy,
    qty / 28.0::DOUBLE AS quarterly_forecast, top - qty / n AS rmse, floor(qty / n) AS new_min,
    CASE WHEN l_suppkey % 7 <> 0 THEN top END AS new_max,
    CASE WHEN l_suppkey % 5 = 0 THEN 'n/a' ELSE top::VARCHAR END AS in_stock
  FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty, max(l_quantity) AS top, count(*) AS n
        FROM lineitem WHERE l_partkey % 10 = 0 GROUP BY ALL)
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def mode_sql(src: str, key: str, col: str) -> str:
    return (f"(SELECT {key}, {col} FROM (SELECT {key}, {col}, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY count(*) DESC, {col}) AS rn FROM {src} WHERE {col} IS NOT NULL GROUP BY {key}, {col}) WHERE rn = 1)")


def li(spark, sf):
    return X.table(spark, sf, "lineitem")


# --- scans and sources ----------------------------------------------------------------------------

@add("scan_parquet_columns", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_parquet_columns(spark, sf):
    return li(spark, sf).where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")


@add("calendar_audit", """SELECT CASE WHEN l_shipdate IS NULL THEN 'undated' WHEN year(l_shipdate) < 1995 THEN 'before'
WHEN year(l_shipdate) > 2001 THEN 'after' ELSE 'inside' END AS period, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM lineitem GROUP BY ALL""")
def calendar_audit(spark, sf):
    return X.calendar_audit(spark, sf)


@add("model_union", Q.query(Q.panel() + "," + Q.forecasts(16, False, ("SBA", "MA")) + """,
u AS (SELECT item_id, site_id, 'SBA' AS model, f_SBA AS level, NULL::DOUBLE AS q50 FROM fc
      UNION ALL SELECT item_id, site_id, 'MA', f_MA, NULL FROM fc
      UNION ALL SELECT item_id, site_id, 'EXT', (s[8] + s[9]) / 2.0::DOUBLE, s[8]
      FROM (SELECT item_id, site_id, list_sort(y[1:16]) AS s FROM panel WHERE item_id % 7 <> 0))""",
    "SELECT model, count(*) AS n, rd4(sum(level)) AS total, count(q50) AS n_q FROM u GROUP BY model"))
def model_union(spark, sf):
    """Union of whatever model outputs exist, each with its own columns."""
    from partcast.functions.smoothing import with_forecasts
    from partcast.sources.files import union_present
    p = P.prepared_panel(spark, sf)
    fc = with_forecasts(p, models=("SBA", "MA"))
    ext = X.external_forecasts(p)
    parts = {
        "SBA": fc.selectExpr(*KEYS, "f_SBA AS level"), "MA": fc.selectExpr(*KEYS, "f_MA AS level"),
        "LEARNED": None,
        "EXT": ext.selectExpr(*KEYS, "point AS level", "quantiles[0] AS q50"),
    }
    return union_present(parts).groupBy("model").agg(
        F.count("*").alias("n"), r(F.sum("level"), 4, "total"), F.count("q50").alias("n_q"))


@add("forecast_folds", """
WITH n AS (SELECT max((year(l_shipdate) - 1995) * 4 + quarter(l_shipdate))::INTEGER AS n FROM lineitem)
SELECT 'fixed_train' AS name, 1 AS first_q, n - 8 AS last_q, NULL::INTEGER AS horizon_first, NULL::INTEGER AS horizon_last FROM n
UNION ALL SELECT 'fixed_val', n - 7, n - 4, NULL, NULL FROM n
UNION ALL SELECT 'fixed_test', n - 3, n, NULL, NULL FROM n
UNION ALL SELECT 'roll_origin_' || o::VARCHAR, 1, o::INTEGER, o::INTEGER + 1, o::INTEGER + 1 FROM n, unnest(range(20, n)) t(o)
UNION ALL SELECT 'roll4_origin_' || o::VARCHAR, 1, o::INTEGER, o::INTEGER + 1, o::INTEGER + 4 FROM n, unnest(range(20, n - 3)) t(o)""")
def forecast_folds(spark, sf):
    return PN.forecast_folds(li(spark, sf).select(X.quarter_index(F.col("l_shipdate")).alias("q")))


@add("external_forecast_join", Q.query(Q.with_external(Q.panel() + "," + Q.forecasts(16, False, ("MA",))), """
SELECT segment, count(*) AS n, rd4(sum(f_EXT)) AS ext_total, count_if(item_id % 7 = 0) AS n_missing FROM fcx GROUP BY segment"""))
def external_forecast_join(spark, sf):
    p = P.prepared_panel(spark, sf)
    ext = X.external_forecasts(p).select(*KEYS, "point")
    return p.join(ext, KEYS, "left").groupBy("segment").agg(
        F.count("*").alias("n"), r(F.sum(F.coalesce("point", F.lit(0.0))), 4, "ext_total"),
        F.count_if(F.col("point").isNull()).alias("n_missing"))


# --- projections ----------------------------------------------------------------------------------

@add("pseudonymise", """
SELECT c_custkey, CASE WHEN c_mktsegment IS NULL THEN NULL ELSE 'SEG_' || lpad((('0x' || substr(sha256('pepper' || chr(31) || 'segment' || chr(31) || c_mktsegment), 1, 15))::BIGINT % 100000000)::VARCHAR, 8, '0') END AS c_mktsegment,
  'CUS_' || lpad((('0x' || substr(sha256('pepper' || chr(31) || 'customer' || chr(31) || c_name), 1, 15))::BIGINT % 100000000)::VARCHAR, 8, '0') AS c_name
FROM customer""")
def pseudonymise(spark, sf):
    df = X.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    return privacy.pseudonymise(
        df, {"c_mktsegment": "segment", "c_name": "customer", "c_phone": "customer"},
        {"segment": "SEG_", "customer": "CUS_"}, salt="pepper")


@add("default_deny_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate::DATE AS l_shipdate FROM lineitem")
def default_deny_columns(spark, sf):
    df = li(spark, sf).withColumn("l_shipdate", F.to_date("l_shipdate"))
    return privacy.keep_columns(df, ["l_orderkey", "l_missing"], ["l_partkey", "l_suppkey"], ["l_ship"])


@add("cardinality_audit", """
SELECT 'o_custkey' AS "column", count(DISTINCT o_custkey) AS n_unique, count(*) AS n_rows FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders
UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey), count(*) FROM orders""")
def cardinality_audit(spark, sf):
    return privacy.cardinality(X.table(spark, sf, "orders"), ["o_custkey", "o_orderpriority", "o_orderkey"])


@add("nonstrict_cast", "WITH " + STOCKMAX + """
SELECT strategy, count(*) AS n, count(try_cast(in_stock AS DOUBLE)) AS n_ok, rd4(avg(try_cast(in_stock AS DOUBLE))) AS mean_stock
FROM sm GROUP BY strategy""")
def nonstrict_cast(spark, sf):
    v = F.expr("try_cast(in_stock AS DOUBLE)")
    return X.stockmax(spark, sf).groupBy("strategy").agg(
        F.count("*").alias("n"), F.count(v).alias("n_ok"), r(F.avg(v), 4, "mean_stock"))


@add("normalise_categories", Q.query(Q.panel(), """
SELECT segment, abc, strategy, count(*) AS n FROM panel GROUP BY ALL"""))
def normalise_categories(spark, sf):
    return P.prepared_panel(spark, sf).groupBy("segment", "abc", "strategy").agg(F.count("*").alias("n"))


@add("coalesce_price", "WITH " + MASTER + """
SELECT part_id, ship_id, coalesce(CASE WHEN price_brand > 0 THEN price_brand END, CASE WHEN price_ship > 0 THEN price_ship END,
  CASE WHEN price_avg > 0 THEN price_avg END) AS price FROM master""")
def coalesce_price(spark, sf):
    m = X.parts_master(spark, sf)
    return m.select("part_id", "ship_id", first_positive(
        F.col("price_brand"), F.col("price_ship"), F.col("price_avg")).alias("price"))


@add("analysis_defaults", Q.query(Q.panel(), """
SELECT item_id, site_id, price, lead_days, lead_q, sba_alpha, ses_alpha, tier FROM panel"""))
def analysis_defaults(spark, sf):
    return P.prepared_panel(spark, sf).select(
        *KEYS, "price", "lead_days", "lead_q", "sba_alpha", "ses_alpha", "tier")


@add("label_codes", "WITH " + MASTER + """
SELECT coalesce(stock_class, '__NA__') AS value, dense_rank() OVER (ORDER BY coalesce(stock_class, '__NA__')) - 1 AS code
FROM master GROUP BY coalesce(stock_class, '__NA__')
UNION ALL SELECT brand, dense_rank() OVER (ORDER BY brand) - 1 FROM master GROUP BY brand""")
def label_codes(spark, sf):
    m = X.parts_master(spark, sf)
    return O.label_codes(m, "stock_class").unionByName(O.label_codes(m, "brand"))


@add("quarter_vector_long", Q.query(Q.series(), """
SELECT item_id, q.q::INTEGER AS q, sum(y[q.q]) AS qty FROM series, (SELECT unnest(range(1, 29)) AS q) q GROUP BY ALL"""))
def quarter_vector_long(spark, sf):
    """One series per item, so that nothing is summed again after it is unfolded."""
    long = X.demand_series(spark, sf, "part").select("item_id", F.posexplode("y").alias("pos", "qty"))
    return long.select("item_id", (F.col("pos") + 1).alias("q"), "qty")


@add("derived_flags", Q.query(Q.panel(), """
SELECT segment, count(*) AS n, count_if(list_sum(y[17:20]) > 0) AS n_active,
  count_if(list_median(y[17:20]) = 0) AS n_zero_median, count_if(y[16] > 0) AS n_fired
FROM panel GROUP BY segment"""))
def derived_flags(spark, sf):
    df = extend(P.prepared_panel(spark, sf), {"test": "slice(y, 17, 4)"})
    from partcast.functions.arrays import median
    return df.groupBy("segment").agg(
        F.count("*").alias("n"), F.expr("count_if(aggregate(test, 0.0D, (a, x) -> a + x) > 0) AS n_active"),
        F.count_if(median(F.col("test")) == 0).alias("n_zero_median"),
        F.expr("count_if(y[15] > 0) AS n_fired"))


@add("boolean_predicates", "WITH " + MASTER + """
SELECT part_id, ship_id, status FROM master
WHERE status IN ('Obsolete', 'Scrapped') AND NOT (replaced_by IS NULL OR replaced_by = '')
   OR received BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' AND legacy_velocity IS NULL""")
def boolean_predicates(spark, sf):
    replaced = F.col("replaced_by").isNotNull() & (F.col("replaced_by") != "")
    window = F.col("received").between(F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date"))
    return X.parts_master(spark, sf).where(
        (F.col("status").isin("Obsolete", "Scrapped") & replaced)
        | (window & F.col("legacy_velocity").isNull())
    ).select("part_id", "ship_id", "status")


@add("segment_restriction", "WITH " + FCST + "," + MASTER + """
SELECT stock_item, run_id, n_lines FROM fcst WHERE stock_item IN (SELECT part_type FROM master WHERE brand = 'Brand#7')""")
def segment_restriction(spark, sf):
    focal = X.parts_master(spark, sf).where("brand = 'Brand#7'").select(
        F.col("part_type").alias("stock_item")).distinct()
    return X.forecast_table(spark, sf).join(focal, "stock_item", "left_semi").select(
        "stock_item", "run_id", "n_lines")


@add("outlier_trim", """
WITH t AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.99) AS cut FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, count(*) AS n, rd4(max(l_extendedprice)) AS top FROM lineitem JOIN t USING (l_returnflag)
WHERE l_extendedprice BETWEEN 0 AND cut GROUP BY l_returnflag""")
def outlier_trim(spark, sf):
    df = li(spark, sf).select("l_returnflag", "l_extendedprice")
    cut = quantile_columns(df, ["l_returnflag"], "l_extendedprice", {"cut": 0.99})
    # three return flags: the cut-off table is bounded by the flag domain
    return df.join(F.broadcast(cut), "l_returnflag").where("l_extendedprice BETWEEN 0 AND cut").groupBy(
        "l_returnflag").agg(F.count("*").alias("n"), r(F.max("l_extendedprice"), 4, "top"))


@add("dedupe_key_subset", """
SELECT l_partkey, l_suppkey, l_shipdate::DATE AS l_shipdate, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM lineitem)
WHERE rn = 1""")
def dedupe_key_subset(spark, sf):
    df = li(spark, sf).select("l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("l_shipdate"), "l_orderkey", "l_linenumber")
    newest_first = F.datediff(F.lit("1970-01-01").cast("date"), "l_shipdate").alias("_age")
    return O.dedupe(df, ["l_partkey", "l_suppkey"], [newest_first, F.col("l_orderkey").alias("_o"), F.col("l_linenumber").alias("_l")])


@add("canonical_order", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderkey")
def canonical_order(spark, sf):
    return X.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").orderBy("o_custkey", "o_orderkey")


@add("strata_key", Q.query(Q.panel(), "SELECT segment || '|' || abc AS stratum, count(*) AS n FROM panel GROUP BY ALL"))
def strata_key(spark, sf):
    return P.prepared_panel(spark, sf).groupBy(F.concat_ws("|", "segment", "abc").alias("stratum")).agg(F.count("*").alias("n"))


@add("rowwise_guards", """
SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS top, least(greatest(l_quantity, 10), 40) AS clipped,
  rd6(CASE WHEN l_tax = 0 THEN NULL ELSE l_discount / l_tax END) AS ratio FROM lineitem""")
def rowwise_guards(spark, sf):
    return li(spark, sf).select(
        "l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("top"),
        F.expr("least(greatest(l_quantity, 10.0D), 40.0D)").alias("clipped"),
        r(F.try_divide("l_discount", "l_tax"), 6, "ratio"))


@add("scalar_functions", """
SELECT p_partkey, lower(trim('  ' || p_name || ' ')) AS name, lpad(p_partkey::VARCHAR, 9, '0') AS code, starts_with(p_brand, 'Brand#1') AS b1,
  rd6(ln(1 + p_retailprice)) AS lp, round_even(p_retailprice / 200.0::DOUBLE, 0) AS half, ceil(sqrt(p_size))::BIGINT AS cs, abs(p_size - 25)::BIGINT AS dist
FROM part""")
def scalar_functions(spark, sf):
    return X.table(spark, sf, "part").selectExpr(
        "p_partkey", "lower(trim(concat('  ', p_name, ' '))) AS name", "lpad(CAST(p_partkey AS STRING), 9, '0') AS code",
        "startswith(p_brand, 'Brand#1') AS b1", "floor(log1p(p_retailprice) * 1e6D + 0.50001D) / 1e6D AS lp",
        "rint(p_retailprice / 200.0D) AS half", "ceil(sqrt(p_size)) AS cs", "CAST(abs(p_size - 25) AS BIGINT) AS dist")


@add("date_parsing", "WITH " + LOG + f"""
SELECT code, count(*) AS n, count(d) AS n_dated, max(CASE WHEN d <= DATE '{AS_OF}' THEN d END) AS newest,
  count_if(d >= DATE '{AS_OF}' - 1826) AS n_history
FROM (SELECT code, try_cast(trans_date AS TIMESTAMP)::DATE AS d FROM log) GROUP BY code""")
def date_parsing(spark, sf):
    log = X.transaction_log(spark, sf).select("code", V.parsed_date().alias("d"))
    return log.groupBy("code").agg(
        F.count("*").alias("n"), F.count("d").alias("n_dated"),
        F.expr(f"max(if(d <= DATE'{AS_OF}', d, NULL)) AS newest"),
        F.expr(f"count_if(d >= date_sub(DATE'{AS_OF}', 1826)) AS n_history"))


# --- joins ----------------------------------------------------------------------------------------

@add("join_inner_composite", "WITH " + MASTER + """
SELECT ship_id, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN master ON l_partkey = part_id AND l_suppkey = ship_id
WHERE status = 'Active' GROUP BY ship_id""")
def join_inner_composite(spark, sf):
    m = X.parts_master(spark, sf).where("status = 'Active'").select("part_id", "ship_id")
    moves = li(spark, sf).groupBy(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("ship_id")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    return moves.join(m, ["part_id", "ship_id"]).groupBy("ship_id").agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"))


@add("join_renamed_keys", "WITH " + FCST + "," + STOCKMAX + """
SELECT stock_item, run_id, count(ship_id) AS n_policies FROM fcst LEFT JOIN sm ON part_type = stock_item GROUP BY ALL""")
def join_renamed_keys(spark, sf):
    per = X.stockmax(spark, sf).groupBy(F.col("part_type").alias("stock_item")).agg(F.count("ship_id").alias("k"))
    return X.forecast_table(spark, sf).join(per, "stock_item", "left").select(
        "stock_item", "run_id", F.coalesce("k", F.lit(0)).alias("n_policies"))


@add("join_left_fill", "WITH " + MASTER + """
SELECT m.part_id, m.ship_id, coalesce(c.n, 0) AS n FROM master m LEFT JOIN (
  SELECT l_partkey AS part_id, l_suppkey AS ship_id, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) c
  ON c.part_id = m.part_id AND c.ship_id = m.ship_id""")
def join_left_fill(spark, sf):
    c = li(spark, sf).where("l_returnflag = 'R'").groupBy(
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("ship_id")).agg(F.count("*").alias("n"))
    return X.parts_master(spark, sf).select("part_id", "ship_id").join(c, ["part_id", "ship_id"], "left").fillna({"n": 0})


@add("join_anti", "WITH " + MASTER + """
SELECT part_id, ship_id FROM master WHERE NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_partkey = part_id AND l_suppkey = ship_id AND l_returnflag IN ('N', 'R'))""")
def join_anti(spark, sf):
    used = li(spark, sf).where("l_returnflag IN ('N', 'R')").select(
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("ship_id"))
    return X.parts_master(spark, sf).select("part_id", "ship_id").join(used, ["part_id", "ship_id"], "left_anti")


@add("join_full_outer", """
SELECT coalesce(a.k, b.k) AS l_partkey, a.n AS n_returned, b.n AS n_open FROM
  (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY ALL) a
  FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 10 GROUP BY ALL) b ON a.k = b.k""")
def join_full_outer(spark, sf):
    a = li(spark, sf).where("l_returnflag = 'R' AND l_quantity > 40").groupBy("l_partkey").agg(F.count("*").alias("n_returned"))
    b = li(spark, sf).where("l_linestatus = 'O' AND l_quantity < 10").groupBy("l_partkey").agg(F.count("*").alias("n_open"))
    return a.join(b, "l_partkey", "full")


@add("join_name_collision", "WITH " + FCST + """
SELECT a.stock_item, a.run_id, a.actual_total, b.actual_total AS actual_total_prev, b.n_lines AS n_lines_prev
FROM fcst a JOIN fcst b ON a.stock_item = b.stock_item AND a.run_id = b.run_id + 1""")
def join_name_collision(spark, sf):
    f = X.forecast_table(spark, sf)
    prev = f.select("stock_item", (F.col("run_id") + 1).alias("run_id"),
                    F.col("actual_total").alias("actual_total_prev"), F.col("n_lines").alias("n_lines_prev"))
    return f.select("stock_item", "run_id", "actual_total").join(prev, ["stock_item", "run_id"])


@add("latest_forecast", "WITH " + FCST + """
SELECT stock_item, run_id, actual_total, n_lines FROM fcst f WHERE run_id = (SELECT max(run_id) FROM fcst g WHERE g.stock_item = f.stock_item)""")
def latest_forecast(spark, sf):
    return PN.latest_run(X.forecast_table(spark, sf)).select("stock_item", "run_id", "actual_total", "n_lines")


@add("membership_flag", Q.query(Q.panel(), """
SELECT segment, item_id IN (SELECT p_partkey FROM part WHERE p_size <= 10) AS in_set, count(*) AS n FROM panel GROUP BY ALL"""))
def membership_flag(spark, sf):
    members = X.table(spark, sf, "part").where("p_size <= 10").select(
        F.col("p_partkey").alias("item_id"), F.lit(True).alias("hit")).distinct()
    return P.prepared_panel(spark, sf).join(members, "item_id", "left").groupBy(
        "segment", F.col("hit").isNotNull().alias("in_set")).agg(F.count("*").alias("n"))


@add("price_band_join", Q.query(Q.panel() + """,
e AS (SELECT quantile_cont(price, [0.0, 0.5, 0.8, 0.9, 0.95, 0.97, 0.99, 1.0]) AS b FROM panel)""", """
SELECT i::INTEGER AS band, count(*) AS n, rd2(min(price)) AS lo, rd2(max(price)) AS hi
FROM panel, e, (SELECT unnest(range(1, 8)) AS i) WHERE price >= b[i] AND (price < b[i + 1] OR (i = 7 AND price <= b[8])) GROUP BY i"""))
def price_band_join(spark, sf):
    from partcast.plans.analyses import with_price_band
    return with_price_band(P.prepared_panel(spark, sf)).groupBy("band").agg(
        F.count("*").alias("n"), r(F.min("price"), 2, "lo"), r(F.max("price"), 2, "hi"))


@add("nearest_level_lookup", Q.query(Q.with_external(Q.panel() + "," + Q.forecasts(16, False, ("MA",))), """
SELECT tier, sl, lv AS level, count(*) AS n, rd4(sum(qv)) AS total FROM (
  SELECT tier, sl, lv, qv, row_number() OVER (PARTITION BY item_id, site_id ORDER BY d, lv) AS rn FROM (
    SELECT item_id, site_id, tier, sl, lv, qv, abs(lv - sl) AS d FROM (
      SELECT item_id, site_id, tier, CASE tier WHEN 'high' THEN 0.99::DOUBLE WHEN 'low' THEN 0.95::DOUBLE ELSE 0.97::DOUBLE END AS sl,
        unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS lv, unnest(q) AS qv
      FROM panel JOIN ext USING (item_id, site_id)))) WHERE rn = 1 GROUP BY ALL"""))
def nearest_level_lookup(spark, sf):
    from partcast.operators.policy import nearest_level_index, quantile_at_service, service_level
    p = P.prepared_panel(spark, sf)
    df = p.select(*KEYS, "tier").join(X.external_forecasts(p), KEYS)
    read = {sl: C.QUANTILE_LEVELS[nearest_level_index(sl) - 1] for sl in (0.99, 0.97, 0.95)}
    lv = "CASE sl " + " ".join(f"WHEN {k}D THEN {v}D" for k, v in read.items()) + " END"
    df = extend(df, {"sl": service_level(), "level": lv, "v": quantile_at_service("quantiles")})
    return df.groupBy("tier", "sl", "level").agg(F.count("*").alias("n"), r(F.sum("v"), 4, "total"))


@add("replacement_link", "WITH " + MASTER + f"""
SELECT m.part_type, min(h.legacy_velocity) AS heir_class, count(*) AS n_rows FROM master m LEFT JOIN
  {mode_sql("(SELECT replaced_by AS part_type, legacy_velocity FROM master WHERE replaced_by IS NOT NULL AND replaced_by <> '')", "part_type", "legacy_velocity")} h
  ON h.part_type = m.part_type GROUP BY m.part_type""")
def replacement_link(spark, sf):
    m = X.parts_master(spark, sf)
    heirs = O.mode_of(
        m.where("replaced_by IS NOT NULL AND replaced_by != ''").select(
            F.col("replaced_by").alias("part_type"), "legacy_velocity"), ["part_type"], ["legacy_velocity"])
    per = m.groupBy("part_type").agg(F.count("*").alias("n_rows"))
    return per.join(heirs, "part_type", "left").select(
        "part_type", F.col("legacy_velocity").alias("heir_class"), "n_rows")


# --- aggregates -----------------------------------------------------------------------------------

@add("group_count", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_count(spark, sf):
    return li(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@add("group_stats", """
SELECT l_suppkey, sum(l_quantity) AS s, rd4(avg(l_extendedprice)) AS m, min(l_discount) AS lo, max(l_tax) AS hi,
  median(l_quantity) AS med FROM lineitem GROUP BY l_suppkey""")
def group_stats(spark, sf):
    df = li(spark, sf)
    base = df.groupBy("l_suppkey").agg(
        F.sum("l_quantity").alias("s"), r(F.avg("l_extendedprice"), 4, "m"),
        F.min("l_discount").alias("lo"), F.max("l_tax").alias("hi"))
    # quantities have few different values: count them, then take the weighted median
    med = df.groupBy("l_suppkey", "l_quantity").agg(F.count("*").alias("k")).groupBy("l_suppkey").agg(
        F.percentile("l_quantity", 0.5, F.col("k")).alias("med"))
    return base.join(med, "l_suppkey")


@add("distinct_counts", "SELECT p_brand, count(DISTINCT l_suppkey) AS n_sites, count(DISTINCT p_type) AS n_types FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def distinct_counts(spark, sf):
    pairs = li(spark, sf).select("l_partkey", "l_suppkey").distinct()
    part = X.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return pairs.join(part, "l_partkey").groupBy("p_brand").agg(
        F.count_distinct("l_suppkey").alias("n_sites"), F.count_distinct("p_type").alias("n_types"))


@add("mode_first_on_ties", "WITH pri AS (SELECT l_partkey, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT * FROM "
     + mode_sql("pri", "l_partkey", "o_orderpriority"))
def mode_first_on_ties(spark, sf):
    o = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return O.mode_of(li(spark, sf).select("l_orderkey", "l_partkey").join(o, "l_orderkey"), ["l_partkey"], ["o_orderpriority"])


@add("distinct_list", "WITH " + STOCKMAX + """
SELECT part_type, string_agg(region, ',' ORDER BY region) AS regions FROM (SELECT DISTINCT part_type, region FROM sm WHERE region IS NOT NULL) GROUP BY part_type""")
def distinct_list(spark, sf):
    return X.stockmax(spark, sf).where("region IS NOT NULL").groupBy("part_type").agg(
        F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))


@add("conditional_share", """
SELECT l_linestatus, count_if(l_discount > 0.05) AS n_disc, rd6(avg(CASE WHEN l_tax <= 0.01 THEN 1.0::DOUBLE ELSE 0 END)) AS share_low_tax FROM lineitem GROUP BY l_linestatus""")
def conditional_share(spark, sf):
    return li(spark, sf).groupBy("l_linestatus").agg(
        F.expr("count_if(l_discount > 0.05D) AS n_disc"), r(F.expr("avg(if(l_tax <= 0.01D, 1.0D, 0.0D))"), 6, "share_low_tax"))


@add("population_std", "SELECT l_suppkey, rd6(stddev_pop(l_quantity)) AS sd, rd4(var_pop(l_quantity)) AS v FROM lineitem GROUP BY l_suppkey")
def population_std(spark, sf):
    return li(spark, sf).groupBy("l_suppkey").agg(r(F.stddev_pop("l_quantity"), 6, "sd"), r(F.var_pop("l_quantity"), 4, "v"))


@add("quantile_linear", """
SELECT l_returnflag, rd4(quantile_cont(l_extendedprice, 0.1)) AS p10, rd4(quantile_cont(l_extendedprice, 0.5)) AS p50, rd4(quantile_cont(l_extendedprice, 0.95)) AS p95
FROM lineitem GROUP BY l_returnflag""")
def quantile_linear(spark, sf):
    q = quantile_columns(li(spark, sf), ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p95": 0.95})
    return q.select("l_returnflag", r("p10", 4), r("p50", 4), r("p95", 4))


@add("quantile_nearest", "SELECT l_returnflag, quantile_disc(l_quantity, 0.95) AS q95, quantile_disc(l_quantity, 0.5) AS q50 FROM lineitem GROUP BY l_returnflag")
def quantile_nearest(spark, sf):
    counts = li(spark, sf).groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("k"))
    up = W.partitionBy("l_returnflag").orderBy("l_quantity").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumns({"cum": F.sum("k").over(up), "n": F.sum("k").over(W.partitionBy("l_returnflag"))})
    return ranked.groupBy("l_returnflag").agg(
        F.expr("min(if(cum >= ceil(0.95D * n), l_quantity, NULL)) AS q95"),
        F.expr("min(if(cum >= ceil(0.5D * n), l_quantity, NULL)) AS q50"))


@add("pivot_counts", "WITH " + MASTER + """
SELECT coalesce(legacy_velocity, 'none') AS velocity, count_if(status = 'Active') AS active, count_if(status = 'Obsolete') AS obsolete, count_if(status = 'Scrapped') AS scrapped
FROM master GROUP BY ALL""")
def pivot_counts(spark, sf):
    m = X.parts_master(spark, sf).select(F.coalesce("legacy_velocity", F.lit("none")).alias("velocity"), F.lower("status").alias("s"))
    return m.groupBy("velocity").pivot("s", ["active", "obsolete", "scrapped"]).agg(F.count(F.lit(1))).fillna(0)


WEIGHTED = """
d AS (SELECT p.*, t.w FROM panel p JOIN (
  SELECT segment, abc, count(*) / (1.0::DOUBLE * count_if(item_id % 3 = 0)) AS w FROM panel GROUP BY ALL) t USING (segment, abc) WHERE item_id % 3 = 0)"""


@add("share_of_total", Q.query(Q.panel(), "SELECT segment, count(*) AS n, rd6(100.0::DOUBLE * count(*) / sum(count(*)) OVER ()) AS pct FROM panel GROUP BY segment"))
def share_of_total(spark, sf):
    g = P.prepared_panel(spark, sf).groupBy("segment").agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n")).scalar()
    return g.select("segment", "n", r(F.lit(100.0) * F.col("n") / total, 6, "pct"))


@add("argmin_model", Q.query(Q.scored(), """
SELECT best_mae, best_cost, count(*) AS n FROM (
  SELECT item_id, site_id, arg_min(model, struct_pack(a := rm, b := model)) AS best_mae, arg_min(model, struct_pack(a := rc, b := model)) AS best_cost
  FROM (SELECT *, round_even(mae * 1e6::DOUBLE, 0) AS rm, round_even(cost * 1e6::DOUBLE, 0) AS rc FROM sc) GROUP BY ALL) GROUP BY ALL"""))
def argmin_model(spark, sf):
    rows = P.scored_from(spark, sf)
    best = lambda m: F.min_by("model", F.struct(F.expr(f"rint({m} * 1e6D)"), "model"))
    per = rows.groupBy(*KEYS).agg(best("mae").alias("best_mae"), best("cost").alias("best_cost"))
    return per.groupBy("best_mae", "best_cost").agg(F.count("*").alias("n"))


@add("log_correlation", """
SELECT l_returnflag, CASE WHEN count(*) > 10 THEN rd6(corr(ln(1 + l_quantity), ln(1 + l_extendedprice))) END AS corr, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def log_correlation(spark, sf):
    return li(spark, sf).groupBy("l_returnflag").agg(
        r(guarded_corr(F.log1p("l_quantity"), F.log1p("l_extendedprice"), 11), 6, "corr"), F.count("*").alias("n"))


@add("grouping_sets", Q.query(Q.panel(), """
SELECT segment, abc, count(*) AS n, rd4(avg(lead_days)) AS lead FROM panel GROUP BY GROUPING SETS ((segment, abc), (segment), ())"""))
def grouping_sets(spark, sf):
    p = P.prepared_panel(spark, sf).select("segment", "abc", "lead_days")
    return p.groupingSets([["segment", "abc"], ["segment"], []], "segment", "abc").agg(
        F.count("*").alias("n"), r(F.avg("lead_days"), 4, "lead"))


@add("series_assembly", Q.query(Q.series("part"), """
SELECT item_id, array_to_string(list_transform(y, lambda v: v::BIGINT), ',') AS y FROM series"""))
def series_assembly(spark, sf):
    """Ordered vector per id from long rows, gaps filled from the calendar."""
    from partcast.plans.series import assemble
    rows = li(spark, sf).select(
        F.col("l_partkey").alias("item_id"), X.quarter_index(F.col("l_shipdate")).alias("q"), F.col("l_quantity").alias("v"))
    s = assemble(rows, ["item_id"], "q", "v", 1, C.QUARTERS)
    return s.select("item_id", F.expr("array_join(transform(y, v -> CAST(v AS BIGINT)), ',') AS y"))


# --- windows --------------------------------------------------------------------------------------

COUNTS = "cnt AS (SELECT l_partkey AS part_id, l_suppkey AS ship_id, count(*) AS n FROM lineitem GROUP BY ALL)"


@add("partition_total", "WITH " + COUNTS + """
SELECT part_id, ship_id, n, sum(n) OVER (PARTITION BY ship_id)::BIGINT AS ship_total FROM cnt""")
def partition_total(spark, sf):
    """Group totals by aggregate and join, so a hot ship is reduced before the exchange."""
    cnt = li(spark, sf).groupBy(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("ship_id")).agg(F.count("*").alias("n"))
    total = li(spark, sf).groupBy(F.col("l_suppkey").alias("ship_id")).agg(F.count("*").alias("ship_total"))
    return cnt.join(total, "ship_id")


@add("running_share", "WITH " + COUNTS + """
SELECT part_id, ship_id, n, run::BIGINT AS running, tot::BIGINT AS group_total, rd8(run / tot) AS share FROM (
  SELECT *, sum(n) OVER (PARTITION BY ship_id ORDER BY n DESC, md5(part_id::VARCHAR), part_id ROWS UNBOUNDED PRECEDING) AS run,
    sum(n) OVER (PARTITION BY ship_id) AS tot FROM cnt)""")
def running_share(spark, sf):
    cnt = li(spark, sf).groupBy(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("ship_id")).agg(F.count("*").alias("n"))
    return O.running_share(cnt, "ship_id", "n", "part_id").select(
        "part_id", "ship_id", "n", "running", "group_total", r("share", 8))


SAMPLE_SQL = """
smp AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY segment, abc ORDER BY md5('42|' || item_id::VARCHAR || '|' || site_id::VARCHAR), item_id, site_id) AS rn
  FROM panel) WHERE rn <= greatest(1, ceil(3000.0::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT segment, abc FROM panel)))))"""


@add("stratified_sample", Q.query(Q.panel() + "," + SAMPLE_SQL, "SELECT item_id, site_id, segment, abc FROM smp"))
def stratified_sample(spark, sf):
    p = P.prepared_panel(spark, sf).select(*KEYS, "segment", "abc")
    return O.stratified_sample(p, ["segment", "abc"], KEYS, 3000)


@add("design_weights", Q.query(Q.panel() + "," + SAMPLE_SQL, """
SELECT segment, abc, pop_n, sample_n, rd6(pop_n / (1.0::DOUBLE * sample_n)) AS weight
FROM (SELECT segment, abc, count(*) AS pop_n FROM panel GROUP BY ALL) JOIN (SELECT segment, abc, count(*) AS sample_n FROM smp GROUP BY ALL) USING (segment, abc)"""))
def design_weights(spark, sf):
    p = P.prepared_panel(spark, sf).select(*KEYS, "segment", "abc")
    w = PN.design_weights(p, O.stratified_sample(p, ["segment", "abc"], KEYS, 3000), ["segment", "abc"])
    return w.select("segment", "abc", "pop_n", "sample_n", r("weight"))


@add("weighted_mean_kish", Q.query(Q.panel() + "," + SAMPLE_SQL + """,
w AS (SELECT segment, abc, a.n / (1.0::DOUBLE * b.n) AS w FROM (SELECT segment, abc, count(*) AS n FROM panel GROUP BY ALL) a
      JOIN (SELECT segment, abc, count(*) AS n FROM smp GROUP BY ALL) b USING (segment, abc))""", """
SELECT tier, rd6(sum(w * lead_days) / sum(w)) AS lead_weighted, rd6(avg(lead_days)) AS lead_raw, rd4(sum(w) * sum(w) / sum(w * w)) AS n_eff
FROM smp JOIN w USING (segment, abc) GROUP BY tier"""))
def weighted_mean_kish(spark, sf):
    from partcast.plans.weighting import kish, weighted_mean
    p = P.prepared_panel(spark, sf).select(*KEYS, "segment", "abc", "tier", "lead_days")
    s = O.stratified_sample(p, ["segment", "abc"], KEYS, 3000, sizes=True).withColumn("weight", F.expr("pop_n / sample_n"))
    return s.groupBy("tier").agg(
        r(weighted_mean("lead_days"), 6, "lead_weighted"), r(F.avg("lead_days"), 6, "lead_raw"), r(kish(), 4, "n_eff"))


@add("competition_rank", "SELECT l_suppkey, n, rank() OVER (ORDER BY n)::BIGINT AS rk FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)")
def competition_rank(spark, sf):
    """Rank from the table of distinct values, so rows are never ordered globally."""
    n = li(spark, sf).groupBy("l_suppkey").agg(F.count("*").alias("n"))
    freq = n.groupBy("n").agg(F.count("*").alias("k"))
    below = W.orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return n.join(freq.select("n", (F.coalesce(F.sum("k").over(below), F.lit(0)) + 1).alias("rk")), "n")


@add("average_rank", Q.query("f AS (SELECT l_suppkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)",
     f"SELECT l_suppkey, l_linestatus, n, {Q.avg_rank('n', 'l_linestatus')} AS rk FROM f"))
def average_rank(spark, sf):
    n = li(spark, sf).groupBy("l_linestatus", "l_suppkey").agg(F.count("*").alias("n"))
    freq = n.groupBy("l_linestatus", "n").agg(F.count("*").alias("k"))
    below = W.partitionBy("l_linestatus").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    ranks = freq.select("l_linestatus", "n", (
        F.coalesce(F.sum("k").over(below), F.lit(0)) + 1 + (F.col("k") - 1) / 2.0).alias("rk"))
    return n.join(ranks, ["l_linestatus", "n"])


LONG = """
lg AS (SELECT item_id, q, y[q] AS v FROM series, (SELECT unnest(range(1, 29)) AS q))"""


@add("lag_features", Q.query(Q.series("part") + "," + LONG, """
SELECT item_id, q::INTEGER AS q, v, """ + ", ".join(f"coalesce(lag(v, {k}) OVER w, 0) AS lag{k}" for k in (1, 2, 3, 4, 8, 12)) + """
FROM lg WINDOW w AS (PARTITION BY item_id ORDER BY q)"""))
def lag_features(spark, sf):
    from partcast.plans.features import long_series, with_lags
    return with_lags(long_series(X.demand_series(spark, sf, "part"), ["item_id"]), ["item_id"], (1, 2, 3, 4, 8, 12))


@add("rolling_features", Q.query(Q.series("part") + "," + LONG, """
SELECT item_id, q::INTEGER AS q, """ + ", ".join(
    f"rd6(coalesce(avg(v) OVER w{w}, 0)) AS mean{w}, rd6(coalesce(stddev_pop(v) OVER w{w}, 0)) AS std{w}, (count(*) FILTER (WHERE v > 0) OVER w{w})::BIGINT AS nz{w}"
    for w in (4, 8, 12)) + " FROM lg WINDOW " + ", ".join(
    f"w{w} AS (PARTITION BY item_id ORDER BY q ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in (4, 8, 12))))
def rolling_features(spark, sf):
    from partcast.plans.features import long_series, with_rolling
    df = with_rolling(long_series(X.demand_series(spark, sf, "part"), ["item_id"]), ["item_id"], (4, 8, 12))
    return df.select("item_id", "q", *[c for w in (4, 8, 12) for c in (r(f"mean{w}"), r(f"std{w}"), F.col(f"nz{w}"))])


@add("recency_features", Q.query(Q.series("part") + "," + LONG, """
SELECT item_id, q::INTEGER AS q, (q - 1 - coalesce(max(CASE WHEN v > 0 THEN q END) OVER w, 0))::INTEGER AS since_last,
  (count(*) FILTER (WHERE v > 0) OVER w)::BIGINT AS n_demand, rd6(coalesce(avg(CASE WHEN v > 0 THEN v END) OVER w, 0)) AS mean_size
FROM lg WINDOW w AS (PARTITION BY item_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""))
def recency_features(spark, sf):
    from partcast.plans.features import long_series, with_recency
    df = with_recency(long_series(X.demand_series(spark, sf, "part"), ["item_id"]), ["item_id"])
    return df.select("item_id", "q", "since_last", "n_demand", r("mean_size"))


@add("first_difference", Q.query(Q.series("part"), """
SELECT item_id, rd6(list_sum(list_transform(range(2, 17), lambda i: abs(y[i] - y[i - 1]))) / 15.0::DOUBLE) AS mad,
  rd6(sqrt(list_sum(list_transform(range(2, 17), lambda i: (y[i] - y[i - 1]) * (y[i] - y[i - 1]))) / 15.0::DOUBLE)) AS rmsd FROM series"""))
def first_difference(spark, sf):
    from partcast.plans.analyses import naive_scales
    return extend(X.demand_series(spark, sf, "part"), naive_scales(16)).select("item_id", r("naive_mad", 6, "mad"), r("naive_rmsd", 6, "rmsd"))


@add("uncross_running_max", Q.query(Q.with_external(Q.panel() + "," + Q.forecasts(16, False, ("MA",))), """
SELECT item_id, site_id, array_to_string(list_transform(range(1, 6), lambda i: list_max(jq[1:i])::BIGINT), ',') AS q FROM (
  SELECT item_id, site_id, [q[1], q[3], q[2], q[5], q[4]] AS jq FROM ext)"""))
def uncross_running_max(spark, sf):
    from partcast.plans.distribution import uncross
    e = X.external_forecasts(P.prepared_panel(spark, sf))
    e = e.selectExpr(*KEYS, "array(quantiles[0], quantiles[2], quantiles[1], quantiles[4], quantiles[3]) AS jq")
    return e.select(*KEYS, F.array_join(uncross("jq").cast("array<bigint>"), ",").alias("q"))


@add("trailing_window", Q.query(Q.series(), """
SELECT item_id, site_id, rd6(list_avg(y[-4:])) AS mean4, list_median(y[-4:]) AS med4, rd6(list_avg(y[-7:])) AS mean7 FROM series"""))
def trailing_window(spark, sf):
    from partcast.functions import arrays as A
    t = lambda n: F.slice("y", -n, n)
    return X.demand_series(spark, sf).select(
        *KEYS, r(A.mean(t(4)), 6, "mean4"), A.median(t(4)).alias("med4"), r(A.mean(t(7)), 6, "mean7"))


# --- top-k, sets ----------------------------------------------------------------------------------

@add("multi_key_sort", "SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL ORDER BY l_returnflag, n DESC, l_suppkey")
def multi_key_sort(spark, sf):
    return li(spark, sf).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).orderBy(
        "l_returnflag", F.col("n").desc(), "l_suppkey")


@add("topk_strata", Q.query(Q.panel(), "SELECT segment, abc, count(*) AS n FROM panel GROUP BY ALL ORDER BY n DESC, segment, abc LIMIT 4"))
def topk_strata(spark, sf):
    return P.prepared_panel(spark, sf).groupBy("segment", "abc").agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), "segment", "abc").limit(4)


@add("random_sample", """
SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY md5('7|' || l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR), l_orderkey, l_linenumber LIMIT 500""")
def random_sample(spark, sf):
    return O.random_sample(li(spark, sf).select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 500, seed=7)


@add("union_relaxed", """
SELECT k, v, count(*) AS n FROM (
  SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey, s_name FROM supplier) GROUP BY ALL""")
def union_relaxed(spark, sf):
    from partcast.sources.files import union_shared
    c = X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    n = X.table(spark, sf, "nation").join(c, "n_nationkey").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"), "n_regionkey")
    s = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"), "s_acctbal")
    return union_shared(n, s).groupBy("k", "v").agg(F.count("*").alias("n"))


@add("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    return li(spark, sf).select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@add("set_operations", """
WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount >= 0.1)
SELECT 'both' AS kind, l_partkey FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'only_first', l_partkey FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_operations(spark, sf):
    a = li(spark, sf).where("l_quantity >= 50").select("l_partkey")
    b = li(spark, sf).where("l_discount >= 0.1D").select("l_partkey")
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), "l_partkey")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "only_first"))


# --- panel building -------------------------------------------------------------------------------

PER_ITEM = "," .join(["WITH " + MASTER, f"""
pi AS (
  SELECT part_type, count(DISTINCT brand) AS n_brands, count(DISTINCT ship_id) AS n_ships, median(price) AS unit_price,
    min(price) AS price_min, max(price) AS price_max, count(price) AS n_prices, max(received) AS latest_purchase,
    avg(lead_days) AS lead_days, avg(usage_year) AS usage_year
  FROM (SELECT *, coalesce(CASE WHEN price_brand > 0 THEN price_brand END, CASE WHEN price_ship > 0 THEN price_ship END,
          CASE WHEN price_avg > 0 THEN price_avg END) AS price FROM master) GROUP BY part_type)""", f"""
mi AS (SELECT pi.*, v.legacy_velocity, c.criticality, k.stock_class, t.status, coalesce(v.legacy_velocity = 'C', false) AS is_slow FROM pi
  LEFT JOIN {mode_sql('master', 'part_type', 'legacy_velocity')} v USING (part_type)
  LEFT JOIN {mode_sql('master', 'part_type', 'criticality')} c USING (part_type)
  LEFT JOIN {mode_sql('master', 'part_type', 'stock_class')} k USING (part_type)
  LEFT JOIN {mode_sql('master', 'part_type', 'status')} t USING (part_type))"""])

PER_SM = STOCKMAX + f""",
si AS (SELECT a.*, s.strategy FROM (
  SELECT part_type, count(DISTINCT region) AS n_regions, avg(quarterly_forecast) AS deployed_forecast, avg(rmse) AS deployed_rmse,
    avg(new_min) AS deployed_min, avg(new_max) AS deployed_max, avg(try_cast(in_stock AS DOUBLE)) AS in_stock FROM sm GROUP BY part_type) a
  LEFT JOIN {mode_sql('sm', 'part_type', 'strategy')} s USING (part_type))"""


@add("master_per_item", PER_ITEM + """
SELECT part_type, n_brands, n_ships, rd4(unit_price) AS unit_price, rd4(price_min) AS price_min, rd4(price_max) AS price_max, n_prices,
  latest_purchase, rd4(lead_days) AS lead_days, rd4(usage_year) AS usage_year, legacy_velocity, criticality, stock_class, status, is_slow FROM mi""")
def master_per_item(spark, sf):
    m = PN.master_per_item(X.parts_master(spark, sf))
    return m.select(
        "part_type", "n_brands", "n_ships", r("unit_price", 4), r("price_min", 4), r("price_max", 4), "n_prices",
        "latest_purchase", r("lead_days", 4), r("usage_year", 4), "legacy_velocity", "criticality", "stock_class", "status", "is_slow")


@add("stockmax_per_item", "WITH " + PER_SM + """
SELECT part_type, n_regions, rd6(deployed_forecast) AS deployed_forecast, rd6(deployed_rmse) AS deployed_rmse, rd4(deployed_min) AS deployed_min,
  rd4(deployed_max) AS deployed_max, rd4(in_stock) AS in_stock, strategy FROM si""")
def stockmax_per_item(spark, sf):
    s = PN.stockmax_per_item(X.stockmax(spark, sf))
    return s.select("part_type", "n_regions", r("deployed_forecast"), r("deployed_rmse"), r("deployed_min", 4),
                    r("deployed_max", 4), r("in_stock", 4), "strategy")


PANEL_SQL = PER_ITEM + "," + PER_SM + "," + FCST + """,
pn AS (SELECT f.stock_item AS part_type, run_id, n_lines, unit_price, n_ships, deployed_max, n_regions,
  CASE WHEN trim(segmentation) IN ('Smooth', 'Erratic', 'Intermittent', 'Lumpy') THEN trim(segmentation) ELSE 'Unknown' END AS segment,
  CASE WHEN trim(abc) IN ('A', 'B', 'C') THEN trim(abc) ELSE 'Unknown' END AS abc,
  CASE WHEN trim(strategy) IN ('Strategy 1', 'Strategy 2', 'Strategy 3', 'Strategy 4', 'Strategy 5', 'Other') THEN trim(strategy) ELSE 'Unknown' END AS strategy
  FROM (SELECT *, rank() OVER (PARTITION BY stock_item ORDER BY run_id DESC) AS rk FROM fcst) f
  JOIN mi ON mi.part_type = f.stock_item LEFT JOIN si ON si.part_type = f.stock_item WHERE rk = 1)"""


@add("build_panel", PANEL_SQL + """
SELECT part_type, run_id, n_lines, rd4(unit_price) AS unit_price, n_ships, rd4(deployed_max) AS deployed_max, segment, abc, strategy FROM pn""")
def build_panel(spark, sf):
    p = PN.build_panel(X.forecast_table(spark, sf), X.parts_master(spark, sf), X.stockmax(spark, sf))
    return p.select("part_type", "run_id", "n_lines", r("unit_price", 4), "n_ships", r("deployed_max", 4), "segment", "abc", "strategy")


@add("policy_panel", PANEL_SQL + """
SELECT part_type, run_id, segment, abc, strategy FROM pn WHERE n_regions > 0""")
def policy_panel(spark, sf):
    p = PN.build_panel(X.forecast_table(spark, sf), X.parts_master(spark, sf), X.stockmax(spark, sf))
    return PN.policy_panel(p).select("part_type", "run_id", "segment", "abc", "strategy")


VELOCITY_SQL = "WITH " + LOG + "," + MASTER + f""",
mv AS (SELECT part_id, ship_id, count(*) AS n, bool_or(d >= DATE '{AS_OF}' - 365) AS recent
  FROM (SELECT *, try_cast(trans_date AS TIMESTAMP)::DATE AS d FROM log WHERE code = 'Used')
  WHERE d BETWEEN DATE '{AS_OF}' - 1826 AND DATE '{AS_OF}' GROUP BY ALL),
sh AS (SELECT *, sum(n) OVER (PARTITION BY ship_id ORDER BY n DESC, md5(part_id::VARCHAR), part_id ROWS UNBOUNDED PRECEDING)
    / sum(n) OVER (PARTITION BY ship_id) AS share FROM mv),
v1 AS (SELECT m.part_id, m.ship_id, m.part_type, coalesce(s.n, 0) AS n, coalesce(s.share, 1.0::DOUBLE) AS share,
    CASE WHEN s.n IS NULL THEN 'C' WHEN s.share <= 0.5 THEN 'A' WHEN s.share <= 0.8 THEN 'B' ELSE 'C' END AS base,
    coalesce(s.recent, false) AS recent,
    m.status IN ('Obsolete', 'Scrapped', 'Inactive') OR (m.replaced_by IS NOT NULL AND m.replaced_by <> '') AS is_d, m.legacy_velocity
  FROM master m LEFT JOIN sh s ON s.part_id = m.part_id AND s.ship_id = m.ship_id),
v2 AS (SELECT v1.*, CASE WHEN base = 'A' AND NOT recent THEN 'B' ELSE base END AS after_recent, h.legacy_velocity AS heir_class FROM v1 LEFT JOIN
  {mode_sql("(SELECT replaced_by AS part_type, legacy_velocity FROM master WHERE replaced_by IS NOT NULL AND replaced_by <> '')", "part_type", "legacy_velocity")} h
  ON h.part_type = v1.part_type),
vel AS (SELECT *, CASE WHEN is_d THEN 'D' WHEN heir_class IS NULL THEN after_recent ELSE least(after_recent, heir_class) END AS velocity FROM v2)"""


def velocity_of(spark, sf):
    return V.velocity(X.transaction_log(spark, sf), X.parts_master(spark, sf), AS_OF)


@add("velocity_classes", VELOCITY_SQL + """
SELECT part_id, ship_id, n, rd8(share) AS share, base, recent, after_recent, heir_class, is_d, velocity FROM vel""")
def velocity_classes(spark, sf):
    return velocity_of(spark, sf).select(
        "part_id", "ship_id", "n", r("share", 8), "base", "recent", "after_recent", "heir_class", "is_d", "velocity")


@add("velocity_confusion", VELOCITY_SQL + """
SELECT coalesce(legacy_velocity, '(none)') AS legacy, count_if(velocity = 'A') AS A, count_if(velocity = 'B') AS B,
  count_if(velocity = 'C') AS C, count_if(velocity = 'D') AS D FROM vel GROUP BY ALL""")
def velocity_confusion(spark, sf):
    return V.coverage(velocity_of(spark, sf), X.parts_master(spark, sf))


@add("velocity_agreement", VELOCITY_SQL + """
SELECT count(*) AS n, count(legacy_velocity) AS n_legacy, rd6(avg(CASE WHEN legacy_velocity IS NULL THEN NULL WHEN legacy_velocity = velocity THEN 1.0::DOUBLE ELSE 0 END)) AS agree,
  count_if(legacy_velocity IS NULL) AS gained FROM vel""")
def velocity_agreement(spark, sf):
    return V.agreement(velocity_of(spark, sf), X.parts_master(spark, sf)).select("n", "n_legacy", r("agree"), "gained")
