"""Files, privacy, streaming ingest, learner, partition invariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from partcast.operators import privacy
from partcast.operators.learner import LAGS, ROLLS, TwoHead, feature_exprs
from partcast.plans import analyses as N, compare as P, costing as K, panel as PN
from partcast.plans.features import long_series, with_lags, with_recency, with_rolling
from partcast.plans.reproduction import recover_levels
from partcast.functions.smoothing import extend
from partcast.sources import files, fixtures as X
from partcast.streaming.ingest import start_ingest


def test_csv_scan_keeps_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,qty,day\n1,2.5,2001-01-01 00:00:00.000\n2,oops,\n")
    df = files.scan_csv(spark, str(tmp_path / "a.csv"), StructType.fromDDL("id INT, qty DOUBLE, day STRING"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 2.5, "2001-01-01 00:00:00.000"), (2, None, None)]


def test_parquet_sink_and_audit(spark, sf, tmp_path):
    df = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = str(tmp_path / "o")
    files.write_parquet(df, out, rows_per_file=400)
    back = files.scan_parquet(spark, out, ["o_orderkey"])
    assert back.count() == df.count() and back.columns == ["o_orderkey"]
    a = privacy.audit(spark.read.parquet(out), ["o_orderkey", "o_missing"]).first()
    assert (a["n_rows"], a["n_columns"], a["missing"]) == (df.count(), 2, "o_missing")


def test_ledger_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("model", "SBA", "mae", 1.5)], "analysis string, grp string, metric string, value double")
    files.write_ledger(df, str(tmp_path / "l"))
    assert [tuple(r) for r in spark.read.schema(df.schema).json(str(tmp_path / "l")).collect()] == [("model", "SBA", "mae", 1.5)]


@pytest.mark.parametrize("encode", [privacy.surrogate, privacy.surrogate_blake2b])
def test_surrogates(spark, encode):
    df = spark.createDataFrame([("x",), ("x",), ("y",), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(encode(F.col("v"), "ns", "P_", "salt")).collect()]
    assert got[0] == got[1] != got[2] and got[3] == "" and got[4] is None
    assert got[0].startswith("P_") and len(got[0]) == 10 and got[0][2:].isdigit()
    other = [r[0] for r in df.select(encode(F.col("v"), "other", "P_", "salt")).collect()]
    assert other[0] != got[0]


def test_stream_ingest_equals_batch(spark, sf, tmp_path):
    src = X.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    args = ({"c_name": "customer"}, {"customer": "CUS_"}, ["c_custkey", "c_mktsegment"], "s")
    for _ in range(2):  # a restart adds nothing
        q = start_ingest(spark, str(tmp_path / "in"), src.schema, str(tmp_path / "out"), str(tmp_path / "cp"), *args)
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert set(got.columns) == {"c_custkey", "c_name", "c_mktsegment"}
    assert got.count() == src.count() and got.where("c_name LIKE 'CUS\\_%'").count() == src.count()


def test_partition_invariance(spark, sf):
    panel = P.prepared_panel(spark, sf, "part")
    one = N.fleet_means(P.scored(panel.coalesce(1))).orderBy("model").collect()
    many = N.fleet_means(P.scored(panel.repartition(8))).orderBy("model").collect()
    assert [r["model"] for r in one] == [r["model"] for r in many]
    assert np.allclose([[r["mae"], r["cost"]] for r in one], [[r["mae"], r["cost"]] for r in many])


def test_regrouping_needs_no_second_exchange(spark, sf):
    rows = P.scored_from(spark, sf)
    plan = P.model_vectors(rows, ["mae", "cost"], [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_weights_sum_to_population(spark, sf):
    from partcast.operators.ordering import stratified_sample
    p = P.prepared_panel(spark, sf).select("item_id", "site_id", "segment", "abc")
    s = stratified_sample(p, ["segment", "abc"], ["item_id", "site_id"], 300)
    w = PN.design_weights(p, s, ["segment", "abc"])
    assert s.join(w, ["segment", "abc"]).agg(F.sum("weight")).first()[0] == pytest.approx(p.count())


def test_fill_matching_reaches_target(spark, sf):
    from partcast.catalog.costing import quantile_rows
    for r in K.fill_matched(quantile_rows(spark, sf), 4).collect():
        assert r["capped"] or (r["fill"] >= r["target"] and r["fill"] - r["target"] < 1e-3)


def test_history_features_equal_window_features(spark, sf):
    s = X.demand_series(spark, sf, "part").limit(25)
    long = with_recency(with_rolling(with_lags(long_series(s, ["item_id"]), ["item_id"], LAGS), ["item_id"], ROLLS), ["item_id"])
    win = {(r["item_id"], r["q"]): r for r in long.where("q = 17").collect()}
    arr = extend(s.withColumn("h", F.slice("y", 1, 16)), feature_exprs("h")).collect()
    for r in arr:
        w = win[r["item_id"], 17]
        for k in LAGS:
            assert r[f"x_lag{k}"] == w[f"lag{k}"]
        for n in ROLLS:
            assert r[f"x_mean{n}"] == pytest.approx(w[f"mean{n}"]) and r[f"x_std{n}"] == pytest.approx(w[f"std{n}"])
            assert r[f"x_nz{n}"] == w[f"nz{n}"]
        assert r["x_n"] == w["n_demand"] and r["x_since"] == w["since_last"] and r["x_size"] == pytest.approx(w["mean_size"])


def test_learner_outputs(spark, sf):
    p = P.prepared_panel(spark, sf, "part").select("item_id", "site_id", "y", "price", "lead_days")
    model = TwoHead.fit(p, 16, ["price", "lead_days"], trees=3)
    rows = model.recursive(p, 16, 3).collect()
    assert all(len(r["path"]) == 3 and min(r["path"]) >= 0 and 0 <= r["first_p"] <= 1 for r in rows)
    assert len(rows) == p.count()


def test_level_recovery_picks_the_sign(spark):
    rows = [(2.0, -2.0), (1.0, 3.0), (4.0, -3.5)]
    for sign in (1, -1):
        df = spark.createDataFrame([(m, sign * b) for m, b in rows], "oos_mean double, bias_A double")
        got = sorted(r["level_A"] for r in recover_levels(df, ["A"]).collect())
        assert got == [0.0, 0.5, 4.0]
