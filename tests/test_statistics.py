"""Rank statistics, quantiles, bootstrap and ordered operators against brute force."""

import hashlib
import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from partcast.functions import arrays as A
from partcast.functions.guarded import guarded_corr, t_two_sided_p
from partcast.functions.resampling import MODULUS, mix_numpy, poisson_numpy
from partcast.plans.velocity import agreement, coverage
from partcast.sources.fixtures import calendar_audit, demand_series
from partcast.operators import bootstrap as B, ordering as O
from partcast.operators import quantiles
from partcast.operators.quantiles import exact_quantiles, quantile_columns
from partcast.plans.distribution import count_quantiles


def tau_b(x, y):
    s = nx = ny = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        s, nx, ny = s + a * b, nx + abs(a), ny + abs(b)
    return None if nx * ny == 0 else s / math.sqrt(nx * ny)


def test_tau_and_spearman(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.integers(0, 5, 9)], [float(v) for v in rng.integers(0, 5, 9)]) for i in range(60)]
    rows += [(60, [1.0] * 9, [float(v) for v in range(9)]), (61, [1.0, 2.0], [2.0, 1.0])]
    df = spark.createDataFrame(rows, "i int, x array<double>, y array<double>")
    df = df.select("i", "x", "y", A.kendall_tau_b(F.col("x"), F.col("y")).alias("tau"), A.spearman(F.col("x"), F.col("y")).alias("rho"))
    for r in df.collect():
        want = tau_b(r["x"], r["y"]) if len(r["x"]) >= 3 else None
        if want is None:
            assert r["tau"] is None
        else:
            assert r["tau"] == pytest.approx(want) and -1 <= r["tau"] <= 1
        rx, ry = pd.Series(r["x"]).rank(), pd.Series(r["y"]).rank()
        if rx.std() and ry.std():
            assert r["rho"] == pytest.approx(rx.corr(ry))
        else:
            assert r["rho"] is None


def test_unrolled_statistics_equal_array_forms(spark):
    rng = np.random.default_rng(8)
    rows = [tuple(float(v) for v in rng.integers(0, 4, 10)) for _ in range(80)] + [tuple([1.0] * 5 + [2.0, 3.0, 1.0, 0.0, 2.0])]
    xs, ys = [f"x{i}" for i in range(5)], [f"y{i}" for i in range(5)]
    df = spark.createDataFrame(rows, [*xs, *ys])
    ranks = A.rank_columns("p", xs) | A.rank_columns("q", ys)
    df = df.selectExpr("*", *[f"{e} AS {n}" for n, e in ranks.items()])
    df = df.selectExpr("*", f"{A.tau_text(xs, ys)} AS tau", f"{A.spearman_text([f'p{i}' for i in range(5)], [f'q{i}' for i in range(5)])} AS rho")
    df = df.withColumns({"xa": F.array(*xs), "ya": F.array(*ys)})
    for r in df.select("tau", "rho", A.kendall_tau_b(F.col("xa"), F.col("ya")).alias("t2"), A.spearman(F.col("xa"), F.col("ya")).alias("r2")).collect():
        for a, b in ((r["tau"], r["t2"]), (r["rho"], r["r2"])):
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b))


def test_t_tail(spark):
    # published two-sided 5 % points of Student's t
    points = [(1, 12.706), (2, 4.303), (3, 3.182), (7, 2.365), (8, 2.306), (9, 2.262), (30, 2.042)]
    df = spark.createDataFrame(points, "df int, t double").select("df", t_two_sided_p(F.col("t"), F.col("df")).alias("p"))
    for r in df.collect():
        assert r["p"] == pytest.approx(0.05, abs=2e-4)


def test_guarded_corr_is_null_for_a_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(guarded_corr(F.col("x"), F.col("y"))).first()[0] is None


@pytest.mark.parametrize("parts", [1 << 20, 3])
def test_exact_quantiles_of_hot_close_and_extreme_values(spark, parts, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros(3000), rng.lognormal(0, 3, 3000), rng.normal(-5, 1e-3, 3000), 1 + np.arange(3000) * 2.0 ** -52,
                        -np.logspace(-300, 300, 500), [5e-324, -5e-324, 1.7e308, -1.7e308]])
    pdf = pd.DataFrame({"g": np.where(np.arange(len(x)) % 3 == 0, "a", "b"), "v": x})
    df = spark.createDataFrame(pdf).repartition(7)
    probs = [0.0, 0.025, 0.5, 0.77, 0.99, 1.0]
    monkeypatch.setattr(quantiles, "_EVEN", quantiles._EVEN.replace(str(1 << 20), str(parts)).replace(str((1 << 20) - 1), str(parts - 1)))
    got = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in "ab":
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(pdf.v[pdf.g == g], p), rel=1e-12, abs=1e-300)


def t_tail(t, df):
    """Twice the integral of the density beyond |t|, by Simpson's rule over u = 1 / x; math.lgamma only."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) if df < 1e5 else 1 / math.sqrt(2 * math.pi) * (1 - 1 / (4 * df))
    u = np.linspace(0, 1, 400_001)[1:] / abs(t)
    f = np.append(0 if df > 1.0 else c * df ** ((df + 1) / 2) if df == 1.0 else np.nan, c * np.exp(-(df + 1) / 2 * np.log1p(1 / (u * u * df))) / (u * u))
    h = 1 / abs(t) / 400_000
    return 2 * h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())


def test_t_tail_for_any_degrees_of_freedom(spark):
    points = [(df, t) for df in (1.0, 2.0, 2.5, 7.0, 30.25, 150.0, 199.5, 200.0, 200.5, 1e3, 12345.6, 1e6, 1e9) for t in (0.1, -0.9, 1.5, 1.96, 2.4, -3.0, 5.0, 8.0)]
    df = spark.createDataFrame(points, "df double, t double").select("df", "t", t_two_sided_p(F.col("t"), F.col("df")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(t_tail(r.t, r.df), rel=2e-7), r
    odd = spark.createDataFrame([(3.0, 0.0), (0.0, 1.0), (None, 1.0), (5.0, None)], "df double, t double")
    assert [r[0] for r in odd.select(t_two_sided_p(F.col("t"), F.col("df"))).collect()] == [1.0, None, None, None]


def test_exact_quantiles_of_groups_without_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", None), ("a", nan), ("b", 1.0), ("b", None), (None, 2.0), (None, 4.0), ("c", inf), ("c", -inf), ("c", 0.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {("a", 0.0): None, ("a", 0.5): None, ("a", 1.0): None, ("b", 0.0): 1.0, ("b", 0.5): 1.0, ("b", 1.0): 1.0,
                   (None, 0.0): 2.0, (None, 0.5): 3.0, (None, 1.0): 4.0, ("c", 0.0): -inf, ("c", 0.5): 0.0, ("c", 1.0): inf}
    wide = quantile_columns(df, [], "v", {"lo": 0.25, "mid": 0.5}).collect()
    assert [tuple(r) for r in wide] == [(0.25, 1.5)]
    assert exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_exact_quantiles_read_their_input_once(spark, tmp_path):
    spark.range(1000).selectExpr("id % 3 AS g", "id * 1.5D AS v").write.parquet(str(tmp_path / "t"))
    out = exact_quantiles(spark.read.parquet(str(tmp_path / "t")), ["g"], "v", [0.25, 0.5])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.split("\n") if re.search(r"\bExchange (hash|range|single)", x) and "ReusedExchange" not in x]
    assert plan.count("Scan parquet") == 1 and len(dealt) <= 8


def test_running_share_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"part_id": np.arange(n), "ship_id": np.where(rng.random(n) < 0.7, 1, rng.integers(2, 9, n)),
                        "n": rng.choice([1, 1, 1, 2, 5, 40], n)})
    got = O.running_share(spark.createDataFrame(pdf).repartition(5), "ship_id", "n", "part_id").toPandas()
    assert len(got) == n
    got = got.sort_values(["ship_id", "running"])
    for _, g in got.groupby("ship_id"):
        assert (g.n.diff().dropna() <= 0).all()
        assert (g.running.to_numpy() == g.n.cumsum().to_numpy()).all()
        assert g.group_total.iloc[0] == g.n.sum()


def test_stratified_sample_allocation_and_invariance(spark):
    pdf = pd.DataFrame({"k": np.arange(5000), "s": ["a"] * 4000 + ["b"] * 990 + ["c"] * 10})
    df = spark.createDataFrame(pdf)
    one = O.stratified_sample(df.coalesce(1), ["s"], ["k"], 300).toPandas()
    many = O.stratified_sample(df.repartition(8), ["s"], ["k"], 300).toPandas()
    assert one.s.value_counts().to_dict() == {"a": 100, "b": 100, "c": 10}
    assert set(one.k) == set(many.k)


def test_stratified_sample_reads_its_rows_twice(spark):
    df = spark.range(5000).selectExpr("id AS k", "if(id < 4000, 'a', if(id < 4990, 'b', NULL)) AS s")
    out = O.stratified_sample(df, ["s"], ["k"], 300)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") <= 2
    rows = O.stratified_sample(df, ["s"], ["k"], 300, sizes=True).collect()
    assert {(r.s, r.pop_n, r.sample_n) for r in rows} == {("a", 4000, 100), ("b", 990, 100), (None, 10, 10)} and len(rows) == 210
    first = sorted(range(4000), key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())[:100]
    assert {r.k for r in rows if r.s == "a"} == set(first) and {r.k for r in rows} == {r.k for r in out.collect()}


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), (None,), ("ab",), ("a",), ("b",), ("zz",)], "c string")
    got = {r["value"]: r["code"] for r in O.label_codes(df, "c").collect()}
    assert got == {v: i for i, v in enumerate(sorted(["__NA__", "b", "ab", "a", "zz"]))}


def test_label_codes_of_long_common_beginnings(spark):
    rng = np.random.default_rng(8)
    names = [f"https://parts.example/{'x' * 40}/{int(i):06d}" for i in rng.integers(0, 10 ** 6, 3000)] + ["", "h", "https", "zz", "é", "\U0001F600"]
    got = {r["value"]: r["code"] for r in O.label_codes(spark.createDataFrame([(n,) for n in names], "c string").repartition(4), "c").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(names), key=lambda v: v.encode()))}
    values = spark.createDataFrame([(n,) for n in sorted(set(names))], "value string")
    sizes = [r["count"] for r in O.with_prefix(values).groupBy("_p").count().collect()]
    assert max(sizes) <= 2 * len(set(names)) ** 0.5


def test_buckets_split_a_hot_group_evenly(spark):
    df = spark.range(40_000).selectExpr("id", "if(id % 2 = 0, 0, id % 97) AS g").withColumn("_h", O.key_hash("id"))
    sizes = O.with_buckets(df, ["g"]).groupBy("g", "_b").count().toPandas()
    hot = sizes[sizes.g == 0]["count"]
    assert len(hot) <= 146 and hot.max() <= 2 * hot.median()
    order = O.with_buckets(df, ["g"]).where("g = 0").orderBy("_h").toPandas()
    assert order._b.is_monotonic_increasing


def test_mode_and_dedupe(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, "a"), (1, None), (2, None)], "k int, v string")
    assert [tuple(r) for r in O.mode_of(df, ["k"], ["v"]).collect()] == [(1, "a")]
    d = O.dedupe(df.where("v IS NOT NULL"), ["k"], [F.col("v").alias("_o")]).collect()
    assert [tuple(r) for r in d] == [(1, "a")]


def test_weights_are_poisson_and_independent():
    keys = np.arange(20000, dtype=np.int64) * 1000003 + 7
    w = poisson_numpy(mix_numpy(keys, np.arange(50), 42))
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    c = np.corrcoef(w.T)
    np.fill_diagonal(c, 0)
    assert abs(c).max() < 0.05
    assert not (poisson_numpy(mix_numpy(keys, np.arange(5), 1)) == w[:, :5]).all()


def test_distant_units_have_their_own_weights():
    keys = np.array([5, 5 + MODULUS, 5 + 2 * MODULUS, 5 + 10 ** 9 * MODULUS, 6], dtype=np.int64)
    w = poisson_numpy(mix_numpy(keys, np.arange(200), 42))
    assert len({tuple(x) for x in w}) == len(keys)
    assert abs(np.corrcoef(w) - np.eye(len(keys))).max() < 0.3


def test_legacy_class_of_repeated_master_rows(spark):
    classes = spark.createDataFrame([(1, 1, "A"), (2, 1, "C")], "part_id int, ship_id int, velocity string")
    master = spark.createDataFrame(
        [(1, 1, "A"), (1, 1, "A"), (1, 1, "B"), (1, 1, None), (2, 1, None)], "part_id int, ship_id int, legacy_velocity string")
    assert [tuple(r) for r in agreement(classes, master).collect()] == [(2, 1, 1.0, 1)]
    assert sorted(tuple(r) for r in coverage(classes, master).collect()) == [("(none)", 0, 0, 1, 0), ("A", 1, 0, 0, 0)]


def test_rows_outside_the_calendar(spark, tmp_path):
    rows = [(1, 1, 10.0, 100.0, "1995-01-01"), (1, 1, 7.0, 700.0, "1994-12-31"), (1, 1, 9.0, 900.0, "2002-01-01"), (2, 1, 5.0, 50.0, None)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, d string").selectExpr(
        "*", "CAST(d AS DATE) AS l_shipdate").drop("d").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = demand_series(spark, str(tmp_path)).selectExpr("item_id", "y[0]", "aggregate(y, 0D, (a, b) -> a + b)", "price0").collect()
    assert [tuple(r) for r in got] == [(1, 10.0, 10.0, 10.0)]
    assert {tuple(r) for r in calendar_audit(spark, str(tmp_path)).collect()} == {
        ("inside", 1, 10), ("before", 1, 7), ("after", 1, 9), ("undated", 1, 5)}


def test_bootstrap_engines_agree_and_ignore_layout(spark):
    pdf = pd.DataFrame({"item_id": np.arange(700), "site_id": np.arange(700) % 13, "g": np.arange(700) % 2, "x": np.arange(700) * 0.5})
    df = spark.createDataFrame(pdf)
    def run(d, engine, point=False):
        return B.replicate_sums(d, ["x"], 30, ["g"], engine=engine, point=point).toPandas().sort_values(["g", "b"]).reset_index(drop=True)
    a, b, c = run(df.coalesce(1), "numpy", True), run(df.repartition(6), "numpy", True), run(df.repartition(3), "sql", True)
    for other in (b, c):
        assert np.allclose(a[["g", "b", "w", "x"]], other[["g", "b", "w", "x"]])
    plain = a[a.b == -1]
    assert plain.w.tolist() == [350, 350] and plain.x.sum() == pytest.approx(pdf.x.sum())


def test_mean_interval_covers_normal_theory(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(10, 2, 4000)
    df = spark.createDataFrame(pd.DataFrame({"item_id": np.arange(4000), "site_id": 0, "x": x}))
    r = B.mean_interval(df, "x", 800).first()
    half = 1.96 * x.std() / math.sqrt(len(x))
    assert r["mean"] == pytest.approx(x.mean()) and r["n"] == 4000
    assert r["hi"] - r["lo"] == pytest.approx(2 * half, rel=0.12)


def poisson_q(mu, q):
    k, p = 0, math.exp(-mu)
    c = p
    while c < q:
        k += 1
        p *= mu / k
        c += p
    return k


def test_count_quantiles(spark):
    mus = [0.05, 0.7, 3.0, 25.0, 400.0]
    df = spark.createDataFrame([(m,) for m in mus], "mu double")
    got = df.select("mu", count_quantiles(F.lit(1.0), F.col("mu"), F.lit(0.0)).alias("q")).collect()
    for r in got:
        assert r["q"] == [poisson_q(r["mu"], a) for a in (0.5, 0.8, 0.9, 0.95, 0.99)]
    # far beyond exp underflow, and a nearly Poisson negative binomial
    big = spark.range(1).select(count_quantiles(F.lit(1.0), F.lit(5000.0), F.lit(0.0)).alias("a"),
                                count_quantiles(F.lit(1.0), F.lit(5000.0), F.lit(1e-6)).alias("b")).first()
    assert big["a"][0] == pytest.approx(5000, abs=2) and big["a"][4] == pytest.approx(5000 + 2.3263 * math.sqrt(5000), abs=3)
    assert big["b"] == pytest.approx(big["a"], abs=1)
    zero = spark.range(1).select(count_quantiles(F.lit(0.04), F.lit(9.0), F.lit(0.5)).alias("q")).first()["q"]
    assert zero[:4] == [0, 0, 0, 0] and zero[4] > 0


def test_t_tail_for_many_degrees_of_freedom(spark):
    import math

    import numpy as np

    from partcast.functions.guarded import t_two_sided_p
    df = spark.createDataFrame([(2.0, 83), (2.0, 100), (2.0, 200), (2.0, 5000), (2.0, 1), (2.0, 2)], "t double, df int")
    got = [round(r[0], 4) for r in df.select(t_two_sided_p(df["t"], df["df"])).collect()]
    x = np.linspace(0, 2, 200_001)
    for (_, n), p in zip([(r.t, r.df) for r in df.collect()], got):
        density = np.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + x * x / n) ** (-(n + 1) / 2)
        assert abs(1 - 2 * np.trapezoid(density, x) - p) < 1e-4


def test_rank_statistics_leave_out_missing_models(spark):
    from partcast.functions import arrays as A
    xs, ys = [f"x{i}" for i in range(9)], [f"y{i}" for i in range(9)]
    none = [None] * 5
    rows = [tuple([1.0, 2.0, 3.0, 4.0, *none, 4.0, 3.0, 2.0, 1.0, *none]), tuple([1.0, 2.0, *none, None, None, 2.0, 1.0, *none, None, None])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in xs + ys))
    ranks = {**A.rank_columns("rx", xs), **A.rank_columns("ry", ys)}
    df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in ranks.items()])
    got = df.selectExpr(A.spearman_text([f"rx{i}" for i in range(9)], [f"ry{i}" for i in range(9)]), A.tau_text(xs, ys)).collect()
    assert [tuple(r) for r in got] == [(-1.0, -1.0), (None, None)]
