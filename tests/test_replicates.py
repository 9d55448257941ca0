"""Replicate matrices against plain loops, and many quick replicates against few portable ones."""

import numpy as np
import pytest

from partcast.catalog import load
from partcast.functions.resampling import MODULUS, mix_numpy, poisson_numpy
from partcast.operators import replicates as R

QUERIES = dict(load().queries)


def test_quick_weights_are_poisson_and_pure():
    units = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, (20_000, 2))
    w = R.quick_weights(units, 0, 64, 42)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    c = np.corrcoef(w.T)
    np.fill_diagonal(c, 0)
    assert abs(c).max() < 0.04
    assert np.bincount(w.astype(int).ravel())[:3] / w.size == pytest.approx([0.3679, 0.3679, 0.1839], abs=2e-3)
    assert (R.quick_weights(units[5:9], 13, 30, 42) == w[5:9, 13:30]).all() and not (R.quick_weights(units, 0, 64, 43) == w).all()
    near = np.array([[i, j] for i in range(60) for j in range(60)])
    assert len(np.unique(R.quick_weights(near, 0, 64, 42), axis=0)) == len(near)


def test_quick_weights_are_mixed_a_piece_at_a_time():
    """As one 64-bit word after the other gives them, in little more memory than they take themselves."""
    import tracemalloc
    rng = np.random.default_rng(5)
    units = rng.integers(-(1 << 62), 1 << 62, (6_000, 2))
    tracemalloc.start()
    w = R.quick_weights(units, 6, 506, 11)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert w.dtype == np.float64 and used < w.nbytes + (6 << 20)
    last = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & last
        x = (x ^ x >> 27) * 0x94D049BB133111EB & last
        return x ^ x >> 31
    cuts = np.rint(np.cumsum([np.exp(-1) / np.prod(np.arange(1.0, k + 1)) for k in range(12)]) * 65536)
    for i in (0, 1, 2_999, 5_999):
        a, b = (int(x) & last for x in units[i])
        unit = mixed((mixed((a + 11 * 0x9E3779B97F4A7C15) & last) + b * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & last)
        for r in (6, 7, 8, 255, 505):
            word = mixed((unit + (r // 4 + 1) * 0x9E3779B97F4A7C15) & last)
            assert w[i, r - 6] == (cuts <= (word >> 16 * (r % 4) & 0xFFFF)).sum()
    assert R.quick_weights(units[:0], 0, 10, 1).shape == (0, 10)


def test_series_of_one_group_lie_side_by_side():
    """Their weights are a slice, not a copy; rows of one series in several cells still share theirs."""
    import pyarrow as pa

    def batch(u, arm, cell):
        x = pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * 2, np.arange(2.0 * len(u)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array([0] * len(u)), pa.array(arm, pa.int32()), pa.array(cell, pa.int32()), x],
                                          names=["u0", "u1", "arm", "cell", "x"])
    units, groups = next(R.by_row([batch([5, 6, 7, 8], [0] * 4, [1, 0, 1, 0])]))
    assert units[:, 0].tolist() == [6, 8, 5, 7] and [g.own for g in groups] == [slice(0, 2), slice(2, 4)]
    assert groups[1].x.tolist() == [[0, 4], [1, 5]] and [g.into[0][:2] for g in groups] == [(0, 0), (0, 1)]
    units, groups = next(R.by_row([batch([5, 5, 7], [0, 0, 0], [0, 1, 1])]))
    assert units[:, 0].tolist() == [5, 7] and [g.own.tolist() for g in groups] == [[0], [0, 1]]


def test_portable_weights_are_those_of_the_key():
    units = np.array([[0, 5], [7, 0], [123_456, 99], [40, MODULUS - 1]])
    keys = units[:, 0] * MODULUS + units[:, 1]
    want = poisson_numpy(mix_numpy(keys, np.arange(3, 20), 9))
    assert (R.portable_weights(units, 3, 20, 9) == want).all()
    far = np.array([[1 << 40, 5], [(1 << 40) + MODULUS, 5], [(1 << 40), 5 + MODULUS]])
    assert len(np.unique(R.portable_weights(far, 0, 50, 9), axis=0)) == 3


@pytest.mark.parametrize("draw", [R.quick_weights, R.portable_weights])
def test_matrices_are_plain_sums(spark, draw):
    rng = np.random.default_rng(2)
    rows = [(int(i % 50), int(i // 50), int(rng.integers(0, 4)), float(rng.normal()), None if i % 13 == 0 else float(rng.normal()))
            for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c int, x double, y double")
    arms = {"one": R.Arm("c", ("x",)), "two": R.Arm("if(c = 3, NULL, 0)", ("x", "y"), "1.0D + c")}
    views = {"all": (0, 4), "low": (0, 2), "high": (2, 4), "mid": (1, 3), "ends": [0, 3], "none": (7, 9)}
    seen = {}
    for parts in (1, 7):
        sums = R.matrices(R.arm_rows(df.repartition(parts), ["a", "b"], arms), 37, 3, 10, draw)
        got = R.statistics(sums, list(arms), views, lambda v: v, 37, 10).collect()
        seen[parts] = {(r.arm, r.name, r.b): r["values"] for r in got}
    assert seen[1].keys() == seen[7].keys()
    units = np.array([r[:2] for r in rows])
    w = np.column_stack([draw(units, 0, 37, 3), np.ones(len(rows))])
    c, x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([np.nan if r[4] is None else r[4] for r in rows])
    inside = {"all": c >= 0, "low": c < 2, "high": c >= 2, "mid": (c == 1) | (c == 2), "ends": (c == 0) | (c == 3)}
    want = {}
    for b in [*range(37), -1]:
        for name, some in inside.items():
            want["one", name, b] = [w[some, b].sum(), (w[some, b] * x[some]).sum()]
        ok = ~np.isnan(y) & (c != 3)
        for name in ("all", "low", "ends"):
            v = w[ok, b] * (1 + c[ok])
            want["two", name, b] = [v.sum(), (v * x[ok]).sum(), (v * y[ok]).sum()]
    assert seen[1].keys() == want.keys()
    for k, v in want.items():
        assert seen[1][k] == pytest.approx(v) and seen[7][k] == pytest.approx(v)
    assert R.matrices(R.arm_rows(df.limit(0), ["a", "b"], arms), 37).count() == 0


def test_rank_correlation_has_ties_and_gaps():
    x = np.array([[1.0, 2.0, 1.0], [2.0, 2.0, np.nan], [3.0, 2.0, 2.0], [3.0, 2.0, 1.0]])
    y = np.array([[1.0, 1.0, 1.0], [3.0, 2.0, 2.0], [2.0, 3.0, 3.0], [4.0, 4.0, 4.0]])
    got = R.rank_correlation(x, y)
    rx, ry = np.array([1, 2, 3.5, 3.5]), np.array([1, 3, 2, 4])
    assert got[0] == pytest.approx(np.corrcoef(rx, ry)[0, 1]) and np.isnan(got[1:]).all()


@pytest.mark.parametrize("many, few, keys", [
    ("bootstrap_model_cost_20000", "bootstrap_model_cost", ["model"]),
    ("bootstrap_regime_rho_20000", "bootstrap_regime_rho", ["grp"]),
    ("bootstrap_deployed_gap_20000", "bootstrap_deployed_gap", []),
    ("pinball_common_set_10000", "pinball_common_set", ["metric"]),
    ("weighted_deployed_gap_2000", "weighted_deployed_gap", ["arm"]),
])
def test_many_replicates_agree_with_few(spark, sf, many, few, keys):
    a = QUERIES[many](spark, sf).toPandas().set_index(keys or ["replicates"])
    b = QUERIES[few](spark, sf).toPandas().set_index(keys or ["replicates"])
    if not keys:
        a.index, b.index = [0], [0]
    assert set(a.index) == set(b.index)
    for k in a.index:
        lo, hi = b.lo[k], b.hi[k]
        wide = max(hi - lo, 1e-9)
        assert abs(a.lo[k] - lo) <= 0.25 * wide + 1e-6 and abs(a.hi[k] - hi) <= 0.25 * wide + 1e-6


def test_cells_and_seeds(spark, sf):
    cells = QUERIES["cell_tau_interval_1000"](spark, sf).toPandas().set_index("cell")
    few = QUERIES["cell_tau_interval"](spark, sf).toPandas()
    assert set(cells.index) == {"all"} | {f"{s}|{a}" for s, a in zip(few.segment, few.abc)}
    assert all(cells.point[f"{x.segment}|{x.abc}"] == pytest.approx(x["mean"], abs=1e-6) for _, x in few.iterrows())
    sweep = QUERIES["bootstrap_seed_sweep_20000"](spark, sf).toPandas()
    assert len(sweep) == 30 and (sweep.groupby("grp").point.nunique() == 1).all()
    spread = sweep.groupby(["b", "grp"]).lo.agg(lambda v: v.max() - v.min()).unstack(0)
    assert spread[20_000].max() <= spread[2_000].max() + 1e-9
