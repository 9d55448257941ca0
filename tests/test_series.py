"""Forecasters and replay on hand-made edge series, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from partcast.config import MODELS, CostTerms, Window
from partcast.functions import smoothing as S
from partcast.operators.replay import replay, with_costs

EDGE = {
    "zero": [0.0] * 16,
    "first": [5.0] + [0.0] * 15,
    "last": [0.0] * 15 + [7.0],
    "constant": [3.0] * 16,
    "huge": [0.0, 900.0, 0.0, 1200.0] * 4,
    "mixed": [0, 2, 0, 0, 5, 1, 0, 0, 0, 3, 0, 4, 0, 0, 6, 0],
}


def frame(spark):
    rows = [(k, [float(v) for v in y], 0.15, 0.4) for k, y in EDGE.items()]
    return spark.createDataFrame(rows, "name string, y array<double>, sba_alpha double, ses_alpha double")


def brute(y, a, e, update):
    """Textbook recurrences, one quarter at a time."""
    t = len(y)
    nz = [v for v in y if v > 0]
    level = sum(nz) / len(nz) if nz else 0.0
    gap = period = t / len(nz) if nz else float(t)
    prob = len(nz) / t
    for i in range(1, t + (1 if update else 0)):
        hit = y[i - 1] > 0
        if hit:
            level, period = a * y[i - 1] + (1 - a) * level, a * gap + (1 - a) * period
        prob = a * hit + (1 - a) * prob
        gap = 1.0 if i < t and y[i] > 0 else gap + 1
    return {"SBA": (1 - a / 2) * level / max(period, 1e-12), "CROSTON": level / max(period, 1e-12), "TSB": level * prob}


def blocks_forecast(y, k, e):
    n = len(y) // k
    b = [sum(y[len(y) - n * k + i * k: len(y) - n * k + (i + 1) * k]) for i in range(n)]
    f = b[0]
    for v in b:
        f = e * v + (1 - e) * f
    return f / k


@pytest.mark.parametrize("update", [False, True])
def test_smoothers_match_brute_force(spark, update):
    got = {r["name"]: r for r in S.with_forecasts(frame(spark), equal_info=update).collect()}
    for name, y in EDGE.items():
        want = brute(y, 0.15, 0.4, update)
        adi = 16 / sum(v > 0 for v in y) if any(v > 0 for v in y) else 16.0
        k = int(min(max(np.round(adi), 1), 5))
        want["ADIDA"] = blocks_forecast(y, k, 0.4)
        top = int(min(max(np.round(adi), 2), 5))
        want["IMAPA"] = sum(blocks_forecast(y, j, 0.4) for j in range(1, top + 1)) / top
        want["MA"] = (y[-1] + y[-2]) / 2
        for m, v in want.items():
            assert got[name][f"f_{m}"] == pytest.approx(v, abs=1e-9), (name, m)


def test_moment_means_agree_with_sample_mean(spark):
    for r in S.with_forecasts(frame(spark)).collect():
        mean = sum(r["y"]) / 16
        assert r["f_HURDLE_NB"] == pytest.approx(mean, abs=1e-9)
        if mean > 0:
            assert r["f_ZIP"] == pytest.approx(mean, rel=1e-5)


def test_update_changes_nothing_after_an_empty_quarter(spark):
    base = {r["name"]: r for r in S.with_forecasts(frame(spark)).collect()}
    late = {r["name"]: r for r in S.with_forecasts(frame(spark), equal_info=True).collect()}
    for name, y in EDGE.items():
        if y[-1] == 0:
            assert base[name]["f_SBA"] == pytest.approx(late[name]["f_SBA"])
            assert base[name]["f_CROSTON"] == pytest.approx(late[name]["f_CROSTON"])


def test_fold_equals_unrolled_level(spark):
    df = S.with_forecasts(frame(spark)).withColumn("fold", S.folded_level())
    for r in df.collect():
        assert r["fold"] == pytest.approx(r["w_level"], abs=1e-12)


def arrivals_replay(test, s, up, lead, start):
    due, on, held, short, n, received = {}, start, 0.0, 0.0, 0, 0.0
    for t, d in enumerate(test):
        got = due.pop(t, 0.0)
        received += got
        on += got
        served = min(on, d)
        on -= served
        short += d - served
        pos = on + sum(due.values())
        if pos < s:
            n += 1
            due[t + lead] = due.get(t + lead, 0.0) + max(up - pos, 0.0)
        held += on
    return held, short, n, on, received


def test_replay_matches_arrivals_form_and_balances(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        test = [float(v) for v in rng.integers(0, 30, 8) * (rng.random(8) < 0.6)]
        s = float(rng.integers(0, 40))
        rows.append((i, test, s, s + float(rng.integers(1, 30)), int(rng.integers(1, 12)), float(rng.integers(0, 50)), 10.0))
    df = spark.createDataFrame(rows, "i int, test array<double>, rp double, up_to double, lead_q bigint, opening double, price double")
    got = {r["i"]: r for r in with_costs(replay(df, 8, start="opening")).collect()}
    for i, test, s, up, lead, start, price in rows:
        held, short, n, end, received = arrivals_replay(test, s, up, lead, start)
        r = got[i]
        assert (r["on_hand_sum"], r["short_units"], r["n_orders"], r["end_on_hand"]) == pytest.approx((held, short, n, end))
        assert start + received == pytest.approx(sum(test) - short + end)
        assert r["fill"] == (1.0 if sum(test) == 0 else pytest.approx(1 - short / sum(test)))


def test_terms_and_window():
    assert CostTerms().crossover_price == 1600.0
    assert Window().horizon == 4
    assert math.ceil(30000 / 19) == 1579 and len(MODELS) == 9
