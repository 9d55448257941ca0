"""Whitening and ranked search against brute force, and on odd rows."""

import re
from collections import Counter
from math import floor, inf, log, nan

import numpy as np
import pytest
from pyspark.sql import functions as F

from partcast.llm import queries as q
from partcast.llm import ranked, whitening
from tests.llm.conftest import ROWS


def brute_whitening(rows, scale=256):
    """Integers without limits, covariances by the definition."""
    x = {i: [floor(scale * float(c)) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    y = np.array([[n * v[k] - s[k] for k in range(d)] for v in fit], object)
    cov = (y.T @ y).astype(float) / float(n) ** 3
    values, vectors = np.linalg.eigh(cov)
    deviation = {i: sum((n * a - b) ** 2 for a, b in zip(v, s)) for i, v in x.items()}
    return n, s, x, values[::-1], vectors[:, ::-1], np.trace(cov), deviation


def check_whitening(got, rows, components=4):
    n, s, x, values, vectors, trace, deviation = brute_whitening(rows)
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, k) for i, _ in rows for k in range(1, components + 1))
    for k in range(1, components + 1):
        mine = [r for r in got if r.component == k]
        want = np.array([(np.array([float(a) - b / n for a, b in zip(x[r.vec_id], s)]) @ vectors[:, k - 1]) / values[k - 1] ** 0.5 for r in mine])
        have = np.array([r.whitened for r in mine])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
        assert all(r.explained == pytest.approx(values[k - 1] / trace, rel=1e-9) for r in mine)
    assert all(r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-7 for r in got)


def test_whitening_matches_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(q.op12_whitening(spark, sf).collect(), rows)


def test_whitening_limbs_are_exact():
    rng = np.random.default_rng(3)
    for bits in (10, 29, 31, 45, 60):
        z = rng.integers(-(1 << bits), 1 << bits, (500, 3))
        assert list(whitening._sum_of_squares(z)) == [sum(int(v) ** 2 for v in z[:, k]) for k in range(3)]


def test_whitening_odd_rows(spark):
    schema = "vec_id long, x string, n int, embedding array<double>, i int"
    rng = np.random.default_rng(4)
    good = [(k, [float(c) for c in rng.normal(size=5) * 10.0 ** (k % 3)]) for k in range(40)]
    good += [(100, good[3][1]), (101, [-0.0, 0.0, -1e-9, 1 / 256, 1e3]), (102, [0.0] * 5)]
    bad = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [nan] * 5), (204, [1.0, inf, 1.0, 1.0, 1.0]),
           (205, [1.0, -inf, 1.0, 1.0, 1.0]), (206, [1.0, 2.0]), (207, [1e300, 1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, "a", 1, v, 2) for i, v in good + bad], schema).repartition(3)
    check_whitening(whitening.whiten(df).collect(), good)
    twice = whitening.whiten(df.unionAll(df).withColumn("vec_id", F.when(F.col("vec_id") > 0, F.col("vec_id")))).collect()
    assert len(twice) == 2 * 4 * len(good) and sum(r.vec_id is None for r in twice) == 8
    assert {r.n for r in twice} == {len({tuple(np.floor(256 * np.array(v)) + 0.0) for _, v in good})}
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 200 and vec_id < 206")).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, "", 1, [1.0, 2.0], 1)] * 3, schema)).collect()
    assert len(flat) == 6 and {(r.n, r.deviation, r.whitened, r.explained) for r in flat} == {(1, 0, None, None)}
    line = whitening.whiten(spark.createDataFrame([(k, "", 1, [float(k), 2.0 * k], 1) for k in range(9)], schema)).collect()
    assert [r.whitened is None for r in sorted(line, key=lambda r: r.component)] == [False] * 9 + [True] * 9
    huge = [(k, [float(v) for v in rng.integers(-(1 << 44), 1 << 44, 3)]) for k in range(30)]
    got = whitening.whiten(spark.createDataFrame([(i, "", 1, v, 1) for i, v in huge], schema)).collect()
    assert {r.deviation for r in got} == {None} and all(r.identity_error < 1e-6 for r in got)


MARKED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def brute_search(docs, items, top=10):
    def terms(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(MARKED, text or "")]
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n) // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return Counter(out)


def test_ranked_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert Counter(map(tuple, q.op13_ranked(spark, sf).collect())) == brute_search(docs, items)


def test_ranked_odd_rows(spark, docs, no_docs):
    items = [(1, "W1 w2, w2! W3"), (1, "w1 w2 w2 w3"), (2, None), (3, ""), (4, "nowhere"), (None, "one É é ß"), (5, "w150 w151 more")]
    b = spark.createDataFrame([(i, t, 7, "x") for i, t in items], "item_id long, text string, score int, rank string").repartition(2)
    want = brute_search([(r[0], r[1]) for r in ROWS], items, top=3)
    for limit in (ranked.BLOCK_TERMS, 3):
        assert Counter(map(tuple, ranked.search(docs, b, top=3, block_terms=limit).collect())) == want
    assert sum(want.values()) > 8
    assert ranked.search(no_docs, b).count() == 0 and ranked.search(docs, b.limit(0)).count() == 0


def test_ranked_ties_and_slices(spark, monkeypatch):
    texts = [(i % 40, "a b c" if i % 3 else "a b") for i in range(200)] + [(None, "a b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    items = [(k, "a b c " * (k + 1)) for k in range(30)]
    monkeypatch.setattr(ranked, "_CELLS", 64)
    got = ranked.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, got.collect())) == brute_search(texts, items)
