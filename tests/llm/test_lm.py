"""Language-model scores against counts in dictionaries, and the trie against plain search."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from partcast.llm import elias_fano as ef
from partcast.llm import lm
from partcast.llm import queries as q
from partcast.llm.scratch import Scratch
from tests.llm.conftest import ROWS

SPACED = r"[^\x20\x09-\x0D]+"


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(SPACED, text or "")] + [None]


def brute(rows, weights):
    """{(id, size, known, tokens): [(base, score)]} from counts of all n-grams."""
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    grams, contexts = Counter(), Counter()

    def places(text):
        t = [""] * (weights.order - 1) + tokens(text)
        for at in range(weights.order - 1, len(t)):
            yield [tuple(t[at - k: at + 1]) for k in range(weights.order)]

    for i, text in rows:
        if not held[i]:
            for some in places(text):
                grams.update(some)
                contexts.update(g[:-1] for g in some[1:])
    n = sum(c for g, c in grams.items() if len(g) == 1)
    v = sum(len(g) == 1 for g in grams)
    out = []
    for i, text in rows:
        base = score = known = 0
        for one, *more in places(text):
            c = grams[one]
            known += c > 0
            p0 = (c + 1) / (n + v + 1)
            up = down = weights.prior
            up *= p0
            for a, g in zip(weights.of_order, more):
                seen = grams[g] if len(g) < weights.order or grams[g] >= weights.least else 0
                up, down = up + a * seen, down + a * contexts[g[:-1]]
            base, score = base + log10(p0), score + log10(up / down)
        out.append((i, held[i], len(tokens(text)), known, n, base, score))
    return out


def same(got, want, rel):
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    by = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    for a, b in zip(sorted(got, key=by), sorted(want, key=by), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=rel, abs=0.02 + 0.01 * a[2])


@pytest.mark.parametrize("weights", [lm.Weights(2, (3.0,), 2.0, 1), lm.Weights(3, (2.0, 5.0), 1.5, 2), lm.Weights(4, (1.0, 2.0, 3.0), 1.0, 1)])
@pytest.mark.parametrize("chunk, shard", [(lm.CHUNK, lm.SHARD), (700, 2_000)])
def test_scores_match_counts(spark, weights, chunk, shard):
    rng = np.random.default_rng(5)
    common = "the same passage stands in many texts and in a few of them twice".split()
    rows = [(i, " ".join(["a"] * int(rng.integers(0, 9)) + common[: int(rng.integers(0, 13))] +
                         [f"W{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 30))) % 50])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = lm.fit(docs.where(~lm.held_out()), Scratch(spark), weights, chunk, shard)
    assert (model.shards > 1) == (shard == 2_000) == bool(len(model.hot))
    same(lm.annotate(docs, weights=weights, chunk=chunk, shard_tokens=shard).collect(), brute(rows, weights), 4e-3)


def test_hot_shards_have_several_tasks(spark):
    rows = [(i, "x y " * 40 + f"w{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = lm.fit(docs.where(~lm.held_out()), Scratch(spark), lm.Weights(), 300, 100)
    assert model.parts and max(model.parts.values()) > 4
    same(lm.score(docs, model, 300).withColumn("held_out", lm.held_out()).collect(), brute(rows, lm.Weights()), 4e-3)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = q.op11_lm_scores(spark, sf).collect()
    same(got, brute(rows, lm.Weights()), 4e-3)
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark, docs, no_docs):
    rows = [r[:2] for r in ROWS]
    same(lm.annotate(docs).collect(), brute(rows, lm.Weights()), 4e-3)
    assert lm.annotate(no_docs).count() == 0
    unseen = lm.annotate(docs.where(lm.held_out())).collect()
    assert unseen and all(r.train_tokens == r.n_known == 0 == r.base_score and r.score == pytest.approx(0, abs=1e-3) for r in unseen)


def test_elias_fano_is_plain_search():
    rng = np.random.default_rng(6)
    for n, universe in ((0, 10), (1, 1 << 64), (1, 1), (5, 3), (3_000, 1 << 64), (3_000, 5_000), (5_000, 40), (4_000, 1 << 33)):
        top = np.uint64(universe - 1)
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        if n > 2_000 and universe > 1 << 20:
            values[500:2_000] = np.sort(values[500] + rng.integers(0, 1 << 12, 1_500, dtype=np.uint64))  # crowded
            values = np.sort(np.minimum(values, top))
        seq = ef.Sequence({f"x.{k}": a for k, a in ef.encode(values, universe).items()}, "x")
        ask = np.concatenate([values, rng.integers(0, top, 2_000, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64)])
        assert (seq.access(np.arange(n)) == values).all() if n else True
        assert (seq.successor(ask) == np.searchsorted(values, ask)).all()
        there = np.isin(ask, values)
        assert ((seq.find(ask) >= 0) == there).all()


def test_trie_maps_and_finds():
    words, counts = np.array([5, 9, 1 << 63], np.uint64), np.array([3, 1, 2])
    parent, mark = np.array([0, 0, 2]), np.array([1, 2 ** 32 - 1, 1], np.uint32)
    data = ef.build(words, counts, [(parent, mark, {"up": np.array([-1.0, -2.0, -1.0])})])
    trie = ef.Trie(ef.mapped(data))
    node, count = trie.word(np.array([9, 5, 6, 1 << 63], np.uint64))
    assert node.tolist() == [1, 0, -1, 2] and count.tolist() == [1, 3, 0, 2]
    got = trie.child(2, np.array([0, 0, 1, 2, -1, 2]), np.array([2 ** 32 - 1, 3, 1, 1, 1, 0], np.uint32))
    assert got.tolist() == [1, -1, -1, 2, -1, -1] and trie.value("up", 2, np.array([1, 2])).tolist() == [-2.0, -1.0]
    assert (lm._plain(lm._varint(np.array([0, 127, 128, 1 << 40, 5]))) == [0, 127, 128, 1 << 40, 5]).all()
