"""Operators on pages, embeddings and conversations against brute force and round trips."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from partcast.llm import chat, lattice, warc
from partcast.llm import queries as q
from partcast.llm.scratch import Scratch


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    least = {}
    for r in pages:
        least[r.html] = min(r.page_id, least.get(r.html, r.page_id))
    want = Counter((r.page_id, len(r.html.encode()), sha(r.html), "response" if least[r.html] == r.page_id else "revisit",
                    None if least[r.html] == r.page_id else least[r.html]) for r in pages)
    assert Counter(map(tuple, q.op4_warc(spark, sf).collect())) == want


def test_warc_odd_rows_frames_and_lookup(spark):
    rows = [(1, "u", "same " * 500), (2, None, "same " * 500), (2, None, "same " * 500), (3, "u x", None), (4, "u", ""),
            (5, "", "ß\r\n\r\nWARC/1.1"), (None, "u", "same " * 500), (6, "u", "long " * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).withColumn("first", F.lit(0))
    scratch = Scratch(spark)
    bundles = warc.write(pages, scratch, frame_bytes=1000, bundle_bytes=3000)
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(bundles).collect())
    assert got == Counter({(1, 2500, "response", None): 1, (2, 2500, "revisit", 1): 2, (3, 0, "response", None): 1,
                           (4, 0, "revisit", 3): 1, (5, 14, "response", None): 1, (None, 2500, "revisit", 1): 1,
                           (6, 2_000_000, "response", None): 1})
    names = bundles.select(F.explode("index.record_id").alias("record_id"))
    assert {r.record[:8] for r in warc.lookup(bundles, names).collect()} == {b"WARC/1.1"}
    assert warc.lookup(bundles, names).count() == len(rows)
    for r in bundles.collect():  # a reader that knows nothing of the seek table reads it all
        with zstandard.ZstdDecompressor().stream_reader(bytes(r.data), read_across_frames=True) as f:
            assert f.read().count(b"X-Page-ID") == r.records
    big = warc.write(pages, scratch, min_bytes=1)
    assert warc.read(big).where("page_id = 4").first().record_type == "response"
    assert warc.read(warc.write(pages.limit(0), scratch)).count() == 0


def brute_vectors(rows, cosine=0.95):
    ids = [i for i, _ in rows]
    unit = np.array([np.asarray(v, float) / np.linalg.norm(v) for _, v in rows])
    hit = unit @ unit.T >= cosine
    np.fill_diagonal(hit, False)
    root = np.arange(len(ids))
    for _ in ids:
        root = np.array([min(root[k], *root[np.flatnonzero(hit[k])]) if hit[k].any() else root[k] for k in range(len(ids))])
    return {i: (int(hit[k].sum()), min(ids[j] for j in range(len(ids)) if root[j] == root[k])) for k, i in enumerate(ids)}


def test_lattice_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in q.op6_lattice(spark, sf).collect()}
    assert got == want


def test_lattice_recall_at_the_threshold(spark):
    """Pairs whose cosine is just enough, and groups larger than a block."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.standard_normal((150, 64))
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    near = 0.952 * base + np.sqrt(1 - 0.952**2) * off
    many = base[0] + 0.02 * rng.standard_normal((90, 64))
    rows = [(i, v.tolist()) for i, v in enumerate([*base, *near, *many])]
    want = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in lattice.near_copies(df, block=32).collect()}
    assert all(got[i] <= want[i][0] for i in got)
    assert sum(got[i] for i in range(1, 300) if i != 150) >= 0.9 * sum(want[i][0] for i in range(1, 300) if i != 150)
    assert all(got[i] >= 89 for i in range(300, 390))


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8)) * 2
    y = lattice.nearest(x)
    assert ((2 * y) % 1 == 0).all() and (np.abs(y.sum(1)) % 2 == 0).all()
    around = ((x[:, None] - y[:, None] - lattice._SHORT[None]) ** 2).sum(2).min(1)
    assert (((x - y) ** 2).sum(1) <= around + 1e-9).all() and len(lattice._SHORT) == 240


def test_lattice_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (3, v), (3, v), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 3.0]),
            (8, [1.0, float("nan"), 3.0]), (9, [1.0, float("inf"), 3.0]), (10, [1.0, 2.0, 3.0, 0.0]), (None, v), (11, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, e int, key string")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in lattice.near_copies(df).collect())
    assert got == Counter({(1, 4, 1): 1, (2, 4, 1): 1, (3, 4, 1): 2, (None, 4, 1): 1, (4, 0, 4): 1, (5, 0, 5): 1, (6, 0, 6): 1,
                           (7, 0, 7): 1, (8, 0, 8): 1, (9, 0, 9): 1, (10, 0, 10): 1, (11, 0, 11): 1})
    assert lattice.near_copies(df.limit(0)).count() == 0


def test_chat_digests(spark, sf):
    got = {r.conv_id: r for r in q.op7_chat(spark, sf).collect()}
    convs = {-7: [(0, "user", q.HARD), (1, "assistant", q.HARD)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert got.keys() == convs.keys() and got[-7].loss_chars == len(q.HARD) == 26
    for c, turns in convs.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        every = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        assert got[c][1:5] == (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_parts_and_odd_rows(spark):
    rows = [(1, 0, "user", [("text", "see <image:0>", None, None, None, None, None), ("image", None, "a.png", 56, 30, None, None),
                            ("audio", None, "b.wav", None, None, 1.5, None)]),
            (1, 1, "assistant", [("image", None, "c.png", 28, 28, None, None), ("document", None, "d.pdf", None, None, None, 2)]),
            (2, 0, None, None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    out = {(r.conv_id, r.place): r for r in chat.format_conversations(df, "parts").collect()}
    assert out[1, 0].formatted == "### user: see \\<image:0><image:0><audio:0></turn>\n"
    assert [(a.kind, a.number, a.ref, a.tokens) for a in out[1, 0].attachments] == [("image", 0, "a.png", 4), ("audio", 0, "b.wav", 38)]
    assert [(a.kind, a.number, a.tokens) for a in out[1, 1].attachments] == [("image", 1, 1), ("document", 0, 512)]
    assert out[1, 1].expanded_tokens == 513 and out[2, 0].formatted == "### : </turn>\n"
    odd = [(1, 0, "a:b\\", "x"), (1, 0, "a:b\\", "x"), (1, None, "assistant", None), (None, 3, "assistant", "\\</turn>\n### user: #"), (None, 3, None, "")]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).collect():
        role, text = chat.read_turn(r.formatted)
        assert (r.conv_id, role, text) in {(c, role or "", t or "") for c, _, role, t in odd}
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_conversations(df)).collect()} == {(1, 3, 0), (None, 2, 20)}
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_matches_its_sql(spark, sf, duck, name):
    got, want = q.QUERIES[name](spark, sf), duck.execute(q.SQL[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == sorted(got.columns)
    assert Counter(map(tuple, got.select(at).collect())) == Counter(want.fetchall())
