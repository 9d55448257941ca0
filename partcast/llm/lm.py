"""Language-model scores from a trie of n-grams in shards.

Tokens are words and one end per text.  With c the counts in the training
texts, ctx_k the k - 1 tokens to the left and p0(w) = (c(w) + 1) / (N + V + 1),

    p(w | context) = (sum over k of a_k c(ctx_k w) + mu p0(w)) / (sum over k of a_k c(ctx_k) + mu),

counts of all orders pooled with a Dirichlet prior: a distribution over all
words, known or not.  Its numerator hangs on the n-grams that end in w, its
denominator on those that end in the token before w, so a text's score is a sum
of terms each of which one shard of the trie knows: n-grams are dealt by their
last word and looked up right to left (`elias_fano.Trie`).

`fit`: tasks send counts of the distinct n-grams of a chunk of texts, packed and
sorted, one row per chunk and shard; each shard becomes one trie (words with
exact counts, smoothed numerators and denominators in codebooks).  The number of
shards follows the number of tokens (`shard_tokens`).  A word of more than an
eighth of that is spread over the shards by the word before it; at most 2^20
words can be (the bound is raised if need be), and only they are broadcast.

`score`: tasks send each distinct n-gram of a chunk with the texts that hold it
to the trie of its shard, once per chunk; back come sums per text.  Shards that
more queries meet than others (a passage in every third text) have their trie
sent to several tasks, each with its part of the chunks.

The highest order keeps n-grams of at least `least` occurrences.  Left contexts
are told apart by 32-bit marks below their node: a wrong hit has odds of the
node's children in 2^32 and changes `score` only.  `base`, `n_known` and all
counts come from 64-bit hashes of words.

Defined results: null and empty texts are one end; a null id is trained on;
repeated rows are trained on and returned each; without training texts p = p0
and the base score is 0.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partcast.llm import words as W
from partcast.llm.elias_fano import Trie, build, mapped, pack, unpack
from partcast.llm.scratch import Scratch

_U = np.uint64
END, START = _U(0xD6E8FEB86659FD93), _U(0xCA5A826395121157)
#: Tokens of a chunk (more if one text has more), and training tokens of a shard.
CHUNK, SHARD = 800_000, 3_000_000
HOT = 1 << 20
#: Partitions per shard: with as many as shards, hashing puts five of them into one task.
SPREAD = 4


class Weights(NamedTuple):
    order: int = 2
    of_order: tuple[float, ...] = (1.0,)        #: a_k from order 2 on
    prior: float = 100.0                        #: mu
    least: int = 1                              #: occurrences that an n-gram of the highest order needs


class Model(NamedTuple):
    tries: DataFrame        #: (shard, tokens, data)
    shards: int
    hot: np.ndarray         #: sorted hashes of the words spread over shards
    hot_counts: np.ndarray
    tokens: int             #: N
    distinct: int           #: V
    texts: int
    weights: Weights
    parts: dict[int, int]   #: tasks of the shards that need more than one

    def p0(self, count):
        return (count + 1.0) / (self.tokens + self.distinct + 1.0)


# -- chunks of texts

class Chunk(NamedTuple):
    number: int
    ids: pa.Array
    sizes: np.ndarray       #: tokens of each text
    text: np.ndarray        #: of each token, the text's place in the chunk
    tokens: np.ndarray
    left: list[np.ndarray]  #: marks of the tokens before, nearest first


def chunks(batches, order: int, limit: int) -> Iterator[Chunk]:
    """Texts in runs of at least limit tokens; numbers are the same whenever a partition is read again."""
    at = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
    ids, sizes, tokens, have = [], [], [], 0

    def made() -> Chunk:
        n, t = np.concatenate(sizes), np.concatenate(tokens)
        first = np.cumsum(n) - n
        text = np.repeat(np.arange(len(n), dtype=np.int32), n)
        left, mark = [], _marks(t) if order > 1 else None
        for k in range(1, order):
            before = np.empty(len(t), np.uint32)
            before[k:] = mark[:-k]
            for i in range(k):  # no text is shorter than its end; what lies before it is START
                before[np.minimum(first + i, first + n - 1)] = _START
            left.append(before)
        return Chunk(at, pa.concat_arrays(ids), n, text, t, left)

    for batch in batches:
        for part in W.slices(batch, "text"):
            w = W.split(part.column("text"), W.SPACES)
            t = np.full(len(w.start) + part.num_rows, END)
            t[np.arange(len(w.start)) + w.row] = W.hashes(w)
            ids.append(part.column("doc_id")), sizes.append(w.count + 1), tokens.append(t)
            have += len(t)
            if have >= limit:
                yield made()
                at, ids, sizes, tokens, have = at + 1, [], [], [], 0
    if have:
        yield made()


def _marks(tokens: np.ndarray) -> np.ndarray:
    return (W.mix(tokens ^ _U(0x9FB21C651E98DF25)) >> _U(32)).astype(np.uint32)


_START = _marks(np.array([START]))[0]


def _varint(values: np.ndarray) -> np.ndarray:
    """Numbers >= 0 in groups of 7 bits."""
    v = np.asarray(values, np.uint64)
    n = 1 + sum((v >= _U(1) << _U(7 * k)).astype(np.int64) for k in range(1, 7))
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max(initial=0))):
        some = n > k
        more = (n[some] > k + 1).astype(np.uint8) << 7
        out[at[some] + k] = ((v[some] >> _U(7 * k)) & _U(127)).astype(np.uint8) | more
    return out


def _plain(packed: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(packed < 128)
    begin = np.append(0, last[:-1] + 1)
    n = last - begin + 1
    out = np.zeros(len(last), np.int64)
    for k in range(int(n.max(initial=0))):
        some = n > k
        out[some] |= (packed[begin[some] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _deal(c: Chunk, shards: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, word, rank) of the chunk's distinct words in their shards, by shard and word; rank is of each token."""
    home = lambda x: (W.mix(x) % _U(shards)).astype(np.int32)
    name, spread = c.tokens, None
    if len(hot):
        spread = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, c.tokens), len(hot) - 1)] == c.tokens)
        own = home(c.tokens[spread] ^ W.mix(c.left[0][spread].astype(np.uint64)))
        name = c.tokens.copy()
        name[spread] = W.mix(c.tokens[spread] + own.astype(np.uint64) + _U(1))
    _, one, back = np.unique(name, return_index=True, return_inverse=True)
    word = c.tokens[one]
    shard = home(word ^ _U(0x2545F4914F6CDD1D))
    if spread is not None:
        shard[back[spread]] = own
    order = np.lexsort((word, shard))
    rank = np.empty(len(one), np.int32)
    rank[order] = np.arange(len(one))
    return shard[order], word[order], rank[back]


def rows(c: Chunk, shards: int, hot: np.ndarray, with_texts: bool) -> Iterator[tuple[int, bytes]]:
    """(shard, packed n-grams): words; per level the number of children of each node above and their marks; per
    n-gram its count or, with_texts, how many texts hold it, which, and how often."""
    shard, word, rank = _deal(c, shards, hot)
    marks = c.left
    key = (rank.astype(np.uint64) << _U(32)) | marks[0].astype(np.uint64)
    order = np.lexsort((*marks[:0:-1], key)) if len(marks) > 1 else np.argsort(key, kind="stable")
    rank, text, marks = rank[order], c.text[order], [m[order] for m in marks]
    new = [np.diff(rank, prepend=-1) != 0]
    for m in marks:
        new.append(new[-1] | np.concatenate([[True], m[1:] != m[:-1]]))
    post = new[-1] | (np.diff(text, prepend=-1) != 0)
    cut = np.searchsorted(shard[rank], np.append(np.unique(shard), shards))
    for s, a, b in zip(np.unique(shard), cut[:-1], cut[1:]):
        at = [np.flatnonzero(x[a:b]) for x in new]
        out = {"words": word[rank[a:b][at[0]]]}
        for k, m in enumerate(marks, 1):
            out[f"kids{k}"] = _varint(np.diff(np.append(np.searchsorted(at[k], at[k - 1]), len(at[k]))))
            out[f"marks{k}"] = m[a:b][at[k]]
        if with_texts:
            p = np.flatnonzero(post[a:b])
            out["held"] = _varint(np.diff(np.append(np.searchsorted(p, at[-1]), len(p))))
            out["texts"], out["times"] = _varint(text[a:b][p]), _varint(np.diff(np.append(p, b - a)))
        else:
            out["counts"] = _varint(np.diff(np.append(at[-1], b - a)))
        yield int(s), pack(out)


def _nodes(block: dict[str, np.ndarray], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """words, marks of each level, and of each level's nodes the place of the node above."""
    above = [np.repeat(np.arange(len(n)), n) for n in (_plain(block[f"kids{k}"]) for k in range(1, order))]
    return block["words"], [block[f"marks{k}"] for k in range(1, order)], above


# -- tries

def _trie(blocks: list[dict[str, np.ndarray]], model: Model) -> tuple[int, bytes]:
    """(tokens, bytes) of one shard."""
    order, a, least = model.weights.order, model.weights.of_order, model.weights.least
    word, marks, count = [], [[] for _ in range(order - 1)], []
    for block in blocks:
        w, m, above = _nodes(block, order)
        leaf = np.arange(len(m[-1]))
        for k in range(order - 2, -1, -1):
            marks[k].append(m[k][leaf])
            leaf = above[k][leaf]
        word.append(w[leaf]), count.append(_plain(block["counts"]))
    word, marks, count = np.concatenate(word), [np.concatenate(m) for m in marks], np.concatenate(count)
    words, node = np.unique(word, return_inverse=True)
    by = np.lexsort((*marks[::-1], node))
    node, marks, count = node[by], [m[by] for m in marks], count[by]
    total = np.bincount(node, count, len(words)).astype(np.int64)
    tokens = int(total.sum())
    if len(model.hot):
        at = np.minimum(np.searchsorted(model.hot, words), len(model.hot) - 1)
        total = np.where(model.hot[at] == words, model.hot_counts[at], total)
    levels, prior = [], model.weights.prior * model.p0(total)
    upper, pooled, above_count = node, prior, total     # of each n-gram its node above; of nodes their numerator without own count
    for k in range(order - 1):
        last = k == order - 2
        first = np.flatnonzero((np.diff(upper, prepend=-1) != 0) | np.concatenate([[True], marks[k][1:] != marks[k][:-1]]))
        n = np.add.reduceat(count, first)
        parent, mark = upper[first], marks[k][first]
        own = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(count))))
        keep = np.flatnonzero(n >= least) if last else np.arange(len(n))
        sums = pooled[parent] + a[k] * n
        values = {"up": np.log10(sums[keep])}
        if not last:
            # as a context: a_2 c(w) + a_3 c(vw) + ..., with counts of one word fewer
            context = (model.weights.prior + a[0] * above_count if k == 0 else below)[parent] + a[k + 1] * n
            values["down"], below = np.log10(context), context
        levels.append((parent[keep], mark[keep], values))
        upper, pooled, above_count = own, sums, n
    return tokens, build(words, total, levels)


def _tries(batches, model: Model):
    """Blocks in order of shard -> (shard, tokens, data)."""
    now, held = None, []

    def made() -> pa.RecordBatch:
        tokens, data = _trie(held, model)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([tokens]), pa.array([data], pa.binary())],
                                          names=["shard", "tokens", "data"])

    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
            if shard != now:
                if held:
                    yield made()
                now, held = shard, []
            held.append(unpack(data.as_buffer()))
    if held:
        yield made()


def fit(docs: DataFrame, scratch: Scratch, weights: Weights = Weights(), chunk: int = CHUNK, shard_tokens: int = SHARD) -> Model:
    """docs (doc_id, text), the training rows only."""
    def words(batches):
        for c in chunks(batches, 1, chunk):
            w, n = np.unique(c.tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(w)), pa.array(n)], names=["w", "n"])

    counts = scratch.keep(docs.mapInArrow(words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    most = max(shard_tokens // 8, tokens // HOT)
    # words with more than tokens / HOT tokens: fewer than HOT of them
    hot = {r.w: r.n for r in counts.where(F.col("n") > most).collect()}
    texts = counts.where(F.col("w") == int(W.signed(np.array([END]))[0])).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    names = np.sort(np.array(list(hot), np.int64).view(np.uint64))
    scratch.drop(counts)
    model = Model(None, max(1, -(-tokens // shard_tokens)), names, np.array([hot[int(x)] for x in W.signed(names)], np.int64), tokens,
                  distinct, texts, weights, {})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def blocks(batches):
        for c in chunks(batches, weights.order, chunk):
            for s, data in rows(c, shared.value.shards, shared.value.hot, False):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])

    tries = scratch.keep(
        docs.mapInArrow(blocks, "shard int, data binary").repartition(SPREAD * model.shards, "shard").sortWithinPartitions("shard")
        .mapInArrow(lambda it: _tries(it, shared.value), "shard int, tokens long, data binary"))
    # shards of more than four times the mean: fewer than a quarter of them
    parts = {r.shard: -(-r.tokens // shard_tokens) for r in tries.where(F.col("tokens") > 4 * shard_tokens).select("shard", "tokens").collect()}
    return model._replace(tries=tries, parts=parts)


# -- scores

def _answer(block: dict[str, np.ndarray], trie: Trie | None, model: Model) -> dict[str, np.ndarray]:
    """Per text of the block: known tokens, log10 (c + 1) and log10 of the model, summed over the block's tokens."""
    order, a, prior = model.weights.order, model.weights.of_order, model.weights.prior
    words, marks, above = _nodes(block, order)
    node, count = trie.word(words) if trie else (np.full(len(words), -1), np.zeros(len(words), np.int64))
    if len(model.hot):
        at = np.minimum(np.searchsorted(model.hot, words), len(model.hot) - 1)
        count = np.where(model.hot[at] == words, model.hot_counts[at], count)
    base = np.log10(count + 1.0)
    up, down = np.log10(prior * model.p0(count)), np.log10(prior + a[0] * count)
    for k in range(order - 1):
        parent = above[k]
        node, up, down = (trie.child(k + 2, node[parent], marks[k]) if trie else np.full(len(parent), -1)), up[parent], down[parent]
        met = node >= 0
        up[met] = trie.value("up", k + 2, node[met]) if trie else 0
        if k < order - 2:
            down[met] = trie.value("down", k + 2, node[met]) if trie else 0
    leaf = np.arange(len(node))
    for k in range(order - 2, -1, -1):
        leaf = above[k][leaf]
    down = np.where(words[leaf] == END, 0.0, down)
    held = np.repeat(np.arange(len(leaf)), _plain(block["held"]))
    texts, times = _plain(block["texts"]), _plain(block["times"])
    which, back = np.unique(texts, return_inverse=True)
    add = lambda x: np.bincount(back, times * x[held], len(which))
    return {"texts": _varint(which), "known": _varint(add((count[leaf] > 0).astype(float))), "base": add(base[leaf]),
            "score": add(up - down).astype(np.float32)}


_ASKED = "shard int, part int, kind int, chunk long, data binary"


def _ask(batches, model: Model, chunk: int):
    """A row per chunk and shard (kind 1), and one with the chunk's ids and sizes (kind 2)."""
    def row(shard: int, kind: int, number: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([number % model.parts.get(shard, 1)], pa.int32()), pa.array([kind], pa.int32()),
            pa.array([number]), pa.array([data], pa.binary())], names=["shard", "part", "kind", "chunk", "data"])

    for c in chunks(batches, model.weights.order, chunk):
        null = c.ids.is_null().to_numpy(zero_copy_only=False)
        yield row(c.number % model.shards, 2, c.number, pack({"ids": c.ids.fill_null(0).to_numpy(), "null": null, "sizes": c.sizes.astype(np.int64)}))
        for s, data in rows(c, model.shards, model.hot, True):
            yield row(s, 1, c.number, data)


def _meet(batches, model: Model):
    """Tries (kind 0) and queries, by shard and part -> answers by chunk."""
    now, trie = None, None
    for batch in batches:
        shard, part, kind, chunk = (batch.column(i).to_pylist() for i in range(4))
        for i, data in enumerate(batch.column(4)):
            if (shard[i], part[i]) != now:
                now, trie = (shard[i], part[i]), None
            if kind[i] == 0:
                trie = Trie(mapped(data.as_buffer()))
                continue
            out = data.as_py() if kind[i] == 2 else pack(_answer(unpack(data.as_buffer()), trie, model))
            yield pa.RecordBatch.from_arrays([pa.array([chunk[i]]), pa.array([kind[i]], pa.int32()), pa.array([shard[i]], pa.int32()),
                                              pa.array([out], pa.binary())], names=["chunk", "kind", "shard", "data"])


def _totals(batches, model: Model):
    """Answers in order of chunk, the ids first -> a row per text."""
    start = np.log10(model.weights.prior + sum(model.weights.of_order) * model.texts)
    unit = np.log10(model.tokens + model.distinct + 1.0)
    now, one, sums = None, None, None

    def made() -> pa.RecordBatch:
        known, base, score = sums
        n = one["sizes"]
        return pa.RecordBatch.from_arrays([
            pa.array(one["ids"], mask=one["null"]), pa.array(n), pa.array(np.rint(known).astype(np.int64)),
            pa.array(np.full(len(n), model.tokens)), pa.array(base - n * unit), pa.array(score - start)],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    for batch in batches:
        chunk, kind = batch.column("chunk").to_pylist(), batch.column("kind").to_pylist()
        for i, data in enumerate(batch.column("data")):
            block = unpack(data.as_buffer())
            if kind[i] == 2:
                if one is not None:
                    yield made()
                now, one, sums = chunk[i], block, np.zeros((3, len(block["ids"])))
                continue
            at = _plain(block["texts"])
            for total, x in zip(sums, (_plain(block["known"]), block["base"], block["score"])):
                total[at] += x
    if one is not None:
        yield made()


def score(docs: DataFrame, model: Model, chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model._replace(tries=None))
    parts = F.lit(1)
    if model.parts:
        table = spark.createDataFrame(list(model.parts.items()), "of int, parts int")
        tries = model.tries.join(table, F.col("shard") == F.col("of"), "left")
        parts = F.coalesce("parts", F.lit(1))
    else:
        tries = model.tries
    tries = tries.select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"),
                         F.lit(0).cast("long").alias("chunk"), "data")
    asked = docs.mapInArrow(lambda it: _ask(it, shared.value, chunk), _ASKED)
    tasks = SPREAD * (model.shards + sum(model.parts.values()))
    met = (tries.unionAll(asked).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "kind", "chunk")
           .mapInArrow(lambda it: _meet(it, shared.value), "chunk long, kind int, shard int, data binary"))
    return (met.repartition("chunk").sortWithinPartitions("chunk", F.desc("kind"), "shard")
            .mapInArrow(lambda it: _totals(it, shared.value),
                        "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Weights = Weights(), chunk: int = CHUNK,
             shard_tokens: int = SHARD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row per row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(texts.where(~held_out()), Scratch(docs.sparkSession), weights, chunk, shard_tokens)
    return score(texts, model, chunk).withColumn("held_out", held_out())
