"""Ranked lexical search, reversed: the queries are indexed and the documents stream past.

Benchmark items are few and documents are many, so the inverted index is built
over the items' terms (term -> items that ask for it, and how often) and sent to
the tasks.  A first pass counts the documents with terms, all their terms, and
the documents that hold each indexed term.  A second pass streams each
document's term counts through the index, adds up integer scores, and keeps a
heap of the best documents per item; the heaps of all tasks are merged by a
window per item, which ranks at most `top` rows of each task.

Items come in blocks of at most `block_terms` distinct terms (or one item), read
in order: that, and not the size of the table of items, bounds what is
broadcast; each further block is two more passes over the documents.

score(item, document) = sum over the item's terms, repeats included, of
    w * ((10^9 tf) div (1000 tf + 8 m)),   w = floor(1000 ln((2 N + 2) / (2 df + 1))),
    m = 100 - 75 + (75 n N) div L,
in 64-bit integers: N documents with terms, L terms in them, n in this one.

Defined results: each row of items is an item of its own, also where ids repeat
or are null; null and empty texts have no terms and no score; each document row
counts, also repeated ones; equal scores are ordered by document id, null last.
Other columns are not looked at.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partcast.llm import words as W
from partcast.llm.scratch import Scratch

TOP, BLOCK_TERMS = 10, 1_000_000
#: Scores of one slice: rows times items.
_CELLS = 1 << 21
_NONE = np.iinfo(np.int64).max


class Index(NamedTuple):
    ids: list               #: of the block's items
    terms: np.ndarray       #: sorted hashes
    first: np.ndarray       #: where each term's postings begin; one more at the end
    item: np.ndarray        #: place of the item in ids
    times: np.ndarray       #: how often it asks for the term


def blocks(items: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[Index]:
    """The items in order of id, at most limit terms (or one item) at a time."""
    now, size = [], 0

    def made() -> Index:
        t = np.concatenate([t for _, t, _ in now]) if now else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(now)), [len(t) for _, t, _ in now])
        order = np.lexsort((which, t))
        terms, first = np.unique(t[order], return_index=True)
        times = np.concatenate([n for *_, n in now]) if now else np.zeros(0, np.int64)
        return Index([i for i, *_ in now], terms, np.append(first, len(t)), which[order], times[order])

    for r in items.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        t, n = np.unique(W.hashes(W.split(pa.array([r["t"]], pa.string()), W.MARKS)), return_counts=True)
        if now and size + len(t) > limit:
            yield made()
            now, size = [], 0
        now.append((r["i"], t, n.astype(np.int64)))
        size += len(t)
    if now:
        yield made()


def _held(column: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each row, and (row, term, times) of the indexed ones, by term and row."""
    w = W.split(column, W.MARKS)
    h = W.hashes(w)
    at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
    met = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
    pair, tf = np.unique(at[met] * len(column) + w.row[met], return_counts=True)
    return w.count, pair % len(column), pair // len(column), tf.astype(np.int64)


def _count(batches, terms: np.ndarray):
    """(term, n): documents that hold each indexed term; as -1 documents with terms, as -2 their terms."""
    df, docs, total = np.zeros(len(terms), np.int64), 0, 0
    for batch in batches:
        for part in W.slices(batch, "text"):
            count, _, term, _ = _held(part.column("text"), terms)
            df += np.bincount(term, minlength=len(terms))
            docs, total = docs + int((count > 0).sum()), total + int(count.sum())
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], held])), pa.array(np.concatenate([[docs, total], df[held]]))],
                                     names=["term", "n"])


class Best:
    """The best rows of each item so far: bounded heaps, one array row per item."""

    def __init__(self, items: int, top: int) -> None:
        self.score = np.zeros((items, top), np.int64)
        self.doc = np.full((items, top), _NONE)
        self.null = np.ones((items, top), bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """score: items x rows."""
        top = self.score.shape[1]
        item, row = np.nonzero((score >= self.score[:, -1:]) & (score > 0))
        if not len(item):
            return
        touched, place = np.unique(item, return_inverse=True)
        i = np.concatenate([np.repeat(np.arange(len(touched)), top), place])
        s = np.concatenate([self.score[touched].ravel(), score[item, row]])
        d = np.concatenate([self.doc[touched].ravel(), doc[row]])
        z = np.concatenate([self.null[touched].ravel(), null[row]])
        order = np.lexsort((d, z, -s, i))
        begin = np.searchsorted(i[order], np.arange(len(touched)))
        keep = order[(begin[:, None] + np.arange(top)).ravel()]
        for mine, new in ((self.score, s), (self.doc, d), (self.null, z)):
            mine[touched] = new[keep].reshape(-1, top)


def _stream(batches, index: Index, weight: np.ndarray, docs: int, total: int, top: int):
    """(item, doc_id, score) of the best documents of this task, per item."""
    best = Best(len(index.ids), top)
    step = max(1, _CELLS // max(1, len(index.ids)))
    for batch in batches:
        for whole in W.slices(batch, "text"):
            for a in range(0, whole.num_rows, step):
                part = whole.slice(a, step)
                count, row, term, tf = _held(part.column("text"), index.terms)
                if not len(row):
                    continue
                m = 25 + (75 * count.astype(np.int64) * docs) // total
                gain = weight[term] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m[row]))
                score = np.zeros((len(index.ids), part.num_rows), np.int64)
                cut = np.flatnonzero(np.diff(term, prepend=-1))
                for x, y in zip(cut, np.append(cut[1:], len(term))):
                    p, q = index.first[term[x]], index.first[term[x] + 1]
                    score[index.item[p:q, None], row[x:y]] += index.times[p:q, None] * gain[x:y]
                ids = part.column("doc_id")
                best.add(score, ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
    item, place = np.nonzero(best.score > 0)
    null = best.null[item, place]
    yield pa.RecordBatch.from_arrays([
        pa.array(item.astype(np.int32)), pa.array(best.doc[item, place], mask=null), pa.array(best.score[item, place])],
        names=["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of each item."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def one(index: Index) -> DataFrame:
        # at most block_terms rows
        held = {r.term: r.n for r in texts.select("text").mapInArrow(lambda it: _count(it, index.terms), "term long, n long")
                .groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, total = held.get(-1, 0), held.get(-2, 0)
        weight = np.array([floor(1000 * log((2 * n + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(index.terms))], np.int64)
        ids = {i: x for i, x in enumerate(index.ids)}
        shared = spark.sparkContext.broadcast((index, weight, ids))
        met = texts.mapInArrow(lambda it: _stream(it, *shared.value[:2], n, max(total, 1), top), "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

        def named(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([
                    pa.array([shared.value[2][i] for i in b.column("item").to_pylist()], pa.int64()), b.column("rank"), b.column("doc_id"),
                    b.column("score")], names=["item_id", "rank", "doc_id", "score"])
        return ranked.mapInArrow(named, "item_id long, rank int, doc_id long, score long")

    out = None
    for index in blocks(items, item_col, item_text_col, block_terms):
        # a second block is only read when the first one's results are written
        out = one(index) if out is None else scratch.keep(out).unionByName(one(index))
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
