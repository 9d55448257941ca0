"""Repeated passages: paragraph MinHash banding, verified, clustered, removed.

A paragraph doesn't depend on line breaks: it is the run of `words` words from a
content-selected place on, the first of a k-gram that is the smallest of some
`window` neighbouring ones.  A passage holds the same such places wherever it
stands, so copies have paragraphs of equal words whatever surrounds them: one of
words + window - 1 words (55 by default) or more surely holds a whole one, and one
of `passage` words (50 by default) four fifths of the shingles of one.  Where the text
ends first, the words up to its end are the paragraph, if they are as many as that
(passage - window + 1), so that a passage at the end of a text, or one that is all of a
text, is met too.

Paragraphs whose first gram occurs once drop out before anything is compared.
Equal shingle sets are one set from the start.  Each set gets bands of MinHash
values, as many and as wide as `tune` finds for the threshold and the recall
asked for.  Sets that collide in a band are joined (see `linking`: a crowded
bucket is thinned in star rounds, without all of its pairs, and then split by the
rarest shingles of its sets, of which similar ones share one), verified by the exact
Jaccard similarity of their shingles, and clustered by components.  Of a cluster
the occurrence with the smallest document id, place and text hash is the first,
and stays together with those in the same text that overlap it; the words of the
others are removed, unless a first occurrence of another cluster covers them.

Defined results: null, empty and texts too short for that have no paragraphs; rows that
repeat both id and text count as one occurrence, and all of them are treated
alike; a null id sorts first.  Other columns pass through `without_repeats`,
which takes the removed words out of the text and leaves all separators.
"""

from __future__ import annotations

from math import ceil, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm import words as W
from partcast.llm.linking import PERCENT, groups, in_shared_lists
from partcast.llm.scratch import Scratch
from partcast.llm.suffixes import FOUND, by_text, cut_out, minimisers

K, WORDS, WINDOW, GRAM, PASSAGE = 5, 41, 15, 8, 50
RECALL, HASHES = 0.95, 16


def tune(percent: int, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the widest bands that find a pair at the threshold with the recall asked for, within so many hashes.

    Wider bands let fewer unlike pairs collide; narrower ones need fewer hashes.
    """
    best = None
    for rows in range(1, hashes + 1):
        met = (percent / 100) ** rows
        bands = ceil(log1p(-recall) / log1p(-met)) if met < 1 else 1
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError(f"{hashes} hashes can't reach a recall of {recall}")
    return best


class Sets:
    """The shingle sets of paragraphs, and their band keys."""

    def __init__(self, k: int, words: int, window: int, gram: int, bands: int, rows: int, passage: int = PASSAGE) -> None:
        self.k, self.words, self.window, self.gram = k, words, window, gram
        #: Words of a paragraph that the end of its text cuts short: what a passage surely has from a place on.
        self.least = min(words, max(passage - window + 1, k, gram))
        rng = np.random.default_rng(9)
        self.xor = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64)
        self.mul = rng.integers(0, 1 << 63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, gram) of the paragraphs of one text."""
        g = W.grams(h, self.gram)
        at = minimisers(g, self.window)
        at = at[at + self.least <= len(h)]
        return at, g[at]

    def shingles(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted shingles, which of them are the first of their kind, hash of the set), a row per paragraph.

        A paragraph that the text's end cuts short has its first shingle again in place of those beyond.
        """
        g, i = W.grams(h, self.k), at[:, None] + np.arange(self.words - self.k + 1)
        s = np.sort(g[np.where(i < len(g), i, at[:, None])], axis=1)
        new = np.ones(s.shape, bool)
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        with np.errstate(over="ignore"):
            total = np.where(new, W.mix(s), 0).sum(axis=1, dtype=np.uint64) + new.sum(axis=1).astype(np.uint64)
        return s, new, W.mix(total)

    def keys(self, s: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """A key per paragraph and band; paragraphs that begin with different grams never collide, so that
        neighbours in one text, which overlap, don't."""
        out = np.empty((len(s), len(self.xor)), np.uint64)
        for b, (xor, mul) in enumerate(zip(self.xor, self.mul)):
            acc = np.full(len(s), b + 1, np.uint64)
            for x, m in zip(xor, mul):
                acc = W.mix(acc + ((s ^ x) * m).min(axis=1))
            out[:, b] = W.mix(acc ^ gram)
        return out


def _texts(part: pa.RecordBatch, words: int):
    """(row, word hashes) of each text of at least so many words."""
    w = W.split(part.column("text"), W.SPACES)
    h = W.hashes(w)
    for r in np.flatnonzero(w.count >= words):
        yield int(r), h[w.first[r]: w.first[r + 1]]


def _grams(batches, sets: Sets):
    """(doc_id, t, gram, n): first grams of each text's paragraphs, and how often each occurs in it."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            rows, keys, often = [], [], []
            for r, h in _texts(part, sets.least):
                one, n = np.unique(sets.places(h)[1], return_counts=True)
                rows.append(np.full(len(one), r)), keys.append(one), often.append(n)
            if rows:
                r = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(r), part.column("t").take(r), pa.array(W.signed(np.concatenate(keys))),
                    pa.array(np.concatenate(often).astype(np.int32))], names=["doc_id", "t", "gram", "n"])


def _index(batches, sets: Sets):
    """(doc_id, t, size, place, n, e, keys) of paragraphs with one of the grams; size is the words of the text, keys is empty
    for sets that the task has had."""
    had: set[int] = set()
    for batch in batches:
        for part in W.slices(batch, "text"):
            grams = part.column("grams").to_pylist()
            for r, h in _texts(part, sets.least):
                at, g = sets.places(h)
                met = np.isin(g, np.array(grams[r], np.int64).view(np.uint64))
                at, g = at[met], g[met]
                for a in range(0, len(at), 1 << 13):    # a text of any length, a bounded matrix at a time
                    some, own = at[a: a + (1 << 13)], g[a: a + (1 << 13)]
                    s, first, e = sets.shingles(h, some)
                    sign = W.signed(e)
                    _, one = np.unique(sign, return_index=True)
                    new = np.zeros(len(some), bool)
                    new[[i for i in one.tolist() if sign[i] not in had]] = True
                    had.update(sign[new].tolist())
                    row = pa.array(np.full(len(some), r))
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(row), part.column("t").take(row),
                        pa.array(np.full(len(some), len(h), np.int32)), pa.array(some.astype(np.int32)),
                        pa.array(first.sum(axis=1).astype(np.int32)), pa.array(sign),
                        W.list_column(W.signed(sets.keys(s[new], own[new]).ravel()), new * len(sets.xor))],
                        names=["doc_id", "t", "size", "place", "n", "e", "keys"])


def _members(batches, sets: Sets):
    """(e, members) of the sets named in wanted."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            wanted = part.column("wanted").to_pylist()
            for r, h in _texts(part, sets.least):
                need = np.array(wanted[r], np.int64)
                at = sets.places(h)[0]
                for a in range(0, len(at), 1 << 13):
                    s, first, e = sets.shingles(h, at[a: a + (1 << 13)])
                    sign, one = np.unique(W.signed(e), return_index=True)
                    some = one[np.isin(sign, need)]
                    if len(some):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(W.signed(e[some])), W.list_column(W.signed(s[some][first[some]]), first[some].sum(axis=1))],
                            names=["e", "members"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS, window: int = WINDOW,
            percent: int = PERCENT, recall: float = RECALL, hashes: int = HASHES, passage: int = PASSAGE) -> DataFrame:
    """(doc_id, t, repeated_words, removed_words, repeated, removed) for each text with a repeated paragraph.

    Spans are words [start, end) of the text; t, the hash of the text, tells rows of one id apart.
    """
    scratch, sets = Scratch(docs.sparkSession), Sets(k, words, window, GRAM, *tune(percent, recall, hashes), passage)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))

    def with_texts(rows: DataFrame, value: str, name: str) -> DataFrame:
        """Each text once, with the values that its rows have."""
        of = rows.groupBy("doc_id", "t").agg(F.collect_set(value).alias(name)).toDF("d", "u", name)
        return (texts.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
                .dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "text", name))

    grams = scratch.keep(texts.mapInArrow(lambda it: _grams(it, sets), "doc_id long, t long, gram long, n int"))
    shared = grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    index = scratch.keep(with_texts(grams.join(shared, "gram"), "gram", "grams").mapInArrow(
        lambda it: _index(it, sets), "doc_id long, t long, size int, place int, n int, e long, keys array<long>"))
    scratch.drop(grams)
    places = index.drop("keys", "n")

    def fetch(wanted: DataFrame) -> DataFrame:
        # a place per task and set is enough, however many texts hold it
        where = index.where(F.size("keys") > 0).join(wanted, "e").groupBy("e").agg(F.min(F.struct("doc_id", "t")).alias("at"))
        some = with_texts(where.select("at.doc_id", "at.t", "e"), "e", "wanted")
        return some.mapInArrow(lambda it: _members(it, sets), "e long, members array<long>").dropDuplicates(["e"])

    banded = (index.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "e", "n").dropDuplicates(["key", "e"])
              .selectExpr("key", "e", "n", "CAST(NULL AS INT) AS left", "0.0D AS shared"))
    met = scratch.keep(in_shared_lists(banded))
    label = groups(met.select("e").distinct(), fetch, scratch, percent, lists=met)
    # distinct sets first, each with its first place: a set that a third of all texts hold is one row per task
    first = F.struct("doc_id", "place", "t")
    ends = lambda: [F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high")]
    of_set = (places.select("e", first.alias("first"), first.alias("last"), F.col("t").alias("low"), F.col("t").alias("high"))
              .groupBy("e").agg(*ends()).join(label, "e", "left").withColumn("label", F.coalesce("label", "e")))
    clusters = of_set.groupBy("label").agg(*ends())
    near = lambda x: (x["doc_id"].eqNullSafe(F.col("first.doc_id")) & (x["t"] == F.col("first.t"))
                      & (x["place"] < F.col("first.place") + words))
    # where all occurrences overlap the first, they stand in one text and the last overlaps it
    repeated = clusters.where(~near(F.col("last")) | (F.col("low") < F.col("high"))).select("label", "first")
    found = scratch.keep(of_set.select("e", "label").join(repeated, "label").select("e", "first"))
    of_text = places.join(found, "e").select(
        "doc_id", "t", "size", F.array("place").alias("places"),
        near({c: F.col(c) for c in ("doc_id", "t", "place")}).alias("kept"))
    return (of_text.repartition("doc_id", "t").sortWithinPartitions("doc_id", "t")
            .mapInArrow(lambda it: by_text(it, words), FOUND))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every repeated paragraph but the first taken out of the text; docs is read several times."""
    found = Scratch(docs.sparkSession).keep(repeats(docs, id_col, text_col, **options))
    return cut_out(docs, found, id_col, text_col)
