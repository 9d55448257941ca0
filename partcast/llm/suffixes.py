"""Repeated passages: every window of `words` words that two places share, found by minimisers.

Each window of `words` words holds a minimiser, the smallest k-gram hash among
its `words - k + 1` grams, and holds the same one wherever it occurs.  Windows
whose minimiser gram occurs once drop out before anything is compared; the others
meet by a 64-bit hash of all their words, so no repeated window is missed,
whatever stands to its left or right.

Of each window's occurrences the one with the smallest document id, place and
text hash is its first, and the words of first occurrences stay where they are.
Removed are the words of the others, unless a first occurrence of another window
covers them too: so each repeated window keeps one whole copy, also where
passages overlap, within one text or across several.

A text sends each distinct window once, with its places, so a text of one
repeated word pair is two rows; a window that a third of all texts hold is one
row per task before the exchange, and the join back may be split.

Defined results: null, empty and shorter texts have no passages; rows that
repeat id and text count as one; a null id sorts first.  Other columns are not
looked at, and pass through `without_repeats`, which takes the removed words out
of the text and leaves all separators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm import words as W
from partcast.llm.scratch import Scratch

WORDS, K = 50, 8


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick.minimum or maximum of each run of w values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places whose gram is the smallest of some window."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    least = _sliding(grams, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == grams)


def _places(batches, words: int, k: int):
    """(doc_id, t, gram) of each text's distinct minimisers, n: how often each occurs in it."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            w = W.split(part.column("text"), W.SPACES)
            h = W.hashes(w)
            rows, keys, often = [], [], []
            for r in np.flatnonzero(w.count >= words):
                g = W.grams(h[w.first[r]: w.first[r + 1]], k)
                one, n = np.unique(g[minimisers(g, words - k + 1)], return_counts=True)
                rows.append(np.full(len(one), r)), keys.append(one), often.append(n)
            if rows:
                r = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(r), part.column("t").take(r),
                    pa.array(W.signed(np.concatenate(keys))), pa.array(np.concatenate(often).astype(np.int32))],
                    names=["doc_id", "t", "gram", "n"])


def _windows(batches, words: int, k: int):
    """(doc_id, t, w, places): each distinct window whose minimiser is one of grams, and where it begins."""
    for batch in batches:
        for part in W.slices(batch, "text"):
            w = W.split(part.column("text"), W.SPACES)
            h = W.hashes(w)
            rows, keys, begin, at = [], [], [np.zeros(1, np.int64)], []
            total = 0
            for r, grams in enumerate(part.column("grams").to_pylist()):
                own = h[w.first[r]: w.first[r + 1]]
                least = _sliding(W.grams(own, k), words - k + 1, np.minimum)
                a = np.flatnonzero(np.isin(least, np.array(grams, np.int64).view(np.uint64)))
                v = W.windows(own, words)[a]
                order = np.argsort(v, kind="stable")
                one, start = np.unique(v[order], return_index=True)
                rows.append(np.full(len(one), r)), keys.append(one), at.append(a[order])
                begin.append(total + np.append(start[1:], len(a)) if len(a) else start)
                total += len(a)
            if rows:
                r = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(r), part.column("t").take(r), pa.array(W.signed(np.concatenate(keys))),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(begin).astype(np.int32)), pa.array(np.concatenate(at).astype(np.int32)))],
                    names=["doc_id", "t", "w", "places"])


def _covered(starts: np.ndarray, words: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + words, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(covered: np.ndarray) -> list[dict]:
    edge = np.diff(covered.astype(np.int8), prepend=0, append=0)
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]


_SPAN = "array<struct<start:int,end:int>>"
FOUND = f"doc_id long, t long, repeated_words long, removed_words long, repeated {_SPAN}, removed {_SPAN}"


def by_text(batches, words: int):
    """Repeated windows (doc_id, t, places, kept) in order of text -> a row per text; kept: the first place stays.

    Where a column `size` says how many words the text has, windows end there.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64()] * 4 + [kind] * 2
    last, size, held, out = None, None, [], []

    def ended() -> tuple:
        firsts, others = (np.concatenate(x) for x in zip(*held))
        n = int(max(firsts.max(initial=0), others.max(initial=0))) + words
        n = n if size is None else min(n, size)
        stays, again = _covered(firsts, words, n), _covered(others, words, n)
        every, gone = stays | again, again & ~stays
        return (*last, int(every.sum()), int(gone.sum()), _spans(every), _spans(gone))

    def table() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                          names=["doc_id", "t", "repeated_words", "removed_words", "repeated", "removed"])

    for batch in batches:
        if not batch.num_rows:
            continue
        null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").fill_null(0).to_numpy()
        t = batch.column("t").to_numpy()
        kept = batch.column("kept").to_numpy(zero_copy_only=False)
        places = batch.column("places")
        at = places.offsets.to_numpy()
        flat = places.values.to_numpy()
        sizes = batch.column("size").to_numpy() if "size" in batch.schema.names else None
        new = np.ones(len(t), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (null[1:] != null[:-1]) | (t[1:] != t[:-1])
        cut = np.append(np.flatnonzero(new), len(t))
        for a, b in zip(cut[:-1], cut[1:]):
            key = (None if null[a] else int(doc[a]), int(t[a]))
            if key != last:
                if held:
                    out.append(ended())
                last, size, held = key, None if sizes is None else int(sizes[a]), []
            first = np.zeros(int(at[b] - at[a]), bool)
            first[at[a:b][kept[a:b]] - at[a]] = True
            x = flat[at[a]: at[b]].astype(np.int64)
            held.append((x[first], x[~first]))
        if len(out) > 2_000:
            yield table()
            out = []
    if held:
        out.append(ended())
    yield table()


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """(doc_id, t, repeated_words, removed_words, repeated, removed) for each text that shares a passage.

    Spans are words [start, end) of the text; t, the hash of the text, tells rows of one id apart.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    places = scratch.keep(texts.mapInArrow(lambda it: _places(it, words, k), "doc_id long, t long, gram long, n int"))
    shared = places.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    wanted = scratch.keep(places.join(shared, "gram").groupBy("doc_id", "t").agg(F.collect_set("gram").alias("grams"))
                          .toDF("d", "u", "grams"))
    scratch.drop(places)
    with_text = (texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u")))
                 .dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "text", "grams"))
    windows = scratch.keep(with_text.mapInArrow(
        lambda it: _windows(it, words, k), "doc_id long, t long, w long, places array<int>"))
    scratch.drop(wanted)
    place = F.struct("doc_id", F.col("places")[0].alias("place"), "t")
    met = windows.groupBy("w").agg(F.min(place).alias("first"), F.sum(F.size("places")).alias("n")).where("n > 1")
    again = scratch.keep(windows.join(met.select("w", "first"), "w")
                         .select("doc_id", "t", "places", place.eqNullSafe(F.col("first")).alias("kept")))
    scratch.drop(windows)
    found = scratch.keep(again.repartition("doc_id", "t").sortWithinPartitions("doc_id", "t")
                         .mapInArrow(lambda it: by_text(it, words), FOUND))
    scratch.drop(again)
    return found


def _without(batches, text: str):
    """The batches with the words of gone_spans, their last column, cut out of the text."""
    for batch in batches:
        for part in W.slices(batch, text):
            at = part.schema.get_field_index(text)
            column = part.column(at)
            raw = column.to_pylist()
            spans = part.column(part.num_columns - 1).to_pylist()
            for r in (r for r, one in enumerate(spans) if one):
                w = W.split(column.slice(r, 1), W.SPACES)
                whole, pieces, last = raw[r].encode(), [], 0
                for s in spans[r]:
                    pieces.append(whole[last: w.start[s["start"]]])
                    last = int(w.end[s["end"] - 1])
                raw[r] = b"".join([*pieces, whole[last:]]).decode()
            columns = part.columns[:-1]
            columns[at] = pa.array(raw, column.type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names[:-1])


def cut_out(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the removed words of each text, as found by `repeats`, taken out."""
    gone = found.where("removed_words > 0").select(
        F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t"), F.col("removed").alias("gone_spans"))
    rows = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    both = rows.join(gone, F.col(at[id_col]).cast("long").eqNullSafe(F.col("gone_id"))
                     & (F.xxhash64(at[text_col]) == F.col("gone_t")), "left").drop("gone_id", "gone_t")
    return both.mapInArrow(lambda it: _without(it, at[text_col]), rows.schema).toDF(*docs.columns)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K) -> DataFrame:
    """docs with the removed words of each text taken out; docs is read several times."""
    return cut_out(docs, repeats(docs, id_col, text_col, words, k), id_col, text_col)
