"""Near-duplicate documents: exact Jaccard join on sets of word shingles.

Set relations carry the work.  Equal sets are one set from the start (the rows
of a task are merged before anything is shuffled).  Shingles are ordered
globally by rarity; a set is indexed only by the first of them that a partner
at the threshold can't all miss, and index lists hold set size and position so
that whole blocks fail the length or the positional filter.  Sets alike take
their answer from a leader's, as `linking` describes.

Only a fixed share of the shingles, chosen by their hash, needs counting: a
large set has enough of them to fill its prefix.  Sets small enough that they
may not, are indexed in full in a band of their own; the bands overlap by the
threshold, so every pair meets in one of them, and a set that still lacks
shingles for its prefix goes on with uncounted ones.  The sets that meet in this
first join are few; they are joined again on all their shingles, where sets with
many shingles of their own drop out.

Defined results: null or blank texts have no shingles, link with nothing and
are their own component; fewer than k words make one shingle; repeated rows and
equal texts share a component; a null id counts as absent when the smallest id
is taken.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm import words as W
from partcast.llm.linking import PERCENT, groups, in_shared_lists, prefix_length
from partcast.llm.scratch import Scratch

K = 5
#: Share of shingles that is counted for large sets, and where the bands meet.
SHARE, SMALL = 0.35, 125
_CUT = np.uint64(int(SHARE * (1 << 64)))
_BANDS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)


def distinct_shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = W.split(column, W.SPACES)
    values, begin = W.shingles(W.hashes(w), w.count, w.first, k)
    for a, b in zip(begin[:-1], begin[1:]):
        one = np.sort(values[a:b])
        yield one[np.concatenate([[True], one[1:] != one[:-1]])] if len(one) else one


def _index(batches, k: int, percent: int):
    """Rows (doc_id, t, n, e, main, band, u, toks); toks is empty for sets that the task has had."""
    had: set[int] = set()
    low = SMALL * percent // 100
    for batch in batches:
        for part in W.slices(batch, "text"):
            ids, texts, n, e, main, band, u, toks = [], [], [], [], [], [], [], []
            for doc, text, one in zip(part.column("doc_id").to_pylist(), part.column("t").to_pylist(), distinct_shingles(part.column("text"), k)):
                size, sign = len(one), W.set_hash(one)
                new = size > 0 and sign not in had
                had.add(sign)
                counted = one[: np.searchsorted(one, _CUT)]
                rows = [(0, size, one)] if size <= SMALL else []
                if size >= low:
                    rows.append((1, len(counted), counted))
                    lack = size - (size * percent + 99) // 100 + 1 - len(counted)
                    if lack > 0:
                        rows.append((2, 0, one[len(counted): len(counted) + lack]))
                for i, (b, known, t) in enumerate(rows if new else rows[:1]):
                    ids.append(doc), texts.append(text), n.append(size), e.append(sign), main.append(i == 0), band.append(b)
                    u.append(known), toks.append(t ^ np.uint64(_BANDS[b]) if new else t[:0])
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(n, pa.int32()), pa.array(e, pa.int64()), pa.array(main, pa.bool_()),
                pa.array(band, pa.int32()), pa.array(u, pa.int32()),
                W.list_column(W.signed(np.concatenate(toks)) if toks else np.zeros(0, np.int64), [len(t) for t in toks]),
            ], names=["doc_id", "t", "n", "e", "main", "band", "u", "toks"])


_SCHEMA = "doc_id long, t long, n int, e long, main boolean, band int, u int, toks array<long>"


def _members(batches, k: int):
    had: set[int] = set()
    for batch in batches:
        for part in W.slices(batch, "text"):
            rows = [(sign, one) for one in distinct_shingles(part.column("text"), k)
                    if len(one) and (sign := W.set_hash(one)) not in had and not had.add(sign)]
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _ in rows], pa.int64()),
                    W.list_column(W.signed(np.concatenate([x for _, x in rows])), [len(x) for _, x in rows])],
                    names=["e", "members"])


def counted_prefix(index: DataFrame, percent: int) -> DataFrame:
    """(key, e): shared shingles within each set's prefix, the rarest counted ones first."""
    tokens = index.where(F.size("toks") > 0).select(F.explode("toks").alias("key"), "e", "n", "band", "u")
    shared = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # what is left are shingles of near copies and of common passages
    some = tokens.join(shared, "key").dropDuplicates(["key", "e"])
    ranked = some.selectExpr(
        "key", "e", "n", "band", "u",
        "row_number() over (partition by e, band order by df, key) as i",
        "count(1) over (partition by e, band) as s")
    return ranked.where(f"band = 2 or i <= {prefix_length('n', percent)} - (u - s)").select("key", "e")


def labelled(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(doc_id, t, n, label, component_id), a row per row of docs; t is the hash of the text, label null without shingles."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    index = scratch.keep(texts.mapInArrow(lambda it: _index(it, k, percent), _SCHEMA))
    rows = index.where("main").select("doc_id", "t", "n", "e")

    def fetch(wanted: DataFrame) -> DataFrame:
        ids = rows.join(wanted, "e").groupBy("e").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
        some = texts.drop("t").alias("t").join(ids.alias("i"), F.col("t.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi")
        sets = some.mapInArrow(lambda it: _members(it, k), "e long, members array<long>")
        return sets.join(wanted, "e", "left_semi").dropDuplicates(["e"])

    meets = in_shared_lists(scratch.keep(counted_prefix(index, percent)))
    label = groups(meets.select("e").distinct(), fetch, scratch, percent)
    classes = rows.where("n > 0").groupBy("e").agg(F.min("doc_id").alias("least"))
    in_group = classes.join(label, "e", "left").withColumn("label", F.coalesce("label", "e"))
    smallest = in_group.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = scratch.keep(in_group.join(smallest, "label").select("e", "label", "component_id"))
    return rows.join(of_set, "e", "left").select(
        "doc_id", "t", "n", F.when(F.col("n") > 0, F.col("label")).alias("label"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                    percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of docs."""
    found = labelled(docs, Scratch(docs.sparkSession), id_col, text_col, k, percent)
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each component one row with its smallest id, and one of those without an id.

    Rows are told apart by id and hash of the text, so an id that stands on several texts loses only
    those that are near copies; of rows that repeat both, one stays, the first as JSON.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep(labelled(docs, scratch, id_col, text_col, k, percent)
                         .groupBy("doc_id", "t", "label").agg(F.count(F.lit(1)).alias("rows")))
    first = (found.where("label is not null").groupBy("label", F.isnull("doc_id").alias("unnamed"))
             .agg(F.min(F.struct("doc_id", "t")).alias("first")))
    marks = scratch.keep(
        found.withColumn("unnamed", F.isnull("doc_id")).join(first, ["label", "unnamed"], "left")
        .withColumn("stays", F.isnull("label") | F.struct("doc_id", "t").eqNullSafe(F.col("first")))
        .where("not stays or rows > 1").select(F.col("doc_id").alias("mark_id"), F.col("t").alias("mark_t"), "stays"))
    named = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    key = F.col(f"c{docs.columns.index(id_col)}").cast("long"), F.xxhash64(f"c{docs.columns.index(text_col)}")
    marked = key[0].eqNullSafe(F.col("mark_id")) & (key[1] == F.col("mark_t"))
    once = named.join(marks, marked, "left_anti")
    repeated = (named.join(marks.where("stays"), marked, "left_semi").groupBy(key[0].alias("id"), key[1].alias("t"))
                .agg(F.min_by(F.struct(*named.columns), F.to_json(F.struct(*named.columns))).alias("row")))
    return once.unionAll(repeated.select("row.*")).toDF(*docs.columns)
