"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of words (small letters, digits and
everything beyond ASCII).  Runs of k words that both have are the seeds, found
with Karp-Rabin hashes over all places of all texts at once.  Seeds on one
diagonal join to maximal matches; the longest is marked again and again, matches
that run into a mark being cut to what is free, until none of k words is left.
The share of an item's words under such tiles counts, in whatever order they
stand in the text.

The items go to the tasks in blocks of at most block_words words, a pass over
the texts for each block: one pass for any usual benchmark, and never more than
a block in memory.  Passes are narrow; no text is moved.

Defined results: null and empty texts or items match nothing; an item of fewer
than k words has to stand in a text in one piece; repeated rows give repeated
results; repeated items are reported each; other columns are not looked at and
pass through `clean`.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm import words as W
from partcast.llm.scratch import Scratch

K, COVERAGE = 5, 0.8
BLOCK_WORDS = 1_000_000


class Seeds:
    """The k-grams of a block of items, by their hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], k: int) -> None:
        self.items, self.k = items, k
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for which, (_, h) in enumerate(items):
            size = min(k, len(h))
            for j, g in enumerate(W.grams(h, size).tolist() if size else ()):
                self.places[size][g].append((which, j))
        self.places = {size: dict(x) for size, x in self.places.items()}
        self.sorted = {size: np.sort(np.array(list(x), np.uint64)) for size, x in self.places.items()}
        self.top = {}
        for size, values in self.sorted.items():
            table = np.zeros(1 << 16, bool)
            table[(values >> np.uint64(48)).astype(np.int64)] = True
            self.top[size] = table

    def found(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of h where one of the grams begins, and that gram."""
        g = W.grams(h, size)
        at = np.flatnonzero(self.top[size][(g >> np.uint64(48)).astype(np.int64)])
        values = self.sorted[size]
        slot = np.minimum(np.searchsorted(values, g[at]), len(values) - 1)
        at = at[values[slot] == g[at]]
        return at, g[at]


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (text place, item place, words) of non-overlapping matches, the longest first."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    text, item, out = set(), set(), []
    while heap:
        n, i, j = heapq.heappop(heap)
        free = [x for x in range(-n) if i + x not in text and j + x not in item]
        if len(free) == -n:
            out.append((i, j, -n))
            text.update(range(i, i - n))
            item.update(range(j, j - n))
            continue
        begin = 0
        for x in range(1, len(free) + 1):
            if x == len(free) or free[x] != free[x - 1] + 1:
                if x - begin >= least:
                    heapq.heappush(heap, (begin - x, i + free[begin], j + free[begin]))
                begin = x
    return out


def _runs(seeds: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Seeds (text place, item place) joined along diagonals."""
    out, last = [], None
    for d, i in sorted((i - j, i) for i, j in seeds):
        if last and last[0] == d and i == last[1] + last[2] - size + 1:
            last[2] += 1
        else:
            last = [d, i, size]
            out.append(last)
    return [(i, i - d, n) for d, i, n in out]


def matched(column: pa.Array, seeds: Seeds, coverage: float) -> Iterator[tuple[int, int, float, list]]:
    """(row, item, share of the item's words under tiles, tiles) where the share is large enough."""
    w = W.split(column, W.MARKS)
    h = W.hashes(w)
    met: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for size, places in seeds.places.items():
        at, gram = seeds.found(h, size)
        inside = at + size <= w.first[w.row[at] + 1]
        for at, gram in zip(at[inside].tolist(), gram[inside].tolist()):
            row = int(w.row[at])
            for which, j in places[gram]:
                met[row, which].append((at - int(w.first[row]), j))
    for (row, which), pairs in sorted(met.items()):
        item, words = seeds.items[which]
        size = min(seeds.k, len(words))
        got = tiles(_runs(pairs, size), size)
        share = sum(n for _, _, n in got) / len(words)
        if share >= coverage:
            yield row, item, share, got


def blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word hashes, at most limit words (or one item) at a time."""
    now, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator():
        h = W.hashes(W.split(pa.array([r["t"]], pa.string()), W.MARKS))
        if now and size + len(h) > limit:
            yield now
            now, size = [], 0
        now.append((r["i"], h))
        size += len(h)
    yield now


_HITS = "doc_id long, item_id long, coverage double, tiles array<struct<text_word:int,item_word:int,words:int>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", k: int = K, coverage: float = COVERAGE,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) for each text and item whose coverage is reached."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("text_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))

    def one(items):
        seeds = Seeds(items, k)

        def rows(batches):
            for batch in batches:
                for part in W.slices(batch, "text"):
                    ids = part.column("doc_id")
                    got = list(matched(part.column("text"), seeds, coverage))
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array([r for r, *_ in got], pa.int64())), pa.array([g[1] for g in got], pa.int64()),
                        pa.array([g[2] for g in got], pa.float64()),
                        pa.array([[dict(zip(("text_word", "item_word", "words"), t)) for t in g[3]] for g in got], kind)],
                        names=["doc_id", "item_id", "coverage", "tiles"])
        return texts.mapInArrow(rows, _HITS)

    out, scratch = None, Scratch(docs.sparkSession)
    for items in blocks(benchmark, item_col, "text", block_words):
        # a second block is only read when the first one's results are written
        out = one(items) if out is None else scratch.keep(out).unionByName(one(items))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", k: int = K,
          coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that hold a benchmark item, all columns kept."""
    at, out = docs.columns.index(text_col), docs

    def one(df, items):
        seeds = Seeds(items, k)

        def rows(batches):
            for batch in batches:
                plain = batch.rename_columns([str(i) for i in range(batch.num_columns)])
                for part in W.slices(plain, str(at)):
                    stays = np.ones(part.num_rows, bool)
                    stays[[g[0] for g in matched(part.column(at), seeds, coverage)]] = False
                    yield part.filter(pa.array(stays)).rename_columns(batch.schema.names)
        return df.mapInArrow(rows, docs.schema)

    scratch = Scratch(docs.sparkSession)
    for n, items in enumerate(blocks(benchmark, item_col, "text", block_words)):
        out = one(scratch.keep(out) if n else out, items)
    return out
