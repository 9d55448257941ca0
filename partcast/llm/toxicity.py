"""Toxicity scores from a learned lexicon, met through Levenshtein automata.

The lexicon is learned from labelled texts: words, and stems with several
endings, whose texts are nearly all toxic and that stand in many different
contexts (copies of one text repeat the same few).  Its trie is intersected with
the Levenshtein automata of its terms into one table-driven automaton over
characters, which all words of a slice of texts run through at once.  A hit is
exact or has one or two typing errors, and stands inside quotation marks (two that
match, in one line, at most QUOTED words apart) or not; windows around hits tell a cluster from a lone mention.  A logistic model
over these counts gives the score.  Its prior counts on hits outside quotation,
so kinds of hit that the labelled rows don't show still weigh something.

Defined results: null and empty texts score what no evidence gives; a label
that is null is not used; of contradicting labels of one id toxic holds;
repeated rows score alike; other columns pass through `annotate` untouched and
are never looked at.

Bounds: fitted on at most max_rows labelled texts, those whose ids hash lowest;
at most max_terms terms.  Scoring reads every text whole in one narrow pass.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partcast.llm import words as W
from partcast.llm.scratch import Scratch

MAX_ROWS, MAX_TERMS, CANDIDATES = 20_000, 256, 5_000
THRESHOLD = 0.7
WINDOW = 10
_WORD = r"[\p{L}\p{N}]+"
_STEM = (3, 8)


class Term(NamedTuple):
    text: str
    stem: bool

    @property
    def edits(self) -> int:
        """Typing errors that are still taken for the term."""
        n = len(self.text) - self.stem
        return 2 if n >= 9 and not self.stem else 1 if n >= 5 else 0


class Automaton(NamedTuple):
    kinds: np.ndarray   #: class of each code point: 0 between words, 1 any other letter
    step: np.ndarray    #: state x class -> state; state 0 is dead, 1 the start
    edits: np.ndarray   #: least typing errors of a word that ends in the state, 9: none


def automaton(terms: list[Term]) -> Automaton:
    """The trie of terms intersected with their Levenshtein automata, made deterministic."""
    children: list[dict[str, int]] = [{}]
    ends: list[dict[bool, int]] = [{}]
    most = [0]
    for term in terms:
        at = 0
        most[0] = max(most[0], term.edits)
        for c in term.text:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({}), ends.append({}), most.append(0)
            at = children[at][c]
            most[at] = max(most[at], term.edits)
        ends[at][term.stem] = max(term.edits, ends[at].get(term.stem, 0))
    whole = -1  # behind a complete stem, whatever follows

    def closed(found: dict[int, int]) -> frozenset:
        """Adds letters left out, and keeps the fewest errors for each trie node."""
        todo = sorted(found, key=found.get)
        while todo:
            at = todo.pop(0)
            e = found[at]
            if at == whole:
                continue
            if True in ends[at] and e <= ends[at][True] and e < found.get(whole, 9):
                found[whole] = e
            for nxt in children[at].values():
                if e + 1 <= most[nxt] and e + 1 < found.get(nxt, 9):
                    found[nxt] = e + 1
                    todo.append(nxt)
        if whole in found:
            found = {at: e for at, e in found.items() if at == whole or e < found[whole]}
        return frozenset(found.items())

    letters = sorted({c for t in terms for c in t.text})
    states: dict[frozenset, int] = {frozenset(): 0, closed({0: 0}): 1}
    todo, table = [s for s in states if s], [[0] * (len(letters) + 2)]
    while todo:
        state = todo.pop(0)
        row = [0]
        for c in [None, *letters]:
            found: dict[int, int] = {}

            def reach(at: int, e: int) -> None:
                if e <= (2 if at == whole else most[at]) and e < found.get(at, 9):
                    found[at] = e

            for at, e in state:
                if at == whole:
                    reach(whole, e)
                    continue
                reach(at, e + 1)
                for letter, nxt in children[at].items():
                    reach(nxt, e + (letter != c))
            key = closed(found)
            if key not in states:
                states[key] = len(states)
                todo.append(key)
            row.append(states[key])
        table.append(row)
    edits = np.full(len(states), 9, np.uint8)
    for state, i in states.items():
        edits[i] = min([9, *(e for at, e in state if at == whole or e <= ends[at].get(False, -1))])
    kinds = np.zeros(0x110000, np.uint8)
    kinds[[i for i in range(0x110000) if chr(i).isalnum()]] = 1
    for i, c in enumerate(letters):
        kinds[ord(c)] = i + 2
    return Automaton(kinds, np.array(table, np.int32), edits)


#: Each closing mark and what it closes; U+201C opens where there is no U+201E to close.
_CLOSES = {"”": "“„", "“": "„", "»": "«", '"': '"'}
_OPEN, QUOTED = '“«„"', 100
FEATURES = ("exact", "one error", "two errors", "quoted", "in one window", "share")
#: Prior of the model: log odds without evidence, and for each feature.
PRIOR = np.array([-3.0, 3.0, 1.5, 0.5, 0.0, 0.3, 0.5])


def _quotations(points: np.ndarray, start: np.ndarray, spots: np.ndarray) -> tuple[list[int], list[int]]:
    """Where matching marks stand, opening and closing, in the lines that hold spots; start: where words begin."""
    feeds = np.flatnonzero(points == 10)
    marks = np.flatnonzero(np.isin(points, [ord(c) for c in {*_CLOSES, *_OPEN}]))
    lines = np.searchsorted(feeds, marks)
    here = np.isin(lines, np.searchsorted(feeds, spots))
    opened, closed, waiting, last = [], [], [], -1
    for at, line, words in zip(marks[here].tolist(), lines[here].tolist(), np.searchsorted(start, marks[here]).tolist()):
        if line != last:
            waiting, last = [], line
        mark = chr(points[at])
        opens = closes = True
        if mark == '"':
            # by what stands on either side: an inch mark opens nothing
            before, behind = chr(points[at - 1]) if at else " ", chr(points[at + 1])
            opens, closes = not behind.isspace() and not before.isalnum(), not before.isspace() and not behind.isalnum()
            opens, closes = (opens, closes) if opens != closes else (True, True)
        match = next((i for i in range(len(waiting) - 1, -1, -1) if closes and waiting[i][0] in _CLOSES.get(mark, "")), None)
        if match is not None:
            if words - waiting[match][2] <= QUOTED:
                opened.append(waiting[match][1]), closed.append(at)
            del waiting[match:]
        elif opens and mark in _OPEN:
            waiting.append((mark, at, words))
    return opened, closed


def features(texts: list[str | None], a: Automaton) -> np.ndarray:
    """A row per text: what FEATURES names."""
    low = [(t or "").lower() for t in texts]
    joined = "\n".join(low) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    kind = a.kinds[points]
    inside = kind > 0
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    state = np.ones(len(start), np.int32)
    live = np.arange(len(start))
    place = start.copy()
    while len(live):
        state[live] = a.step[state[live], kind[place]]
        place = place + 1
        on = (place < end[live]) & (state[live] > 0)
        live, place = live[on], place[on]
    edits = a.edits[state]
    hit = np.flatnonzero(edits < 9)
    row = np.searchsorted(at, start[hit], "right") - 1
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    if len(hit):
        opened, closed = _quotations(points, start, start[hit])
        quoted = np.searchsorted(np.sort(opened), start[hit]) > np.searchsorted(np.sort(closed), start[hit])
        free = ~quoted
        for i in range(3):
            out[:, i] = np.log1p(np.bincount(row[free & (edits[hit] == i)], minlength=n))
        out[:, 3] = np.log1p(np.bincount(row[quoted], minlength=n))
        # words of different texts never share a window: shift each text's out of reach
        spot = hit + row * (2 * WINDOW + 1)
        near = np.searchsorted(spot, spot + WINDOW, "right") - np.searchsorted(spot, spot - WINDOW, "left") - 1
        np.maximum.at(out[:, 4], row[free], np.log1p(near[free]))
        words = np.bincount(np.searchsorted(at, start, "right") - 1, minlength=n)
        out[:, 5] = 100 * np.bincount(row[free], minlength=n) / np.maximum(words, 20)
        out[:, 5] = np.log1p(out[:, 5])
    return out


class Model(NamedTuple):
    terms: list[Term]
    automaton: Automaton
    weights: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = features(texts, self.automaton) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, spread: float = 2.0) -> np.ndarray:
    """Most likely weights under a normal prior around PRIOR, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + (w - PRIOR) / spread**2
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / spread**2
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-9:
            break
    return w


def _contexts(batches, words: frozenset, stems: frozenset):
    """(term, before): the word that precedes each candidate in toxic texts."""
    longest = _STEM[1]
    word = re.compile(r"[^\W_]+")
    for batch in batches:
        found = set()
        for text in batch.column("text").to_pylist():
            last = ""
            for w in word.findall((text or "").lower()):
                if w in words:
                    found.add((w, False, last))
                for k in range(_STEM[0], min(longest, len(w)) + 1):
                    if w[:k] in stems:
                        found.add((w[:k], True, last))
                last = w
        found = sorted(found)
        yield pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_()),
            pa.array([f[2] for f in found], pa.string())], names=["term", "stem", "before"])


def _lexicon(train: DataFrame, max_terms: int) -> list[Term]:
    totals = train.agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("n")).first()
    if not totals["a"]:
        return []
    least = max(5, totals["a"] // 100)
    words = (train.select("toxic", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)))).alias("w"))
        .groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")))
    stems = (words.where(F.length("w") >= _STEM[0])
             .select("a", "b", F.explode(F.transform(F.sequence(F.lit(_STEM[0]), F.least(F.length("w"), F.lit(_STEM[1]))),
                                                     lambda k: F.col("w").substr(F.lit(1), k))).alias("w"))
             .groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))

    def best(df: DataFrame) -> dict[str, int]:
        rows = df.where((F.col("a") >= least) & (F.col("b") <= 0.02 * F.col("a"))).orderBy(F.desc("a"), "w").limit(CANDIDATES)
        return {r["w"]: r["a"] for r in rows.collect()}

    word_a, stem_a = best(words), best(stems)
    sets = frozenset(word_a), frozenset(stem_a)
    seen = (train.where("toxic = 1").select("text")
            .mapInArrow(lambda it: _contexts(it, *sets), "term string, stem boolean, before string").distinct()
            .groupBy("term", "stem").count().where(F.col("count") >= least).collect())
    wide = {(r["term"], r["stem"]) for r in seen}
    stem_a = {s: a for s, a in stem_a.items() if (s, True) in wide}
    word_a = {w: a for w, a in word_a.items() if (w, False) in wide}
    terms: list[Term] = []
    for s in sorted(stem_a, key=lambda s: (len(s), s)):
        if any(t.text == s[: len(t.text)] for t in terms):
            continue
        # on to the longest beginning that nearly all of it shares, or to the one word that it is
        while True:
            longer = max((x for x in stem_a if len(x) == len(s) + 1 and x.startswith(s)), key=stem_a.get, default=None)
            if longer is None or stem_a[longer] < 0.95 * stem_a[s]:
                break
            s = longer
        one = max((w for w in word_a if w.startswith(s)), key=word_a.get, default=None)
        terms.append(Term(one, False) if one and word_a[one] >= 0.9 * stem_a[s] else Term(s, True))
    covered = tuple(t.text for t in terms if t.stem)
    terms += [Term(w, False) for w in word_a if not w.startswith(covered) and Term(w, False) not in terms]
    weight = lambda t: -(stem_a if t.stem else word_a)[t.text]
    return sorted(set(terms), key=lambda t: (weight(t), t.text))[:max_terms]


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = MAX_ROWS,
        max_terms: int = MAX_TERMS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic), the training rows only."""
    chosen = (labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    # at most max_rows rows of two numbers
    train = scratch.keep(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                         .where("text is not null").dropDuplicates(["text"]).select("text", "toxic"))
    terms = _lexicon(train, max_terms)
    made = automaton(terms)

    def rows(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                x = features(part.column("text").to_pylist(), made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[:, i]) for i in range(x.shape[1])] + [part.column("toxic").cast(pa.float64())],
                    names=[f"f{i}" for i in range(x.shape[1])] + ["y"])

    schema = ", ".join([f"f{i} double" for i in range(len(FEATURES))] + ["y double"])
    table = np.array([tuple(r) for r in train.mapInArrow(rows, schema).collect()], float).reshape(-1, len(FEATURES) + 1)
    table = table[np.lexsort(table.T)]
    return Model(terms, made, _logistic(table[:, :-1], table[:, -1]) if len(table) else PRIOR)


def annotate(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each text added, in one narrow pass."""
    score, names = model.score, docs.columns

    def rows(batches):
        for batch in batches:
            batch = batch.rename_columns([str(i) for i in range(len(names))])
            for part in W.slices(batch, str(names.index(text_col))):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(score(part.column(names.index(text_col)).to_pylist()), pa.float64())],
                    names=[*names, score_col])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """The fold that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
