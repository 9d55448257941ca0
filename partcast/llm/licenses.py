r"""License scans: exact set-similarity join of text blocks with license templates.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z in small
letters; a block is a line, or a run of words over neighbouring lines (none of them
without words), as many as the template has and as it may miss: so wrapped
sentences are met.  A block holds a template when at least `percent`
per cent of the template's distinct words are in it.  Template words are ordered
by how often they occur in all texts, the rarest first: a block that holds the
template has one of the first words, as many as it could miss and one more
(prefix filter); a word further on leaves only what follows (positional filter);
a block of too few words can't hold it (length filter).  Survivors are
verified exactly, so every block that reaches the threshold is found.  Phrases,
whose words stand consecutively, are matched on the same words.

Two narrow passes over whole texts: frequencies of the template words (a row
per word and task), then the scan.

Defined results: null and empty texts have no words, no labels and score 0;
repeated rows are scanned each; other columns are not looked at.  The score is
1 with a phrase, else the largest share of a template in a block, 0 below the
threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partcast.llm import words as W

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Opening or naming sentences of common licenses.
TEMPLATES = {
    "licensed under the gnu general public license version 3": "gpl-3",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
}
PERCENT = 80


def _hash(text: str) -> np.ndarray:
    return W.hashes(W.split(pa.array([text]), W.MARKS))


def word_counts(docs: DataFrame, text_col: str, texts: list[str]) -> dict[int, int]:
    """How often each word of a few short texts occurs in all documents; a word that doesn't, is absent."""
    wanted = np.unique(np.concatenate([_hash(t) for t in texts]))

    def rows(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for part in W.slices(batch, "text"):
                h = W.hashes(W.split(part.column("text"), W.MARKS))
                slot = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                total += np.bincount(slot[wanted[slot] == h], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(W.signed(wanted)), pa.array(total)], names=["word", "n"])

    counts = (docs.select(F.col(text_col).alias("text")).mapInArrow(rows, "word long, n long")
              .groupBy("word").agg(F.sum("n").alias("n")).collect())
    return {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in counts}


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], counts: dict[int, int], percent: int) -> None:
        self.phrases = [(_hash(p), label) for p, label in phrases.items()]
        self.templates, self.prefix, self.percent = [], {}, percent
        for which, (text, label) in enumerate(templates.items()):
            span = -(-len(_hash(text)) * 100 // percent)
            order = sorted(set(_hash(text).tolist()), key=lambda h: (counts.get(h, 0), h))
            need = -(-len(order) * percent // 100)
            self.templates.append((frozenset(order), need, span, label))
            for i, h in enumerate(order[: len(order) - need + 1]):
                self.prefix.setdefault(h, []).append((which, len(order) - i))
        self.first = np.sort(np.array(list(self.prefix), np.uint64))

    def scan(self, column: pa.Array) -> list[tuple]:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
        w = W.split(column, W.MARKS)
        h = W.hashes(w)
        n = len(column)
        base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for phrase, label in self.phrases:
            at = np.arange(max(0, len(h) - len(phrase) + 1))
            for j, x in enumerate(phrase):
                at = at[h[at + j] == x]
            at = at[at + len(phrase) <= w.first[w.row[at] + 1]]
            for a in at.tolist():
                base[w.row[a]].append((a - int(w.first[w.row[a]]), label))
        more: list[dict[str, float]] = [{} for _ in range(n)]
        if len(self.first) and len(h):
            slot = np.minimum(np.searchsorted(self.first, h), len(self.first) - 1)
            feeds = np.concatenate([[0], np.cumsum(w.data == 10)])
            line = feeds[w.start]
            jump = np.ones(len(h), bool)
            jump[1:] = (w.row[1:] != w.row[:-1]) | (line[1:] - line[:-1] > 1)
            stretch, begins = np.cumsum(jump) - 1, np.append(np.flatnonzero(jump), len(h))
            tried = set()
            for a in np.flatnonzero(self.first[slot] == h).tolist():
                row = int(w.row[a])
                lo = int(np.searchsorted(line[w.first[row]: w.first[row + 1]], line[a], "left")) + int(w.first[row])
                hi = int(np.searchsorted(line[w.first[row]: w.first[row + 1]], line[a], "right")) + int(w.first[row])
                for which, rest in self.prefix[int(h[a])]:
                    template, need, span, label = self.templates[which]
                    if rest < need:
                        continue
                    held = 0
                    if (lo, which) not in tried and hi - lo >= need:
                        tried.add((lo, which))
                        held = len(template.intersection(h[lo:hi].tolist()))
                    left, right = max(int(begins[stretch[a]]), a - span + 1), min(int(begins[stretch[a] + 1]), a + span)
                    if (left < lo or right > hi) and right - left >= need:
                        near = h[left:right].tolist()
                        held = max(held, *(len(template.intersection(near[i: i + span])) for i in range(max(1, len(near) - span + 1))))
                    if held >= need:
                        more[row][label] = max(held / len(template), more[row].get(label, 0.0))
        out = []
        for row in range(n):
            places, plain = [p for p, _ in base[row]], {x for _, x in base[row]}
            score = 1.0 if plain else max(more[row].values(), default=0.0)
            out.append((int(w.count[row]), len(places), min(places, default=None), max(places, default=None),
                        ",".join(sorted(plain)), ",".join(sorted(plain | set(more[row]))), score))
        return out


NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
_KINDS = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None,
         templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row of docs."""
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    scanner = Scanner(phrases, templates, word_counts(docs, text_col, list(templates)), percent)

    def rows(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                got = scanner.scan(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array([g[i] for g in got], k) for i, k in enumerate(_KINDS))],
                    names=["doc_id", *NAMES])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
              "labels string, score double")
