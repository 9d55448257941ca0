"""Operators on documents against brute force, on the small tables and on odd rows."""

import math
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partcast.llm import decontaminate, licenses, linking, mixing, ngram_join, paragraphs, suffixes, toxicity
from partcast.llm import queries as q
from partcast.llm.components import components
from partcast.llm.scratch import Scratch
from tests.llm.conftest import PASSAGE, ROWS, words

SPACED, MARKED = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(words):
    return frozenset(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def linked(sets):
    """{id: set} -> {id: smallest id reachable}, over all pairs that share a shingle."""
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter(p for h in holders.values() for p in combinations(sorted(h), 2))
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def rows_of(spark, sf, name):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", *name).collect()]


def test_ngram_jaccard_matches_all_pairs(spark, sf):
    sets = {i: shingles(re.findall(SPACED, low(t))) for i, t in rows_of(spark, sf, ["text"])}
    want = linked(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q.op3_ngram_jaccard(spark, sf).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert len(set(want.values())) < len(want)


def test_ngram_jaccard_odd_rows(docs, no_docs):
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got[(2, 57, 1)] == 2 and got[(1, 56, 1)] == 1
    assert {(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 6), (11, 66, 11), (None, 66, 11)} <= set(got)
    assert sum(got.values()) == len(ROWS)
    assert ngram_join.near_duplicates(no_docs).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, None, 8, 9, 10, 11}


def test_licenses_match_regular_expressions(spark, sf):
    texts = dict(rows_of(spark, sf, ["text"]))
    got = {r.doc_id: r for r in q.op2_licenses(spark, sf).collect()}
    assert got.keys() == texts.keys()
    labelled = 0
    for i, t in texts.items():
        w = re.findall(MARKED, low(t))
        base = [(a, label) for p, label in licenses.PHRASES.items() for a in range(len(w))
                if w[a: a + len(p.split())] == p.split()]
        more, score = set(), 0.0
        for line in low(t).split("\n"):
            have = set(re.findall(MARKED, line))
            for p, label in licenses.TEMPLATES.items():
                need = set(p.split())
                share = len(need & have) / len(need)
                if 100 * len(need & have) >= 80 * len(need):
                    more.add(label)
                    score = max(score, share)
        r, plain = got[i], {x for _, x in base}
        places = [a for a, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(base), min(places, default=None), max(places, default=None))
        assert (r.base_labels, r.labels) == (",".join(sorted(plain)), ",".join(sorted(plain | more)))
        assert r.score == pytest.approx(1.0 if plain else score)
        labelled += bool(more)
    assert labelled


def test_licenses_odd_rows(spark, docs, no_docs):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[3].n_words, got[3].labels, got[3].score) == (0, "", 0.0) and got[10].n_words == 5
    assert licenses.scan(no_docs).count() == 0
    one = spark.createDataFrame([(1, "Under the MIT. license; under THE mit-license")], "doc_id long, text string")
    r = licenses.scan(one).first()
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (2, 0, 4, "mit")


def test_mixing_meets_targets(spark, sf):
    rows = rows_of(spark, sf, ["source", "text"])
    size = {i: len(re.findall(SPACED, t or "")) for i, _, t in rows}
    source = {i: s for i, s, _ in rows}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(total))}
    target, free, rest = {}, set(total), 1.5 * sum(total.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        target |= {s: 2 * total[s] for s in over} if over else {s: level * weight[s] for s in free}
        free -= over or free
        rest -= sum(2 * total[s] for s in over)
    got = q.op5_mixing(spark, sf).collect()
    again = q.op5_mixing(spark, sf).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[source[r.doc_id]] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(target[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 50 for s in total)


def test_mixing_odd_rows(docs, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and {r.taken for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert {r.source_size for r in got if r.doc_id in (3, None)} == {70}
    assert mixing.mix(no_docs).count() == 0


def brute_coverage(text, item, k=5):
    """Greedy string tiling by trying every place."""
    a, b, free_a, free_b, done = text, item, [True] * len(text), [True] * len(item), 0
    k = min(k, len(b))
    while k:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            break
        free_a[i: i + n] = free_b[j: j + n] = [False] * n
        done += n
    return done / len(b) if b else 0.0


def test_decontamination_tiles(spark, docs, no_docs):
    x, y, z = "a b c d e f g h", "i j k l m n o p", "q r s t u v"
    texts = [(1, f"0 {y} 1 2 {x} 3"), (2, f"{x} 9 {z}"), (3, None), (4, ""), (5, "hi there"), (6, f"{x} {x} {y[:7]}"),
             (7, "A b! C d e f, g h I j k l m n o p"), (7, "zz " * 3000 + f"{y} {x}")]
    items = [(1, f"{x} {y}"), (2, "hi there"), (3, None), (4, ""), (5, f"{x} {z} {y}"), (1, f"{x} {y}")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, k) for i, t in texts for k, p in items
                   if p and brute_coverage(re.findall(MARKED, low(t))[-40:], p.split()) >= 0.8)
    assert (1, 1) in want and (5, 2) in want and (7, 1) in want and (6, 1) not in want
    for limit in (decontaminate.BLOCK_WORDS, 10):
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b, block_words=limit).collect())
        assert got == want
        assert {r.doc_id for r in decontaminate.clean(d, b, block_words=limit).collect()} == {2, 3, 4, 6}
    assert decontaminate.contaminated(no_docs, b).count() == 0 and decontaminate.clean(docs, b.limit(0)).count() == len(ROWS)


def test_decontamination_finds_planted(spark, sf):
    docs = rows_of(spark, sf, ["text"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {(i, k) for i, t in docs for k, p in items if p in t}
    assert whole <= {(r.doc_id, r.item_id) for r in q.op8_decontamination(spark, sf).collect()}


def repeated_windows(texts, n=50):
    """{id: words that stand in a window of n words which another place has too, one that doesn't overlap it}."""
    seen = places_of(texts, n)
    out = defaultdict(set)
    for places in seen.values():
        for i, a in places:
            if (i, a) != places[0] and (i != places[0][0] or a >= places[0][1] + n) or places[-1] >= (i, a + n):
                out[i].update(range(a, a + n))
    return out


def spans_of(rows, name):
    return {r.doc_id: {x for s in r[name] for x in range(s.start, s.end)} for r in rows}


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_paragraphs_find_repeated_windows(spark, scale):
    """Against all windows of 50 words: texts, words, and how much is found that shorter windows don't explain."""
    texts = {i: re.findall(SPACED, low(t)) for i, t in rows_of(spark, f"/root/testdata/sf{scale}", ["text"])}
    got = spans_of(q.op9_substring(spark, f"/root/testdata/sf{scale}").collect(), "repeated")
    want, some = repeated_windows(texts), repeated_windows(texts, 30)
    assert len(got.keys() & want.keys()) >= 0.97 * len(want)
    print("recall of texts and words", len(got.keys() & want.keys()) / len(want), sum(len(got.get(i, set()) & w) for i, w in want.items()) / sum(map(len, want.values())))
    assert sum(len(got.get(i, set()) & w) for i, w in want.items()) >= 0.95 * sum(map(len, want.values()))
    assert len(got.keys() - some.keys()) <= 0.01 * len(got) and want


def test_paragraphs_keep_one_copy_of_each(spark):
    """Passages inside lines, over lines and with a few changed words: one copy stays whole, the others go."""
    p, near = [f"p{i}" for i in range(90)], [f"n{i}" for i in range(120)]
    changed = [w + "x" if i == 60 else w for i, w in enumerate(near)]
    own = {i: [f"x{i}_{j}" for j in range(80)] for i in range(1, 7)}
    texts = {1: own[1][:40] + p + own[1][40:], 2: own[2] + p, 3: own[3] + p, 4: own[4] + near, 5: own[5] + changed, 6: ["a", "b"] * 300}
    text = {i: " ".join(w) for i, w in texts.items()}
    text[3] = " ".join(own[3]) + "\n" + "\n".join(" ".join(p[a: a + 30]) for a in (0, 30, 60))
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string").repartition(3)
    rows = paragraphs.repeats(docs).collect()
    gone = spans_of(rows, "removed")
    assert not gone[1] and not gone[4]
    for i in (2, 3):
        assert gone[i] <= set(range(80, 170)) and len(gone[i]) >= 90 - 2 * paragraphs.WINDOW
    assert gone[5] <= set(range(80, 200)) and len(gone[5]) >= 80
    assert 400 < len(gone[6]) < 600
    out = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect()}
    assert out[1] == text[1] and out[4] == text[4] and out[3].startswith(" ".join(own[3]))


def test_paragraphs_reach_the_end_of_a_text(spark):
    """Passages of 50 words and a few more, at the end of a text or all of it, leave fewer words than a whole paragraph."""
    texts, size = {}, {}
    for n in range(1, 121):
        p = [f"p{n}_{i}" for i in range(50 + n % 5)]
        a, b = ([f"{x}{n}_{i}" for i in range(60)] for x in "ab")
        texts[n], texts[1000 + n] = a[:30] + p + a[30:], p if n % 2 else b + p
        size[1000 + n] = len(p)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    gone = spans_of(paragraphs.repeats(docs).collect(), "removed")
    assert sum(bool(gone.get(i)) for i in size) >= 0.98 * len(size) and not any(gone.get(n) for n in range(1, 121))
    for i, w in gone.items():
        assert w <= set(range(len(texts[i]) - size.get(i, 0), len(texts[i])))
    out = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect()}
    assert all(len(out[i].split()) == len(texts[i]) - len(w) for i, w in gone.items())


def test_paragraph_bands_are_tuned():
    for percent, recall, hashes in ((80, 0.99, 24), (80, 0.95, 24), (50, 0.9, 60), (100, 0.5, 4)):
        bands, rows = paragraphs.tune(percent, recall, hashes)
        assert bands * rows <= hashes and 1 - (1 - (percent / 100) ** rows) ** bands >= recall
        assert percent == 100 or (rows + 1) * -(-math.log1p(-recall) // math.log1p(-(percent / 100) ** (rows + 1))) > hashes
    with pytest.raises(ValueError):
        paragraphs.tune(10, 0.999, 8)
    rng, sets = np.random.default_rng(7), paragraphs.Sets(5, 41, 15, 8, *paragraphs.tune(80, 0.99, 24))
    base = rng.integers(0, 1 << 63, (400, 45), dtype=np.uint64)
    other = np.concatenate([base[:, :40], rng.integers(0, 1 << 63, (400, 5), dtype=np.uint64)], axis=1)   # Jaccard 40 / 50
    assert (sets.keys(base, base[:, 0]) == sets.keys(other, base[:, 0])).any(axis=1).mean() >= 0.97


def test_paragraph_repeats_odd_rows(docs, no_docs):
    out = paragraphs.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[1] == PASSAGE and len(text[2].split()) <= 30 and PASSAGE not in text[8] and len(text[8].split()) <= 90
    assert len(text[None].split()) == 70 and len(text[11].split()) <= 30 and text[3] is None and text[9] == words(1000, 40000)
    assert paragraphs.repeats(no_docs).count() == 0 and paragraphs.without_repeats(no_docs).count() == 0


def test_suffix_repeats_match_all_windows(spark, sf):
    """A text with a window of 50 words that another place has too is reported, and no other word is."""
    words = {i: re.findall(SPACED, low(t)) for i, t in rows_of(spark, sf, ["text"])}
    seen = Counter(tuple(w[a: a + 50]) for w in words.values() for a in range(len(w) - 49))
    want = {}
    for i, w in words.items():
        hit = set()
        for a in range(len(w) - 49):
            if seen[tuple(w[a: a + 50])] > 1:
                hit.update(range(a, a + 50))
        if hit:
            want[i] = hit
    got = {r.doc_id: {x for s in r.repeated for x in range(s.start, s.end)} for r in q.op10_suffixes(spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] <= want[i] for i in want)
    assert sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values()))


def test_suffix_repeats_odd_rows(docs, no_docs):
    got = {r.doc_id: r for r in suffixes.repeats(docs).collect()}
    assert got.keys() == {1, 2, 8, None, 11}
    assert got[1].removed_words == 0 and got[2].removed_words == 60 and got[8].removed_words == 60
    assert (got[None].removed_words, got[11].removed_words) == (0, 70)
    assert suffixes.repeats(no_docs).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = [toxicity.Term("idiot", False), toxicity.Term("worthless", False), toxicity.Term("bad", False), toxicity.Term("lowei", True)]
    made = toxicity.automaton(terms)
    for word in ("idiot idiots idot iddiot xdiot idxot odiit bad bat worthless wrthles worthlessxxx loweiabc lowei lowea "
                 "xlowei wortlhess id ß wworthlesss lo").split():
        state = 1
        for c in word:
            state = made.step[state, made.kinds[ord(c)]]
        want = [9]
        for t in terms:
            d = min(distance(word[:k], t.text) for k in range(len(word) + 1)) if t.stem else distance(word, t.text)
            if d <= t.edits:
                want.append(d)
        assert made.edits[state] == min(want), word


def test_toxicity_held_out_and_odd_rows(spark, docs, no_docs):
    sf = "/root/testdata/sf0.01"
    scored = q.op1_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = scored.join(labels, "doc_id").where("held_out").collect()
    clean, toxic = [r.score for r in both if not r.toxic], [r.score for r in both if r.toxic]
    auc = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.85 and sum(r.predicted for r in both if not r.toxic) <= 0.02 * len(clean)
    assert scored.count() == scored.where("score between 0 and 1").count() == 1000
    model = q.toxic_model(spark, no_docs.select("doc_id", "text"), sf)
    assert model.terms == [] and toxicity.annotate(no_docs, model, score_col="s").count() == 0
    assert toxicity.annotate(docs, model, score_col="s").where("s is null").count() == 0
    terms = [toxicity.Term("idiot", False)]
    model = toxicity.Model(terms, toxicity.automaton(terms), toxicity.PRIOR)
    plain, quoted, wrong, none = model.score(["you idiot, an idiot", 'he wrote "you idiot, an idiot"', "you idi0t, an idiiot", None])
    assert plain > wrong > none and plain > quoted


def test_pipeline_stages_on_odd_rows(spark, docs, no_docs, sf):
    for table in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, sf)
            if name != "mixing":
                assert out.columns == table.columns
            assert out.count() <= table.count()


def test_pipeline_is_its_stages(spark, sf):
    kept = corpus_pipeline.run(spark, sf)
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    assert {"doc_id", "size", "target", "taken"} <= set(kept.columns)
    groups = q.op3_ngram_jaccard(spark, sf).select("doc_id", "component_id").toDF("doc_id", "group")
    assert kept.join(groups, "doc_id").groupBy("group").count().where("count > 1").isEmpty()
    leaks = {r.doc_id for r in q.op8_decontamination(spark, sf).collect()}
    toxic = {r.doc_id for r in q.op1_toxicity(spark, sf).where("predicted = 1").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & toxic and len(ids) > 0.6 * texts.count() and len(ids & leaks) <= len(leaks) // 2
    assert kept.agg(F.sum("taken")).first()[0] > 0


@pytest.mark.parametrize("edges", [
    [], [(3, 3)], [(7, i) for i in range(8, 40)], [(i, i + 1) for i in range(60)],
    [(i * 37 % 101, i * 53 % 89) for i in range(90)], [(1, 2), (2, 1), (1, 2), (5, 4), (4, -3)]])
def test_components_match_union_find(spark, edges):
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    want = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    rows = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert len(rows) == len(want) and {r["node"]: r["label"] for r in rows} == want


def places_of(texts, n=50):
    """{window: [(id, place)]} of all windows of n words."""
    at = defaultdict(list)
    for i, w in sorted(texts.items()):
        for a in range(len(w) - n + 1):
            at[tuple(w[a: a + n])].append((i, a))
    return at


def untouched(texts, removed, n=50):
    """Whether each repeated window has a place that no removed word touches."""
    return all(len(p) < 2 or any(not removed[i] & set(range(a, a + n)) for i, a in p) for p in places_of(texts, n).values())


def test_suffix_repeats_leave_a_copy_of_each_window(spark):
    def run(name, n):
        return [f"{name}{i}" for i in range(n)]
    p, r = run("p", 60), run("r", 60)
    # 1 and 2 share p, 2 and 3 share r: 1 holds no r; 4 repeats itself; 5 and 6 share p's end with new words behind
    texts = {1: p, 2: p + r, 3: run("x", 5) + r, 4: ["a", "b"] * 400, 5: p[5:] + r[:55] + run("y", 9), 6: run("z", 3) + p[5:] + r[:55]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    removed = defaultdict(set)
    for row in suffixes.repeats(docs).collect():
        removed[row.doc_id] = {x for s in row.removed for x in range(s.start, s.end)}
    assert untouched(texts, removed)
    assert removed[3] == set(range(5, 65)) and not removed[1] and len(removed[4]) == 800 - 51


def test_suffix_repeats_meet_past_other_left_contexts(spark):
    """Copies of a passage are found though many texts share only its end."""
    p = [f"p{i}" for i in range(50)]
    texts = {1: p + ["end1"], 99: p + ["end99"]} | {i: [f"x{i}"] * 60 + p[1:] + [f"end{i}"] for i in range(2, 42)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: {x for s in r.repeated for x in range(s.start, s.end)} for r in suffixes.repeats(docs).collect()}
    assert {1, 99} <= got.keys() and got[1] == got[99] == set(range(50))


def test_pipeline_takes_out_passages_across_lines(spark, sf):
    """A repeated passage inside longer lines, or over several short ones, stays once."""
    p = [f"p{i}" for i in range(60)]
    own = {i: [f"x{i}_{j}" for j in range(80)] for i in range(1, 4)}
    texts = {1: " ".join(own[1][:40] + p + own[1][40:]), 2: "é " + " ".join(own[2] + p) + "\nend",
             3: " ".join(own[3]) + "\n" + "\n".join(" ".join(p[a: a + 20]) for a in (0, 20, 40))}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, docs, sf).collect()}
    assert out[1] == texts[1]
    for i in (2, 3):  # what may stay of the passage is less than a paragraph at either end
        left = [w for w in out[i].split() if w in p]
        assert len(left) <= 2 * paragraphs.WINDOW and [w for w in out[i].split() if w not in p] == [w for w in texts[i].split() if w not in p]


def test_one_of_each_counts_rows(spark):
    """One row of each component, by id and text; one more where rows have no id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "s"), (1, a, "s"), (1, a, "r"), (2, a + " more", "s"), (2, b, "s"), (3, a, "s"), (4, "", "s"), (4, "", "s"),
            (5, b + " x", "s"), (5, b + " y", "s"), (None, c, "s"), (None, c + " x", "s"), (None, c, "s"), (6, None, "s"),
            (7, c + " a b", "s"), (7, c + " a", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [(r.doc_id, (r.text or "-")[0], r.source) for r in ngram_join.one_of_each(docs).collect()]
    assert Counter(got) == Counter([(1, "a", "r"), (2, "b", "s"), (4, "-", "s"), (None, "c", "s"), (6, "-", "s"), (7, "c", "s")])


def test_toxicity_quotation_is_two_matching_marks():
    made = toxicity.automaton([toxicity.Term("idiot", False)])
    texts = ['a 19" screen, you idiot', 'he said „so“ and you idiot', '"unclosed, you idiot', 'a 19" one, a 21" one, you idiot',
             'said "so\nyou idiot" ', "“so” idiot ” x", 'he said "so", you idiot, "he said"', '"' + "x " * 200 + 'idiot"',
             'x “idiot” y', 'x „idiot“ y', 'x „idiot” y', 'x «idiot» y', 'a 19" tv: "you idiot"', '" idiot "', '("idiot")', 'so “a „idiot“ b”']
    got = toxicity.features(texts, made)
    assert [bool(x[3]) for x in got] == [False] * 8 + [True] * 8 and [bool(x[0]) for x in got] == [True] * 8 + [False] * 8


def test_licenses_wrapped_over_lines(spark):
    bsd = " * Redistribution and use in source and binary forms, with or without\r\n * modification, are permitted provided"
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy"
    apart = bsd.replace("\r\n", "\n\n")
    texts = [(1, bsd), (2, mpl), (3, apart), (4, "Released under\nthe MIT\nlicense"), (5, "x\n" + mpl.replace("\n", " ") + "\ny")]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("bsd", 1.0), 2: ("mpl-2", 1.0), 3: ("", 0.0), 4: ("mit", 1.0), 5: ("mpl-2", 1.0)}


def test_crowded_bands_lose_no_link_and_ask_few_pairs(spark, monkeypatch):
    """One list of 400 sets with two changed fifths each: all links as over all pairs, without asking for all pairs."""
    rng, asked = np.random.default_rng(3), []
    sets = {}
    for e in range(0, 800, 2):
        m = list(range(37))
        for block in rng.choice(7, 2, replace=False).tolist():
            m[block * 5: block * 5 + 5] = (1000 + 1000 * int(rng.integers(30)) + np.arange(block * 5, block * 5 + 5)).tolist()
        sets[e] = m
        if e % 40 == 0:
            sets[e + 1] = m[:int(rng.integers(33, 37))] + [10 ** 6 + e]
    table = spark.createDataFrame([(e, m) for e, m in sets.items()], "e long, members array<long>").repartition(3)

    def counted(pairs, all_sets, percent, real=linking.verify):
        asked.append(pairs.count())
        return real(pairs, all_sets, percent)
    monkeypatch.setattr(linking, "verify", counted)
    scratch = Scratch(spark)
    lists = scratch.keep(table.selectExpr("7L AS key", "e", "size(members) AS n", "CAST(NULL AS INT) AS left", "0.0D AS shared"))
    got = {r.e: r.label for r in linking.groups(table.select("e"), lambda wanted: table.join(wanted, "e"), scratch, lists=lists).collect()}
    like = {e: [f for f in sets if len({*sets[e]} & {*sets[f]}) * 180 >= (len(sets[e]) + len(sets[f])) * 80] for e in sets}
    for e in sets:   # groups are chains of links
        now = {e}
        while (more := now.union(*[like[f] for f in now])) != now:
            now = more
        assert got.get(e, e) == min(now)
    assert sum(len(f) > 1 for f in like.values()) >= 20 and max(asked) <= 10 * len(sets)
