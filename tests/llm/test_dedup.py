"""Substring dedup, line dedup and the Jaccard join against brute force on small texts."""

import random
import re
from collections import Counter

import pytest

from sluice.llm.decontaminate import decontaminated, matches
from sluice.llm.jaccard_join import near_duplicates
from sluice.llm.line_dedup import line_dedup
from sluice.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^ \t-\r]+")
EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (None, "a b c d e f g h i j k l m n"), (6, "é ü" * 3)]


@pytest.fixture
def docs_of(spark):
    """Small documents: (doc_id, text) pairs, with a column whose name clashes with inner ones."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, chunk string")
    return make


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["a", "a", "ñ"]
    base = [[r.choice(vocab) for _ in range(r.randint(5, 120))] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.3:
            w = w + ["run"] * r.randint(0, 30) + r.choice(base)[:20]
        rows.append((i, "".join(x + r.choice([" ", " ", "\n", "  "]) for x in w)))
    return rows + [(100 + (i or 0), t) for i, t in EDGE if i] + [(200, " ".join(f"long{i % 997}" for i in range(30000)))]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(docs_of, seed):
    rows = corpus(seed)
    got = {r.doc_id: r for r in substring_dedup(docs_of(rows), chunk_bytes=4000).collect()}
    words, first = {i: WORD.findall(t or "") for i, t in rows}, {}
    for i, _ in sorted(rows):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k:k + 13]), i)
    for i, _ in rows:
        w, gone = words[i], set()
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        assert got[i].text == " ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert {j for s in got[i].spans for j in range(s.start, s.end)} == gone


def test_substring_dedup_edges(spark, docs_of):
    t = " ".join(str(i) for i in range(20))
    got = substring_dedup(docs_of([(None, t), (1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 20)]
    assert substring_dedup(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(docs_of, seed):
    rows = corpus(seed)
    r = random.Random(seed + 10)
    star = [r.choice("abcdefghijklmnop") + str(r.randrange(9)) for _ in range(60)]
    for i in range(40):  # a component whose members do not all link, many of them equal
        w = list(star)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = r.choice("xyz")
        rows.append((300 + i, " ".join(w)))
    rows += [(i + 50, t) for i, t in rows[-40::3]] + [(400, None)]
    got = {r.doc_id: r for r in near_duplicates(docs_of(rows), chunk_bytes=4000, links=True, block=10000).collect()}
    sets, links = {}, Counter()
    for i, t in rows:
        w = [x.lower() if x.isascii() else x for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
                links.update([a, b])
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(sets[i]), find(i), links[i]), i
    assert len({links[300 + i] for i in range(40)}) > 3


def test_jaccard_join_edges(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    assert near_duplicates(docs_of([]), links=True).count() == 0
    got = near_duplicates(docs_of([(None, ""), (3, "x y"), (3, "x y"), (2, "X Y")]), links=True).collect()
    assert sorted(r.n_links for r in got) == [0, 2, 2, 2]
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (2, 2), (3, 2), (3, 2)]


def test_line_dedup(docs_of):
    r = random.Random(5)
    line = [f"line {i}" for i in range(9)] + ["", "  "]
    rows = [(i, "\n".join(r.choice(line) for _ in range(r.randint(0, 25)))) for i in range(40)] + [(50, None), (51, "")]
    got = {x.doc_id: x for x in line_dedup(docs_of(rows).drop("chunk"), chunk_bytes=700).collect()}
    own = {i: [x for x in (t or "").split("\n") if x.strip()] for i, t in rows}
    first = {}
    for i in sorted(own):
        for k in range(len(own[i]) - 2):
            first.setdefault(tuple(own[i][k:k + 3]), (i, k))
    for i, t in rows:
        gone = {j for k in range(len(own[i]) - 2) if first[tuple(own[i][k:k + 3])] < (i, k) for j in range(k, k + 3)}
        assert (got[i].n_lines, got[i].n_removed) == (len(own[i]), len(gone))
        seen, out = -1, []
        for x in (t or "").split("\n"):
            seen += bool(x.strip())
            if not x.strip() or seen not in gone:
                out.append(x)
        assert (got[i].text or "") == "\n".join(out)
    assert line_dedup(docs_of([])).count() == 0


def test_line_dedup_extends_matches(docs_of):
    """A long repeat is one run, whatever stands around it; one from two documents is two; a text may repeat itself."""
    a, b = [f"first text line {i}" for i in range(40)], [f"second text line {i}" for i in range(40)]
    rows = [(1, "\n".join(a)), (2, "\n".join(b)), (5, "\n".join(["own", *a[3:31], "", "more", *a[30:], *b[:9]])), (6, "\n".join(["x y z u"] * 6)),
            (7, "\n".join(f"long {i % 500} line" for i in range(3000))), (None, "\n".join(a))]
    for c in (300, 10 ** 6):
        got = {r.doc_id: [tuple(x) for x in r.runs] for r in line_dedup(docs_of(rows), chunk_bytes=c).collect()}
        assert got == {1: [], 2: [], 5: [(1, 29, 1, 3), (30, 40, 1, 30), (40, 49, 2, 0)], 6: got[6], 7: got[7], None: []}
        assert {j for s, e, _, _ in got[6] for j in range(s, e)} == {1, 2, 3, 4, 5}  # two lines of four words are a run
        assert {j for s, e, _, _ in got[7] for j in range(s, e)} == set(range(500, 3000))


def test_line_dedup_short_runs(docs_of):
    """Repeats on one or two lines: those of eight words and more go, in texts of any number of lines."""
    r = random.Random(6)
    line = [f"line {i}" for i in range(4)] + [f"five words are here {i}" for i in range(5)] + [f"one line of eight words and more {i}" for i in range(4)]
    rows = [(i, "\n".join(r.choice([*line, f"own {i} {r.random()}", ""]) for _ in range(r.randint(0, 7)))) for i in range(80)]
    rows += [(90, "many " * 60), (91, "many " * 60), (92, "x\n" + "many " * 59 + "many"), (93, None)]
    got = {x.doc_id: x for x in line_dedup(docs_of(rows), chunk_bytes=900).collect()}
    own = {i: [x.strip() for x in (t or "").split("\n") if x.strip()] for i, t in rows}
    runs = [(i, k, tuple(own[i][k:k + n])) for i in sorted(own) for k in range(len(own[i])) for n in (1, 2, 3) if k + n <= len(own[i])]
    first = {}
    for i, k, run in runs:
        first.setdefault(run, (i, k))
    short = 0
    for i, _ in rows:
        gone = {j for d, k, run in runs if d == i and first[run] < (i, k) and (len(run) == 3 or len(" ".join(run).split()) >= 8)
                for j in range(k, k + len(run))}
        three = {j for d, k, run in runs if d == i and first[run] < (i, k) and len(run) == 3 for j in range(k, k + 3)}
        short += len(gone - three)
        assert (got[i].n_lines, got[i].n_removed) == (len(own[i]), len(gone)), i
        assert {j for x in got[i].runs for j in range(x.start, x.end)} == gone
        for x in got[i].runs:  # the same lines stand at the one earlier place that is named
            there = own[x.from_id][x.from_line:x.from_line + x.end - x.start]
            assert there == own[i][x.start:x.end] and (x.from_id, x.from_line) < (i, x.start)
            assert x.end - x.start >= 3 or len(" ".join(there).split()) >= 8
        assert [x.strip() for x in (got[i].text or "").split("\n") if x.strip()] == [x for j, x in enumerate(own[i]) if j not in gone]
    assert short > 50 and got[91].n_removed == got[92].n_removed == 1


def test_decontamination(spark, docs_of):
    r = random.Random(3)
    vocab = [f"term{i}" for i in range(2000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, say(30)) for i in range(20)] + [(90, say(150)), (91, [])]
    docs, true = [(1, None), (2, "")], set()
    for i in range(3, 60):
        w, item = say(r.randint(0, 200)), r.choice(items)
        if i % 3 == 0:
            own = list(item[1])
            for _ in range(len(own) // 10 if i % 2 else 0):  # paraphrased: a tenth of the words differ
                own[r.randrange(len(own) - 10)] = "other"
            k = r.randint(0, len(w))
            w = w[:k] + [x.upper() + "," for x in own] + w[k:]
            if own:
                true.add((i, item[0]))
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(92, None)], "item_id long, text string")
    df = docs_of(docs)
    assert {(m.doc_id, m.item_id) for m in matches(df, bench).collect()} == true
    assert {x.doc_id for x in decontaminated(df, bench).collect()} == {i for i, _ in docs} - {i for i, _ in true}
    held = "prefix " + " ".join(items[0][1])
    rows = [(7, held, "a"), (7, "of its own", "b"), (None, held, "c"), (None, "clean", "d"), (8, None, None)]  # equal and no ids: each row by its own text
    more = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    assert decontaminated(more, bench).columns == more.columns
    assert {tuple(x) for x in decontaminated(more, bench).collect()} == {rows[1], rows[3], rows[4]}
    assert decontaminated(more, bench.limit(0)).count() == 5 and decontaminated(more.limit(0), bench).count() == 0
    assert matches(docs_of([]), bench).count() == 0 and matches(df, bench.limit(0)).count() == 0


def test_words_counted_alike():
    assert Counter(WORD.findall("a\x0bb c")) == Counter(["a", "b c"])


def test_decontamination_of_short_items_and_any_punctuation(spark, docs_of):
    bench = spark.createDataFrame([(1, "What is the boiling point?"), (2, "Yes"), (3, None), (4, "name the seven largest lakes of Africa now")], "item_id long, text string")
    rows = [(1, "He asked: What is the boiling point?!?!?! Nobody knew."), (2, "what is the BOILING\n point"), (3, "the boiling point is what"),
            (4, '"""""yes......, said she'), (5, "yesterday"), (6, "name the seven largest lakes of Africa now " + "x " * 100), (7, "....... !!!"), (8, None)]
    got = {(m.doc_id, m.item_id) for m in matches(docs_of(rows), bench).collect()}
    assert got == {(1, 1), (2, 1), (4, 2), (6, 4)}
    assert {r.doc_id for r in decontaminated(docs_of(rows), bench).collect()} == {3, 5, 7, 8}
    assert {m.item_id for m in matches(docs_of(rows), bench.filter("item_id = 2")).collect()} == {2}  # short items alone


def test_latent_space_is_that_of_the_singular_vectors(spark):
    import numpy as np

    from sluice.llm.decontaminate import PASSAGE_DDL, latent
    r = np.random.Generator(np.random.PCG64(3))
    known = np.sort(r.choice(2**40, 60, replace=False).astype(np.uint64))
    idf = r.uniform(0.5, 3, 60).astype(np.float32)
    rows = [r.choice(known, 20, replace=False) for _ in range(30)]
    space = latent(spark.createDataFrame([(i, True, w.tobytes()) for i, w in enumerate(rows)], PASSAGE_DDL), known, idf, rank=40, power=2)
    a = np.zeros((30, 60))
    for i, w in enumerate(rows):
        at = np.searchsorted(known, w)
        a[i, at] = idf[at] / np.linalg.norm(idf[at])
    _, sizes, vectors = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(np.linalg.norm(a @ space[:, :20], axis=0), sizes[:20], rtol=1e-3)  # singular values, in order
    assert np.allclose(np.abs(np.sum(space[:, :5].T * vectors[:5], axis=1)), 1, atol=1e-2)
