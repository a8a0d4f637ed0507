"""Operators that SQL cannot express, held against plain versions of their methods."""

import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import brown_lm as B
from sluice.llm import exchange as X
from sluice.llm import quality_gam as G
from sluice.llm import quality_rules as R

WORD = re.compile(r"[^ \t-\r]+")
KEEP, SYMBOL = 0.5, re.compile(r"[#*$%&|<>]")


# weak supervision

def plain_votes(text):
    """Base counts and the seven votes of one text."""
    t = text or ""
    w, full = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    again = len({j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(k, k + 3)})
    n, chars = max(len(w), 1), sum(map(len, w))
    sym, rep, up = len(SYMBOL.findall(t)) / n, again / n, sum("A" <= c <= "Z" for c in t) / max(chars, 1)
    dup, size, variety = (len(full) - len(set(full))) / max(len(full), 1), chars / n, len(set(w)) / math.sqrt(n)
    vote = lambda good, bad: -1 if bad else 1 if good else 0
    return len(w), again, (vote(len(w) >= 80, len(w) < 50), vote(sym < .05, sym > .3), vote(dup < .05, dup > .3), vote(rep < .1, rep > .35),
                           vote(up < .1, up > .3), vote(3 <= size <= 9, size < 2 or size > 14),
                           vote(variety > 4 and len(w) >= 50, variety < 2 and len(w) >= 50))


def plain_posteriors(votes, rounds=10):
    """Expectation-maximisation document by document."""
    clip = lambda x: min(max(x, .02), .98)
    good, right = .8, [(.8, .8)] * 7

    def posterior(vs):
        g, b = good, 1 - good
        for v, (a, c) in zip(vs, right):
            g *= {1: a, -1: 1 - a, 0: 1}[v]
            b *= {1: 1 - c, -1: c, 0: 1}[v]
        return g / (g + b)

    for _ in range(rounds):
        p = [posterior(vs) for vs in votes]
        rate = lambda k, yes, of: (sum(q for q, vs in zip(of, votes) if vs[k] == yes),
                                   sum(q for q, vs in zip(of, votes) if vs[k] == -yes))
        bad = [1 - q for q in p]
        share = lambda yes, no: clip((yes + 4) / (yes + no + 5))
        good, right = clip((sum(p) + 4) / (len(p) + 5)), [(share(*rate(k, 1, p)), share(*rate(k, -1, bad))) for k in range(7)]
    return [posterior(vs) for vs in votes]


def plain_kept(texts):
    seen = [plain_votes(t) for t in texts]
    p = plain_posteriors([v for _, _, v in seen])
    return p, [n >= 50 and 100 * again <= 50 * n and q >= KEEP for (n, again, _), q in zip(seen, p)]


def mixed_texts(seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ["plain", "word", "of", "common", "tea", "light"] for b in "abcdefghijklmnop"]
    out = [None, ""]
    for i in range(70):
        w = [r.choice(vocab) for _ in range(r.choice([10, 55, 90, 140]))]
        if i % 5 == 1:
            w = [x.upper() for x in w]
        if i % 5 == 2:
            w = [x if r.random() < .6 else "#$%" for x in w]
        if i % 7 == 3:
            w = w[:6] * (len(w) // 6)
        step = r.choice([6, 9, 200])
        lines = [" ".join(w[k:k + step]) for k in range(0, len(w), step)]
        if i % 6 == 4:
            lines = lines[:3] * 4
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_posteriors_are_those_of_plain_expectation_maximisation(spark, seed):
    texts = mixed_texts(seed)
    got = sorted(R.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    p, kept = plain_kept(texts)
    assert all(math.isclose(r.p_good, q, rel_tol=1e-6, abs_tol=1e-9) for r, q in zip(got, p, strict=True))
    assert [r.kept for r in got] == kept and 10 < sum(kept) < len(kept) - 10


# additive model

def loss_gain(g, h):
    return g * g / (h + G.LAMBDA)


def plain_tree(rows, depth, lo, hi):
    """Bin values of the best cut, then of the best cut of each side; ``rows`` are (bin, gradient, curvature)."""
    total = lambda a, z: (sum(x[1] for x in rows if a <= x[0] < z), sum(x[2] for x in rows if a <= x[0] < z))
    g, h = total(lo, hi)
    if depth:
        found = [(loss_gain(*total(lo, k)) + loss_gain(*total(k, hi)), -k) for k in range(lo + 1, hi)]
        best = max(found, default=(0, 0))
        if found and best[0] > loss_gain(g, h) + 1e-9:
            return plain_tree(rows, depth - 1, lo, -best[1]) + plain_tree(rows, depth - 1, -best[1], hi)
    return [g / (h + G.LAMBDA)] * (hi - lo)


def test_tree_is_the_best_cut_and_the_best_cut_of_each_side():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, G.BINS):
        bins, g, h = r.integers(0, n, 200), r.normal(size=200), r.uniform(.05, .25, 200)
        want = plain_tree(list(zip(bins, g, h)), 2, 0, n)
        assert np.allclose(G._tree(np.bincount(bins, g, n), np.bincount(bins, h, n)), want) and len(set(want)) <= 4


def test_pair_tree_is_the_best_of_all_crosses():
    r = np.random.default_rng(2)
    a, c, g, h = r.integers(0, G.BINS, 300), r.integers(0, G.BINS, 300), r.normal(size=300), r.uniform(.05, .25, 300)
    gain, values = G._cross(a, c, g, h)
    best = (-1, None)
    for i in range(G.BINS - 1):
        for j in range(G.BINS - 1):
            parts = [(x, y) for x in (a <= i, a > i) for y in (c <= j, c > j)]
            score = sum(loss_gain(g[x & y].sum(), h[x & y].sum()) for x, y in parts)
            if score > best[0] + 1e-9:
                best = (score, (i, j))
    assert math.isclose(gain, best[0] - loss_gain(g.sum(), h.sum()), rel_tol=1e-9)
    i, j = best[1]
    for x, y, at in (((a <= i), (c <= j), (0, 0)), ((a <= i), (c > j), (0, -1)), ((a > i), (c <= j), (-1, 0)), ((a > i), (c > j), (-1, -1))):
        assert math.isclose(values[at], g[x & y].sum() / (h[x & y].sum() + G.LAMBDA), rel_tol=1e-9, abs_tol=1e-12)


def test_model_is_that_of_plain_cyclic_boosting(monkeypatch):
    """Rounds over all measures, then over the pairs of most gain, row by row in plain Python."""
    monkeypatch.setattr(G, "ROUNDS", 2)
    monkeypatch.setattr(G, "PAIR_ROUNDS", 2)
    monkeypatch.setattr(G, "PAIRS", 2)
    r = np.random.default_rng(3)
    x = r.normal(size=(90, len(G.FEATURES))).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + r.normal(size=90) * .3 > 0).astype(float)
    model = G.Gam(x, y)
    bins = [[sum(v >= e for e in model.edges[j]) for v in x[:, j]] for j in range(x.shape[1])]
    f = [math.log((y.sum() + 1) / (len(y) + 1 - y.sum()))] * len(y)

    def slopes():
        p = [1 / (1 + math.exp(-v)) for v in f]
        return [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]

    for _ in range(2):
        for own in bins:
            tree = plain_tree(list(zip(own, *slopes())), 2, 0, G.BINS)
            f = [v + G.RATE * tree[b] for v, b in zip(f, own)]
    g, h = (np.array(s) for s in slopes())
    at = [np.array(b) for b in bins]
    pairs = sorted(((G._cross(at[a], at[c], g, h)[0], a, c) for a in range(len(at)) for c in range(a)), reverse=True)[:2]
    assert [p[:2] for p in model.pairs] == [(a, c) for _, a, c in pairs]
    for _ in range(2):
        for _, a, c in pairs:
            g, h = (np.array(s) for s in slopes())
            tree = G._cross(at[a], at[c], g, h)[1]
            f = [v + G.RATE * tree[i, j] for v, i, j in zip(f, bins[a], bins[c])]
    assert np.allclose(model.score(x), [1 / (1 + math.exp(-v)) for v in f])


def test_sample_is_of_the_least_hashes(spark):
    zero = [F.lit(0.0).cast("float").alias(c) for c in G.FEATURES[1:]]
    rows = spark.range(3000).withColumnRenamed("id", "doc_id").unionByName(spark.range(500).select(F.lit(7).cast("long").alias("doc_id")))
    known = rows.select("doc_id", F.col("doc_id").cast("float").alias(G.FEATURES[0]), *zero, (F.col("doc_id") % 2).cast("int").alias("quality"))
    order = [r.doc_id for r in spark.range(3000).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    for n in (1, 40, 2999, 5000):
        assert [r.doc_id for r in G._least_hashes(known, n).collect()] == order[:n]
    assert G._least_hashes(known.limit(0), 5).count() == 0


def test_very_long_text_and_conflicting_labels_are_scored(spark):
    rows = [(i, "good plain words here and there. " * 20 if i % 2 else "BAD!! $$$ BAD!! $$$ " * 20) for i in range(100)] + [(300, "good plain words here. " * 200_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] * 2 + [(1, 0), (300, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in G.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert len(got) == 101 and all(got[i].predicted == i % 2 for i in range(100)) and 0 <= got[300].score <= 1


# exchange clustering

def likelihood(grams):
    x = lambda v: float(sum(a * math.log(a) for a in np.ravel(v) if a > 0))
    return x(grams) - x(grams.sum(0)) - x(grams.sum(1))


def test_exchange_takes_the_class_of_most_likelihood():
    """Words whose neighbours have fixed classes: the move is the best of all classes by the whole likelihood."""
    r = np.random.default_rng(5)
    fixed = np.arange(B.LEARNED, B.K)
    grams = np.zeros((B.K, B.K), np.int64)
    grams[:B.LEARNED, B.LEARNED:], grams[B.LEARNED:, :B.LEARNED] = (r.integers(20, 200, s) for s in ((B.LEARNED, len(fixed)), (len(fixed), B.LEARNED)))
    own = r.integers(0, B.LEARNED, 12)
    words = []
    for w, k in enumerate(own):
        near = Counter(r.choice(fixed, 8).tolist()), Counter(r.choice(fixed, 8).tolist())  # as many before as after
        words.append(near)
        for c, n in near[0].items():
            grams[c, k] += n
        for c, n in near[1].items():
            grams[k, c] += n
    entries = sorted((w, c + side * B.K, n) for w, near in enumerate(words) for side in (0, 1) for c, n in near[side].items())
    row, col, n = (np.array(v) for v in zip(*entries))
    got = B.exchanged(row, col, n, own.astype(np.int64), grams)
    for w, (before, after) in enumerate(words):
        scores = []
        for k in range(B.LEARNED):
            g = grams.copy()
            for c, m in before.items():
                g[c, own[w]] -= m
                g[c, k] += m
            for c, m in after.items():
                g[own[w], c] -= m
                g[k, c] += m
            scores.append(likelihood(g))
        assert math.isclose(scores[got[w]], max(scores), rel_tol=1e-12)


# the exchange

def test_partitions_are_bounded_and_chunks_share_them(spark, monkeypatch):
    """Operators give the same results where a partition holds many chunks."""
    from sluice.llm.jaccard_join import near_duplicates
    from sluice.llm.line_dedup import line_dedup
    from sluice.llm.substring_dedup import substring_dedup
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(mixed_texts(3) * 2)] + [(500, "hot " * 30 + str(i)) for i in range(30)], "doc_id long, text string")
    few = spark.range(1)
    assert [X.partitions(few, n) for n in (1, 512, 513, 16 * 1000, 10 ** 8)] == [1, 512, 512, 1000, 1 << 15]
    run = lambda: [sorted(map(repr, f(docs, chunk_bytes=b).collect())) for f, b in
                   ((near_duplicates, 1500), (line_dedup, 1500), (substring_dedup, 1500))] + [
        sorted((r.doc_id, round(r.score, 6)) for r in B.score_texts(docs, rounds=1, chunk_bytes=4000).collect())]
    want = run()
    for name, n in (("ONE_EACH", 1), ("TOGETHER", 3), ("MOST", 6)):
        monkeypatch.setattr(X, name, n)
    assert X.chunk_count(docs, 1500) > 20 and X.chunked(docs, 30).rdd.getNumPartitions() == 6
    assert run() == want
    monkeypatch.setattr(X, "DIRECT", 7)  # questions in two steps
    assert X.ranges(30) == X.Ranges(7, 3, 6)
    assert run() == want
    assert len({r.chunk for r in X.chunked(docs.filter("doc_id = 500"), 30).collect()}) > 10  # a hot id is dealt out


def test_rows_of_the_exchange_grow_slower_than_its_square(spark):
    """Rows of each step of a corpus 16 times as large, where every chunk has keys of every bucket."""
    def rows(chunks):
        r = X.ranges(chunks, 8)
        def fn(table):
            chunk = table["chunk"][0].as_py()
            keys = np.unique(np.random.default_rng(chunk).integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2))
            return X.asked(chunk, keys, r, lambda lo, hi: (keys[lo:hi].tobytes(), b""))
        def same(table):
            keys, edge = X.unpack(table, "<u8", "keys")
            return X.answered(table, [keys[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])])
        asks = X.ask(spark.range(chunks).selectExpr("cast(id as int) AS chunk"), fn)
        back = X.answer(asks, same, r).collect()
        for chunk in (0, chunks - 1):  # every answer comes back to the chunk that asked, in the order of its keys
            own = b"".join(x.answer for x in sorted((x for x in back if x.chunk == chunk), key=lambda x: x.bucket))
            assert own == np.unique(np.random.default_rng(chunk).integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)).tobytes()
        merged = asks.groupBy("bucket", (X.F.expr(f"chunk div {r.together}"))).applyInArrow(X._merged(r), X.MERGED_DDL)
        assert merged.groupBy("bucket").count().count() == r.buckets
        return asks.count() + merged.count() + len(back)
    few, many = rows(32), rows(512)
    assert many < 16 ** 1.5 * 1.2 * few and many < 512 * 128 / 4


def test_model_table_is_dropped_where_the_fit_fails(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    before = spark.catalog.listTables()
    monkeypatch.setattr(B, "fit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        B.score_texts(docs)
    assert spark.catalog.listTables() == before


# the pipeline

def plain_line_dedup(docs):
    """``id -> text``: later repeats of three lines, or of eight words on fewer, are deleted; texts of which nothing stays go."""
    own = {i: [x.strip(" \t\n\x0b\f\r") for x in t.split("\n") if WORD.search(x)] for i, t in docs.items()}
    runs = [(i, k, tuple(own[i][k:k + n])) for i in sorted(own) for k in range(len(own[i])) for n in (1, 2, 3) if k + n <= len(own[i])]
    first, gone = {}, {i: set() for i in own}
    for i, k, run in runs:
        first.setdefault(run, (i, k))
    for i, k, run in runs:
        if first[run] < (i, k) and (len(run) == 3 or len(WORD.findall(" ".join(run))) >= 8):
            gone[i] |= set(range(k, k + len(run)))
    out = {}
    for i, t in docs.items():
        seen, kept = -1, []
        for x in t.split("\n"):
            seen += bool(WORD.search(x))
            if not WORD.search(x) or seen not in gone[i]:
                kept.append(x)
        if not gone[i] or len(gone[i]) < len(own[i]):
            out[i] = "\n".join(kept)
    return out


def plain_one_of_each(docs):
    sets = {}
    for i, t in docs.items():
        w = WORD.findall(t.lower())
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}
    for _ in sets:  # labels spread until they stay
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    return {i: t for i, t in docs.items() if top[i] == i}


def test_pipeline_is_its_plain_stages(spark, tmp_path):
    r = random.Random(11)
    vocab = [a + b for a in ["stone", "river", "cloud", "garden", "winter", "letter", "morning"] for b in ["", "s", "ly", "er", "ing", "ed", "est", "like", "less"]]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    bench = [(i, " ".join(say(25))) for i in range(6)] + [(9, None)]
    base = [say(r.randint(90, 200)) for _ in range(14)]
    shared = [" ".join(say(10)) for _ in range(4)]
    rows = []
    for i in range(90):
        w = list(base[i % 14]) if i % 3 == 0 else say(r.randint(40, 220))
        if i % 3 == 0 and i % 2:
            w[r.randrange(len(w))] = "changed"
        if i % 13 == 5:
            w = ["#*%$"] * len(w)
        if i % 17 == 4:
            w = w[:40] + bench[i % 6][1].split() + w[40:]
        step = r.choice([8, 12, 300])
        lines = [" ".join(w[k:k + step]) for k in range(0, len(w), step)]
        if i % 4 == 1:
            lines.insert(len(lines) // 2, r.choice(shared))
        rows.append((i, "\n".join(lines), "en", "s", len(" ".join(w))))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    _, kept = plain_kept([t for _, t, *_ in rows])
    after = [{i: t or "" for (i, t, *_), ok in zip(rows, kept) if ok}]
    after.append(plain_line_dedup(after[-1]))
    after.append(plain_one_of_each(after[-1]))
    after.append({i: t for i, t in after[-1].items() if not any(b and f" {b} " in f" {' '.join(WORD.findall(t))} " for _, b in bench)})
    sizes = [len(rows), *map(len, after)]
    assert sizes[0] > sizes[1] and after[0] != after[1] and sizes[2] > sizes[3] > sizes[4] > 20  # each stage has work to do

    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in after[-1].items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "piece").collect()
    assert {x.doc_id for x in got} == set(ids)
    places = {}
    for x in got:
        own = ids[x.doc_id][x.start:x.start + x.length]
        assert len(own) == x.length and zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == x.ids_crc32
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert Counter(x.doc_id for x in got) == Counter({i: 1 for i in ids}) and all(x.length == len(ids[x.doc_id]) for x in got)
    for spots in places.values():
        spots.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:])) and spots[0][0] == 0 and sum(n for _, n in spots) <= 2048
    gaps = []
    for n in sorted(map(len, ids.values()), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 2048) - n)
    assert len(places) <= len(gaps)
