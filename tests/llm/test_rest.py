"""Scores, rules, packing, archives and the pipeline on small tables."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import brown_lm as B
from sluice.llm import exchange as X
from sluice.llm import queries as Q
from sluice.llm.brown_lm import score_texts
from sluice.llm.packing import pack, plan
from sluice.llm.quality_gam import classify
from sluice.llm.quality_rules import quality_rules
from sluice.llm.url_rules import judge_urls
from sluice.llm.warc import read_warc, write_warc
from sluice.llm.words import blocks, texts
from sluice.session import scratch_root

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]+")
VOCAB = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture
def docs_of(spark):
    """Small documents: (doc_id, text) pairs, with a column whose name clashes with inner ones."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, chunk string")
    return make


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df, res = Q.QUERIES[name](spark, SMALL), con.execute(Q.ORACLE[name])
    cols = sorted(df.columns)
    names = [d[0] for d in res.description]
    assert cols == sorted(names)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=repr)


def test_brown_scores(docs_of):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "The dog sat on the cat", None, "", "unseen zebra é.", "the dog"] * 6)]
    got = score_texts(docs_of(rows), vocabulary=8, rounds=2).collect()
    tok = {i: [x.lower() for x in WORD.findall(t or "")] + [None] for i, t in rows}
    c = Counter(x for i in tok if zlib.crc32(str(i).encode()) % 10 for x in tok[i])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        w = tok[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + .1) / (n + .1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0
    assert score_texts(docs_of([])).count() == 0


def test_brown_clusters_all_words(spark, docs_of):
    """Every training word has a learned class, however rare, and scores are those of the plain class bigram model."""
    r = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'ab'[(j + i) % 2]}{r.integers(25000)}" for j in range(1000))) for i in range(100)]
    df, n = docs_of(rows), 5
    folds = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    chunks = X.chunked(df.select("doc_id", "text", folds.alias("held_out")), n, "held_out").groupBy("chunk").applyInArrow(B._compact, B.CHUNK_DDL).cache()
    m = B.fit(chunks, n, scratch_root(spark, "test"))
    w = np.concatenate([np.frombuffer(x["items"], B.WORDS) for x in spark.read.parquet(m.path).filter("bucket >= 0").collect()])
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert len(w) - 1 == len({x for t in train for x in t}) > 1 << 15
    assert (w["k"][w["h"] != B.END] < B.LEARNED).all()
    word = {x: h for b in blocks(*texts(pa.array([t for _, t in rows]))) for x, h in zip([x for _, t in rows[b.lo:b.hi] for x in t.split()], b.hashes(lower=True))}
    info, end = {a: (c, k) for a, c, k in zip(w["h"].tolist(), w["c"].tolist(), w["k"].tolist())}, B.END_CLASS
    size, words, grams = Counter(), Counter(), Counter()
    for c, k in info.values():
        size[k], words[k] = size[k] + c, words[k] + 1
    for t in train:
        path = [end, *(info[int(word[x])][1] for x in t), end]
        grams.update(zip(path, path[1:]))
    assert all(m.grams[a, b] == grams[a, b] for a in range(B.K) for b in range(B.K))
    before = Counter()
    for (a, _), c in grams.items():
        before[a] += c
    got = {x.doc_id: x.score for x in score_texts(df, chunk_bytes=200000).collect()}
    for i, t in rows:
        own = [info.get(int(word[x]), (0, int(m.unseen[0]))) for x in t.split()]
        path = [end, *(k for _, k in own), end]
        want = sum(math.log10((grams[a, b] + .5) / (before[a] + .5 * B.K)) for a, b in zip(path, path[1:]))
        want += sum(math.log10((c + .1) / (size[k] + .1 * (words[k] + 1))) for c, k in own)
        assert math.isclose(got[i], want, rel_tol=1e-9)


def test_gam_learns(spark, docs_of):
    rows = [(i, "good plain words here and there. " * 20 if i % 2 else "BAD!! $$$ BAD!! $$$ " * 20) for i in range(200)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = classify(docs_of(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 200)
    assert classify(docs_of(rows), labels.limit(0)).filter("score <> 0.5").count() == 0
    assert classify(docs_of([]), labels).count() == 0


def test_quality_rules(docs_of):
    text = " ".join(f"word{i}" for i in range(90))
    rows = [(1, None), (2, ""), (3, text), (3, text), (4, "a b c a b c\na b c\n\n a b c"), (5, "#* % " * 60), (None, text)]
    got = quality_rules(docs_of(rows)).collect()
    for r in got:
        t = dict(rows)[r.doc_id] or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        g = Counter(zip(w, w[1:], w[2:]))
        again = {j for k in range(len(w) - 2) if g[tuple(w[k:k + 3])] > 1 for j in range(k, k + 3)}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and r.kept == (t == text)
    assert "chunk" in got[0].asDict() and quality_rules(docs_of([])).count() == 0


def best_fit(lengths):
    """Sequences that plain best fit, longest first, needs."""
    gaps = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 2048) - n)
    return len(gaps)


def test_plan_is_gapless_and_tight():
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 2049, 500), np.full(300, 700), np.full(99, 683), [2048] * 5])
    counts = Counter(lengths.tolist())
    seq = {}
    for n, first, k, s, offset in sorted(slots := plan(counts)):
        last = min([x[1] for x in slots if x[0] == n and x[1] > first], default=counts[n])
        for j in range(last - first):
            seq.setdefault(s + j // k, []).append((offset + j % k * n, n))
    for items in seq.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(map(len, seq.values())) == len(lengths) and len(seq) <= best_fit(lengths)


def test_pack_round_trip(docs_of):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCAB[0])
    rows = [(1, None), (2, ""), (3, "Hello  world \n\n it's"), (4, "a b   c\x1fd"), (5, "x<|endoftext|>y "), (6, "né ü " * 3000), (6, "again"), (None, " \t")]
    got = pack(docs_of(rows), *VOCAB, with_ids=True).collect()
    texts = {}
    for r in sorted(got, key=lambda r: (r.doc_id or 0, r.start)):
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for i, t in rows:
        if i != 6:
            texts[i] = [x for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece) for x in r.ids]
            assert texts[i] == tok.encode(t or "", add_special_tokens=False).ids + [0]
    long = [r for r in got if r.doc_id == 6 and r.piece > 0]
    assert long and all(r.length == 2048 for r in long)
    assert pack(docs_of([]), *VOCAB).count() == 0


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, None, "h"), (2, "no scheme", "h"), (3, "http://WWW.Example.com/en/x?q", "h"), (4, "http://a.example.com/en/", "h"),
                                   (5, "https://x.net/es", "h"), (5, "https://x.net/es/", "h"), (6, "http://", "h"), (7, "http://com" + "." * 3000 + "com/" + "/" * 3000, "h")],
                                  "page_id long, url string, host string")
    rules = spark.createDataFrame(Q.RULES, "host string, path string, action string")
    got = [(r.page_id, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()]
    assert len(got) == 8
    assert {g for g in got if g[0] < 7} == {(1, None, "allow"), (2, None, "allow"), (3, "www.example.com/en/", "allow"), (4, "example.com/en/", "block"),
                                            (5, None, "allow"), (5, "net/es/", "block"), (6, None, "allow")}
    assert (7, "com/", "allow") in got
    assert judge_urls(pages, rules.limit(0)).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        judge_urls(pages, spark.createDataFrame([("a", "/x", "block")], "host string, path string, action string"))


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 400
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (3, "http://b/", "small"), (4, "http://b/", "small"), (5, "u", None), (5, "u", big), (5, "v", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    digests = []
    for k in range(2):
        out = f"file://{tmp_path}/{k}"
        write_warc(pages.repartition(3 + k), out, roll_bytes=300, shard_bytes=4000)
        digests.append(sorted((r.file, r.sha1) for r in spark.read.parquet(f"{out}/_manifest").collect()))
    assert digests[0] == digests[1] and len(digests[0]) > 1
    got = read_warc(spark, out).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [
        (0, "revisit", 5), (1, "revisit", 5), (2, "revisit", 5), (3, "response", 0), (4, "response", 0), (5, "response", 0), (5, "response", 0), (5, "revisit", 5)]
    assert Counter(bytes(r.payload).decode() for r in got if r.payload is not None) == Counter([big, "small", "small", ""])
    assert not (tmp_path / "0" / "_tmp").exists()
    write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert read_warc(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("odd", [10 ** 17, -5, None, 7])
def test_warc_shards_follow_the_rows(spark, tmp_path, odd):
    """A far id, a negative one, a third of all rows without an id or with one id: no shard holds much more than its share."""
    ids = list(range(600)) + [odd] * (1 if odd in (10 ** 17, -5) else 300)
    rows = [(i, f"http://h/{n}", f"{n} " * 200 if n % 10 else None) for n, i in enumerate(ids)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, shard string").repartition(4)
    out = f"file://{tmp_path}/w"
    write_warc(pages, out, shard_bytes=40_000)
    size = sum(len(r[2] or "") + 300 for r in rows)
    shards = spark.read.parquet(f"{out}/_manifest").groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert size / 40_000 <= len(shards) <= 2 * size / 40_000 + 1 and max(r.n for r in shards) < len(rows) / 6
    got = read_warc(spark, out).orderBy("file").collect()
    assert Counter((r.page_id, r.url) for r in got) == Counter((r[0], r[1]) for r in rows)
    order = [(r.page_id is not None, r.page_id or 0) for r in got]
    assert order == sorted(order)  # the shards are ranges of ids


def test_warc_long_and_equal_payloads(spark, tmp_path):
    """A payload of 3 MB, and 400 equal rows of one id, which stay together as a response and its revisits."""
    long = "wörd " * 600_000
    rows = [(1, "a", long), (2, "b", long[:-1])] + [(3, "c", "same " * 300)] * 400
    out = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), out, shard_bytes=100_000)
    got = read_warc(spark, out).collect()
    assert Counter((r.page_id, r.record_type) for r in got) == Counter({(1, "response"): 1, (2, "response"): 1, (3, "response"): 1, (3, "revisit"): 399})
    assert len({r.record_id for r in got}) == 402 and next(r for r in got if r.page_id == 1).payload == long.encode()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    ids = {r.doc_id for r in out.collect()}
    assert ids and ids < {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SMALL).columns == docs.columns, name


def test_pipeline_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 0), (2, text, 1), (3, text + " end", 2), (4, "else", 3), (4, "else", 4), (5, None, 5), (5, None, 6),
            (None, text, 7), (None, "else", 8), (6, "", 9), (9, "some other words that stand alone", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _nth long")
    got = corpus_pipeline.jaccard_join(spark, docs, SMALL)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(
        [(1, text), (4, "else"), (5, None), (None, text), (None, "else"), (6, ""), (9, "some other words that stand alone")])
    assert {tuple(r) for r in got.collect()} <= set(rows)


def test_pipeline_stages_keep_clashing_columns(spark):
    names = ["kept", "n_lines", "n_removed", "chunk", "item_id", "_gone", "_others", "n_words", "p_good"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", *[F.col("doc_id").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(set(r[2:]) == {r.doc_id} for r in got), name
    assert corpus_pipeline.jaccard_join(spark, docs.select("doc_id", "text"), SMALL).columns == ["doc_id", "text"]
