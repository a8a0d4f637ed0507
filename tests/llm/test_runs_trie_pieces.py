"""Periodic runs, the conversation trie and the piece codec against brute force and the library."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from sluice.llm import periodic_runs as R
from sluice.llm import queries as Q
from sluice.llm.conversation_trie import prefix_trie, sequences, with_shared_openings
from sluice.llm.piece_codec import Codec, Vocabulary, encode_texts
from sluice.llm.piece_codec import report as coded_report

WORD = re.compile(r"[^ \t-\r]+")
MODEL = P.path("piece_bpe_32k.model")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- periodic runs -------------------------------------------------------------------------------------------------------------------

def plain_lyndon(s):
    out = []
    for i in range(len(s)):
        out.append(max(k for k in range(1, len(s) - i + 1) if all(s[i:i + k] < s[i + j:i + k] for j in range(1, k))))
    return out


def plain_runs(s):
    out, n = [], len(s)
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(6, 4 * q) and not any(all(s[k] == s[k + d] for k in range(i, i + size - d)) for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_array():
    r = random.Random(3)
    for _ in range(400):
        s = [r.randint(1, r.choice([1, 2, 4])) for _ in range(r.randint(1, 20))]
        assert R.lyndon_array([0, *s], max(s))[1:] == plain_lyndon(s)


def test_block_runs_thue_morse_and_powers():
    tm = [bin(i).count("1") % 2 + 1 for i in range(2000)]   # no word of it occurs three times in a row
    power = [5] * 3000
    mixed = ([1, 1, 2] * 5 + [3]) * 6
    for s in (tm, power, mixed):
        got = [tuple(map(int, x)) for x in zip(*R.block_runs(np.array(s, np.uint64) * np.uint64(7919), np.zeros(len(s), np.int64)))]
        assert got == (plain_runs(s) if len(s) < 3000 else [(0, 3000, 1)])


def planted(i, words):
    if i is None or not words or zlib.crc32(str(i).encode()) % 10:
        return words
    g = zlib.crc32(str(i).encode()) // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def expected_runs(i, text):
    words = planted(i, WORD.findall(text or ""))
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
    return (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_periodic_runs(spark):
    r = random.Random(11)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "x y " * 9), (4, "one"), (4, "one"), (5, "é " * 6), (6, "a " * 5)]
    for i in range(10, 260):
        words = []
        for _ in range(r.randint(0, 6)):
            unit = [f"w{r.randint(0, r.choice([1, 3, 30]))}" for _ in range(r.randint(1, 6))]
            words += (unit * r.randint(1, 8))[:r.randint(1, 30)]
        rows.append((i, "".join(w + r.choice([" ", "\n", " \t"]) for w in words)))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, runs string")
    got = R.report(R.periodic_runs(R.with_planted_runs(docs))).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected_runs(i, t)) for i, t in rows)


def test_periodic_runs_long_and_empty(spark):
    docs = spark.createDataFrame([(7, "ab cd ef " * 100_000)], "doc_id long, text string")
    row = R.periodic_runs(docs).first()
    assert [tuple(x) for x in row.runs] == [(0, 300_000, 3)] and row.collapsed == "ab cd ef" and row.n_words == 300_000
    assert R.report(R.periodic_runs(R.with_planted_runs(docs.limit(0)))).collect() == []
    with pytest.raises(ValueError):
        R.periodic_runs(docs, repeats=3)


# --- conversation trie ---------------------------------------------------------------------------------------------------------------

def plain_trie(rows, opened=True):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    full = own
    if opened:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        full = {c: own.get(c - c % 100, [])[:h[c]] + own[c][h[c]:] for c in own}
    members = defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = below[node]
        leaves = sum(out[k][5] for k in kids) or 1
        saved = sum(out[k][6] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        ends = sorted(c for c in members[node] if len(full[c]) == len(node))
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), leaves, saved,
                     sha(",".join(map(str, ends))))
    return sorted(map(repr, out.values()))


def conversations(seed, n=260):
    r, rows = random.Random(seed), [(None, 1, "user", "lost"), (5000, None, None, None), (5000, 1, "user", "é日"), (777, 3, "", "")]
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 7])):
            rows.append((c, None if r.random() < 0.02 and t == 0 else t, r.choice(["user", "bot"]), "t" * r.randint(0, 3)))
    return rows


DDL = "conv_id long, turn long, role string, text string, depth string"


@pytest.mark.parametrize("limit", [1, 3, 20, 4096])
def test_prefix_trie(spark, limit):
    rows = conversations(limit)
    frame = spark.createDataFrame([(*x, "clash") for x in rows], DDL)
    got = prefix_trie(with_shared_openings(sequences(frame)), limit=limit)
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_trie(rows)


def test_prefix_trie_chain_copies_and_empty(spark):
    # every conversation is a prefix of the next, and one is copied often
    rows = [(c, t, "user", f"turn {t}") for c in range(30) for t in range(c + 1)] + [(100 + c, 0, "user", "same") for c in range(500)]
    rows += [(900, 1, "a", "equal"), (900, 1, "a", "equal"), (901, 0, "user", "x" * 300_000)]
    frame = spark.createDataFrame([(*x, "clash") for x in rows], DDL)
    got = prefix_trie(sequences(frame), limit=4)
    assert sorted(repr(tuple(x)) for x in got.collect()) == plain_trie(rows, opened=False)
    assert prefix_trie(with_shared_openings(sequences(frame.limit(0)))).collect() == []


def test_prefix_trie_sql(spark, tmp_path):
    rows = conversations(99, 420)
    frame = spark.createDataFrame([(*x, "clash") for x in rows], DDL)
    frame.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(Q.ORACLE["op12_burst_trie"]).fetchall()
    assert sorted(map(repr, want)) == plain_trie(rows)
    assert sorted(repr(tuple(x)) for x in Q.QUERIES["op12_burst_trie"](spark, str(tmp_path)).collect()) == plain_trie(rows)


# --- piece codec ---------------------------------------------------------------------------------------------------------------------

LETTERS = "abcdefghi  ▁\n\té日本😀\x00<s>ﬁ́0123ABC.,"
PARTS = [" ", "  ", "a", "aa", "the", "in", "ing", " " * 7, "▁", "\n"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_codec_against_library(library):
    own, r = Codec(Vocabulary(MODEL)), random.Random(8)
    for k in range(4000):
        s = "".join(r.choice(LETTERS if k % 2 else PARTS) for _ in range(r.randint(0, 30)))
        ids = library.encode(s, add_eos=True)
        assert own.encode(s) == ids
        assert own.decode(ids) == library.decode(ids)
    for _ in range(2000):  # any ids, broken bytes and control ids among them
        ids = [r.choice([0, 1, 2, r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_last_pieces_are_those_of_prefixes(library):
    own = Codec(Vocabulary(MODEL))
    unit = "▁internationalization"
    table = own.last_pieces(unit)
    for at in range(2, len(unit) + 1):
        assert table[at] == library.encode(unit[1:at], out_type=str)[-1]


def test_encode_texts(spark, library):
    r = random.Random(4)
    rows = [(None, "no id"), (1, None), (2, ""), (3, " "), (4, "same"), (4, "same"), (5, "x" * 200_000), (6, "word " * 50_000)]
    rows += [(i, "".join(r.choice(PARTS + ["Größe", "東京", "\x07"]) for _ in range(r.randint(1, 200)))) for i in range(10, 60)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = coded_report(encode_texts(docs, MODEL)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert encode_texts(docs.limit(0), MODEL).collect() == []
