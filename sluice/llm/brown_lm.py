"""Brown class-based n-gram model: exchange clustering, class transitions, word emissions, smoothed log probability.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; one end token closes each text.

1. **Tokens.**  Texts are dealt into chunks once (see ``exchange``); each becomes its distinct words and the
   numbers of its tokens, kept as a bucketed table, so later passes neither hash nor shuffle texts.
2. **Counts** of every training token, packed by hash range and summed per range.  The table has each
   word's count and class; it grows with the corpus and stays in Spark.
3. **Classes.**  All training words are clustered by exchange: the most frequent words seed the classes;
   then each round chunks ask for the classes of their distinct words, count every word's left and right
   neighbour classes, and send them to the word's range, where it moves to the class that raises the class
   bigram likelihood most.  The end token is a class of its own.  A given ``vocabulary`` clusters only so
   many words; the others stay in one of eight classes by their surface (other than ASCII bytes,
   closing punctuation, length).
4. **Scores.**  P(text) is the product over tokens of P(class | class before) and
   P(word | class), both additively smoothed; each class reserves mass for a word never seen, which
   belongs to the class of most words of its surface seen once.  Chunks ask for count and class together.

``base_score`` is the unigram score sum(log10((c + 0.1) / (N + 0.1 (V + 1)))).

Defined results: null text reads as empty (one token, the end); a null ``doc_id``
counts as the text ``''`` for the split; repeated rows are scored alike and counted
as often as they occur; other columns are ignored; an empty table gives no
rows; without training rows every count is 0.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import exchange as X
from sluice.llm.words import U, Block, blocks, texts
from sluice.session import scratch_root

LEARNED = 31           # classes found by exchange
SURFACE = 8            # classes of words outside a given vocabulary
END_CLASS = LEARNED + SURFACE
K = END_CLASS + 1
ROUNDS = 4
DELTA, ALPHA = 0.1, 0.5
END = U(0x9E3779B97F4A7C15)
WORDS = np.dtype([("h", "<u8"), ("c", "<u8"), ("s", "u1"), ("k", "u1")])
OWN = np.dtype([("h", "<u8"), ("s", "u1")])                                      # distinct words of a chunk
TEXTS = np.dtype([("id", "<i8"), ("has", "u1"), ("held", "u1"), ("n", "<i4")])  # its texts, n tokens each
SAID = np.dtype([("c", "<u8"), ("k", "u1")])
NONE = 255             # class of a word that is not in the table
SHARES = 16            # sums of class bigrams
CHUNK_DDL = "chunk int, words binary, tokens binary, texts binary"
CHUNK = pa.schema([("chunk", pa.int32()), ("words", pa.binary()), ("tokens", pa.binary()), ("texts", pa.binary())])
COUNT_DDL = "bucket int, items binary"
COUNT = pa.schema([("bucket", pa.int32()), ("items", pa.binary())])
PART_DDL = "bucket int, part int, items binary"
PART = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("items", pa.binary())])
SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                   ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def surface(b: Block) -> np.ndarray:
    """Three bits of each word: a byte beyond ASCII, closing punctuation, more than eight bytes."""
    wide = np.concatenate([[0], np.cumsum(b.data >= 128)])
    last = b.data[b.end - 1]
    alnum = ((last >= 48) & (last <= 57)) | ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    return ((wide[b.end] > wide[b.start]) + 2 * ~alnum + 4 * (b.end - b.start > 8)).astype(np.uint8)


def tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, surface and text of every token, ends included, in order."""
    at = b.first[1:]
    return (np.insert(b.hashes(lower=True), at, END), np.insert(surface(b), at, 0),
            np.insert(b.doc, at, np.arange(b.n)))


def _compact(table: pa.Table) -> pa.Table:
    parts = [(tokens(b), b.n) for b in blocks(*texts(table["text"]))]
    h, s = (np.concatenate([p[0][i] for p in parts]) for i in range(2))
    keys, first, back = np.unique(h, return_index=True, return_inverse=True)
    own, rows = np.empty(len(keys), OWN), np.empty(table.num_rows, TEXTS)
    own["h"], own["s"] = keys, s[first]
    ids = table["doc_id"].combine_chunks().cast(pa.int64())
    rows["id"], rows["has"] = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
    rows["held"] = table["held_out"].to_numpy()
    rows["n"] = np.concatenate([np.bincount(p[2], minlength=n) for p, n in parts])
    return pa.table([table["chunk"].slice(0, 1).cast(pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (own, back.astype("<i4"), rows))], schema=CHUNK)


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a chunk, its texts, the words of its tokens, those of training texts."""
    own, ids, rows = np.frombuffer(row["words"], OWN), np.frombuffer(row["tokens"], "<i4"), np.frombuffer(row["texts"], TEXTS)
    return own, rows, ids, ids[np.repeat(rows["held"] == 0, rows["n"])]


def _count(r: X.Ranges):
    def fn(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own, _, _, train = _opened(row)
                c = np.bincount(train, minlength=len(own))
                w = np.zeros(int((c > 0).sum()), WORDS)
                w["h"], w["s"], w["c"] = own["h"][c > 0], own["s"][c > 0], c[c > 0]
                cuts = X.cut(w["h"], r)
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cuts], pa.int32()), pa.array([row["chunk"] // r.together] * len(cuts), pa.int32()),
                                                  pa.array([w[lo:hi].tobytes() for _, lo, hi in cuts], pa.binary())], schema=PART)
    return fn


def _total(table: pa.Table) -> pa.Table:
    items, _ = X.unpack(table, WORDS, "items")
    keys, first, back = np.unique(items["h"], return_index=True, return_inverse=True)
    total = items[first]
    total["c"] = np.bincount(back, weights=items["c"], minlength=len(keys))
    return pa.table([pa.array([table["bucket"][0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=COUNT)


def _count_parted(r: X.Ranges):
    """The words that a set of chunks counted in a group of buckets, by bucket."""
    def fn(table: pa.Table) -> pa.Table:
        total = np.frombuffer(_total(table)["items"][0].as_py(), WORDS)
        cuts = X.cut_buckets(np.ascontiguousarray(total["h"]), r)
        return pa.table([pa.array([c[0] for c in cuts], pa.int32()), pa.array([table["part"][0].as_py()] * len(cuts), pa.int32()),
                         pa.array([total[lo:hi].tobytes() for _, lo, hi in cuts], pa.binary())], schema=PART)
    return fn


TOP_DDL = "h long, c long"
TOP = pa.schema([("h", pa.int64()), ("c", pa.int64())])


def _top(most: int):
    """The most frequent words of each bucket."""
    def fn(batches):
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                w = np.frombuffer(raw, WORDS)
                w = w[w["h"] != END]
                best = w[np.lexsort((w["h"].astype(np.int64), -w["c"].astype(np.int64)))[:most]]
                yield pa.RecordBatch.from_arrays([pa.array(best["h"].astype(np.int64)), pa.array(best["c"].astype(np.int64))], schema=TOP)
    return fn


def _seeded(best: list[tuple[int, int]], capped: bool):
    """First classes: a class for each of the most frequent words, the last one for the others, surface classes outside a vocabulary."""
    seeds = [h for h, _ in best[:LEARNED - 1]]

    def fn(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                w = np.frombuffer(raw, WORDS).copy()
                h, c = w["h"].astype(np.int64), w["c"].astype(np.int64)
                w["k"] = LEARNED - 1
                if capped:
                    h_last, c_last = best[-1] if best else (0, np.iinfo(np.int64).max)
                    out = (c < c_last) | (c == c_last) & (h > h_last)
                    w["k"][out] = LEARNED + w["s"][out]
                for k, seed in enumerate(seeds):
                    w["k"][h == seed] = k
                w["k"][w["h"] == END] = END_CLASS
                rows.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], schema=COUNT)
    return fn


def _ask(r: X.Ranges):
    def fn(batches):
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys = np.ascontiguousarray(np.frombuffer(raw.as_buffer(), OWN)["h"])
                t = X.asked(chunk, keys, r, lambda lo, hi: (keys[lo:hi].tobytes(), b""))
                yield from t.to_batches()
    return fn


def _answer(dtype):
    """Classes of the words asked about, with their counts if ``dtype`` is SAID."""
    def fn(asks: pa.Table, words: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return X.ANSWER.empty_table()
        w = np.concatenate([np.frombuffer(x, WORDS) for x in words["items"].to_pylist()] or [np.zeros(0, WORDS)])
        keys, edge = X.unpack(asks, "<u8", "keys")
        said = np.zeros(len(keys), SAID)
        said["k"] = NONE
        if len(w):
            h = np.ascontiguousarray(w["h"])
            pos = np.minimum(np.searchsorted(h, keys), len(h) - 1)
            hit = h[pos] == keys
            said["c"][hit], said["k"][hit] = w["c"][pos[hit]], w["k"][pos[hit]]
        said = said if dtype is SAID else np.ascontiguousarray(said["k"])
        return X.answered(asks, [said[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])])
    return fn


def _turns(h: np.ndarray, turn: int) -> np.ndarray:
    """All words move in the first round, later half of them at a time, so that neighbours do not swap for ever."""
    return np.ones(len(h), bool) if turn == 0 else (h >> U(17)) % U(2) == U(turn % 2)


def _packed(row: np.ndarray, col: np.ndarray, n: np.ndarray, words: int) -> bytes:
    """Entries sorted by word: how many each has, columns, counts by byte planes (compressed by the exchange)."""
    return np.bincount(row, minlength=words).astype("u1").tobytes() + col.astype("u1").tobytes() + n.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def _unpacked(raw: bytes, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, "u1")
    row = np.repeat(np.arange(words), x[:words])
    e = len(row)
    return row, x[words:words + e].astype(np.int64), np.ascontiguousarray(x[words + e:].reshape(4, e).T).view("<u4").reshape(-1).astype(np.int64)


def _neighbours(r: X.Ranges, turn: int | None):
    """Left and right neighbour classes of each word whose turn it is, by range; buckets below 0: class bigrams of all tokens."""
    def fn(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.ASK.empty_table()
        row = table.to_pylist()[0]
        own, _, _, ids = _opened(row)
        k = X.gathered(answers, "u1")
        c, end = k[ids].astype(np.int32), np.array([END_CLASS], np.int32)
        before = np.concatenate([end, c])[:len(c)]  # the token before a text is the end of the one before
        after = np.concatenate([c[1:], end])[:len(c)]
        grams = np.bincount(before * K + c, minlength=K * K).astype("<i8")
        bucket, keys, extra = [-1 - row["chunk"] % SHARES], [b""], [grams.tobytes()]
        if turn is not None:
            moves = (k < LEARNED) & _turns(own["h"], turn)
            first = (np.cumsum(moves) - 1) * (2 * K)
            first = first.astype(np.int32 if len(own) * 2 * K < 1 << 31 else np.int64)
            at = moves[ids]
            word = first[ids[at]]
            key, n = np.unique(np.concatenate([word + before[at], word + after[at] + np.int32(K)]), return_counts=True)
            w, col, h = key // (2 * K), key % (2 * K), own["h"][moves]
            for i, lo, hi in X.cut(h, r):
                a, z = np.searchsorted(w, [lo, hi])
                bucket.append(i)
                keys.append(h[lo:hi].tobytes())
                extra.append(_packed(w[a:z] - lo, col[a:z], n[a:z], hi - lo))
        return pa.table([pa.array(bucket, pa.int32()), pa.array([row["chunk"]] * len(bucket), pa.int32()),
                         pa.array(keys, pa.binary()), pa.array(extra, pa.binary())], schema=X.ASK)
    return fn


def _near_parted(r: X.Ranges):
    """Neighbour counts that a set of chunks sent to a group of buckets, summed, by bucket."""
    def fn(table: pa.Table) -> pa.Table:
        bucket, part = table["bucket"][0].as_py(), table["chunk"][0].as_py() // r.together
        if bucket < 0:
            grams = sum(np.frombuffer(x, "<i8") for x in table["extra"].to_pylist()).tobytes()
            return pa.table([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([b""], pa.binary()), pa.array([grams], pa.binary())], schema=X.ASK)
        words = [np.frombuffer(x, U) for x in table["keys"].to_pylist()]
        known, key, n = np.unique(np.concatenate(words)), [], []
        for h, raw in zip(words, table["extra"].to_pylist()):
            row, col, m = _unpacked(raw, len(h))
            key.append(np.searchsorted(known, h)[row] * (2 * K) + col)
            n.append(m)
        key, back = np.unique(np.concatenate(key), return_inverse=True)
        n = np.bincount(back, weights=np.concatenate(n), minlength=len(key)).astype(np.int64)
        word, col, out = key // (2 * K), key % (2 * K), []
        for i, lo, hi in X.cut_buckets(known, r):
            a, z = np.searchsorted(word, [lo, hi])
            out.append((i, known[lo:hi].tobytes(), _packed(word[a:z] - lo, col[a:z], n[a:z], hi - lo)))
        return pa.table([pa.array([o[0] for o in out], pa.int32()), pa.array([part] * len(out), pa.int32()),
                         pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())], schema=X.ASK)
    return fn


NEAR_DDL = "bucket int, items binary, counts binary"
NEAR = pa.schema([("bucket", pa.int32()), ("items", pa.binary()), ("counts", pa.binary())])


def _near_total(near: pa.Table, words: pa.Table) -> pa.Table:
    """The words of a range with their neighbour counts summed."""
    bucket = (near if near.num_rows else words)["bucket"][0].as_py()
    if bucket < 0:
        w, counts = b"", sum(np.frombuffer(x, "<i8") for x in near["extra"].to_pylist()).tobytes()
    else:
        w = b"".join(words["items"].to_pylist())
        known = np.ascontiguousarray(np.frombuffer(w, WORDS)["h"])
        total = np.zeros(len(known) * 2 * K, np.int64)
        for h, raw in zip(near["keys"].to_pylist(), near["extra"].to_pylist()):
            h = np.frombuffer(h, U)
            row, col, n = _unpacked(raw, len(h))
            total[np.searchsorted(known, h)[row] * (2 * K) + col] += n  # a chunk has each entry once
        key = np.flatnonzero(total)
        counts = key.astype("<i8").tobytes() + total[key].astype("<i8").tobytes()
    return pa.table([pa.array([bucket], pa.int32()), pa.array([w], pa.binary()), pa.array([counts], pa.binary())], schema=NEAR)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchanged(row: np.ndarray, col: np.ndarray, n: np.ndarray, own: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The class of each word that raises the class bigram likelihood most, the others held.

    Entries (sorted by ``row``) say how often word ``row`` has class ``col`` before it, or ``col - K`` after it."""
    out, total = np.zeros((len(own), LEARNED)), np.bincount(row, weights=n * (col < K), minlength=len(own))
    near = np.concatenate([grams[:, :LEARNED], grams[:LEARNED].T]).astype(float)
    step = 1 << 16
    for a in range(0, len(row), step):
        r, m = row[a:a + step], n[a:a + step, None].astype(float)
        with_ = near[col[a:a + step]]
        with_[np.arange(len(r)), own[r]] -= m[:, 0]
        with_ = np.maximum(with_, 0)
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[first]] += np.add.reduceat(_xlogx(with_ + m) - _xlogx(with_), first, axis=0)
    for size in (grams.sum(1), grams.sum(0)):
        left = np.tile(size[:LEARNED].astype(float), (len(own), 1))
        left[np.arange(len(own)), own] -= total
        left = np.maximum(left, 0)
        out -= _xlogx(left + total[:, None]) - _xlogx(left)
    return np.where(total > 0, out.argmax(1), own)


def _move(grams: np.ndarray):
    def fn(batches):
        for batch in batches:
            rows = []
            for items, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                w = np.frombuffer(items, WORDS).copy()
                key, n = np.frombuffer(counts, "<i8").reshape(2, -1)
                at, row = np.unique(key // (2 * K), return_inverse=True)
                if len(at):
                    w["k"][at] = exchanged(row, key % (2 * K), n, w["k"][at].astype(np.int64), grams)
                rows.append(w.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], schema=COUNT)
    return fn


SIZE_DDL = "s int, k int, c long, words long, once long"
SIZE = pa.schema([("s", pa.int32()), ("k", pa.int32()), ("c", pa.int64()), ("words", pa.int64()), ("once", pa.int64())])


def _sizes(batches):
    """Tokens, words and words seen once by surface and class."""
    for batch in batches:
        for raw in batch.column(1).to_pylist():
            w = np.frombuffer(raw, WORDS)
            at = w["s"].astype(np.int64) * K + w["k"]
            sums = [np.bincount(at, weights=x, minlength=SURFACE * K).astype(np.int64) for x in (w["c"], np.ones(len(w)), w["c"] == 1)]
            hit = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(hit // K, pa.int32()), pa.array(hit % K, pa.int32()), *(pa.array(x[hit]) for x in sums)], schema=SIZE)


class Model:
    """The bounded part of the model: transitions, sizes, classes of words never seen; the words with counts and classes stay in the table ``path``."""

    def __init__(self, grams, sizes, path):
        self.grams, self.path = grams, path
        at = {i: np.zeros((SURFACE, K), np.int64) for i in ("c", "words", "once")}
        for r in sizes:
            for i in at:
                at[i][r.s, r.k] = r[i]
        self.tokens_of, self.words_of = at["c"].sum(0), at["words"].sum(0)
        self.n, self.v = int(self.tokens_of.sum()), int(self.words_of.sum())
        once = at["once"][:, :END_CLASS]
        self.unseen = np.where(once.any(1), once.argmax(1), LEARNED + np.arange(SURFACE))


def fit(chunks: DataFrame, n: int, root: str, vocabulary: int | None = None, rounds: int = ROUNDS) -> Model:
    """The model of ``n`` chunks; what it writes lies below ``root``."""
    spark, r = chunks.sparkSession, X.ranges(n)
    counts = chunks.mapInArrow(_count(r), PART_DDL)
    if r.per > 1:
        counts = counts.groupBy("bucket", "part").applyInArrow(_count_parted(r), PART_DDL)
    counts.groupBy("bucket").applyInArrow(_total, COUNT_DDL).write.parquet(f"{root}/counts")
    words = spark.read.parquet(f"{root}/counts")
    most = LEARNED if vocabulary is None else vocabulary
    best = words.mapInArrow(_top(most), TOP_DDL).orderBy(F.desc("c"), "h").limit(most).collect()  # the seeds, or a given vocabulary
    words = words.mapInArrow(_seeded([(b.h, b.c) for b in best], vocabulary is not None), COUNT_DDL)
    grams = np.zeros((K, K), np.int64)
    for turn in [*range(rounds), None]:  # the last pass counts the class bigrams of the final classes
        said = X.answer(chunks.select("chunk", "words").mapInArrow(_ask(r), X.ASK_DDL), _answer("u1"), r, words)
        near = X.meet(chunks, said, _neighbours(r, turn), X.ASK_DDL)
        if r.per > 1:
            near = near.groupBy("bucket", F.expr(f"chunk div {r.together}")).applyInArrow(_near_parted(r), X.ASK_DDL)
        near.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_near_total, NEAR_DDL).write.parquet(f"{root}/near{turn}")
        near = spark.read.parquet(f"{root}/near{turn}")
        grams = sum((np.frombuffer(x.counts, "<i8").reshape(K, K) for x in near.filter("bucket < 0").select("counts").collect()), np.zeros((K, K), np.int64))
        words = near.filter("bucket >= 0").mapInArrow(_move(grams), COUNT_DDL)
    sizes = words.mapInArrow(_sizes, SIZE_DDL).groupBy("s", "k").agg(*[F.sum(c).alias(c) for c in ("c", "words", "once")]).collect()  # by surface and class
    return Model(grams, sizes, f"{root}/near{turn}")


def _score(m: Model):
    step = np.log10((m.grams + ALPHA) / (m.grams.sum(1, keepdims=True) + ALPHA * K))
    size = np.log10(m.tokens_of + DELTA * (m.words_of + 1))  # one word more: any that was never seen
    base = np.log10(m.n + DELTA * (m.v + 1))

    def fn(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SCORE.empty_table()
        own, rows, ids, _ = _opened(table.to_pylist()[0])
        said = X.gathered(answers, SAID)
        k = np.where(said["k"] == NONE, m.unseen[own["s"]], said["k"])
        k[own["h"] == END] = END_CLASS
        cls, c = k[ids].astype(np.int64), said["c"][ids]
        before = np.concatenate([[END_CLASS], cls[:-1]])
        seen = np.log10(c + DELTA)
        emit = np.where(cls == END_CLASS, 0.0, seen - size[cls])
        n, tok = len(rows), rows["n"].astype(np.int64)
        doc = np.repeat(np.arange(n), tok)
        return pa.table([pa.array(rows["id"], mask=rows["has"] == 0), pa.array(rows["held"] > 0), pa.array(tok),
                         pa.array(np.bincount(doc[c > 0], minlength=n)), pa.array(np.full(n, m.n), pa.int64()),
                         pa.array(np.bincount(doc, weights=seen, minlength=n) - tok * base),
                         pa.array(np.bincount(doc, weights=step[before, cls] + emit, minlength=n))], schema=SCORE)
    return fn


def score_texts(docs: DataFrame, folds: int = 10, vocabulary: int | None = None, rounds: int = ROUNDS,
                chunk_bytes: int = X.CHUNK_BYTES) -> DataFrame:
    """Scores of all texts by the model of those whose crc32(doc_id) mod ``folds`` is not 0."""
    spark = docs.sparkSession
    root, n = scratch_root(spark, "brown"), X.chunk_count(docs, chunk_bytes)
    marked = docs.select("doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0).alias("held_out"))
    # bucketed by chunk, so that every pass meets its answers without a shuffle of the tokens; fewer buckets than shuffle partitions would be shuffled
    name, parts = f"brown_{uuid.uuid4().hex}", max(X.partitions(docs, n), int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        (X.chunked(marked, n, "held_out").groupBy("chunk").applyInArrow(_compact, CHUNK_DDL)
         .write.bucketBy(parts, "chunk").option("path", f"{root}/chunks").saveAsTable(name))
        chunks = spark.table(name)
        model = fit(chunks, n, root, vocabulary, rounds)
        words = spark.read.parquet(model.path).filter("bucket >= 0").select("bucket", "items")
        cut = X.ranges(n)
        said = X.answer(chunks.select("chunk", "words").mapInArrow(_ask(cut), X.ASK_DDL), _answer(SAID), cut, words)
        out = X.meet(chunks, said, _score(model), SCORE_DDL)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the catalog's entry only, the files lie in the scratch folder
    return out
