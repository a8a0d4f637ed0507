"""Benchmark decontamination by latent semantic retrieval, with sequence and answer checks.

1. **Terms.**  Words with A-Z lowered and edge punctuation off.  Term weights are inverse
   frequencies over *all* documents (one pass); the vocabulary is the benchmark's, without
   terms more frequent than ``STOP`` of all words (the rarest of each passage always count).
2. **Latent space.**  Benchmark texts are cut into passages; a randomised SVD of their TF-IDF
   matrix A (range finder with power steps, each a distributed product A'(A x), then the small
   decomposition of A'A in that range) gives the ``RANK`` leading right singular vectors.  Document passages are folded in: 64 words, every 32.
3. **Candidates.**  Passages whose cosine with a benchmark passage reaches ``COSINE``.  The benchmark is
   the stated query set: it goes to the workers in blocks of at most ``BLOCK_ITEMS``
   items, so what is broadcast is bounded; every passage of every document is searched.
4. **Checks.**  The longest common subsequence of the benchmark passage and the document's words around
   the candidate must reach ``LCS`` of the passage; below ``SURE`` the passage's answer (its last
   fifth) must be there as well, which tells paraphrases from texts on the same subject.

Nothing is shuffled but term counts.  Defined results: null or empty texts and items match
nothing; an item under ``LEAST`` words matches where exactly its words stand in a row, case and edge punctuation
aside (even one word alone), found by the hash of the sequence; repeated rows give repeated matches; null ids are kept; other columns are ignored; an empty table or
benchmark gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.words import LOWER, U, Block, blocks, grams, texts

SEGMENT = 32           # a passage is two segments
ITEM_WORDS = 64        # longest benchmark passage
LEAST = 8
STOP = 1e-4            # terms more frequent are left out, but for the RAREST of each passage
RAREST = 8
RANK, POWER = 256, 2
COSINE, LCS, SURE, ANSWER = 0.45, 0.6, 0.8, 0.5
BLOCK_ITEMS = 2000
TERM_DDL = "term long, n long"
TERM = pa.schema([("term", pa.int64()), ("n", pa.int64())])
MATCH_DDL = "doc_id long, item_id long, word long, cosine double, lcs double, answer double"
MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("word", pa.int64()), ("cosine", pa.float64()),
                   ("lcs", pa.float64()), ("answer", pa.float64())])
_EDGE = np.ones(256, bool)
_EDGE[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _EDGE[_lo:_hi] = False
_EDGE_BYTES = bytes(np.flatnonzero(_EDGE).tolist())


def terms(b: Block) -> np.ndarray:
    """Hash of each word without case and edge punctuation (a word of punctuation alone keeps one byte of it)."""
    start, end = b.start.copy(), b.end.copy()
    for _ in range(4):
        end -= (end - start > 1) & _EDGE[b.data[end - 1]]
        start += (end - start > 1) & _EDGE[b.data[start]]
    for i in np.flatnonzero((end - start > 1) & (_EDGE[b.data[end - 1]] | _EDGE[b.data[start]])).tolist() if len(start) else []:  # few have more
        word = b.data[start[i]:end[i]].tobytes()
        left = len(word) - len(word.lstrip(_EDGE_BYTES))
        start[i], end[i] = (start[i] + left, start[i] + len(word.rstrip(_EDGE_BYTES))) if left < len(word) else (start[i], start[i] + 1)
    return Block(b.lo, b.hi, LOWER[b.data], b.offs, start, end, b.first).hashes()


def _words(batches):
    for batch in batches:
        t = [terms(b) for b in blocks(*texts(batch.column(0)))]
        if t:
            h, n = np.unique(np.concatenate(t), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], schema=TERM)


def _counted(known: np.ndarray):
    """Counts of the known terms of a task (first row: all words), in one row per term."""
    def fn(batches):
        total, n = 0, np.zeros(len(known), np.int64)
        for batch in batches:
            for b in blocks(*texts(batch.column(0))):
                h = terms(b)
                total += len(h)
                pos = np.minimum(np.searchsorted(known, h), len(known) - 1)
                n += np.bincount(pos[known[pos] == h], minlength=len(known))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, -1)), pa.array(np.append(n[hit], total))], schema=TERM)
    return fn


PASSAGE_DDL = "item_id long, last boolean, words binary"
PASSAGE = pa.schema([("item_id", pa.int64()), ("last", pa.bool_()), ("words", pa.binary())])


def _passages(batches):
    """Benchmark texts as passages of at most ITEM_WORDS words, of about equal length."""
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        for b in blocks(*texts(batch.column(1))):
            h = terms(b)
            for d in range(b.n):
                own = h[b.first[d]:b.first[d + 1]]
                parts = -(-len(own) // ITEM_WORDS)
                for i, part in enumerate(np.array_split(own, parts) if parts else []):
                    rows.append((ids[b.lo + d], i == parts - 1, part.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(PASSAGE.types)], schema=PASSAGE)


def _weights(words: np.ndarray, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and weights of the known words among ``words``."""
    pos = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
    hit = known[pos] == words if len(known) else np.zeros(len(words), bool)
    return pos[hit], idf[pos[hit]]


def _product(known: np.ndarray, idf: np.ndarray, x: np.ndarray):
    """The rows of A'(A x) that the passages of a task touch; A's rows are TF-IDF vectors of length one."""
    def fn(batches):
        out = {}
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                words = np.frombuffer(raw, U)
                at, w = _weights(words, known, idf)
                if len(at) and len(words) >= LEAST:
                    w = w / np.linalg.norm(w)
                    y = w @ x[at]
                    for i, v in zip(at.tolist(), w):
                        out[i] = out.get(i, 0) + v * y
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())], schema=ROW)
    return fn


ROW_DDL = "term int, row binary"
ROW = pa.schema([("term", pa.int32()), ("row", pa.binary())])


def _added(table: pa.Table) -> pa.Table:
    rows = sum(np.frombuffer(r) for r in table["row"].to_pylist())
    return pa.table([table["term"].slice(0, 1).cast(pa.int32()), pa.array([rows.tobytes()], pa.binary())], schema=ROW)


def latent(passages: DataFrame, known: np.ndarray, idf: np.ndarray, rank: int = RANK, power: int = POWER) -> np.ndarray:
    """Terms x directions: the leading right singular vectors of the passages' TF-IDF matrix."""
    rng = np.random.Generator(np.random.PCG64(7))
    x = rng.standard_normal((len(known), min(rank, len(known))))
    for _ in range(power + 1):
        q, _ = np.linalg.qr(x)
        x = np.zeros_like(q)
        for r in passages.mapInArrow(_product(known, idf, q), ROW_DDL).groupBy("term").applyInArrow(_added, ROW_DDL).collect():  # a row per term
            x[r.term] = np.frombuffer(r.row)
    # the small problem: A'A seen from the range that q spans; its eigenvectors turn q into singular vectors of A
    square, turn = np.linalg.eigh(q.T @ x)
    return (q @ turn[:, np.argsort(-square, kind="stable")]).astype(np.float32)


def _lcs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of ``a`` are in one longest common subsequence with ``b``."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(1, len(a) + 1):
        same = np.where(b == a[i - 1], best[i - 1, :-1] + 1, best[i - 1, 1:])
        best[i, 1:] = np.maximum.accumulate(np.maximum(same, best[i - 1, 1:]))
    used, i, j = np.zeros(len(a), bool), len(a), len(b)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            used[i] = True
    return used


class Index:
    """A block of benchmark passages in the latent space."""

    def __init__(self, rows, known, idf, space):
        self.known, self.idf, self.space = known, idf, space
        self.item, self.last, self.words, vec = [], [], [], []
        short: dict[int, list] = {}
        for r in rows:
            words = np.frombuffer(r.words, U)
            if len(words) < LEAST:
                short.setdefault(len(words), []).append((int(grams(words, np.zeros(1, np.int64), len(words))[0]), r.item_id))
                continue
            at, w = _weights(words, known, idf)
            if len(at):
                self.item.append(r.item_id)
                self.last.append(r.last)
                self.words.append(words)
                vec.append((w[:, None] * space[at]).sum(0))
        self.lists = [w.tolist() for w in self.words]
        v = np.array(vec, np.float32).reshape(len(vec), space.shape[1])
        self.vec = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        # terms that reach COSINE with a passage even when they are a segment's only one
        size = np.maximum(np.linalg.norm(space, axis=1), 1e-9)
        self.alone = ((space @ self.vec.T).max(axis=1, initial=-1) / size >= COSINE - 1e-3).astype(np.int64)
        self.short = {k: sorted(v, key=lambda x: x[0]) for k, v in short.items()}  # (hash of the sequence, item) of the short items

    def sequences(self, h: np.ndarray, b: Block):
        """(text, item, first word) of the places where all words of a short item stand in a row."""
        for k, own in self.short.items():
            at = b.starts_of(k)
            if not len(at):
                continue
            keys = np.array([key for key, _ in own], U)
            g = grams(h, at, k)
            lo, hi = np.searchsorted(keys, g), np.searchsorted(keys, g, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                d = int(np.searchsorted(b.first, at[i], "right") - 1)
                for j in range(lo[i], hi[i]):
                    yield d, own[j][1], int(at[i] - b.first[d])


def _candidates(ix: Index, b: Block, h: np.ndarray) -> dict:
    """Checked matches of a block's texts: (text, item) -> (cosine, share, answer, word)."""
    best: dict = {}
    doc = b.doc
    within = np.arange(len(h)) - b.first[:-1][doc]
    n_seg = np.maximum(-(-np.diff(b.first) // SEGMENT), 1)
    base = np.concatenate([[0], np.cumsum(n_seg)])
    seg = base[:-1][doc] + within // SEGMENT
    at = np.minimum(np.searchsorted(ix.known, h), len(ix.known) - 1)
    hit = ix.known[at] == h
    at, of = at[hit], seg[hit]
    if not len(at):
        return best
    # a passage is a segment and the next of the same text; one whose only term cannot reach COSINE alone is no candidate
    last = np.zeros(base[-1], bool)
    last[base[1:] - 1] = True
    hits = np.bincount(of, minlength=base[-1] + 1) + np.bincount(of, weights=ix.alone[at], minlength=base[-1] + 1)
    some = np.flatnonzero(hits[:-1] + np.where(last, 0, hits[1:]) >= 2)
    if not len(some):
        return best
    new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    row = np.zeros(base[-1] + 1, np.int64)  # 0: a segment without terms
    row[of[new]] = np.arange(len(new)) + 1
    vec = np.zeros((len(new) + 1, ix.space.shape[1]), np.float32)
    vec[1:] = np.add.reduceat(ix.space[at] * ix.idf[at, None], new, axis=0)
    pair = vec[row[some]] + vec[np.where(last[some], 0, row[some + 1])]
    size = np.maximum(np.linalg.norm(pair, axis=1, keepdims=True), 1e-9)
    cos = (pair / size) @ ix.vec.T
    at_s = -1
    for s, j in zip(*(i.tolist() for i in np.nonzero(cos >= COSINE))):
        p = some[s]
        d = int(np.searchsorted(base, p, "right") - 1)
        lo = b.first[d] + max(0, (p - base[d] - 1) * SEGMENT)
        hi = min(b.first[d + 1], b.first[d] + (p - base[d] + 3) * SEGMENT)
        words, here = ix.words[j], h[lo:hi]
        if s != at_s:
            at_s, there = s, set(here.tolist())
        if sum(w in there for w in ix.lists[j]) < LCS * len(words):
            continue
        used = _lcs(words, here)
        share, tail = used.mean(), max(2, len(words) // 5)
        answer = used[-tail:].mean()
        if share >= SURE or share >= LCS and answer >= ANSWER:
            key = (d, ix.item[j])
            if key not in best or share > best[key][1]:
                best[key] = (float(cos[s, j]), float(share), float(answer), int(lo - b.first[d]))
    return best


def _search(ix: Index):
    def fn(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for b in blocks(*texts(batch.column(1))):
                h = terms(b)
                best = _candidates(ix, b, h) if len(ix.item) else {}
                for d, item, word in ix.sequences(h, b):
                    if (d, item) not in best or best[d, item][1] < 1:
                        best[d, item] = (1.0, 1.0, 1.0, word)
                rows += [(ids[b.lo + d], item, word, c, share, answer) for (d, item), (c, share, answer, word) in sorted(best.items(), key=str)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(MATCH.types)], schema=MATCH)
    return fn


def _clean(ix: Index):
    """Rows of a batch whose own text matches nothing, with all their columns."""
    search = _search(ix)

    def fn(batches):
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], names=["doc_id", "text"])
            keep = np.ones(batch.num_rows, bool)
            for found in search([numbered]):
                keep[found.column("doc_id").to_numpy(zero_copy_only=False)] = False
            yield batch.filter(pa.array(keep))
    return fn


def _indexes(docs: DataFrame, benchmark: DataFrame):
    """An index of each bounded block of benchmark items, with term weights from all of ``docs``."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").orderBy("item_id", "text")
    blocks_ = max(1, -(-items.count() // BLOCK_ITEMS))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks_)))
    for k in range(blocks_):
        part = numbered.filter(F.col("block") == k)
        passages = part.select("item_id", "text").mapInArrow(_passages, PASSAGE_DDL)
        rows = passages.collect()  # the stated query set, one bounded block of it
        if not rows:
            continue
        long_ = [r for r in rows if len(r.words) >= LEAST * 8]
        known, idf, space = np.zeros(0, U), np.zeros(0, np.float32), np.zeros((0, 1), np.float32)
        if long_:
            known = np.unique(np.concatenate([np.frombuffer(r.words, U) for r in long_]))
            count = docs.select("text").mapInArrow(_counted(known), TERM_DDL).groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row per benchmark term
            n = {r.term: r.n for r in count}
            total = n.get(-1, 0)
            freq = np.array([n.get(i, 0) for i in range(len(known))], float)
            ok = freq <= max(STOP * total, 20)
            for r in long_:  # every passage keeps its rarest terms
                own = np.searchsorted(known, np.unique(np.frombuffer(r.words, U)))
                ok[own[np.argsort(freq[own], kind="stable")[:RAREST]]] = True
            known, idf = known[ok], np.log((total + 1) / (freq[ok] + 1)).astype(np.float32)
            space = latent(passages, known, idf)
        index = Index(rows, known, idf, space)
        if index.item or index.short:
            yield index


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, word, cosine, lcs, answer``: the best match of each document and benchmark item."""
    found = docs.sparkSession.createDataFrame([], MATCH_DDL)
    for index in _indexes(docs, benchmark):
        found = found.unionByName(docs.select("doc_id", "text").mapInArrow(_search(index), MATCH_DDL))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark text.

    Each row is judged by its own text where it lies, so no text is shuffled and
    rows with equal or no ids are judged each for itself.
    """
    out = docs
    for index in _indexes(docs, benchmark):
        out = out.mapInArrow(_clean(index), docs.schema)
    return out
