"""Quality classifier: a generalised additive model with pairwise interactions.

Every whole text becomes a row of measures (lengths, character classes, repeats;
the text alone decides them).  Each measure is cut into quantile bins; cyclic
gradient boosting visits one measure after the other and adds a shallow tree
(at most three cuts) to its look-up table; then the pairs that reduce the loss
most get two-dimensional tables from one-cut-by-one-cut trees.  A score is the
sigmoid of an intercept and one look-up per table, added over whole columns.

The model is fitted on at most ``max_rows`` labelled training rows (a parameter;
those with the smallest hashes of ``doc_id``, so any input gives the same ones); it is a few
thousand numbers.  Counts by the hash's leading bits cut the labelled rows to little more than
``max_rows`` before they are sorted in one task.  Measures and scores cover all rows.

Defined results: null text reads as empty, and empty texts get a score; rows
with null ``doc_id`` are scored, never learned from; repeated rows are scored alike and learned from once;
a label given twice counts once, an id with both labels is learned from with each;
other columns are ignored; without labelled training rows every score is 0.5, with
one label only it leans to that label; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.words import Block, blocks, grams, texts
from sluice.session import scratch_root

MAX_ROWS = 20_000
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 120, 40, 8, 0.15
FEATURES = ["words", "word_size", "symbols", "capitals", "digits", "exclaims", "stops", "other_bytes", "line_words", "repeated_lines",
            "variety", "repeated_windows", "runs", "closed_words", "capital_words", "pipes", "short_words", "top_word"]


def _share(mask: np.ndarray, b: Block, per: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[b.offs[1:]] - total[b.offs[:-1]]) / per


def lines(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the lines of a block that hold a word (from its first word to its last)."""
    if not len(b.start):
        return b.start, b.end, b.start
    breaks = np.concatenate([[0], np.cumsum(b.data == 10)])
    row, doc = breaks[b.start], b.doc
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return b.start[first], b.end[last], doc[first]


def _repeats(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct items, items seen before, most of one item."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=n)
    at = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[at], np.diff(np.append(at, len(d))))
    return distinct, np.bincount(d, minlength=n) - distinct, most


def measures(b: Block) -> np.ndarray:
    d, n = b.data, np.diff(b.first).astype(float)
    size, some = np.maximum(np.diff(b.offs), 1).astype(float), np.maximum(n, 1)
    h, doc = b.hashes(), b.doc
    upper = (d >= 65) & (d <= 90)
    ls, le, ld = lines(b)
    n_lines = np.maximum(np.bincount(ld, minlength=b.n), 1)
    line_hash = Block(b.lo, b.hi, d, b.offs, ls, le, np.searchsorted(ld, np.arange(b.n + 1))).hashes() if len(ls) else np.zeros(0, np.uint64)
    distinct, _, most = _repeats(doc, h, b.n)
    at = b.starts_of(3)
    _, again, _ = _repeats(doc[at], grams(h, at, 3), b.n)
    run = np.zeros(len(h), bool)
    run[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    by = lambda mask: np.bincount(doc[mask], minlength=b.n) / some
    last = d[b.end - 1] if len(h) else d[:0]
    return np.column_stack([
        np.log1p(n), _share(np.ones(len(d), bool), b, some), _share(np.isin(d, np.frombuffer(b"#*$%&|<>", np.uint8)), b, some), _share(upper, b, size),
        _share((d >= 48) & (d <= 57), b, size), _share(d == 33, b, some), _share((d == 46) | (d == 44), b, some),
        _share(d >= 128, b, size), n / n_lines, _repeats(ld, line_hash, b.n)[1] / n_lines, distinct / np.sqrt(some),
        again / some, by(run), by(~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128))) if len(h) else np.zeros(b.n),
        by(upper[b.start]) if len(h) else np.zeros(b.n), _share(d == 124, b, some), by(b.end - b.start <= 3),
        most / some]).astype(np.float32)


def _measure(batches):
    names = ["doc_id", *FEATURES]
    for batch in batches:
        rows = [measures(b) for b in blocks(*texts(batch.column(1)))]
        if rows:
            x = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=names)


class Gam:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(len(FEATURES))]
        self.tables, self.pairs = np.zeros((len(FEATURES), BINS)), []
        p = (y.sum() + 1) / (len(y) + 2)
        self.intercept = float(np.log(p / (1 - p)))
        if 0 < y.sum() < len(y):
            self._fit(self.binned(x), y)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)])

    def _fit(self, bins, y):
        f = np.full(len(y), self.intercept)
        grad = lambda: (y - (p := 1 / (1 + np.exp(-f))), p * (1 - p))
        for _ in range(ROUNDS):
            for j in range(bins.shape[1]):
                g, h = grad()
                step = RATE * _tree(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS))
                self.tables[j] += step
                f += step[bins[:, j]]
        g, h = grad()
        gains = []
        for a in range(bins.shape[1]):
            for c in range(a):
                gains.append((_cross(bins[:, a], bins[:, c], g, h)[0], a, c))
        self.pairs = [(a, c, np.zeros((BINS, BINS))) for _, a, c in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for a, c, t in self.pairs:
                g, h = grad()
                step = RATE * _cross(bins[:, a], bins[:, c], g, h)[1]
                t += step
                f += step[bins[:, a], bins[:, c]]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        f = self.intercept + sum(self.tables[j][bins[:, j]] for j in range(bins.shape[1])) + sum(t[bins[:, a], bins[:, c]] for a, c, t in self.pairs)
        return 1 / (1 + np.exp(-f))


LAMBDA = 2.0


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of the bins by a tree of at most three cuts on their gradient sums."""
    out = np.zeros(len(g))

    def cut(lo, hi, depth):
        gs, hs = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        if depth and hi - lo > 1:
            left, right = gs[:-1] ** 2 / (hs[:-1] + LAMBDA), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + LAMBDA)
            k = int(np.argmax(left + right))
            if left[k] + right[k] > gs[-1] ** 2 / (hs[-1] + LAMBDA) + 1e-9:
                cut(lo, lo + k + 1, depth - 1)
                cut(lo + k + 1, hi, depth - 1)
                return
        out[lo:hi] = gs[-1] / (hs[-1] + LAMBDA)

    cut(0, len(g), 2)
    return out


def _cross(a: np.ndarray, c: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and bin values of the best cut of each of two measures, taken together."""
    gs, hs = (np.bincount(a * BINS + c, w, BINS * BINS).reshape(BINS, BINS).cumsum(0).cumsum(1) for w in (g, h))
    parts = []
    for s in (gs, hs):
        q = s[:-1, :-1]
        parts.append((q, s[:-1, -1:] - q, s[-1:, :-1] - q, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + q))
    gain = sum(x ** 2 / (w + LAMBDA) for x, w in zip(*parts))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[i, j] / (w[i, j] + LAMBDA) for x, w in zip(*parts)]
    out = np.empty((BINS, BINS))
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return float(gain[i, j] - gs[-1, -1] ** 2 / (hs[-1, -1] + LAMBDA)), out


def _apply(model: Gam):
    def fn(batches):
        for batch in batches:
            x = np.column_stack([batch.column(j + 1).to_numpy(zero_copy_only=False) for j in range(len(FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])
    return fn


def _remainder(folds: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def _least_hashes(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` different rows with the least hashes of ``doc_id``."""
    rows = rows.distinct()
    top = F.shiftright(F.xxhash64("doc_id"), 48)
    have, edge = 0, None
    for slot, some in sorted(tuple(r) for r in rows.groupBy(top).agg(F.count(F.lit(1))).collect()):  # 2 ** 16 rows at most
        have += some
        if have >= n:
            edge = slot
            break
    some = rows if edge is None else rows.filter(top <= edge)
    return some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *FEATURES).limit(n)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    spark = docs.sparkSession
    out = scratch_root(spark, "gam")
    docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{f} float" for f in FEATURES)).write.parquet(out)
    found = spark.read.parquet(out)
    labelled = found.filter(_remainder(folds) != 0).join(labels.filter("quality IS NOT NULL").select("doc_id", "quality").distinct(), "doc_id")
    known = _least_hashes(labelled, max_rows).select(*FEATURES, "quality").toPandas()  # at most max_rows rows
    model = Gam(known[FEATURES].to_numpy(np.float32), known["quality"].to_numpy(np.float64))
    return (found.mapInArrow(_apply(model), "doc_id long, score double").withColumn("held_out", _remainder(folds) == 0)
            .select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
