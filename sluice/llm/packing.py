"""Best-fit packing of token sequences by large-item matching.

1. **Tokens.**  Every whole text is cut into units (white space and the word it
   precedes): the tokenizer never joins tokens across them, so each distinct unit
   of a worker is encoded once and texts are put together by array look-ups.
   Texts with white space other than the six ASCII ones, or with a special
   token's text, go through the tokenizer whole.  One end id closes each text.
2. **Pieces.**  Only texts longer than the capacity are cut; the first piece takes
   the remainder, so all others are full.
3. **Plan.**  Packing depends on lengths only, so it is solved on the histogram of
   lengths (at most ``capacity`` rows, whatever the input): lengths above one
   third of the capacity pair at most twice per sequence, greedily, largest with the
   largest that fits; the smaller ones, largest first, go where the least gap remains.
   Equal sequences are planned as one pattern with a count.
4. **Places.**  Pieces are numbered within their length (two-level: counts per
   (length, bucket), then a window inside each bucket, so a length of a third
   of all pieces is split) and the number is looked up in the plan.

Defined results: null or empty text is one piece holding the end id; equal rows
are packed as often as they occur; null ``doc_id`` is kept; other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.words import U, Block, blocks, texts
from sluice.session import scratch_root

CAPACITY = 2048
END_ID = 0
CACHE_UNITS = 400_000     # a worker's cache of encoded units starts anew beyond this; results do not depend on it
PER_BUCKET = 4_000        # pieces numbered together
SPECIAL = b"<|endoftext|>"
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])


class Encoder:
    """Ids of texts, by the vocabulary file ``vocab`` and its ranks file ``ranks`` (the same tokens, read by the faster library)."""

    def __init__(self, vocab: str, ranks: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(vocab)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.units = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self._reset()

    def _reset(self):
        self.known, self.at = np.zeros(0, U), np.zeros(0, np.int64)  # sorted unit hashes, their entry
        self.offs, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, h: np.ndarray, strings: list[str]):
        if len(self.known) + len(h) > CACHE_UNITS:
            self._reset()
        got = [self.units.encode_ordinary(s) for s in strings]
        size = np.fromiter(map(len, got), np.int64, len(got))
        entry = np.arange(len(got)) + len(self.offs) - 1
        self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(size)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.uint32, int(size.sum()))])
        order = np.searchsorted(self.known, h)
        self.known, self.at = np.insert(self.known, order, h), np.insert(self.at, order, entry)

    def block(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block and each text's offsets in them (without end ids)."""
        odd = _odd(b)
        # a unit runs from the end of the word before it (or the text's start) to the end of its word
        lo = np.concatenate([[0], b.end[:-1]]) if len(b.end) else b.start
        lo = np.maximum(lo, np.repeat(b.offs[:-1], np.diff(b.first)))
        tail = np.where(np.diff(b.first) > 0, b.end[np.maximum(b.first[1:] - 1, 0)] if len(b.end) else b.offs[:-1], b.offs[:-1])
        has_tail = tail < b.offs[1:]
        doc = np.concatenate([b.doc, np.flatnonzero(has_tail)])
        lo, hi = np.concatenate([lo, tail[has_tail]]), np.concatenate([b.end, b.offs[1:][has_tail]])
        order = np.argsort(doc, kind="stable")
        lo, hi, doc = lo[order], hi[order], doc[order]
        plain = ~odd[doc]
        lo, hi, doc = lo[plain], hi[plain], doc[plain]
        spans = Block(b.lo, b.hi, b.data, b.offs, lo, hi, np.searchsorted(doc, np.arange(b.n + 1)))
        h, first, back = np.unique(spans.hashes(), return_index=True, return_inverse=True)
        pos = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[pos] != h if len(self.known) else np.ones(len(h), bool)
        if new.any():
            raw = b.data.tobytes()
            size = len(self.known)
            self._learn(h[new], [raw[lo[i]:hi[i]].decode("utf-8", "replace") for i in first[new]])
            if len(self.known) != size + int(new.sum()):  # the cache began anew: learn the rest of this block too
                old = ~new
                if old.any():
                    self._learn(h[old], [raw[lo[i]:hi[i]].decode("utf-8", "replace") for i in first[old]])
            pos = np.searchsorted(self.known, h)
        entry = self.at[pos][back]
        size = self.offs[entry + 1] - self.offs[entry]
        src = np.repeat(self.offs[entry] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ids = self.ids[src]
        per = np.bincount(doc, weights=size, minlength=b.n).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(per)])
        if odd.any():
            raw, parts = b.data.tobytes(), []
            for d in range(b.n):
                parts.append(np.array(self.whole.encode(raw[b.offs[d]:b.offs[d + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                             if odd[d] else ids[offs[d]:offs[d + 1]])
            ids, offs = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, offs


def _odd(b: Block) -> np.ndarray:
    """Texts that hold other white space than the six ASCII characters, or a special token's text."""
    d, out = b.data, np.zeros(b.n, bool)
    if not len(d):
        return out
    hit = (d >= 0x1C) & (d <= 0x1F)
    two = np.zeros(len(d), bool)
    if len(d) > 1:
        two[:-1] = (d[:-1] == 0xC2) & ((d[1:] == 0x85) | (d[1:] == 0xA0))
        # lead bytes of the blocks that hold the other Unicode spaces; a needless match only costs speed
        two[:-1] |= ((d[:-1] == 0xE1) & (d[1:] == 0x9A)) | ((d[:-1] == 0xE3) & (d[1:] == 0x80))
        if len(d) > 2:
            third = ((d[2:] <= 0x8A) | (d[2:] == 0xA8) | (d[2:] == 0xA9) | (d[2:] == 0xAF))
            two[:-2] |= (d[:-2] == 0xE2) & (((d[1:-1] == 0x80) & third) | ((d[1:-1] == 0x81) & (d[2:] == 0x9F)))
    at = np.flatnonzero(hit | two)
    out[np.searchsorted(b.offs, at, "right") - 1] = True
    raw, k = b.data.tobytes(), 0
    while (k := raw.find(SPECIAL, k)) >= 0:
        out[np.searchsorted(b.offs, k, "right") - 1] = True
        k += 1
    return out


_encoders: dict[tuple, Encoder] = {}


def _tokenise(vocab: str, ranks: str, pattern: str, capacity: int, with_ids: bool):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocab, ranks)
        if key not in _encoders:
            _encoders[key] = Encoder(*key, pattern)
        enc = _encoders[key]
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for b in blocks(*texts(batch.column(1))):
                ids, offs = enc.block(b)
                rows = []
                for d in range(b.n):
                    own = np.append(ids[offs[d]:offs[d + 1]], np.uint32(END_ID)).astype("<u4")
                    first = (len(own) - 1) % capacity + 1
                    lo = 0
                    for piece, hi in enumerate(range(first, len(own) + 1, capacity)):
                        part = own[lo:hi]
                        rows.append((ids_of[b.lo + d], piece, lo, hi - lo, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                        lo = hi
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(PIECES.types)], schema=PIECES)
    return fn


def pieces(docs: DataFrame, vocab: str, ranks: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, ids`` (ids null unless asked for)."""
    return docs.select("doc_id", "text").mapInArrow(_tokenise(vocab, ranks, pattern, capacity, with_ids), PIECES_DDL)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots ``(length, first number, per sequence, first sequence, offset)`` for ``counts`` pieces of each length.

    Pieces ``first number ..`` of that length go ``per sequence`` each into consecutive sequences.
    """
    left = {n: c for n, c in counts.items() if c}
    patterns: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}  # gap -> (items, sequences)

    def put(items, count, gap):
        if count:
            patterns.setdefault(gap, []).append((items, count))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:  # the largest first, each with the largest that fits beside it
        for m in large:
            if not left.get(n):
                break
            if m > n or n + m > capacity or not left.get(m):
                continue
            if m == n:
                pairs = left[n] // 2
                left[n] -= 2 * pairs
                put([(n, 2)], pairs, capacity - 2 * n)
            else:
                pairs = min(left[n], left[m])
                left[n], left[m] = left[n] - pairs, left[m] - pairs
                put([(n, 1), (m, 1)], pairs, capacity - n - m)
        put([(n, 1)], left.pop(n, 0), capacity - n)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        rest = left[n]
        while rest:
            gap = min((g for g in patterns if g >= n), default=None)
            if gap is None:
                gap, group = capacity, [([], -(-rest // (capacity // n)))]
            else:
                group = patterns.pop(gap)
            k, again = gap // n, []
            for items, count in group:
                full = min(count, rest // k)
                put([*items, (n, k)], full, gap - k * n)
                rest, count = rest - full * k, count - full
                if rest and count:  # fewer than k are left: one sequence takes them
                    put([*items, (n, rest)], 1, gap - rest * n)
                    rest, count = 0, count - 1
                if count:
                    again.append((items, count))
            if again:
                patterns.setdefault(gap, []).extend(again)
    slots, used, sequence = [], dict.fromkeys(counts, 0), 0
    for gap in sorted(patterns):
        for items, count in patterns[gap]:
            offset = 0
            for n, k in items:
                slots.append((n, used[n], k, sequence, offset))
                used[n] += k * count
                offset += n * k
            sequence += count
    return slots


def _placed(slots: list[tuple[int, int, int, int, int]]):
    arr = np.array(sorted(slots), np.int64).reshape(-1, 5)
    key = arr[:, 0] * (1 << 48) + arr[:, 1]

    def fn(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n, rank = (t[c].to_numpy() for c in ("length", "rank"))
            s = arr[np.searchsorted(key, n * (1 << 48) + rank, "right") - 1] if len(n) else arr[:0]
            nth = rank - s[:, 1]
            out = t.drop_columns(["rank"]).append_column("sequence_id", pa.array(s[:, 3] + nth // s[:, 2], pa.int64()))
            out = out.append_column("offset", pa.array(s[:, 4] + nth % s[:, 2] * n, pa.int64()))
            yield from out.to_batches()
    return fn


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (pieces, read from a table: it is read twice) with ``sequence_id`` and ``offset``."""
    per = found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity rows at most
    counts = {r.length: r.n for r in per}
    buckets = max(1, -(-sum(counts.values()) // PER_BUCKET))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
              .withColumn("rank", F.col("before") + F.col("own")).select(*found.columns, "rank"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    return ranked.mapInArrow(_placed(plan(counts, capacity)), f"{ddl}, sequence_id long, offset long")


def pack(docs: DataFrame, vocab: str, ranks: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and the offset each takes, ids included on demand."""
    spark = docs.sparkSession
    out = scratch_root(spark, "packing")
    found = pieces(docs, vocab, ranks, pattern, capacity, with_ids)
    (found if with_ids else found.drop("ids")).write.parquet(out)
    return placed(spark.read.parquet(out), capacity)
