"""Questions about corpus-wide keys, asked chunk by chunk.

Several operators need to know something about every hashed key of every text
(how many texts hold it, whether an earlier text holds it).  One row per key
would make the shuffle the whole cost, and a key of a third of all texts would
land in one task.  Here documents are dealt into **chunks** of a few MB, each
chunk asks once per *distinct* key (so a key, however frequent, is asked at
most once per chunk: that is the pre-aggregation), the questions travel packed
into one binary row per (chunk, key bucket), and the answers come back packed
the same way to the chunk that asked.

``T = chunked(docs)`` is one shuffle of the texts.  Every later step groups or
cogroups by ``chunk`` on that same partitioning, so Spark reuses the exchange
inside a query and only packed keys move after it.

Chunks and buckets both grow with the input.  Up to ``DIRECT`` chunks each sends a row to every bucket.
Beyond that a row for each would be the square of the input, so questions take two steps (``ranges``): a chunk
sends one row to each *group* of buckets, the rows of a set of chunks meet there, and one row per bucket
goes on; answers come back the same way.  Both groups and sets are square roots, so rows grow with the
power 1.5 of the input, and the work on keys in proportion to them.  Partitions hold one chunk each up to ``ONE_EACH`` chunks, then up
to ``TOGETHER`` (one is in memory at a time), and are no more than ``MOST``, so that the driver can track them.  Lost executors cost recomputed
tasks only: nothing is kept outside shuffles and checkpoints.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 6 << 20
ONE_EACH, TOGETHER, MOST = 512, 16, 1 << 15
DIRECT = 512   # chunks that ask every bucket by a row of its own
CHUNKS_EACH = 4  # chunks whose keys make a bucket, where there are more

ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
ASK_DDL = "bucket int, chunk int, keys binary, extra binary"
ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary())])
ANSWER_DDL = "chunk int, bucket int, answer binary"
# in two steps: ``of`` has (chunk, keys) of what was put together
OF = np.dtype([("chunk", "<i4"), ("n", "<u4")])
MERGED_DDL = f"{ASK_DDL}, of binary"
MERGED = ASK.append(pa.field("of", pa.binary()))
MERGED_ANSWER_DDL = f"{ANSWER_DDL}, of binary"
MERGED_ANSWER = ANSWER.append(pa.field("of", pa.binary()))


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks of about ``chunk_bytes`` of text (64 bytes are counted per row besides)."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return max(1, math.ceil((n * 64 + (size or 0)) / chunk_bytes))


def partitions(docs: DataFrame, chunks: int) -> int:
    """Shuffle partitions for ``chunks``; not below the session's number, or Spark would shuffle the texts again to meet their answers."""
    least = max(ONE_EACH, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(chunks, max(least, min(math.ceil(chunks / TOGETHER), MOST)))


def chunked(docs: DataFrame, chunks: int, *more: str) -> DataFrame:
    """``chunk, doc_id, text`` and the columns ``more``, one shuffle.

    Rows are dealt by a hash of id and whole text, so a hot id does not fill one chunk; rows that
    are equal in both do.
    """
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
                        F.col("doc_id"), F.col("text"), *more)
    return dealt.repartition(partitions(docs, chunks), "chunk")


class Ranges(NamedTuple):
    """How the hash range is cut: ``buckets``, of which ``per`` neighbours are addressed by one row, ``together`` chunks in one step."""

    buckets: int
    per: int = 1
    together: int = 1


def ranges(chunks: int, direct: int | None = None) -> Ranges:
    """The cut for so many chunks: each bucket by itself up to ``direct`` (``DIRECT``), in two steps beyond."""
    direct = DIRECT if direct is None else direct
    if chunks <= direct:
        return Ranges(chunks)
    buckets = max(direct, chunks // CHUNKS_EACH)
    return Ranges(buckets, math.isqrt(buckets - 1) + 1, math.isqrt(chunks - 1) + 1)


def bounds(buckets: int) -> np.ndarray:
    """Where sorted 64-bit keys are cut into ``buckets`` equal ranges."""
    return (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)) if buckets > 1 else np.zeros(0, np.uint64)


def bucket_of(keys: np.ndarray, r: Ranges) -> np.ndarray:
    """The bucket of each 64-bit key."""
    if r.buckets == 1:
        return np.zeros(len(keys), np.int64)
    return np.minimum(keys // np.uint64((1 << 64) // r.buckets), np.uint64(r.buckets - 1)).astype(np.int64)


def cut(keys: np.ndarray, r: Ranges) -> list[tuple[int, int, int]]:
    """(group of buckets, from, to) of the non-empty ranges of sorted keys; a group is one bucket where rows go there directly."""
    edge = np.concatenate([[0], np.searchsorted(keys, bounds(r.buckets)[r.per - 1::r.per]), [len(keys)]])
    return [(int(i), int(edge[i]), int(edge[i + 1])) for i in np.flatnonzero(np.diff(edge))]


def cut_buckets(keys: np.ndarray, r: Ranges) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys, where a group of buckets is taken apart."""
    bucket, first = np.unique(bucket_of(keys, r), return_index=True)
    return [(int(b), int(lo), int(hi)) for b, lo, hi in zip(bucket, first, np.append(first, len(keys))[1:])]


def asked(chunk: int, keys: np.ndarray, r: Ranges, pack: Callable[[int, int], tuple[bytes, bytes]]) -> pa.Table:
    """The rows by which a chunk asks about its sorted distinct keys; ``pack`` gives items of one size per key.

    In two steps the packed keys follow their number and the bucket of each within the group."""
    cuts = cut(keys, r)
    packed = [pack(lo, hi) for _, lo, hi in cuts]
    if r.per > 1:
        inner = (bucket_of(keys, r) % r.per).astype("<u2")
        packed = [(np.array([hi - lo], "<u4").tobytes() + inner[lo:hi].tobytes() + k, e) for (_, lo, hi), (k, e) in zip(cuts, packed)]
    return pa.table([pa.array([c[0] for c in cuts], pa.int32()), pa.array([chunk] * len(cuts), pa.int32()),
                     pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], schema=ASK)


def _items(parts: list[bytes], n: int) -> np.ndarray:
    """``n`` items of equal size as rows of bytes."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    return raw.reshape(n, len(raw) // n) if n else raw.reshape(0, 0)


def _dealt(by: np.ndarray, items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Items in the order of ``by`` (else as they stand): its distinct values, their edges, the items."""
    order = np.argsort(by, kind="stable")
    value, first = np.unique(by[order], return_index=True)
    return value, np.append(first, len(by)), [order, *(x[order] for x in items)]


def _merged(r: Ranges):
    """Questions of a set of chunks to a group of buckets: one row per bucket."""
    def fn(table: pa.Table) -> pa.Table:
        chunk, raw = table["chunk"].to_numpy(), table["keys"].to_pylist()
        n = np.array([np.frombuffer(x, "<u4", 1)[0] for x in raw], np.int64)
        inner = np.concatenate([np.frombuffer(x, "<u2", m, 4) for x, m in zip(raw, n)])
        keys = _items([memoryview(x)[4 + 2 * m:] for x, m in zip(raw, n)], len(inner))
        extra = _items(table["extra"].to_pylist(), len(inner))
        value, edge, (_, keys, extra, of) = _dealt(inner, [keys, extra, np.repeat(chunk, n)])
        spans = list(zip(edge[:-1], edge[1:]))
        group, together = table["bucket"][0].as_py(), int(chunk[0]) // r.together
        return pa.table([pa.array(group * r.per + value.astype(np.int64), pa.int32()), pa.array([together] * len(value), pa.int32()),
                         pa.array([keys[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([extra[a:z].tobytes() for a, z in spans], pa.binary()),
                         pa.array([_runs_of(of[a:z]) for a, z in spans], pa.binary())], schema=MERGED)
    return fn


def _runs_of(chunk: np.ndarray) -> bytes:
    first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
    out = np.empty(len(first), OF)
    out["chunk"], out["n"] = chunk[first], np.diff(np.append(first, len(chunk)))
    return out.tobytes()


def _parted(r: Ranges):
    """Answers of a group of buckets to a set of chunks: one row per chunk, in the order of its keys."""
    def fn(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        of = np.frombuffer(b"".join(table["of"].to_pylist()), OF)
        chunk = np.repeat(of["chunk"], of["n"])
        value, edge, (_, items) = _dealt(chunk, [_items(table["answer"].to_pylist(), len(chunk))])
        return pa.table([pa.array(value, pa.int32()), pa.array([table["bucket"][0].as_py() // r.per] * len(value), pa.int32()),
                         pa.array([items[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])], pa.binary())], schema=ANSWER)
    return fn


def answered(table: pa.Table, answers: list[bytes]) -> pa.Table:
    return pa.table([table["chunk"], table["bucket"], pa.array(answers, pa.binary())], schema=ANSWER)


def unpack(table: pa.Table, dtype, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column, and where each row's items begin (one more than rows)."""
    parts = [np.frombuffer(x, dtype) for x in table[column].to_pylist()]
    sizes = np.array([0, *(len(p) for p in parts)])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.cumsum(sizes)


def gathered(answers: pa.Table, dtype) -> np.ndarray:
    """A chunk's answers in the order of its sorted keys."""
    order = np.argsort(answers["bucket"].to_numpy(zero_copy_only=False), kind="stable")
    rows = answers["answer"].to_pylist()
    parts = [np.frombuffer(rows[i], dtype) for i in order]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def ask(chunks: DataFrame, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return chunks.groupBy("chunk").applyInArrow(fn, ASK_DDL)


def _kept_of(fn: Callable[..., pa.Table], cogrouped: bool):
    """``fn`` with the column ``of`` passed on: answers stand in the order of the questions."""
    def run(asks: pa.Table, *known: pa.Table) -> pa.Table:
        if not asks.num_rows:
            return MERGED_ANSWER.empty_table()
        return fn(asks.drop_columns(["of"]), *known).append_column("of", asks["of"])
    return (lambda asks, known: run(asks, known)) if cogrouped else (lambda asks: run(asks))  # Spark counts the parameters


def answer(asks: DataFrame, fn: Callable[..., pa.Table], r: Ranges, known: DataFrame | None = None) -> DataFrame:
    """Answers of every bucket by ``fn`` (questions, rows of ``known`` with that bucket), items of one size per key."""
    def met(df: DataFrame, function, ddl: str) -> DataFrame:
        if known is None:
            return df.groupBy("bucket").applyInArrow(function, ddl)
        return df.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(function, ddl)
    if r.per == 1:
        return met(asks, fn, ANSWER_DDL)
    merged = asks.groupBy("bucket", F.expr(f"chunk div {r.together}")).applyInArrow(_merged(r), MERGED_DDL)
    said = met(merged, _kept_of(fn, known is not None), MERGED_ANSWER_DDL)
    return said.groupBy("chunk", F.expr(f"bucket div {r.per}")).applyInArrow(_parted(r), ANSWER_DDL)


def meet(chunks: DataFrame, answers: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], ddl: str) -> DataFrame:
    """Each chunk's texts together with the answers it got (every chunk, also one that asked nothing)."""
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(fn, ddl)
