"""Prefix trie of conversations as a burst trie over shards.

A conversation is a sequence of turns; a turn's id is a digest of role and text.
Each distinct sequence of first ``d`` turns is a node; the root is the empty one.

1. **Sequences.**  Texts are replaced by (id, length) records before anything is
   shuffled; a conversation is one binary row, 24 bytes a turn.  Equal sequences are
   one row with a count and the least conversation id.
2. **Bursting.**  A container holds the sequences below one trie head.  In the beginning
   the root holds all.  Each round counts the rows of every container (aggregated before
   the shuffle); one of more than ``limit`` bursts: its head becomes a node of the
   upper trie and its rows go on to containers named by one turn id more.  Rounds end
   when none is oversized; only rows of burst containers are written again.
3. **Sweep.**  The containers are dealt to shards and sorted by sequence.  One pass with a
   stack of open nodes gives all nodes of a container; memory follows one container.
4. **Upper trie.**  Sums of containers and heads are added up for all their ancestors by
   one aggregation.

A hot opening (a system prompt of a third of all conversations) is a container that bursts until its
parts are small; a hot conversation, copied very often, is one sequence with a count.  Members that end
at a node are listed in a digest, which is a chain over their sorted ids: ids are range-sorted and packed into
texts first, so that what one task reads of a hot node is the hashed text itself.

Defined results: turns are ordered by ``turn`` (null first), equal ones by their digest;
null role or text reads as empty; rows without ``conv_id`` belong to no conversation and are left out;
equal turns of one conversation are kept; other columns are ignored; an empty table has no node, not
even the root.  A conversation must fit into one row: 80 million turns.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.session import scratch_root

RECORD = 24        # bytes of a turn in a sequence: 16 of its digest, 8 of its text's length
LIMIT = 4096       # sequences above which a container bursts
SMALL_ROWS = 50_000
SMALL_BYTES = 32 << 20
PACKED = 1 << 16   # ids packed into one text
NONE = hashlib.sha256(b"").hexdigest()
SEQUENCES_DDL = "conv_id long, seq binary"
NODES_DDL = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
             "ends_sha256 string, top binary")
NODES = pa.schema([*((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
                   ("ends_sha256", pa.string()), ("top", pa.binary())])
COLUMNS = [f.name for f in NODES][:-1]


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _digest(data: Column) -> Column:
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def _prefix(depth: Column | int, column: str = "seq") -> Column:
    """The first ``depth`` turns of a sequence."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.substring(F.col(column), F.lit(1), (depth * RECORD).cast("int"))


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, seq``: the records of a conversation's turns in order, one row per conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    record = F.concat(_digest(whole), F.unhex(F.lpad(F.hex(F.length(text).cast("long")), 16, "0")))
    turns = (conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", record.alias("record"))
             .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "record"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, parts = None, []
        for batch in batches:
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            data = b"".join(batch.column("record").to_pylist())
            cut = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            done_ids, done = [], []
            for lo, hi in zip(cut[:-1], cut[1:]):
                if lo == hi:
                    continue
                if open_id is not None and ids[lo] != open_id:
                    done_ids.append(open_id)
                    done.append(b"".join(parts))
                    parts = []
                open_id = int(ids[lo])
                parts.append(data[lo * RECORD:hi * RECORD])
            yield pa.record_batch([pa.array(done_ids, pa.int64()), pa.array(done, pa.binary())], names=["conv_id", "seq"])
        if open_id is not None:
            yield pa.record_batch([pa.array([open_id], pa.int64()), pa.array([b"".join(parts)], pa.binary())], names=["conv_id", "seq"])

    return turns.select("conv_id", "record").mapInArrow(gather, SEQUENCES_DDL)


def with_shared_openings(seqs: DataFrame, block: int = 100, most: int = 5) -> DataFrame:
    """Each conversation ``c`` opened by the first ``h`` turns of conversation ``c - c % block``, followed by its own after its first ``h``.

    ``h`` is the checksum of the id's digits modulo ``most + 1``; a missing conversation gives no opening.
    """
    seqs = _stored(seqs, scratch_root(seqs.sparkSession, "sequences"))
    opening = seqs.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("_base"), _prefix(most).alias("_opening"))
    own = seqs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % block)
    own = own.withColumn("_h", (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int"))
    rest = F.substring(F.col("seq"), F.col("_h") * RECORD + 1, F.length("seq"))
    opened = F.coalesce(_prefix(F.col("_h"), "_opening"), F.lit(b""))
    return own.join(opening, "_base", "left").select("conv_id", F.concat(opened, rest).alias("seq"))


def _end_digests(seqs: DataFrame) -> DataFrame:
    """``key, ends_sha256``: SHA-256 of the ascending, comma-joined ids of the conversations of each sequence (``key`` is its digest)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            cut = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
            rows = [(keys[lo], ids[lo], ",".join(map(str, ids[lo:hi]))) for lo, hi in zip(cut[:-1], cut[1:]) if lo < hi]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([], [], []), (pa.binary(), pa.int64(), pa.string()))],
                                  names=["key", "first", "ids"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    digests.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    members = seqs.select(_digest(F.col("seq")).alias("key"), "conv_id")
    packed = members.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key binary, first long, ids string")
    return packed.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(chain, "key binary, ends_sha256 string")


class _Sweep:
    """Nodes of sorted sequences: one stack of open nodes, closed from below."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.stack: list[list] = []   # [n_convs, least id, children, leaves, saved, ends, closed children]
        self.seq, self.depth = b"", 0

    def _close(self):
        n, least, children, leaves, saved, ends, below = self.stack.pop()
        depth = self.depth + len(self.stack)
        if depth:
            saved += (n - 1) * struct.unpack_from(">q", self.seq, depth * RECORD - 8)[0]
        row = (least, depth, None, n, children, leaves or 1, saved, ends)
        self.rows.extend((*r[:2], least, *r[3:], None) for r in below)
        if self.stack:
            up = self.stack[-1]
            up[0] += n
            up[1] = min(up[1], least)
            up[2] += 1
            up[3] += row[5]
            up[4] += saved
            up[6].append(row)
        else:  # the container's head: its parent is in the upper trie
            self.rows.append((*row, self.seq[:depth * RECORD]))

    def finish(self):
        while self.stack:
            self._close()

    def add(self, seq: bytes, depth: int, n: int, least: int, ends: str):
        turns, same = len(seq) // RECORD, depth
        if not self.stack or depth != self.depth or seq[:depth * RECORD] != self.seq[:depth * RECORD]:
            self.finish()
            self.depth = depth
        else:
            most = min(turns, len(self.seq) // RECORD)
            while same < most and seq[same * RECORD:(same + 1) * RECORD] == self.seq[same * RECORD:(same + 1) * RECORD]:
                same += 1
            while len(self.stack) > same - depth + 1:
                self._close()
        self.seq = seq
        while len(self.stack) < turns - depth + 1:
            self.stack.append([0, least, 0, 0, 0, NONE, []])
        end = self.stack[-1]
        end[0], end[1], end[5] = end[0] + n, min(end[1], least), ends

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(NODES), NODES)], schema=NODES)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = _Sweep()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "depth", "n", "least", "ends_sha256"))):
            own.add(*row)
            if len(own.rows) > 20_000:
                yield own.taken()
        yield own.taken()
    own.finish()
    yield own.taken()


def prefix_trie(seqs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of ``seqs (conv_id, seq)`` (one row per conversation, see :func:`sequences`).

    ``conv_id`` is the smallest member and, with ``depth``, names the node's turns; ``parent_conv_id`` is the parent's; ``n_leaves`` and
    ``saved_tokens`` are sums over the node's subtree, the latter of (members - 1) times the length of the last text.
    """
    spark = seqs.sparkSession
    root = scratch_root(spark, "trie")
    seqs = _stored(seqs, f"{root}/sequences")
    distinct = seqs.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).withColumn("key", _digest(F.col("seq")))
    rows = _stored(distinct.join(_end_digests(seqs), "key").drop("key"), f"{root}/rows_0")

    def small(df: DataFrame, column: str) -> DataFrame:
        """Broadcast of a table that is measured to be small."""
        n, size = df.agg(F.count(F.lit(1)), F.sum(F.length(column))).first()
        return F.broadcast(df) if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else df

    settled, heads, active, depth = [], [], rows, 0
    while True:
        marked = active.withColumn("head", _prefix(depth))
        sized = marked.groupBy("head").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"), F.min("least").alias("least"))
        over = _stored(sized.filter(F.col("size") > limit).drop("size"), f"{root}/heads_{depth}")
        if over.isEmpty():
            settled.append(active.withColumn("depth", F.lit(depth)))
            break
        names = small(over.select("head"), "head")
        settled.append(marked.join(names, "head", "left_anti").drop("head").withColumn("depth", F.lit(depth)))
        heads.append(over.withColumn("depth", F.lit(depth)))
        burst = marked.join(names, "head", "left_semi").filter(F.length("seq") > depth * RECORD).drop("head")
        depth += 1
        active = _stored(burst, f"{root}/rows_{depth}")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    shards = (union(settled).withColumn("container", _prefix(F.col("depth"))).repartition("container").sortWithinPartitions("seq")
              .select("seq", "depth", "n", "least", "ends_sha256"))
    nodes = shards.mapInArrow(_sweep, NODES_DDL)
    if not heads:
        return nodes.select(COLUMNS)
    nodes = _stored(nodes, f"{root}/nodes")
    upper = _stored(union(heads), f"{root}/upper")
    chars = F.conv(F.hex(F.substring(F.col("head"), (F.col("depth") * RECORD - 7).cast("int"), F.lit(8))), 16, 10).cast("long")
    saved = F.when(F.col("depth") > 0, (F.col("n") - 1) * chars).otherwise(F.lit(0))
    tops = nodes.filter("top IS NOT NULL")
    up_to = [tops.select("top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth") - 1)).alias("j"), (F.col("depth") - 1).alias("last"), "n_leaves", "saved_tokens"),
             upper.select(F.col("head").alias("top"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth").cast("long"))).alias("j"),
                          (F.col("depth") - 1).cast("long").alias("last"), F.lit(0).cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"))]
    sums = (union(up_to).groupBy(_prefix(F.col("j"), "top").alias("head"))
            .agg(F.sum(F.when(F.col("j") == F.col("last"), 1).otherwise(0)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
                 F.sum("saved_tokens").alias("saved_tokens")))
    parents = small(upper.select(F.col("head").alias("_up"), F.col("least").alias("parent_conv_id")), "_up")
    ends = rows.select(F.col("seq").alias("head"), "ends_sha256")
    first = (upper.join(sums, "head").join(ends, "head", "left").withColumn("_up", F.when(F.col("depth") > 0, _prefix(F.col("depth") - 1, "head")))
             .join(parents, "_up", "left")
             .select(F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
                     "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")))
    joints = (tops.drop("parent_conv_id").withColumn("_up", _prefix(F.col("depth") - 1, "top")).join(parents, "_up").select(COLUMNS))
    return nodes.filter("top IS NULL").select(COLUMNS).unionByName(joints).unionByName(first.select(COLUMNS))
