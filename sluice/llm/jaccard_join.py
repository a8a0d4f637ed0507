"""Near-duplicate classes by a grouped prefix join on word shingles.

A text's set is its distinct five-word shingles (A-Z lowered; with fewer words
the whole sequence is one shingle; none without words).  Two documents link
when 100 * intersection >= 75 * union.

1. **Frequencies.**  Chunks ask how many texts hold each distinct shingle (see
   ``exchange``; packed, once per chunk and shingle).  Sets are ordered rarest
   first, so a prefix of ``n - ceil(0.75 n) + 1`` shingles must meet the other set's
   prefix.  Shingles that one text alone holds cannot meet: they are dropped,
   and a text whose prefix is made of them has no link.  Only the rest of the sets
   (shared shingles, the size) go on; intersections need no more.
2. **Groups.**  Equal sets become one class, and classes of one size with one
   prefix become one group, which takes part in the join once.
3. **First links.**  Groups that share a prefix shingle are chained in order of
   size, every member is paired with the hub of each prefix shingle (the group
   least of whose shingles are its own), members of a group are chained; the pairs are verified and
   components formed.  This is linear in the prefixes, whatever a group's size.
4. **Remaining pairs.**  Groups are expanded to their members.  All pairs with a common
   prefix shingle and *different* components are verified, unless their sizes and the
   numbers of shared shingles in 64 cells of the hash range show that they cannot link.  A pair
   inside one component need not be looked at, so the result is exact: no
   link is lost, and a large cluster costs no square.
5. **Links** (``links=True``).  Links lie inside components, whose members are dealt into blocks of a bounded
   number of shingles.  A task takes two blocks, counts common shingles of all their pairs by
   products of 0/1 matrices, and returns how many links each member has.  Copies are one member with a
   weight; no pair becomes a row.

Shingles are 64-bit hashes.  A component is named by the smallest ``doc_id`` in it.

Defined results: null or empty text has an empty set and its own id as
component; rows with a null ``doc_id`` get their size and a null component
unless they equal or link to a text with an id; rows with equal ids are judged
by their texts; other columns are ignored; an empty table gives no rows.  ``n_links`` is the
number of other rows that a row links to, equal texts and rows without an id included; 0 for empty sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm import exchange as X
from sluice.llm.components import components
from sluice.llm.words import U, Block, blocks, grams, mix, texts
from sluice.session import scratch_root

SHINGLE = 5
SIMILAR = 75   # per cent
CELLS = 64
BLOCK = 1 << 19  # shared shingles of a block of members of a component, each member counted as MEMBER more
MEMBER = 1 << 11
SLAB = 1 << 13   # columns of the matrices
LINKS = pa.schema([("uid", pa.int64()), ("links", pa.int64())])
SETS_DDL = "uid long, doc_id long, n long, f1 long, f2 long, prefix array<long>, shared array<long>, cells array<int>"
SETS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                  ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32()))])


def shingles(b: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct shingles of each text of a block, in that order."""
    h = b.hashes(lower=True)
    at = b.starts_of(k)
    doc, g = [b.doc[at]], [grams(h, at, k)]
    size = np.diff(b.first)
    for j in range(1, k):  # shorter texts: the whole sequence
        short = np.flatnonzero(size == j)
        doc.append(short)
        g.append(grams(h, b.first[short], j))
    doc, g = np.concatenate(doc), np.concatenate(g)
    order = np.lexsort((g, doc))
    doc, g = doc[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def _parse(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray]:
    doc, g = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for b in blocks(*texts(table["text"])):
        d, x = shingles(b, k)
        doc.append(d + b.lo)
        g.append(x)
    return np.concatenate(doc), np.concatenate(g)


def _ask(buckets: X.Ranges, k: int):
    def fn(table: pa.Table) -> pa.Table:
        keys, count = np.unique(_parse(table, k)[1], return_counts=True)
        short = ((keys >> U(8)) & U(0xFFFFFFFF)).astype("<u4")  # only an order is asked for: a coincidence changes no result
        many = np.minimum(count, 255).astype(np.uint8)
        return X.asked(table["chunk"][0].as_py(), keys, buckets, lambda lo, hi: (short[lo:hi].tobytes(), many[lo:hi].tobytes()))
    return fn


def _frequencies(table: pa.Table) -> pa.Table:
    """One byte per key: the number of texts up to 127, above that a logarithm."""
    keys, edge = X.unpack(table, "<u4", "keys")
    many, _ = X.unpack(table, np.uint8, "extra")
    _, group = np.unique(keys, return_inverse=True)
    total = np.bincount(group, weights=many)
    level = np.where(total < 128, total, 121 + np.log2(np.maximum(total, 1))).astype(np.uint8)[group]
    return X.answered(table, [level[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])])


def _sets(k: int, percent: int):
    def fn(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return SETS.empty_table()
        doc, g = _parse(table, k)
        keys, back = np.unique(g, return_inverse=True)
        level = X.gathered(answers, np.uint8)[back]
        n = np.bincount(doc, minlength=table.num_rows)
        sums = []
        for salt in (0x1234567, 0x89ABCDEF):
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(g ^ U(salt)))])
            edge = np.concatenate([[0], np.cumsum(n)])
            sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
        # rarest first within each text; the place of each shingle decides whether it is in the prefix
        order = np.lexsort((g, level, doc))
        doc, g, level = doc[order], g[order], level[order]
        place = np.arange(len(doc)) - edge[:-1][doc]
        length = n - -(-percent * n // 100) + 1
        shared = level > 1
        in_prefix = shared & (place < length[doc])
        alive = np.bincount(doc[in_prefix], minlength=len(n)) > 0
        keep = shared & alive[doc]
        def lists(mask):
            per = np.bincount(doc[mask], minlength=len(n))
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(g[mask].view(np.int64), pa.int64()))
        # shared shingles counted in equal cells of the hash range: a bound for intersections that needs no shingles
        count = np.zeros((len(n), CELLS), np.int64)
        np.add.at(count, (doc[keep], (g[keep] >> U(58)).astype(np.int64)), 1)
        cells = pa.array([row if ok else None for row, ok in zip(count.astype(np.int32), alive)], pa.list_(pa.int32()))
        uid = (np.int64(table["chunk"][0].as_py()) << 32) + np.arange(len(n))
        return pa.table([pa.array(uid), table["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                         lists(in_prefix), lists(keep), cells], schema=SETS)
    return fn


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, both`` of candidate pairs: sizes and common shingles."""
    left = sets.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = sets.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("both"))


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.filter(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def common(row: np.ndarray, token: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of tokens that each of the rows ``a`` has in common with each of ``b``; (row, token) are distinct."""
    _, column, times = np.unique(token, return_inverse=True, return_counts=True)
    of_many = times > 1
    ok = of_many[column]
    row, column = row[ok], (np.cumsum(of_many) - 1)[column[ok]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, rows = np.zeros((len(a), len(b)), np.int64), 1 + max(a.max(initial=0), b.max(initial=0))
    for lo in range(0, int(of_many.sum()), SLAB):
        at, to = np.searchsorted(column, [lo, lo + SLAB])
        has = np.zeros((rows, SLAB), np.float32)
        has[row[at:to], column[at:to] - lo] = 1
        out += (has[a] @ has[b].T).astype(np.int64)
    return out


def _links_of(percent: int):
    """Links of the members of two blocks (p, q) of a component, each pair looked at in one group."""
    def fn(table: pa.Table) -> pa.Table:
        uid, n, copies, block = (table[c].to_numpy() for c in ("uid", "n", "copies", "block"))
        shared = table["shared"].combine_chunks()
        row = np.repeat(np.arange(len(uid)), shared.value_lengths().to_numpy())
        one = table["p"][0].as_py() == table["q"][0].as_py()
        first = block == table["p"][0].as_py()
        a = np.flatnonzero(first)
        b = a if one else np.flatnonzero(~first)
        both = common(row, shared.flatten().to_numpy(), a, b)
        link = 100 * both >= percent * (n[a][:, None] + n[b][None] - both)
        if one:
            np.fill_diagonal(link, False)
        parts = [(uid[a], link @ copies[b])] + ([] if one else [(uid[b], copies[a] @ link)])
        return pa.table([pa.array(np.concatenate([p[i] for p in parts]), pa.int64()) for i in (0, 1)], schema=LINKS)
    return fn


def link_counts(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """``uid, links`` of classes: ``members`` has uid, label, copies of every class in a component, ``sets`` their shingles."""
    weighed = members.join(sets.select("uid", "own"), "uid")
    blocks = weighed.groupBy("label").agg(F.ceil(F.sum(F.col("own") + MEMBER) / block).cast("int").alias("blocks"))
    dealt = (weighed.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("uid", "label", "copies", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")))
    return (dealt.join(sets.select("uid", "n", "shared"), "uid").groupBy("label", "p", "q").applyInArrow(_links_of(percent), "uid long, links long")
            .groupBy("uid").agg(F.sum("links").alias("links")))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = SIMILAR, chunk_bytes: int = X.CHUNK_BYTES,
                    links: bool = False, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; with ``links`` also ``n_links``, its number of links."""
    spark = docs.sparkSession
    root = scratch_root(spark, "jaccard")
    chunks = X.chunk_count(docs, chunk_bytes)
    t, cut = X.chunked(docs, chunks), X.ranges(chunks)
    X.meet(t, X.answer(X.ask(t, _ask(cut, k)), _frequencies, cut), _sets(k, percent), SETS_DDL).write.parquet(f"{root}/rows")
    rows = spark.read.parquet(f"{root}/rows")

    # equal sets: one class, of which one row goes on
    alive = rows.filter(F.size("prefix") > 0)
    classes = alive.groupBy("n", "f1", "f2").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"),
                                                  F.count(F.lit(1)).alias("copies"))
    classes.write.parquet(f"{root}/classes")
    classes = spark.read.parquet(f"{root}/classes")
    sets = rows.select("uid", "n", "prefix", "shared", "cells", F.size("shared").alias("own")).join(classes.select("uid"), "uid", "left_semi")
    group = Window.partitionBy("n", F.xxhash64("prefix"))
    grouped = sets.withColumn("gid", F.min("uid").over(group)).withColumn("most", F.max("own").over(group))
    grouped.write.parquet(f"{root}/sets")
    sets = spark.read.parquet(f"{root}/sets")
    members = sets.select("gid", "uid", "n", "cells")

    def may(n, m, s, t):  # what sizes and shared shingles allow: 100 * both >= percent * (n + m - both), both <= n, m, s, t
        both = F.least(n, m, s, t)
        return (100 + percent) * both >= percent * (F.col(n) + F.col(m))

    token = sets.filter("gid = uid").select("gid", "n", "most", F.explode("prefix").alias("token"))
    chain = Window.partitionBy("token").orderBy("n", "gid")
    near = (token.withColumn("b", F.lead("gid").over(chain)).withColumn("nb", F.lead("n").over(chain))
            .withColumn("sb", F.lead("most").over(chain)).filter(F.col("b").isNotNull() & may("n", "nb", "most", "sb")).select("gid", "b"))
    # the hub of a shingle is the group least of whose shingles are its own: an original rather than its edited copies
    hub = (token.groupBy("token").agg(F.max(F.struct((F.col("most") / F.col("n")).alias("known"), (-F.col("gid")).alias("b"), "n", "most")).alias("h"),
                                      F.count(F.lit(1)).alias("c")).filter("c > 1")
           .select("token", (-F.col("h.b")).alias("b"), F.col("h.n").alias("nb"), F.col("h.most").alias("sb")))
    star = token.join(hub, "token").filter((F.col("gid") != F.col("b")) & may("n", "nb", "most", "sb")).select("gid", "b")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    star = star.distinct().join(members.select("gid", "uid"), "gid").filter("uid <> b").select("uid", F.col("b").alias("hub"))  # every member meets the hub
    inside = (members.withColumn("b", F.lead("uid").over(Window.partitionBy("gid").orderBy("uid"))).filter("b IS NOT NULL")
              .select(F.col("uid").alias("a"), "b"))
    pairs = near.select(F.col("gid").alias("a"), "b").unionByName(star.select(F.col("uid").alias("a"), F.col("hub").alias("b"))).unionByName(inside)
    _measured(pairs.select(*ordered).distinct(), sets).write.parquet(f"{root}/measured")
    measured = spark.read.parquet(f"{root}/measured")
    found = _linked(measured, percent)
    first = components(found)

    # pairs of different components only
    label = (members.join(first.withColumnRenamed("node", "uid"), "uid", "left")
             .select("gid", "uid", "n", "cells", F.coalesce("label", "uid").alias("label")))
    label.write.parquet(f"{root}/labels")
    label = spark.read.parquet(f"{root}/labels")
    spread = token.select("gid", "token").join(label, "gid").drop("gid")
    major = (spread.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("token")
             .agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
             .select("token", F.col("m.label").alias("major")))
    open_ = spread.join(major, "token")  # pairs of the largest component of a shingle are never formed
    side = lambda df, i: df.select("token", "major", *[F.col(c).alias(f"{c}_{i}") for c in ("uid", "n", "label", "cells")])
    x, y = side(open_.filter("label <> major"), "x"), side(open_, "y").drop("major")
    # two sets have in each cell no more in common than the fewer of their shared shingles there
    both = F.expr("aggregate(zip_with(cells_x, cells_y, (p, q) -> least(p, q)), 0L, (a, c) -> a + c)")
    rest = (x.join(y, "token").filter("label_x <> label_y AND (label_y = major OR uid_x < uid_y)")
            .filter((100 + percent) * F.least("n_x", "n_y") >= percent * (F.col("n_x") + F.col("n_y")))
            .filter((100 + percent) * both >= percent * (F.col("n_x") + F.col("n_y")))
            .select(F.least("uid_x", "uid_y").alias("a"), F.greatest("uid_x", "uid_y").alias("b")).distinct())
    _measured(rest, sets).write.parquet(f"{root}/measured2")
    more = _linked(spark.read.parquet(f"{root}/measured2"), percent)
    final = components(found.unionByName(more)) if more.limit(1).count() else first

    named = classes.join(final.withColumnRenamed("node", "uid"), "uid", "left").withColumn("label", F.coalesce("label", "uid"))
    least = named.groupBy("label").agg(F.min("least").alias("component"))
    of_class = named.join(least, "label")
    if links:
        counts = link_counts(final.withColumnRenamed("node", "uid").join(classes.select("uid", "copies"), "uid"), sets, percent, block)
        of_class = of_class.join(counts, "uid", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    more = ["n_links"] if links else []
    of_class = of_class.select("n", "f1", "f2", "component", *more)
    return (rows.select("doc_id", "n", "f1", "f2").join(of_class, ["n", "f1", "f2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in more]))
