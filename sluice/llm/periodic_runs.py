"""Periodic runs of words in every text, and texts with their runs collapsed to one period.

A **run** is a stretch of words with least period ``q`` (words ``q`` apart are
identical), of at least ``repeats`` periods and ``least`` words, that no
neighbouring word extends.  Every run has a *Lyndon root*: a place inside it
where the longest Lyndon word, under the order of words or under its reverse, is
one period long.  So all runs are found from two Lyndon arrays:

1. **Baier grouping** (phase one of his suffix sorter) gives the Lyndon array of
   an order directly.  Suffixes are grouped by their first word; groups are taken
   from the greatest down, and each suffix ``x`` that is the nearest unfinished
   one left of ``l`` suffixes of the group moves into a new group right above its
   own, its prefix longer by ``l`` times the group's.  When a group is taken, its
   prefix is the longest Lyndon word at each of its suffixes.
2. **Extension.**  Each root (i, i + length) is extended both ways by longest
   common extensions.  Those come from names of all power-of-two substrings
   (equal names, equal words), for all roots of a block at once.

Before that, words that no run can hold are set aside: every word of a run with
four periods and six words lies in three consecutive words that occur three times
in its stretch.  The rule is applied a few times over; it removes most prose, and
what it keeps is searched exactly.  Memory follows the longest text.

The work is one ``mapInArrow`` over the rows, without a shuffle: runs lie within
one text.  Words are compared by 64-bit hashes.

Defined results: a null or empty text, or one without words, has no run and
collapses to the empty text; null and repeated ids are kept row by row; other
columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.words import U, Block, blocks, grams, joined, mix, string_array, texts

LEAST, REPEATS = 6, 4   # the filter below is sound for these or more
FILTER_ROUNDS = 4       # any number is sound; more set aside a little more
WORD = r"([^\x20\x09-\x0D]+)"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS), ("collapsed", pa.string())])
OUT_DDL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_array(rank: list[int], top: int) -> list[int]:
    """Length of the longest Lyndon word at each place, by Baier grouping.

    Ranks are 1 to ``top``; 0 marks a barrier below all of them (the first place must be one), across which no word reaches.
    """
    n = len(rank)
    members: list[list[int]] = [[] for _ in range(top + 2)]
    for i, r in enumerate(rank):
        members[r].append(i)
    group, length = list(rank), [1] * (top + 2)
    below, above = list(range(-1, top + 1)), list(range(1, top + 3))
    left, done, out = list(range(-1, n - 1)), bytearray(n), [0] * n
    g = top
    while g > 0:
        width = length[g]
        own = [j for j in members[g] if group[j] == g]
        for j in own:
            done[j] = 1
            out[j] = width
        hits: dict[int, int] = {}
        for j in own:
            k, x = j, left[j]
            while done[x]:          # nearest unfinished place to the left, paths halved on the way
                left[k] = left[x]
                k, x = x, left[x]
            left[j] = x
            if rank[x]:
                hits[x] = hits.get(x, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for x, times in hits.items():
            moved.setdefault((times, group[x]), []).append(x)
        for times, old in sorted(moved, reverse=True):
            new, up = len(members), above[old]
            xs = moved[times, old]
            members.append(xs)
            length.append(length[old] + times * width)
            below.append(old)
            above.append(up)
            above[old] = below[up] = new
            for x in xs:
                group[x] = new
        g = below[g]
    return out


class Extensions:
    """Longest common extensions of a sequence by names of its power-of-two substrings."""

    def __init__(self, seq: np.ndarray, longest: int):
        self.n = len(seq)
        self.names = [seq.astype(np.int32)]
        while 1 << len(self.names) <= longest:
            half, last = 1 << (len(self.names) - 1), self.names[-1].astype(np.int64)
            if len(last) <= half:
                break
            _, name = np.unique(last[:-half] * self.n + last[half:], return_inverse=True)
            self.names.append(name.astype(np.int32))

    def _extend(self, a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            name, step = self.names[k], 1 << k
            while True:  # twice at most but for the top level, whose step may fit often
                x, y = (a - total - step, b - total - step) if back else (a + total, b + total)
                fits = (x >= 0) & (y < len(name))
                same = fits & (name[np.where(fits, x, 0)] == name[np.where(fits, y, 0)])
                total += same * step
                if k < len(self.names) - 1 or not same.any():
                    break
        return total

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the substrings that start at a and b (a < b)."""
        return self._extend(a, b, False)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the substrings that end before a and b (a < b)."""
        return self._extend(a, b, True)


def _stretches(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word places that a run may hold, and the stretch (of consecutive such places in one text) of each."""
    place, stretch = np.arange(len(h)), doc
    for _ in range(FILTER_ROUNDS):
        if len(place) < LEAST:
            return place[:0], stretch[:0]
        at = np.flatnonzero(stretch[:-2] == stretch[2:])
        key = mix(grams(h[place], at, 3) + stretch[at].astype(U) * U(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        edge = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        often = np.repeat(np.diff(edge) >= REPEATS - 1, np.diff(edge))
        hit = at[order[often]]
        held = np.zeros(len(place), bool)
        for k in range(3):
            held[hit + k] = True
        if held.all():
            break
        place, stretch = place[held], stretch[held]
        if len(place):
            cut = (np.diff(place) > 1) | (np.diff(stretch) != 0)
            stretch = np.concatenate([[0], np.cumsum(cut)])
    return place, stretch


def block_runs(h: np.ndarray, doc: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, period) of all runs of a block's word hashes, by first word and period; ``doc`` is each word's text."""
    if least < LEAST or repeats < REPEATS:
        raise ValueError(f"runs of at least {LEAST} words and {REPEATS} periods only")
    none = np.zeros(0, np.int64)
    place, stretch = _stretches(h, doc)
    if not len(place):
        return none, none, none
    first = np.flatnonzero(np.concatenate([[True], np.diff(stretch) != 0]))
    known, name = np.unique(h[place], return_inverse=True)
    top = len(known)
    at = np.arange(len(place)) + np.repeat(np.arange(1, len(first) + 1), np.diff(np.append(first, len(place))))
    n = len(place) + len(first) + 1           # a barrier before each stretch and at the end
    seq, back = np.zeros(n, np.int64), np.zeros(n, np.int64)
    seq[at] = name + 1
    back[at] = place
    one, two = [], []
    for ranks in (seq, np.where(seq > 0, top + 1 - seq, 0)):
        size = np.array(lyndon_array(ranks.tolist(), top), np.int64)[at]
        one.append(at)
        two.append(at + size)
    a, b = np.unique(np.stack([np.concatenate(one), np.concatenate(two)]), axis=1)
    near = (seq[a] == seq[b]) | (seq[a - 1] == seq[b - 1]) & (seq[a - 1] > 0)
    a, b = a[near], b[near]
    if not len(a):
        return none, none, none
    reach = Extensions(seq, int(np.diff(np.append(first, len(place))).max()))
    start, period = a - reach.behind(a, b), b - a
    size = b + reach.ahead(a, b) - start
    good = size >= np.maximum(least, repeats * period)
    found = np.unique(np.stack([back[start[good]], period[good], size[good]]), axis=1)
    return found[0], found[2], found[1]


def _block(b: Block, least: int, repeats: int) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray], np.ndarray]:
    doc = b.doc
    start, size, period = block_runs(b.hashes(), doc, least, repeats)
    rise = np.zeros(len(doc) + 1, np.int64)
    np.add.at(rise, start + period, 1)
    np.add.at(rise, start + size, -1)
    of = doc[start] if len(start) else np.zeros(0, np.int64)
    offsets = np.searchsorted(of, np.arange(b.n + 1))
    parts = [start - b.first[:-1][of], size, period]
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in parts], ["start", "length", "period"]))
    return runs, joined(b, np.cumsum(rise)[:-1] == 0), np.diff(b.first)


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs (doc_id, text)``.

    ``runs`` holds (start, length, period) by start, then period, with words numbered from 0; ``collapsed`` joins by one space the
    words that lie in no run after its first period.
    """
    if least < LEAST or repeats < REPEATS:
        raise ValueError(f"runs of at least {LEAST} words and {REPEATS} periods only")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = texts(batch.column("text"))
            for b in blocks(data, offs):
                runs, kept, words = _block(b, least, repeats)
                yield pa.record_batch([batch.column("doc_id").slice(b.lo, b.n).cast(pa.int64()), pa.array(words, pa.int64()), runs.cast(RUNS),
                                       string_array([kept])], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(search, OUT_DDL)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where every tenth id (by checksum) repeats some of its words to its end, as the registered query wants it."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(1))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", checksum.alias("_h"))
    rest = chosen.withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    a = F.when(n > 0, g % n)
    p = F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + g % 8))

    def again(a: Column, p: Column) -> Column:
        def word(i: Column) -> Column:
            return F.element_at("_words", (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")

    rest = rest.withColumn("_a", a).withColumn("_p", p)
    return rest.select("doc_id", F.when(n > 0, again(F.col("_a"), F.col("_p"))).otherwise(F.col("text")).alias("text"))


def report(found: DataFrame) -> DataFrame:
    """One row of figures and digests per row of :func:`periodic_runs`."""
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("size"), (-r.start).alias("start"), (-r.period).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    out = found.withColumn("_best", greatest)
    size, period = F.col("_best.size"), -F.col("_best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), size.alias("length"), period.alias("period"),
        F.expr("_best.size * 1000L div -_best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
