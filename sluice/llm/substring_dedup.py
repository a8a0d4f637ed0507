"""Substring dedup by recompression: remove long word runs that an earlier document holds.

Every text is a sequence of words (unchanged, ``[^\\x20\\x09-\\x0D]+``).  A window
is ``window`` (13) consecutive words of one document.  A word goes if a window
that covers it also starts in a document with a smaller ``doc_id``; all windows
are judged on the input.

Method.  Rounds name the symbols of all texts alike: first tokens inside runs
(a word beside an equal word) get a run name and take no part in pairing; then
in each of two rounds every symbol draws a side from its name, a left symbol
followed by a right one becomes a pair, and the pair's name is a hash of both
names.  Names are content hashes, so they are global without a dictionary, and
whether a symbol boundary lies before word ``p`` depends on the words
``p-3 .. p+2`` alone: equal substrings get equal symbols but for their
first and last three words.  A pair of pairs holds at most four words, so
the eight inner places of a 13-word window hold a boundary.  Each window elects the
boundary whose six-word name is least: equal windows elect equal names, and only
about one place in five is elected.

Three steps over chunks of texts (see ``exchange``):

1. every chunk asks which elected names occur in another document as well;
2. windows that elected a shared name are verified: the chunk sends a 96-bit
   window hash and the least ``doc_id`` it has it in, and learns whether any
   document with a smaller id holds that window;
3. covered words are removed and the kept ones joined by one space.

Every window of every text takes part; a name or window of a third of all
documents is asked about once per chunk.

Defined results: null or empty text has no words, nothing is removed, the kept
text is empty.  Null ``doc_id`` is not smaller than any id and no id is smaller
than it: such rows are returned unchanged but for white space.  Rows with equal
``doc_id`` do not remove each other's words.  Other columns are ignored.
Empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm import exchange as X
from sluice.llm.words import U, Block, blocks, grams, joined, mix, string_array, texts

CONTEXT = 6     # words that decide a boundary after two rounds: three before, three from it on
ROUNDS = 2
NEVER = U(0xFFFFFFFFFFFFFFFF)
RESULT_DDL = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, text string"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("text", pa.string())])


def boundaries(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Word places where a symbol begins after the run step and the pair rounds."""
    n = len(names)
    if not n:
        return np.zeros(0, np.int64)
    same = np.zeros(n + 1, bool)
    same[1:n] = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
    run = same[:n] | same[1:]
    place, name, frozen, of = np.arange(n), np.where(run, mix(names + U(1)), names), run, doc
    for r in range(ROUNDS):
        right = (mix(name ^ U(0x51ED270B * (r + 1))) >> U(63)).astype(bool)
        pair = np.zeros(len(place), bool)
        pair[:-1] = ~right[:-1] & right[1:] & ~frozen[:-1] & ~frozen[1:] & (of[:-1] == of[1:])
        second = np.zeros(len(place), bool)
        second[1:] = pair[:-1]
        at = np.flatnonzero(pair)
        name[at] = mix(name[at] * U(0x9E3779B97F4A7C15) + name[at + 1])
        place, name, frozen, of = place[~second], name[~second], frozen[~second], of[~second]
    return place


def elected(b: Block, names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where windows start, and the boundary name that each window elects."""
    at = b.starts_of(window)
    if not len(at):
        return at, np.zeros(0, U)
    cost = np.full(len(names) + 1, NEVER)
    cut = boundaries(names.copy(), b.doc)
    inner = cut[(cut >= 3) & (cut + 3 <= len(names))]  # names across texts are never elected: windows lie in one text
    cost[inner] = np.minimum(grams(names, inner - 3, CONTEXT), NEVER - U(1))
    span, least, have = window - CONTEXT + 1, cost[:len(names)], 1
    while have < span:  # least cost of the next `span` places by doubling
        step = min(have, span - have)
        least, have = np.minimum(least[:len(least) - step], least[step:]), have + step
    return at, least[at + 3]


@dataclass
class Parsed:
    """A block of a chunk with the windows of its texts that have an id."""

    b: Block
    ids: np.ndarray    # doc_id of each text
    names: np.ndarray  # name of each word
    at: np.ndarray     # word place of each window
    name: np.ndarray   # the name that it elected
    doc: np.ndarray    # its text


def _parse(table: pa.Table, window: int) -> list[Parsed]:
    ids = table["doc_id"].combine_chunks()
    has = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = []
    for b in blocks(*texts(table["text"])):
        names = b.hashes()
        at, name = elected(b, names, window)
        doc = b.doc[at]
        ok = has[b.lo:b.hi][doc]
        out.append(Parsed(b, ids[b.lo:b.hi], names, at[ok], name[ok], doc[ok]))
    return out


def _names(parsed: list[Parsed]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct elected names of a chunk, and whether two of its documents have each."""
    parts = []
    for p in parsed:
        change = np.ones(len(p.name), bool)  # neighbouring windows mostly elect the same place
        change[1:] = (p.name[1:] != p.name[:-1]) | (p.doc[1:] != p.doc[:-1])
        parts.append((p.name[change], p.ids[p.doc[change]]))
    name, of = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.lexsort((of, name))
    name, of = name[order], of[order]
    first = np.ones(len(name), bool)
    first[1:] = name[1:] != name[:-1]
    group = np.cumsum(first) - 1
    other = np.zeros(len(name), bool)
    other[1:] = ~first[1:] & (of[1:] != of[:-1])
    return name[first], np.bincount(group[other], minlength=int(first.sum())) > 0


def _ask_names(buckets: X.Ranges, window: int):
    def fn(table: pa.Table) -> pa.Table:
        keys, several = _names(_parse(table, window))
        short = ((keys >> U(8)) & U(0xFFFFFFFF)).astype("<u4")  # bucket + 32 bits: a coincidence costs a needless check only
        return X.asked(table["chunk"][0].as_py(), keys, buckets,
                       lambda lo, hi: (short[lo:hi].tobytes(), several[lo:hi].tobytes()))
    return fn


def _shared_names(table: pa.Table) -> pa.Table:
    keys, edge = X.unpack(table, "<u4", "keys")
    several, _ = X.unpack(table, bool, "extra")
    _, group, count = np.unique(keys, return_inverse=True, return_counts=True)
    shared = count > 1
    shared[group[several]] = True
    yes = shared[group]
    return X.answered(table, [yes[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])])


def _least(g: np.ndarray, f: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (g, f) in order, the least id of each, and the group of every input row."""
    order = np.lexsort((ids, f, g))
    a, b = g[order], f[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(first) - 1
    return a[first], b[first], ids[order][first], group


def _verify(parsed: list[Parsed], shared: np.ndarray, window: int):
    """Windows that elected one of the sorted ``shared`` names: (block, places), then the distinct
    windows of the chunk with the least id of each, the group and the id of every one."""
    rows, parts = [], []
    for p in parsed:
        pos = np.minimum(np.searchsorted(shared, p.name), max(len(shared) - 1, 0))
        ok = shared[pos] == p.name if len(shared) else np.zeros(len(p.name), bool)
        at = p.at[ok]
        rows.append((p.b, at))
        parts.append((grams(p.names, at, window), (grams(p.b.hashes(1), at, window, 1) >> U(32)).astype("<u4"), p.ids[p.doc[ok]]))
    g, f, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    return rows, _least(g, f, ids), ids


WINDOW = np.dtype([("g", "<u8"), ("f", "<u4"), ("id", "<i8")])


def _ask_windows(buckets: X.Ranges, window: int):
    def fn(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.ASK.empty_table()
        parsed = _parse(table, window)
        keys, _ = _names(parsed)
        _, (g, f, least, _), _ = _verify(parsed, keys[X.gathered(answers, bool)], window)
        items = np.empty(len(g), WINDOW)
        items["g"], items["f"], items["id"] = g, f, least
        return X.asked(table["chunk"][0].as_py(), g, buckets, lambda lo, hi: (items[lo:hi].tobytes(), b""))
    return fn


def _earlier(table: pa.Table) -> pa.Table:
    items, edge = X.unpack(table, WINDOW, "keys")
    _, _, least, group = _least(items["g"], items["f"], items["id"])
    yes = least[group] < items["id"]
    return X.answered(table, [yes[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])])


def _remove(window: int):
    def fn(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return RESULT.empty_table()
        kind = answers["bucket"].to_numpy(zero_copy_only=False) if answers.num_rows else np.zeros(0, np.int64)
        names_said = answers.filter(pa.array(kind >= 0))
        windows_said = answers.filter(pa.array(kind < 0))
        windows_said = windows_said.set_column(1, "bucket", pa.array(-1 - kind[kind < 0], pa.int32()))
        parsed = _parse(table, window)
        keys, _ = _names(parsed)
        rows, (g, _, least, group), ids_of = _verify(parsed, keys[X.gathered(names_said, bool)], window)
        gone = X.gathered(windows_said, bool)[group] | (least[group] < ids_of)
        out, parts, at_row = [], [], 0
        for b, at in rows:
            hit = at[gone[at_row:at_row + len(at)]]
            at_row += len(at)
            change = np.zeros(len(b.start) + 1, np.int64)
            np.add.at(change, hit, 1)
            np.add.at(change, hit + window, -1)
            keep = np.cumsum(change[:-1]) == 0
            parts.append(joined(b, keep))
            lost = np.zeros(b.n, np.int64)
            np.add.at(lost, b.doc[~keep], 1)
            edge = np.zeros(len(keep), bool)  # a span starts where a removed word follows a kept one or another text
            if len(keep):
                d = b.doc
                edge[0] = ~keep[0]
                edge[1:] = ~keep[1:] & (keep[:-1] | (d[1:] != d[:-1]))
                last = np.zeros(len(keep), bool)
                last[-1] = ~keep[-1]
                last[:-1] = ~keep[:-1] & (keep[1:] | (d[1:] != d[:-1]))
                s, e = np.flatnonzero(edge), np.flatnonzero(last) + 1
                of = d[s]
                s, e = s - b.first[of], e - b.first[of]
            else:
                s = e = of = np.zeros(0, np.int64)
            out.append((np.diff(b.first), lost, np.bincount(of, minlength=b.n), s, e))
        n, lost, per, s, e = (np.concatenate([o[i] for o in out]) for i in range(5))
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()),
                                         pa.StructArray.from_arrays([pa.array(s, pa.int64()), pa.array(e, pa.int64())], ["start", "end"]))
        return pa.table([table["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), spans,
                         string_array(parts)], schema=RESULT)
    return fn


def substring_dedup(docs: DataFrame, window: int = 13, chunk_bytes: int = X.CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, text``: removed word spans and the kept words joined by one space.

    ``window`` must be at least 9: six words of context around one of four
    neighbouring places, one of which is a symbol boundary.
    """
    if window < 9:
        raise ValueError("window must be at least 9 words")
    n = X.chunk_count(docs, chunk_bytes)
    t = X.chunked(docs, n)
    cut = X.ranges(n)
    said = X.answer(X.ask(t, _ask_names(cut, window)), _shared_names, cut)
    found = X.answer(X.meet(t, said, _ask_windows(cut, window), X.ASK_DDL), _earlier, cut)
    both = said.unionByName(found.selectExpr("chunk", "-1 - bucket AS bucket", "answer"))
    return X.meet(t, both, _remove(window), RESULT_DDL)
