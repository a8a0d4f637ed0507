"""Line dedup by winnowing: later repeats of runs of lines go.

The lines of a text are its ``\\n``-split pieces; lines without a word are not
counted (they stay).  Lines are compared from their first word to their last.
A run of consecutive lines is repeated if the same lines stand at an earlier place: in a
document with a smaller ``doc_id``, or before in the same one.  Every repeated run of
``window`` (3) lines, or of at least ``words`` (8) words on fewer lines, a single one included,
is deleted, so the first occurrence of longer repeats stays whole and all later ones go.

1. **Fingerprints.**  Each window of consecutive line hashes (of ``window`` lines, and of each smaller
   number with enough words) selects its minimum (ties: any, the hash is the same), so two equal
   windows select equal fingerprints.  A window that two smaller ones cover takes no part: it
   repeats only where they do.  Chunks ask which fingerprints stand at a second place (see ``exchange``).
2. **Positions.**  Windows with such a fingerprint send a 128-bit hash of their lines and
   the first place (id, line) the chunk has it at, and learn the first place of all: each position is joined
   with one earlier position of the same lines, not with all of them.
3. **Extension.**  Joined positions are extended both ways: windows that overlap or touch and have their first places
   in one document at the same distance are one match.  Matches are ``runs``, with the earlier place of
   each, and their lines are deleted.  A longer match with any other earlier place deletes no line more: it is made of
   windows, and each of them has a first place.

A line of a third of all documents is asked about once per chunk.

Defined results: null text stays null with no lines; rows with null ``doc_id`` are
returned as they are; rows with equal ids do not see each other's equal places as earlier;
other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sluice.llm import exchange as X
from sluice.llm.quality_gam import lines
from sluice.llm.words import U, Block, blocks, grams, mix, texts

RUN = ("start", "end", "from_id", "from_line")
ADDED = ("n_lines", "n_removed", "runs")
RUNS = ArrayType(StructType([StructField(c, LongType()) for c in RUN]))
WINDOW = 3  # lines of a run that counts whatever it holds
WORDS = 8   # words of a shorter run that counts
FIRST = np.dtype([("id", "<i8"), ("at", "<i8")])  # a place: document and number of the line
PLACE = np.dtype([("g", "<u8"), ("f", "<u8"), ("id", "<i8"), ("at", "<i8")])


def _runs(rows: Block, size: np.ndarray, k: int, words: int):
    """Starts of the windows to look at, by number of lines; ``size`` has the words of each line."""
    total, smaller = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(size) + 1, bool)
    for j in range(1, k + 1):
        at = rows.starts_of(j)
        counts = np.ones(len(at), bool) if j == k else total[at + j] - total[at] >= words
        yield j, at[counts & ~(smaller[at] & smaller[at + 1])]
        smaller = np.zeros(len(size) + 1, bool)
        smaller[at] = counts


def _windows(table: pa.Table, k: int, words: int):
    """Windows of a chunk (fingerprint, both hashes, id, line number, row, lines) and the lines of each block."""
    ids = table["doc_id"].combine_chunks()
    has = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    found, kept = [], []
    for b in blocks(*texts(table["text"])):
        start, end, doc = lines(b)
        first = np.searchsorted(doc, np.arange(b.n + 1))
        rows = Block(b.lo, b.hi, b.data, b.offs, start, end, first)
        kept.append(rows)
        h, f = rows.hashes(), rows.hashes(1)
        for j, at in _runs(rows, np.searchsorted(b.start, end) - np.searchsorted(b.start, start), k, words):
            at = at[has[doc[at] + b.lo]]
            least = h[at]
            for i in range(1, j):
                least = np.minimum(least, h[at + i])
            found.append((mix(least + U(j)), grams(h, at, j), grams(f, at, j, 1), ids[doc[at] + b.lo], at - first[doc[at]],
                          doc[at] + b.lo, np.full(len(at), j)))
    return [np.concatenate([f[i] for f in found]) for i in range(7)], kept


def _ask_fingerprints(buckets: X.Ranges, k: int, words: int):
    def fn(table: pa.Table) -> pa.Table:
        (least, g, *_), _ = _windows(table, k, words)
        order = np.lexsort((g, least))
        least, g = least[order], g[order]
        keys, first = np.unique(least, return_index=True)
        again = np.zeros(len(least), np.int64)  # equal windows in this chunk: the fingerprint counts twice
        again[1:] = (least[1:] == least[:-1]) & (g[1:] == g[:-1])
        many = (1 + (np.add.reduceat(again, first) > 0 if len(keys) else again)).astype(np.uint8)
        return X.asked(table["chunk"][0].as_py(), keys, buckets, lambda lo, hi: (keys[lo:hi].tobytes(), many[lo:hi].tobytes()))
    return fn


def _shared(table: pa.Table) -> pa.Table:
    keys, edge = X.unpack(table, "<u8", "keys")
    many, _ = X.unpack(table, np.uint8, "extra")
    _, group = np.unique(keys, return_inverse=True)
    yes = (np.bincount(group, weights=many) > 1)[group].astype(np.uint8)
    return X.answered(table, [yes[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])])


def _first(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, each with its first place, and the group of every row."""
    order = np.lexsort((w["at"], w["id"], w["f"], w["g"]))
    s = w[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["g"][1:] != s["g"][:-1]) | (s["f"][1:] != s["f"][:-1])
    group = np.empty(len(s), np.int64)
    group[order] = np.cumsum(new) - 1
    return s[new], group


def _candidates(table: pa.Table, answers: pa.Table, k: int, words: int):
    (least, g, f, ids, at, row, size), kept = _windows(table, k, words)
    keys = np.unique(least)
    ok = X.gathered(answers, np.uint8).astype(bool)[np.searchsorted(keys, least)] if len(keys) else np.zeros(0, bool)
    w = np.empty(int(ok.sum()), PLACE)
    w["g"], w["f"], w["id"], w["at"] = g[ok], f[ok], ids[ok], at[ok]
    return w, row[ok], size[ok], kept


def _ask_places(buckets: X.Ranges, k: int, words: int):
    def fn(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return X.ASK.empty_table()
        own, _ = _first(_candidates(table, answers, k, words)[0])
        return X.asked(table["chunk"][0].as_py(), own["g"], buckets, lambda lo, hi: (own[lo:hi].tobytes(), b""))
    return fn


def _first_places(table: pa.Table) -> pa.Table:
    w, edge = X.unpack(table, PLACE, "keys")
    own, group = _first(w)
    best = own[["id", "at"]][group].astype(FIRST)
    return X.answered(table, [best[a:z].tobytes() for a, z in zip(edge[:-1], edge[1:])])


def extended(row: np.ndarray, at: np.ndarray, size: np.ndarray, of: np.ndarray, of_at: np.ndarray):
    """Maximal matches of windows (row, line, lines) with places (id, line): row, start, end, id, line there; by row and start."""
    apart = at - of_at
    order = np.lexsort((at, apart, of, row))
    row, at, of, apart, end = row[order], at[order], of[order], apart[order], (at + size)[order]
    change = np.ones(len(row), bool)
    change[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1]) | (apart[1:] != apart[:-1])
    base = (np.cumsum(change) - 1) * (end.max(initial=0) + 1)  # keeps the ends of one document pair and distance above those before
    reach = np.maximum.accumulate(end + base) if len(end) else end
    first = change.copy()
    first[1:] |= (at + base)[1:] > reach[:-1]
    start = np.flatnonzero(first)
    last = np.append(start[1:], len(row))[:len(start)] - 1
    out = (row[start], at[start], (reach - base)[last], of[start], at[start] - apart[start])
    by = np.lexsort((out[3], out[2], out[1], out[0]))
    return tuple(x[by] for x in out)


def _delete(k: int, words: int, names: list[str]):
    def fn(table: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers["bucket"].to_numpy(zero_copy_only=False) if answers.num_rows else np.zeros(0, np.int64)
        one, two = answers.filter(pa.array(kind >= 0)), answers.filter(pa.array(kind < 0))
        two = two.set_column(1, "bucket", pa.array(-1 - kind[kind < 0], pa.int32()))
        w, row, size, kept = _candidates(table, one, k, words)
        own, group = _first(w)
        best = X.gathered(two, FIRST)[group]
        gone = (best["id"] < w["id"]) | (best["id"] == w["id"]) & (best["at"] < w["at"])
        n_lines, removed, text = [], [], []
        run_row, start, end, of, of_at = extended(row[gone], w["at"][gone], size[gone], best["id"][gone], best["at"][gone])
        edge = np.searchsorted(run_row, np.arange(table.num_rows + 1))
        raw_texts = table["text"].to_pylist()
        for rows in kept:
            data = rows.data.tobytes()
            for d in range(rows.n):
                r, n = rows.lo + d, int(rows.first[d + 1] - rows.first[d])
                n_lines.append(n)
                if edge[r] == edge[r + 1]:
                    removed.append(0)
                    text.append(raw_texts[r])
                    continue
                cover = np.zeros(n, bool)
                for i in range(edge[r], edge[r + 1]):
                    cover[start[i]:end[i]] = True
                removed.append(int(cover.sum()))
                # lines that hold a word, by number; the others stay
                out, seen = [], 0
                for line in data[rows.offs[d]:rows.offs[d + 1]].split(b"\n"):
                    if line.strip(b" \t\n\x0b\f\r"):
                        seen += 1
                        if cover[seen - 1]:
                            continue
                    out.append(line)
                text.append(b"\n".join(out).decode())
        cols = [pa.array(text, pa.string()) if c == "text" else table[c] for c in names]
        runs = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (start, end, of, of_at)], list(RUN)))
        return pa.table([*cols, pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), runs], names=[*names, *ADDED])
    return fn


def line_dedup(docs: DataFrame, window: int = WINDOW, words: int = WORDS, chunk_bytes: int = X.CHUNK_BYTES) -> DataFrame:
    """``docs`` with the kept lines as ``text``, ``n_lines``, ``n_removed`` (lines that hold a word), and ``runs``.

    A run has the numbers of its first line and of the line after its last, and the earlier place: document and first line.
    Columns of ``docs`` named ``chunk``, ``n_lines``, ``n_removed`` or ``runs`` are dropped first.
    """
    docs = docs.drop("chunk", *ADDED)
    n = X.chunk_count(docs, chunk_bytes)
    t = X.chunked(docs, n, *[c for c in docs.columns if c not in ("doc_id", "text")])
    cut = X.ranges(n)
    said = X.answer(X.ask(t, _ask_fingerprints(cut, window, words)), _shared, cut)
    found = X.answer(X.meet(t, said, _ask_places(cut, window, words), X.ASK_DDL), _first_places, cut)
    both = said.unionByName(found.selectExpr("chunk", "-1 - bucket AS bucket", "answer"))
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("runs", RUNS)])
    return X.meet(t, both, _guarded(_delete(window, words, docs.columns), docs.columns), schema)


def _guarded(fn, names):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            runs = pa.array([], pa.list_(pa.struct([(c, pa.int64()) for c in RUN])))
            return pa.table([*(table[c] for c in names), pa.array([], pa.int64()), pa.array([], pa.int64()), runs], names=[*names, *ADDED])
        return fn(table, answers)
    return run
