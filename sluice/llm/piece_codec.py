"""SentencePiece byte-pair encoding by last tokens of prefixes, and decoding.

Byte-pair encoding joins, again and again, the neighbours whose joint piece
scores highest.  Two facts make it a left-to-right scan.  Pieces encode a text
exactly if each two neighbouring ones are **compatible**: encoding their joint text gives
just the two back.  And what remains when the last piece is taken off
an encoding is the encoding of the remaining prefix.  So every prefix has one last
piece, and that is the only piece ending there that is compatible with the last
piece of the prefix before it.

1. **Automaton.**  One pass of an Aho-Corasick automaton over the vocabulary names
   all pieces that end at each place.
2. **Table.**  For every prefix its last piece is stored: the match that starts at the
   text's start or passes the pair test against the table's entry at its own start.
   A character without a piece stands for itself.
3. **Recovery.**  From the end, the table is followed back, piece by piece.

The pair test replays the joins inside both pieces in their common order and looks
whether a join across the border comes first.  Pairs are tested once per worker.

No piece of the vocabulary holds letters together with other characters, but for spaces in front
(checked when it is read).  So texts are cut before spaces into units and units between letters and other
characters into parts; a worker encodes each distinct part once and joins the new ones of a batch for one
scan.  Its caches are emptied when they are full; that changes no result.

Characters without a piece become the ids of their UTF-8 bytes.  Decoding joins the
pieces' bytes, reads the space mark as a space and takes one leading space
off; bytes that are no UTF-8 become U+FFFD one by one, control ids vanish.

The work is one ``mapInArrow`` over the rows, without a shuffle; memory follows the
longest text.  Defined results: a null or empty text has the end id only and
decodes to the empty text; null and repeated ids are kept row by row; other columns are
dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NEVER = float("-inf")
CACHE_CHARS = 6 << 20      # of units in a worker's cache
CACHE_PAIRS = 1 << 20
LONGEST_CACHED = 64        # longer units are encoded anew each time
WRITE_CHARS = 1 << 22      # texts per batch given back
UNIT = re.compile(" +[^ ]*")
PART = re.compile(r" *[^\W\d_¹²³¼½¾]+| *(?:[^\w ]+|[\d_¹²³¼½¾]+)+| +")  # spaces and the letters, or the other characters, that follow
BETWEEN = "\x00"            # parts that are encoded together are joined by it; no piece holds it
OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
OUT_DDL = "doc_id long, ids array<int>, decoded string"


class Vocabulary:
    """Pieces, scores and byte ids of a model file of the byte-pair kind with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.end = model.eos_id()
        self.pieces = {model.id_to_piece(i): i for i in range(size) if i not in special}
        self.score = {p: model.get_score(i) for p, i in self.pieces.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.text = [b"" if i in special else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        self.text[model.unk_id()] = " \u2047 ".encode()
        self.byte_ids = frozenset(self.byte.values())
        self.controls = frozenset(special - self.byte_ids - {model.unk_id()})
        self.opening = frozenset(i for p, i in self.pieces.items() if p[0] == MARK)
        if len(self.byte) != 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError("a model with byte fallback and without unused pieces is needed")
        if not all(PART.fullmatch(p.replace(MARK, " ")) and BETWEEN not in p for p in self.pieces):
            raise ValueError("a piece reaches past a part; parts would not be independent")
        probe = " Aﬁ  é́Ａ "
        if "".join(model.encode(probe, out_type=str)[:1])[:1] != MARK or model.decode(model.encode(probe)) != probe:
            raise ValueError("a model with a space put before the text and without normalisation is needed")
        self.automaton = ahocorasick.Automaton()  # pieces of two characters and more, each with its place in the pair tests
        self.longer = [p for p in self.pieces if len(p) > 1]
        for k, p in enumerate(self.longer):
            self.automaton.add_word(p, (len(p), p, k))
        self.automaton.make_automaton()


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.edges: dict[str, tuple | None] = {}
        self.pairs: list[dict[str, bool]] = [{} for _ in vocabulary.longer]  # of each longer piece: whether it may follow a piece
        self.tested = 0
        self.units: dict[str, bytes] = {}   # packed: the collector need not walk through them
        self.parts: dict[str, bytes] = {}
        self.cached = 0

    def _edges(self, piece: str) -> tuple | None:
        """(score, last symbol) and (score, first symbol) after each join inside a piece, in the order of joins; None if it is not joined whole."""
        if piece in self.edges:
            return self.edges[piece]
        symbols, right, left = list(piece), [], []
        score = self.v.score
        while len(symbols) > 1:
            best, at = NEVER, -1
            for k in range(len(symbols) - 1):
                s = score.get(symbols[k] + symbols[k + 1], NEVER)
                if s > best:
                    best, at = s, k
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            right.append((best, symbols[-1]))
            left.append((best, symbols[0]))
        out = (piece[-1], right, piece[0], left) if len(symbols) == 1 else None
        self.edges[piece] = out
        return out

    def compatible(self, one: str, two: str) -> bool:
        """Whether the joint text of two pieces is encoded as the two (of one alone, if the first is empty)."""
        a, b = self._edges(one) if one else ("", (), "", ()), self._edges(two)
        if a is None or b is None:
            return False
        (x, right, _, _), (_, _, y, left) = a, b
        i = j = 0
        while one:
            across = self.v.score.get(x + y, NEVER)
            own = right[i][0] if i < len(right) else NEVER
            other = left[j][0] if j < len(left) else NEVER
            if across > own and across >= other:  # of equal scores the join further left comes first
                return False
            if own == NEVER and other == NEVER:
                break
            if own >= other:
                x, i = right[i][1], i + 1
            else:
                y, j = left[j][1], j + 1
        return True

    def last_pieces(self, unit: str) -> list[str]:
        """The last piece of the encoding of every prefix (the first entry, of the empty one, is empty).

        Where no longer piece passes the test, it is the character itself, with or without a piece of the vocabulary.
        """
        table, pairs, found = ["", *unit], self.pairs, -1
        for at, (size, piece, k) in self.v.automaton.iter(unit):
            if at == found:
                continue
            before = table[at + 1 - size]
            fine = pairs[k].get(before)
            if fine is None:
                fine = self.compatible(before, piece)
                self.tested += 1
                if self.tested > CACHE_PAIRS:
                    for tests in pairs:
                        tests.clear()
                    self.tested = 1
                pairs[k][before] = fine
            if fine:
                table[at + 1], found = piece, at
        return table

    def _ids(self, text: str) -> list[bytes]:
        """Ids of the stretches of ``text`` between its separators, packed."""
        table, at, pieces, byte = self.last_pieces(text), len(text), self.v.pieces, self.v.byte
        back, cut = [], [0]
        while at:
            p = table[at]
            at -= len(p)
            i = pieces.get(p)
            if i is not None:
                back.append(i)
            elif p == BETWEEN:
                cut.append(len(back))
            else:
                back.extend([byte[b] for b in reversed(p.encode())])
        cut.append(len(back))
        packed, n = np.array(back[::-1], np.int32).tobytes(), len(back)
        return [packed[4 * (n - hi):4 * (n - lo)] for lo, hi in zip(cut[-2::-1], cut[:0:-1])]

    def _learn(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units, which are cached unless they are very long."""
        cut = {u: PART.findall(u) for u in units}
        known = self.parts
        new = [p for p in set(chain.from_iterable(cut.values())) if p not in known]
        plain = [p for p in new if BETWEEN not in p and len(p) <= LONGEST_CACHED]
        if plain:
            known.update(zip(plain, self._ids(BETWEEN.join(plain).replace(" ", MARK))))
        if len(plain) < len(new):
            nul = np.int32(self.v.byte[0]).tobytes()  # the separator as a character of a text
            odd = {p: nul.join(self._ids(p.replace(" ", MARK))) for p in set(new).difference(plain)}
            known = {p: odd[p] if p in odd else known[p] for p in set(chain.from_iterable(cut.values()))}
        out = {u: b"".join([known[p] for p in c]) for u, c in cut.items()}
        small = {u: ids for u, ids in out.items() if len(u) <= LONGEST_CACHED}
        self.units.update(small)
        self.cached += sum(map(len, small)) + sum(map(len, plain))
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts, each closed by the end id."""
        if self.cached > CACHE_CHARS:
            self.units.clear()
            self.parts.clear()
            self.cached = 0
        cut = [UNIT.findall(" " + (t.replace(MARK, " ") if MARK in t else t)) if t else [] for t in texts]
        known = self.units.get
        missed = {u for u in set(chain.from_iterable(cut)) if known(u) is None}
        new = self._learn(missed) if missed else {}
        end = np.int32(self.v.end).tobytes()
        return [np.frombuffer(b"".join([known(u) or new[u] for u in units]) + end, np.int32) for units in cut]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, closed by the end id."""
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        table, controls = self.v.text, self.v.controls
        first = next((i for i in ids if i not in controls), None)
        parts, lo = [], 0
        for at in [k for k, i in enumerate(ids) if i in controls] + [len(ids)]:  # bytes on both sides of a control id form no character
            parts.append(b"".join([table[i] for i in ids[lo:at]]))
            lo = at + 1
        out = "".join(map(_read, parts))
        return out[1:] if first in self.v.opening else out



def _read(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(_single(raw))


def _single(raw: bytes) -> Iterator[str]:
    """Characters of bytes; each byte that begins none is U+FFFD."""
    at = 0
    while at < len(raw):
        size = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            yield raw[at:at + size].decode()
            at += size
        except UnicodeDecodeError:
            yield "�"
            at += 1


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """A worker's codec of a model file, read once."""
    if path not in _codecs:
        _codecs[path] = Codec(Vocabulary(path))
    return _codecs[path]


def encode_texts(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, decoded`` for every row of ``docs (doc_id, text)``; ``model`` is a model file that every executor has."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)

        def groups(batch):
            """Rows whose texts have some MB together."""
            rows, size = [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                rows.append((i, text.as_py()))
                size += len(rows[-1][1] or "")
                if size > WRITE_CHARS:
                    yield rows
                    rows, size = [], 0
            yield rows

        for batch in batches:
            for rows in groups(batch):
                coded = own.encode_all([t for _, t in rows])
                offsets = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(coded or [np.zeros(0, np.int32)])))
                yield pa.record_batch([pa.array([i for i, _ in rows], pa.int64()), ids.cast(OUT.field("ids").type),
                                       pa.array([own.decode(c.tolist()) for c in coded], pa.string())], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(encode, OUT_DDL)


def report(coded: DataFrame) -> DataFrame:
    """Counts and digests of :func:`encode_texts`."""
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
