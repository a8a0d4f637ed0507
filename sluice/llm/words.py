"""Vectorised words of whole texts: one NumPy pass over the bytes of an Arrow batch.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D`` within one
text (the contract's ``[^\\x20\\x09-\\x0D]+``; those six bytes never occur inside
a UTF-8 character, so bytes and characters give the same words).  Words are
identified by 64-bit hashes of their bytes; two hash families (``seed`` 0 and 1)
give 128 bits where a coincidence must not decide a result.

Texts are worked on in blocks of about ``BLOCK`` bytes (one text at least), so
memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = [_rng.integers(1, 2**63, 256, dtype=U) * U(2) + U(1) for _ in range(2)]
_BASE = [int(_rng.integers(1, 2**62)) * 4 + 1 for _ in range(2)]
_STEP = [U(int(_rng.integers(1, 2**62)) * 4 + 1) for _ in range(2)]
_power: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _power.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        up = np.full(size, U(_BASE[seed]))
        down = np.full(size, U(pow(_BASE[seed], -1, 2**64)))
        up[0] = down[0] = U(1)
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size == BLOCK + 1:
            _power[seed] = have
    return have


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


@dataclass
class Block:
    """Consecutive texts ``lo .. hi`` of a batch and the places of their words."""

    lo: int
    hi: int
    data: np.ndarray   # the block's bytes
    offs: np.ndarray   # text boundaries in data, hi - lo + 1
    start: np.ndarray  # word starts in data
    end: np.ndarray    # word ends in data
    first: np.ndarray  # words before each text, hi - lo + 1

    @property
    def n(self) -> int:
        return self.hi - self.lo

    @property
    def doc(self) -> np.ndarray:
        """The text (0 .. n-1) of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        up, down = _powers(seed, len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[seed][data] * up[:len(data)], out=total[1:])
        own = (total[self.end] - total[self.start]) * down[self.start]
        return mix(own + (self.end - self.start).astype(U) * _STEP[seed])

    def starts_of(self, k: int) -> np.ndarray:
        """Word places where ``k`` words of one text follow (that word included)."""
        place = np.arange(len(self.start))
        return place[place + k <= np.repeat(self.first[1:], np.diff(self.first))]


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK) -> Iterator[Block]:
    lo, rows = 0, len(offs) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        own, at = data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        n = len(own)
        cut = np.zeros(n + 1, bool)
        cut[at] = True
        solid = ~IS_SPACE[own]
        first, last = solid.copy(), solid.copy()
        if n > 1:
            first[1:] &= ~solid[:-1] | cut[1:n]
            last[:-1] &= ~solid[1:] | cut[1:n]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield Block(lo, hi, own, at, start, end, np.searchsorted(start, at))
        lo = hi


def grams(h: np.ndarray, at: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``k`` symbols that start at each place of ``at``."""
    acc = np.zeros(len(at), U)
    for j in range(k):
        acc = acc * _STEP[seed] + h[at + j]
    return mix(acc + U(k))


def joined(b: Block, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space: bytes and offsets of the block's texts."""
    which = np.flatnonzero(keep)
    doc = b.doc[which]
    size = b.end[which] - b.start[which]
    more = np.zeros(len(which), np.int64)  # a space after each word but a text's last
    if len(which):
        more[:-1] = doc[1:] == doc[:-1]
    total = np.cumsum(size + more)
    begin = total - size - more
    n = int(total[-1]) if len(total) else 0
    out = np.full(n, 32, np.uint8)
    if n:
        src = np.arange(int(size.sum()))
        before = np.cumsum(size) - size
        src += np.repeat(b.start[which] - before, size)
        dst = np.arange(len(src)) + np.repeat(begin - before, size)
        out[dst] = b.data[src]
    per = np.zeros(b.n + 1, np.int64)
    np.add.at(per, doc + 1, size + more)
    return out, np.cumsum(per)


def string_array(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """One string array from (bytes, offsets) of consecutive blocks."""
    sizes = [np.diff(o) for _, o in parts]
    offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
    data = np.concatenate([d for d, _ in parts]) if parts else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32).tobytes()),
                                       pa.py_buffer(data.tobytes()))
