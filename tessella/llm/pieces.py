"""Vectorised pre-tokenisation: the pieces of many texts at once, and a table from pieces to values.

A batch of texts becomes one array of code points. Class changes, blanks and contractions give the
piece boundaries of the byte-level BPE split pattern without running a regular expression. A piece
is looked up by a 64-bit polynomial hash of its code points taken from running sums; every hit is then
compared with the piece it stands for, code point by code point, so equal hashes of different pieces do
no harm. Pieces longer than ``LONG`` are never hashed but handled as texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points handled at a time, unless one text alone is longer.
CHUNK = 1_500_000
LONG = 256
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point under the split pattern's properties."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for code, name in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        hit = "".join(regex.findall(f"{name}+", every))
        table[np.frombuffer(hit.encode("utf-32-le"), np.uint32)] = code
    return table


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def chunks(texts: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts joined up to CHUNK code points, as (string, code points, start of each text and the end)."""
    part: list[str] = []
    size = 0
    for t in texts.to_pylist():
        t = t or ""
        if part and size + len(t) > CHUNK:
            yield _joined(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield _joined(part)


def _joined(part: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    whole = "".join(part)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(t) for t in part], out=starts[1:])
    return whole, points, starts


def piece_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin; ``starts`` are the texts' starts with the end appended."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[points]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= first[:-1]
    blank = points == 32
    space = kind == SPACE
    # a run of white space gives its last character to what follows, unless the text ends
    ends = np.empty(n, bool)  # last of its run with something behind it in the text
    ends[-1] = False
    ends[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    # behind a plain blank the run begins at the blank
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1] & ends[:-1]
    begin &= ~joined
    begin |= ends
    # contractions: a lone apostrophe that begins a piece takes the letters behind it
    at = np.flatnonzero((points == 39) & begin)
    if len(at):
        def char(k: int) -> np.ndarray:
            pos = at + k
            inside = pos < n
            pos = np.minimum(pos, n - 1)
            got = np.where(inside, points[pos], 0)
            for j in range(1, k + 1):  # not across a text's end
                got = np.where(first[np.minimum(at + j, n)], 0, got)
            return got
        a, b = char(1), char(2)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        two &= ~one
        begin[at[one | two] + 1] = False
        for took, k in ((one, 2), (two, 3)):
            pos = at[took] + k
            pos = pos[pos < n]
            begin[pos] |= (kind[pos] == LETTER)
    return np.flatnonzero(begin)


def piece_hashes(points: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of each piece; pieces run from one begin to the next."""
    up, down = powers(len(points))
    c = points.astype(np.uint64)
    c *= np.uint64(0xBF58476D1CE4E5B9)
    c ^= c >> np.uint64(29)
    c += np.uint64(0x94D049BB133111EB)
    c *= up[:len(points)]
    np.cumsum(c, out=c)
    ends = np.append(begin[1:], len(points)) - 1
    total = c[ends]
    total[1:] -= c[ends[:-1]]
    total *= down[begin]
    total ^= total >> np.uint64(32)
    total *= np.uint64(0xD6E8FEB86659FD93)
    total ^= (ends - begin + 1).astype(np.uint64)
    return total


class PieceTable:
    """Open-addressing table from piece hashes to dense piece numbers; emptied when it holds ``limit`` pieces."""

    def __init__(self, learn: Callable[[list[str]], None], forget: Callable[[], None], limit: int = 1 << 20):
        self.learn, self.forget, self.limit = learn, forget, limit
        self._reset()

    def _reset(self) -> None:
        self.bits = 16
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.n = 0
        self.hashed: list[int] = []
        self.long: dict[str, int] = {}  # pieces that are looked up by their text: long ones, and those whose hash is another's
        self.store, self.used = np.zeros(1 << 16, np.uint32), 0  # code points of all pieces, one behind the other
        self.begins, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def _insert(self, h: int, number: int) -> None:
        mask = (1 << self.bits) - 1
        at = h >> (64 - self.bits)
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        self.keys[at], self.slots[at] = h, number

    def _grow(self) -> None:
        while (1 << self.bits) < 4 * (len(self.hashed) + 1):
            self.bits += 1
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        for h, number in self.hashed:
            self._insert(h, number)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        off = np.flatnonzero((out >= 0) & (self.keys[at] != hashes))
        while len(off):
            at[off] = (at[off] + 1) & mask
            out[off] = self.slots[at[off]]
            off = off[(out[off] >= 0) & (self.keys[at[off]] != hashes[off])]
        return out

    def numbers(self, whole: str, points: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Number of each piece; new pieces are learnt in one call, in order of first appearance."""
        if self.n > self.limit:
            self._reset()
            self.forget()
        if not len(begin):
            return np.zeros(0, np.int32)
        ends = np.append(begin[1:], len(points))
        hashes = piece_hashes(points, begin)
        out = self.find(hashes)
        long = np.flatnonzero(ends - begin > LONG)
        out[long] = 0
        gone = np.flatnonzero(out < 0)
        new: list[str] = []
        if len(gone):
            fresh, where, back = np.unique(hashes[gone], return_index=True, return_inverse=True)
            new = [whole[begin[i]:ends[i]] for i in gone[where]]
            numbers = self.n + np.arange(len(new))
            out[gone] = numbers[back]
            self.hashed += zip(map(int, fresh), map(int, numbers))
            if (1 << self.bits) < 2 * len(self.hashed):
                self._grow()
            else:
                for h, k in self.hashed[-len(new):]:
                    self._insert(h, k)
        self._by_text(long, whole, begin, ends, out, new)
        self._keep(new)
        clash = self._unequal(points, begin, ends, out)
        if len(clash):
            more: list[str] = []
            self._by_text(clash, whole, begin, ends, out, more)
            self._keep(more)
        return out

    def _by_text(self, at: np.ndarray, whole: str, begin: np.ndarray, ends: np.ndarray, out: np.ndarray, new: list[str]) -> None:
        for i in at:
            text = whole[begin[i]:ends[i]]
            if text not in self.long:
                self.long[text] = self.n + len(new)
                new.append(text)
            out[i] = self.long[text]

    def _keep(self, new: list[str]) -> None:
        """Learns new pieces and stores their code points."""
        if not new:
            return
        codes = np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) for t in new])
        while self.used + len(codes) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while self.n + len(new) > len(self.begins):
            self.begins, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begins, self.lengths))
        self.store[self.used:self.used + len(codes)] = codes
        self.begins[self.n:self.n + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.lengths[self.n:self.n + len(new)] = sizes
        self.used += len(codes)
        self.n += len(new)
        self.learn(new)

    def _unequal(self, points: np.ndarray, begin: np.ndarray, ends: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Pieces that differ from what their number stands for."""
        sizes = ends - begin
        where = np.repeat(self.begins[out] - begin, sizes)
        where += np.arange(begin[0], len(points))
        np.minimum(where, len(self.store) - 1, out=where)
        differs = np.logical_or.reduceat(self.store[where] != points[begin[0]:], begin - begin[0])
        return np.flatnonzero(differs | (self.lengths[out] != sizes))
