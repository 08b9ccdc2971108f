"""Byte-pair encoding of whole texts by segment trees over byte positions.

A segment tree over the byte positions of a piece stores, in every node, the leftmost position of
the smallest pair rank below it (rank and position in one key, so the minimum is both). A merge
takes the root's position, joins the pair, and makes logarithmic point updates at the merged
position, its dead right half and its live left neighbour. Many short pieces of one width are
merged side by side as rows of numpy arrays; a few long ones run alone.

Defined results: null and empty texts have no ids (an empty list). Special-token strings in a
text are ordinary text. Repeated texts are encoded alike, each under its own key.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.pieces import PieceTable, chunks, piece_starts

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_NONE = np.iinfo(np.int64).max


class Merger:
    """Merge rules of a rank file: ids of single bytes and the rank (which is the id) of each mergeable pair."""

    def __init__(self, rank_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        widths: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) < 2:
                out[i] = self.byte[np.frombuffer(p, np.uint8)]
            else:
                widths.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, own in widths.items():
            if len(own) < 6 or width > 4096:
                for i in own:
                    out[i] = self.merge_one(pieces[i])
            else:
                step = max(6, (1 << 20) // width)
                for s in range(0, len(own), step):
                    for i, ids in zip(own[s:s + step], self.merge_rows([pieces[i] for i in own[s:s + step]], width)):
                        out[i] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Segment trees of equal width, one per row, updated side by side."""
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        token = self.byte[raw]
        position = np.arange(width)
        after = np.repeat(position[None] + 1, n, 0)
        before = np.repeat(position[None] - 1, n, 0)
        alive = position[None] < length[:, None]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        pair = np.full((n, width), _NONE, np.int64)
        pair[:, :-1] = self.rank(token[:, :-1], token[:, 1:])
        pair[position[None] >= length[:, None] - 1] = _NONE
        tree[:, width:] = np.where(pair < _NONE, pair * width + position, _NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = tree[:, 2 * level:4 * level].reshape(n, level, 2).min(2)

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | int) -> None:
            node = at + width
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            best = tree[rows, 1]
            at, merged = best % width, best // width
            gone = after[rows, at]
            follow = after[rows, gone]
            token[rows, at] = merged
            alive[rows, gone] = False
            after[rows, at] = follow
            inside = follow < length[rows]
            before[rows[inside], follow[inside]] = at[inside]
            put(rows, gone, _NONE)
            right = np.full(len(rows), _NONE, np.int64)
            r = self.rank(merged[inside], token[rows[inside], follow[inside]])
            right[inside] = np.where(r < _NONE, r * width + at[inside], _NONE)
            put(rows, at, right)
            left = before[rows, at]
            has = left >= 0
            if has.any():
                r = self.rank(token[rows[has], left[has]], merged[has])
                put(rows[has], left[has], np.where(r < _NONE, r * width + left[has], _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        flat, counts = token[alive], alive.sum(1)
        return np.split(flat, np.cumsum(counts)[:-1])

    def merge_one(self, piece: bytes) -> np.ndarray:
        """The same tree for one piece, over plain lists."""
        n, rank = len(piece), self.pairs.get
        width = 1 << (n - 1).bit_length()
        token = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        none = float("inf")
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank(token[i] << 32 | token[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: float) -> None:
            node = at + width
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                small = a if a < b else b
                if tree[node] == small:
                    break
                tree[node] = small

        while tree[1] != none:
            merged, at = divmod(tree[1], width)
            gone = after[at]
            follow = after[gone]
            token[at], token[gone], after[at] = merged, -1, follow
            put(gone, none)
            r = None
            if follow < n:
                before[follow] = at
                r = rank(merged << 32 | token[follow])
            put(at, none if r is None else r * width + at)
            left = before[at]
            if left >= 0:
                r = rank(token[left] << 32 | merged)
                put(left, none if r is None else r * width + left)
        return np.array([t for t in token if t >= 0], np.int64)


class Encoder:
    """Encodes batches of texts; the ids of pieces seen before are kept."""

    def __init__(self, rank_file: bytes):
        self.merger = Merger(rank_file)
        self.table = PieceTable(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.ids = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        got = self.merger.merge([p.encode("utf-8", "surrogatepass") for p in pieces])
        self.ids = np.concatenate([self.ids, *got]).astype(np.int32)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(g) for g in got])])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        out = []
        for whole, points, starts in chunks(texts):
            begin = piece_starts(points, starts)
            number = self.table.numbers(whole, points, begin)
            total = np.concatenate([[0], np.cumsum(self.offsets[number + 1] - self.offsets[number])])
            out.append(np.diff(total[np.searchsorted(begin, starts)]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """Id lists, in as many arrays as there are chunks."""
        for whole, points, starts in chunks(texts):
            begin = piece_starts(points, starts)
            number = self.table.numbers(whole, points, begin)
            length = self.offsets[number + 1] - self.offsets[number]
            ends = np.cumsum(length)
            total = int(ends[-1]) if len(ends) else 0
            if total == len(number):
                flat = self.ids[self.offsets[number]]
            else:
                flat = self.ids[np.repeat(self.offsets[number] - (ends - length), length) + np.arange(total)]
            cut = np.concatenate([[0], ends])[np.searchsorted(begin, starts)]
            yield pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, pa.int32()))


@lru_cache(2)
def encoder(rank_file: bytes) -> Encoder:
    """One encoder per worker process and vocabulary, kept from task to task."""
    return Encoder(rank_file)


def read_vocabulary(path: str = DEFAULT_VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` of every row. The vocabulary (a file of fixed size) is read by the driver and broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for b in batches:
            at = 0
            for ids in coder.encode(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), ids], names=[key, "ids"])
                at += len(ids)

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``n_tokens`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coder.counts(b.column(1)), pa.int64())], names=[key, "n_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long")
