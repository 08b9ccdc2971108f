from __future__ import annotations

import base64
import random

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import bpe

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def both():
    import tiktoken

    try:
        raw = bpe.read_vocabulary()
    except OSError:
        pytest.skip("no vocabulary here")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines())}
    return bpe.Encoder(raw), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_another_implementation(both):
    own, other = both
    rng = random.Random(5)
    letters = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "a", "Z", "é", "中", "1", "²", "!", " ", "　", "\t", "\x85", "\x1c", "’", "́", "😀", "S", "_"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(8000)]
    texts += [None, "", "<|endoftext|>", "a" * 5000, " " * 3000, "ab" * 4000, "中文" * 2000, "the cat's toys, they'll\n\n say" * 3000, "".join(rng.choice("abcdefgh") for _ in range(20000))]
    got = [x for part in own.encode(pa.array(texts)) for x in part.to_pylist()]
    assert got == [other.encode_ordinary(t or "") for t in texts]
    assert own.counts(pa.array(texts)).tolist() == [len(g) for g in got]


def test_both_forms_of_the_tree_agree(both):
    m = both[0].merger
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b" abcdeinorst'") for _ in range(rng.randint(2, 60))) for _ in range(200)]
    assert [x.tolist() for x in m.merge(pieces)] == [m.merge_one(p).tolist() for p in pieces]


def test_dataframe_and_empty_table(spark, both):
    df = spark.createDataFrame([(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (4, "hello world", "w")], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_texts(df).collect()}
    assert got[1] == got[4] == both[1].encode_ordinary("hello world") and got[2] == got[3] == []
    assert bpe.encode_texts(df.limit(0)).count() == 0 and bpe.count_tokens(df).where("doc_id = 1").first()["n_tokens"] == 2


def test_equal_hashes_of_different_pieces_do_no_harm(monkeypatch):
    import pyarrow as pa

    from tessella.llm import pieces

    monkeypatch.setattr(pieces, "piece_hashes", lambda points, begin: np.full(len(begin), 7, np.uint64) + (np.arange(len(begin)) % 2).astype(np.uint64) * np.uint64(1 << 63))
    known: list[str] = []
    table = pieces.PieceTable(known.extend, known.clear)
    for text in ("the valve and the seat", "a seat and a valve, the seat", "x" * 400 + " the end"):
        for whole, points, starts in pieces.chunks(pa.array([text])):
            begin = pieces.piece_starts(points, starts)
            numbers = table.numbers(whole, points, begin)
            assert [known[k] for k in numbers] == [whole[a:b] for a, b in zip(begin, np.append(begin[1:], len(points)))]
