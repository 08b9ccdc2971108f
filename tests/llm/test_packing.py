from __future__ import annotations

import numpy as np
import pytest

from tessella.llm import packing

CONTAINERS = "container_id int, container_kind string, capacity_tokens int"


def test_greedy_fits_and_is_close_to_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 700, 4000))[::-1]
    at = packing.pack(lengths, 1000)
    assert np.bincount(at, lengths).max() <= 1000 and at.max() + 1 <= 1.03 * np.ceil(lengths.sum() / 1000)
    assert len(packing.pack(np.zeros(0, int), 10)) == 0 and packing.pack(np.zeros(3, int), 10).max() == 0
    assert packing.pack(np.full(5, 10), 10).tolist() == [0, 1, 2, 3, 4]


def test_every_token_is_in_one_container(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n), "x") for i, n in enumerate(rng.integers(0, 300, 500))] + [(900, 0, "x"), (901, None, "x"), (902, 2500, "x"), (903, 1000, "x")]
    items = spark.createDataFrame(rows, "doc_id long, n_tokens long, container_key string")
    kinds = spark.createDataFrame([(1, "a", 100), (2, "b", 1000), (3, "none", 0), (4, "null", None)], CONTAINERS)
    got = packing.pack_items(items, kinds, shard_items=200).toPandas()
    assert set(got.container_id) == {1, 2}
    for c, capacity in ((1, 100), (2, 1000)):
        own = got[got.container_id == c]
        assert own.groupby("container_key").n_tokens.sum().max() <= capacity
        assert own.groupby("doc_id").n_tokens.sum().to_dict() == {i: n or 0 for i, n, _ in rows}
        for i, n, _ in rows:
            pieces = own[own.doc_id == i].sort_values("piece_no")
            assert len(pieces) == max(1, -(-(n or 0) // capacity))
            assert pieces.first_token.tolist() == [capacity * k for k in range(len(pieces))]
    assert packing.fill_rates(packing.pack_items(items, kinds)).where("container_id = 2").first()["used_share"] > 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack_items(none, spark.createDataFrame([(1, "a", 100)], CONTAINERS)).count() == 0
    assert packing.pack_items(none, spark.createDataFrame([], CONTAINERS)).count() == 0


def test_repeated_container_rows_are_filled_apart(spark):
    items = spark.createDataFrame([(i, 30 + i) for i in range(20)], "doc_id long, n_tokens long")
    got = packing.pack_items(items, spark.createDataFrame([(1, "a", 100), (1, "a", 100), (None, "b", 100)], CONTAINERS)).toPandas()
    assert sorted(got.groupby(["container_id", "container_copy"], dropna=False).doc_id.nunique()) == [20, 20, 20]
    assert got.groupby(["container_id", "container_copy", "container_key"], dropna=False).n_tokens.sum().max() <= 100
    rates = packing.fill_rates(packing.pack_items(items, spark.createDataFrame([(1, "a", 100)], CONTAINERS))).first()
    assert rates["most_cost"] >= rates["mean_cost"] > 0 and got.cost.sum() == pytest.approx(3 * packing.cost_of(np.arange(30, 50).astype(float)).sum())
