from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import fill_missing as M

SCHEMA = "id long, who string, a double, b double, kind string, field_name string"


def data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        k = i % 3
        a = 40 + 10 * k + rng.normal()
        rows.append((i, f"w{i // 2 * 3 + k}", float(a), float(3 * a + rng.normal()), ["red", "green", "blue"][k], "x"))
    return rows


def fills(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r["row_key"], r["field_name"]): r for r in M.fill(df, "id", "who", ["a", "b"], ["a", "b"], ["kind"], ["kind"], components=4).collect()}


def test_held_out_values_come_back_and_are_marked(spark):
    rows, truth = data(), {}
    stand_ins = [None, float("nan"), 0.0, -999.0, 99999.0]
    for j, i in enumerate(range(0, 600, 12)):
        r = list(rows[i])
        truth[i] = r[3]
        r[3] = stand_ins[j % 5]
        rows[i] = tuple(r)
    names = {}
    for j, i in enumerate(range(5, 600, 12)):
        r = list(rows[i])
        names[i] = r[4]
        r[4] = [None, " ", "n/a", "Unknown ", "--", "?", "not recorded", "sp. indet."][j % 8]
        rows[i] = tuple(r)
    got = fills(spark, rows)
    assert set(got) == {(i, "b") for i in truth} | {(i, "kind") for i in names}
    assert all(r["filled"] for r in got.values())
    assert np.mean([abs(got[i, "b"]["filled_number"] - t) for i, t in truth.items()]) < 3
    assert np.mean([got[i, "kind"]["filled_text"] == t for i, t in names.items()]) > 0.95


def test_misspelt_and_unusual_values_are_not_missing(spark):
    rows = data(120)
    rows += [(900, None, 12.0, 36.0, " RED", "x"), (901, None, 41.0, 120.0, "gren", "x"), (902, None, 75.0, 225.0, "grenn (ad.)", "x"), (903, None, 50.0, 150.0, "violet", "x")]
    assert not {k for k, _ in fills(spark, rows)} & {900, 901, 902, 903}


def test_known_category_of_the_individual_wins(spark):
    rows = [*data(300), (900, "same", 40.0, 120.0, "blue", "x"), (901, "same", 40.5, 121.0, None, "x")]
    got = fills(spark, rows)[901, "kind"]
    assert got["filled_text"] == "blue" and got["method"] == "individual"


def test_fills_are_spelt_as_usual(spark):
    rows = [(i, w, a, b, k.title() if i % 9 else k.upper(), x) for i, w, a, b, k, x in data(300)]
    rows.append((900, "w3", 40.0, 120.0, " ", "x"))
    assert fills(spark, rows)[900, "kind"]["filled_text"] == "Red"


def test_empty_and_all_missing(spark):
    assert fills(spark, []) == {}
    got = fills(spark, [(1, None, None, None, None, None), (2, None, None, None, None, None)])
    assert len(got) == 6 and got[1, "kind"]["filled_text"] is None


def test_likelihood_does_not_fall(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    p = M.prepare(df, ["a", "b"], ["kind"], {"a": None, "b": None}, ["id", "who"])
    h = M.fit(p, ["a", "b"], {"kind": ["red", "green", "blue"]}, components=3, rounds=8, tolerance=0.0).history
    assert all(b >= a - 0.5 for a, b in zip(h, h[1:]))


def test_mappings(spark):
    data_rows = spark.createDataFrame([(1, None, "s"), (1, "", "t"), (1, "x", None), (2, "y", "z")], "dataset_id long, species string, island string")
    maps = spark.createDataFrame([(1, 1, "species", None, "median-rank"), (2, 1, "island", -1, "?"), (3, 2, "species", 0, " Median-Rank "), (4, 2, "island", 3, None)], "mapping_id long, dataset_id long, column_name string, missing_count long, missing_strategy string")
    got = {(r["row_key"], r["field_name"]): r for r in M.fill_mappings(maps, data_rows, ["species", "island"]).collect()}
    assert set(got) == {(1, "missing_count"), (2, "missing_count"), (2, "missing_strategy"), (4, "missing_strategy")}
    assert got[1, "missing_count"]["filled_number"] == 2 and got[2, "missing_count"]["filled_number"] == 1
    assert got[4, "missing_strategy"]["filled_text"] == "median-rank"


def test_rare_categories_are_categories_and_misspellings_are_not(spark):
    rows = data(600) + [(900 + i, f"r{i}", 80.0, 10.0, "rare", "x") for i in range(2)] + [(950, "q", 40.0, 120.0, "greeen", "x"), (960, "r0", 80.0, 10.0, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert set(M.frequent_values(df, "kind")) == {"red", "green", "blue", "rare"}
    assert fills(spark, rows)[960, "kind"]["filled_text"] == "rare"


def test_many_categories(spark):
    df = spark.createDataFrame([(f"kind {i * 7919 % 100003:06d} {i}",) for i in range(300)], "kind string")
    assert len(M.frequent_values(df, "kind")) == 300


def test_strategies_without_a_data_set_come_from_the_mixture(spark):
    rows = [(i, i, "species" if i % 2 else "island", i % 5, "median-rank" if i % 2 else "drop") for i in range(40)] + [(99, 99, "species", None, " ")]
    maps = spark.createDataFrame(rows, "mapping_id long, dataset_id long, column_name string, missing_count long, missing_strategy string")
    got = {r["field_name"]: r for r in M.fill_mappings(maps, spark.createDataFrame([], "dataset_id long, species string, island string"), ["species", "island"], components=4).collect()}
    assert got["missing_strategy"]["filled_text"] == "median-rank" and got["missing_strategy"]["method"] == "em-mode"
    assert 0 <= got["missing_count"]["filled_number"] <= 4 and got["missing_count"]["method"] == "em-mean"
