from __future__ import annotations

import numpy as np

from tessella.llm import calibrated as C


def test_pivotal_keeps_sums_and_probabilities():
    rng = np.random.default_rng(1)
    p = np.array([0.2, 0.5, 0.8, 0.1, 0.4, 1.0, 0.0, 0.9, 0.1])
    runs = np.array([C.pivotal(p, rng.random(len(p))) for _ in range(4000)])
    assert np.allclose(runs.sum(1), p.sum()) and np.abs(runs.mean(0) - p).max() < 0.03


def test_calibration_meets_the_wanted_rows():
    rows = np.array([100.0, 20, 5, 0])
    want = C.wanted_rows(rows, np.array([0.2, 0.5, 0.2, 0.1]), np.array([0.0, 0, 5, 3]), 40)
    p, steps = C.calibrate(rows, want, 40)
    assert np.allclose(rows * p, want) and abs(want.sum() - 40) < 1e-9 and want[2] == 5 and want[3] == 0 and steps < 60
    assert C.wanted_rows(rows, np.zeros(4), np.zeros(4), 0).sum() == 0


def test_sample_and_report(spark):
    data = [(i, 1, ["red", " RED ", "blue", "green"][i % 4], "x") for i in range(400)] + [(900, 2, "red", "x"), (901, 1, None, "x"), (902, 1, " ", "x")]
    df = spark.createDataFrame(data, "obs_id long, dataset_id long, species string, category string")
    infos = spark.createDataFrame([(1, 1, 50, 3), (2, 1, 50, 4), (3, 9, 10, 1), (4, 1, None, 1)], "sample_id long, dataset_id long, shown long, seed int")
    rows = [(1, "Red", 0.5, 1), (1, "blue", 0.25, None), (1, "green", 0.25, None), (1, "Red", 0.5, 1), (2, "blue", 0.9, None), (2, "violet", 0.1, 2), (3, "red", 0.5, None), (4, "red", 0.5, None)]
    targets = spark.createDataFrame(rows, "sample_id long, species string, target_share double, min_rows int")
    drawn, report = C.calibrated_sample(df, infos, targets, block=60)
    got = {}
    for r in drawn.collect():
        got.setdefault((r["sample_id"], r["category"]), []).append(r["obs_id"])
    assert {k: len(v) for k, v in got.items()} == {(1, "red"): 25, (1, "blue"): 13, (1, "green"): 12} | {(2, "blue"): 50} or {len(got[1, "blue"]), len(got[1, "green"])} == {12, 13}
    assert all(len(set(v)) == len(v) for v in got.values()) and 901 not in sum(got.values(), [])
    assert {(r["sample_id"], r["species"]) for r in report.where("unmet").collect()} == {(2, "violet"), (3, "red")}
    again, _ = C.calibrated_sample(df.orderBy(df.obs_id.desc()), infos, targets, block=60)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in drawn.collect()}


def test_empty(spark):
    none = spark.createDataFrame([], "obs_id long, dataset_id long, species string")
    infos = spark.createDataFrame([(1, 1, 5, 3)], "sample_id long, dataset_id long, shown long, seed int")
    drawn, report = C.calibrated_sample(none, infos, spark.createDataFrame([(1, "a", 1.0, None)], "sample_id long, species string, target_share double, min_rows int"))
    assert drawn.count() == 0 and report.where("unmet").count() == 1
