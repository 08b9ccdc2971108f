from __future__ import annotations

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import api
from tessella.functions import scalars as S
from tessella.operators import analysis, export, layout, normalize, profile, sampling, scoring, settle
from tessella.sources import csv_text, generators


def typed(spark, values):
    return profile.infer_types(spark.createDataFrame([(v,) for v in values], "v string")).first()["inferred_type"]


@pytest.mark.parametrize("text, reason", [("", "empty"), ("   \n\n  ", "empty"), ('{"a": 1, "b": [1,2,3]}', "json"), ("[1, 2, 3]", "json"), ("a,b,c\n", "no-data-rows")])
def test_texts_that_are_no_table(text, reason):
    assert csv_text.parse(text).reason == reason


def test_parsing():
    assert csv_text.parse("a,b\n1,\n,4\n").rows == [["1", None], [None, "4"]]
    t = csv_text.parse('name,note\n"Smith, John","line1\nline2"\n')
    assert t.rows == [["Smith, John", "line1\nline2"]]
    assert csv_text.parse('a\n"she said ""hi"""\n').rows == [['she said "hi"']]
    assert csv_text.parse("a\tb\r\n1\t2\r\n").rows == [["1", "2"]]
    t = csv_text.parse("a,,c\n 1 ,2\n   \n1,2,3,4\n")
    assert t.headers == ["a", "column_2", "c"] and t.rows == [["1", "2", None], [None] * 3, ["1", "2", "3"]]
    assert csv_text.parse('a,b\n1,"open\n2,3').rows == [["1", "open\n2,3"]]


def test_types(spark):
    assert typed(spark, ["1"] * 92 + ["x"] * 8) == "numeric" and typed(spark, ["1"] * 85 + ["x"] * 15) == "categorical"
    assert typed(spark, [f"u{i}" for i in range(50)]) == "id-like" and typed(spark, ["red", "blue", "green"] * 9) == "categorical"
    assert typed(spark, ["Yes", "no"]) == "boolean" and typed(spark, ["2024-01-01", "2024-01-02T03:04Z"]) == "date" and typed(spark, [None, " "]) == "categorical"


def test_variation(spark):
    v = lambda xs: profile.infer_types(spark.createDataFrame([(float(x),) for x in xs], "v double")).first()["variation"]
    assert math.isinf(v([-5, 5, -5, 5])) and v([5, 5, 5, 5]) == 0


def ranks(spark, xs, f=normalize.rank_norm):
    df = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(xs)], "i int, v double")
    return [r["o"] for r in f(df, "v", "o").orderBy("i").collect()]


def test_normalisation(spark):
    assert ranks(spark, [1, 2, 3, 4, 5]) == ranks(spark, [1, 2, 3, 4, 5000]) == [0, 0.25, 0.5, 0.75, 1]
    assert ranks(spark, [1, 5, 5, 9]) == [0, 0.5, 0.5, 1] and ranks(spark, [7] * 4) == [0.5] * 4 and ranks(spark, [1, None, 3, 5])[1] == 0.5
    assert ranks(spark, [1, None, 3], normalize.minmax_norm) == [0, 0.5, 1] and ranks(spark, [4, 4], normalize.minmax_norm) == [0.5, 0.5]
    enc = lambda xs: [r["charge"] for r in normalize.encode_categorical(spark.createDataFrame(list(enumerate(xs)), "i int, v string"), "v", "i").orderBy("i").collect()]
    assert enc(["b", "a", "c", "a", "b"]) == [-1, 0, 1, 0, -1] and enc(["a", None, "b"]) == [-1, 0, 1] and enc(["only"] * 3) == [0, 0, 0]


def test_seeded_numbers_match_known_rows(spark):
    r = generators.noise(spark, 2).orderBy(F.substring("id", 5, 9).cast("int")).limit(2).collect()
    assert list(r[0])[1:] == [4.685, -3.5, -4.2941, 0.7591, 7.5058] and list(r[1])[1:] == [2.6167, -0.016, -2.8551, 5.6318, -7.7194]
    assert list(generators.blobs(spark, 1).where("id = 'row_1'").first())[1:6] == [1.449, 1.6847, -0.0738, -0.2713, 1.9591]


def test_stratified_size_is_exact(spark):
    df = spark.range(500).withColumn("g", F.when(F.col("id") % 2 == 0, "x").otherwise("y"))
    got = sampling.stratified_sample(df, "id", "g", 100, 3).groupBy("g").count().collect()
    assert sorted(r["count"] for r in got) == [50, 50]
    tiny = df.withColumn("g", F.when(F.col("id") == 7, "rare").otherwise(F.lit(None).cast("string")))
    assert sampling.stratified_sample(tiny, "id", "g", 10, 3).count() == 10  # a null stratum counts as one
    assert sampling.stratified_sample(df, "id", "g", 9999, 3).count() == 500


def test_detector_converges_on_call_74():
    d = settle.Detector()
    calls = [d.push(0.0, 100.0) for _ in range(80)]
    assert calls.index(True) + 1 == 74


def test_integration_and_extent(spark):
    s = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0, 0.0, 10.0, 0.0)], "row_idx long, x double, y double, vx double, vy double, viscosity double, ax double, ay double")
    r = layout.integrate(s, base=0.0).first()
    assert abs(r["vx"] - 10 / 60) < 1e-12 and abs(r["x"] - 10 / 3600) < 1e-12
    assert layout.extent(spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "x double, y double")).first()["diagonal"] == 5


def test_forces_are_opposite_and_order_does_not_matter():
    rng = np.random.default_rng(1)
    x, a = rng.normal(size=(12, 2)) * 10, rng.random((12, 2))
    fx, fy = layout.pair_forces(x[:, 0], x[:, 1], np.zeros(12), a, x[:, 0], x[:, 1], np.zeros(12), a, 1.0, layout.Forces())
    assert abs(fx.sum()) < 1e-9 and abs(fy.sum()) < 1e-9


def test_silhouette_rules():
    p = np.array([[0.0, 0], [0, 1], [10, 0], [10, 1]])
    assert scoring.silhouette_of(p, np.array([0, 0, 1, 1])) > 0.85 and scoring.silhouette_of(p, np.zeros(4)) == 0
    assert scoring.silhouette_of(p, np.array([0, 0, 0, 1])) > 0  # the single row counts 1


def test_whole_pipeline_on_noise(spark):
    outcome, (positions, gain, results) = api.load_dataset(spark, generators.noise(spark, 2))
    g, p = gain.first(), positions.first()
    roles = {r["name"]: r["role"] for r in outcome.mapping.collect()}
    assert roles["dim_4"] == "mass" and roles["dim_1"] == "attraction" and roles["id"] == "label"
    assert p["converged"] and not p["unstable"] and abs(g["pca2d_silhouette"] - 0.4272) < 0.01 and g["verdict"] == "no-meaningful-gain"
    assert results.first()["cluster_count"] == g["k"]


def test_degenerate_tables(spark):
    assert api.parse_and_infer(spark, generators.ids_only(spark)).status == "zero-usable-columns"
    _, (positions, gain, results) = api.load_dataset(spark, generators.one_row(spark))
    assert positions.first()["converged"] and positions.first()["step"] == 0 and gain.first()["verdict"] == "insufficient-variance" and results.count() == 0
    assert api.parse_and_infer(spark, "{}").status == "parse-error" and api.parse_and_infer(spark, "").status == "empty"


def test_outliers(spark):
    rows = [(i, float(i % 2), 0.0) for i in range(20)] + [(20, 500.0, 500.0)]
    df = spark.createDataFrame(rows, "row_idx long, x double, y double")
    assert [r["row_idx"] for r in analysis.outliers(df, "row_idx", ["x", "y"]).collect()] == [20]
    assert analysis.outliers(df.limit(2), "row_idx", ["x", "y"]).count() == 0


def test_png_and_crc(spark):
    assert spark.range(1).select(S.crc32_hex(F.encode(F.lit("123456789"), "utf-8")).alias("c")).first()["c"] == "cbf43926"
    png = export.raster(np.array([5.0]), np.array([5.0]), ["#ff0000"], 12, 10)
    out = export.embed(png, '{"seed": 1}')
    at = out.index(b"iTXt")
    n = int.from_bytes(out[at - 4:at], "big")
    assert out[12:16] == b"IHDR" and b'{"seed": 1}' in out and zlib.crc32(out[at:at + 4 + n]) == int.from_bytes(out[at + 4 + n:at + 8 + n], "big")


def test_layout_queries_use_the_reference_row_budget(monkeypatch):
    from tessella.plans import reference

    seen = []
    monkeypatch.setattr(reference, "_state_of", lambda spark, d, name, columns, budget, layout_id=0: seen.append((name, budget)))
    reference._lineitem(None, "")
    assert seen == [("lineitem", 2000)]


def test_unstable_layouts_keep_the_last_sound_frame():
    x = np.array([[0.0, 0.0], [1.0, 0.0]])
    got = settle.run(x, np.array([[np.inf, 0.0], [0.0, 0.0]]), np.ones(2), np.zeros(2), np.zeros(2), np.zeros((2, 1)), layout.Forces(), 10)
    assert got["unstable"] and not got["converged"] and got["step"] == 1 and (got["x"] == x).all()


def test_kernel_forces_equal_the_pair_rule(monkeypatch):
    rng = np.random.default_rng(5)
    x, q, a = rng.normal(size=(400, 2)) * 15, rng.integers(0, 3, 400) - 1.0, rng.random((400, 2))
    x[3] = x[7]
    want = np.stack(layout.pair_forces(x[:, 0], x[:, 1], q, a, x[:, 0], x[:, 1], q, a, 0.6, layout.Forces()), 1)
    assert np.allclose(settle.AllPairs(q, a, layout.Forces())(x, 0.6), want, atol=1e-8)
    monkeypatch.setattr(settle, "KEPT", 10)
    assert np.allclose(settle.AllPairs(q, a, layout.Forces())(x, 0.6), want, atol=1e-8)
    near = np.abs(x - np.array([15.0, 15.0])).max(1) < 14.9  # all within one cell, as if alone
    assert np.allclose(settle.NearCells(q[near], a[near], layout.Forces())(x[near], 0.6), settle.AllPairs(q[near], a[near], layout.Forces())(x[near], 0.6), atol=1e-8)


def test_step_trace_ends_at_the_fixpoint(spark):
    rows = [(0, i, 1.0, 0.0, 0.0, [float(i % 2)], float(i), float(i % 3)) for i in range(12)]
    state = spark.createDataFrame(rows, "layout_id long, row_idx long, mass double, charge double, viscosity double, attraction array<double>, x double, y double")
    trace, end = settle.step_trace(state).orderBy("step").collect(), settle.settle(state).first()
    assert len(trace) == settle.HISTORY and trace[-1]["step"] == end["step"] and trace[-1]["converged"] and trace[-1]["quiet_run"] == settle.DEBOUNCE


def test_typed_dates_and_reasons(spark):
    t = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS a, date'2024-01-02' AS b, timestamp_ntz'2024-01-03 00:00:00.5' AS c")
    assert [r["inferred_type"] for r in profile.infer_types(t).orderBy("ordinal").collect()] == ["date"] * 3
    out = api.parse_and_infer(spark, generators.ids_only(spark))
    assert out.message.count("only as a row label") == 2 and out.seen_columns[0]["reason"].startswith("high-cardinality")


def test_row_numbers_do_not_depend_on_partitions(spark):
    t = spark.createDataFrame([("x", 1)] * 700 + [("y", None)] * 3 + [(None, 1)], "a string, b int")
    one, other = (sorted(map(tuple, api.with_row_number(d, chunk=64).collect()), key=repr) for d in (t.coalesce(1), t.repartition(7)))
    assert one == other and len({r[0] for r in one}) == 704


def test_rows_are_sampled_before_they_are_encoded(spark):
    t = spark.range(400).select(F.col("id").alias("row_idx"), F.col("id").cast("double").alias("v"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("g"))
    built = api.build(api.parse_and_infer(spark, t), budget=40)
    field = built.field.collect()
    assert built.sampled and len(field) == 40 and min(r["mass"] for r in field) == 0.5 and max(r["mass"] for r in field) == 2.0


def test_texts_of_the_report(spark):
    line = lambda n: spark.range(n).select(F.col("id").alias("i"))
    assert analysis.outlier_text(line(0), "i").first()[0].startswith("No outliers") and analysis.outlier_text(line(1), "i").first()[0] == "1 outlier row: row 1."
    assert analysis.outlier_text(line(25), "i").first()[0].endswith("row 20, ….")
    assert [r[0] for r in spark.createDataFrame([(2.0, 2.0), (1.5, 3.0)], "a double, b double").select(S.range_text(F.col("a"), F.col("b"))).collect()] == ["2", "1.50–3"]


def test_outliers_have_a_ring():
    png = export.raster(np.array([20.0]), np.array([20.0]), ["#ff0000"], 40, 40, alpha=np.array([1.0]), rings=["#00ff00"])
    at = png.index(b"IDAT")
    body = zlib.decompress(png[at + 4:at + 4 + int.from_bytes(png[at - 4:at], "big")])
    pixel = lambda x, y: body[y * 121 + 1 + 3 * x:y * 121 + 4 + 3 * x]
    assert pixel(20, 20) == b"\xff\0\0" and pixel(26, 20) == b"\0\xff\0" and pixel(0, 0) == bytes.fromhex(export.GROUND[1:])


def test_catalogue(spark):
    known = {r["id"] for r in generators.catalogue(spark).collect()}
    assert known == {"palmer-penguins", "blobs-3-known", "uncorrelated-random"} and generators.load(spark, "blobs-3-known").count() == 180
    with pytest.raises(ValueError):
        generators.load(spark, "palmer-penguins")
