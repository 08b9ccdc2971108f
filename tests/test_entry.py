from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")
QUICK = ["rank_norm_by_group", "minmax_norm_acctbal", "prng_uniform", "grid_offsets", "spring_accel_nation_region", "one_full_step", "viewport_fit", "convergence_run_length", "kmeans_update", "nn_outliers", "cluster_defining_columns", "stratified_sample_orders", "csv_roundtrip", "scalar_rules_supplier", "type_inference_part"]


@pytest.fixture(scope="module")
def duck():
    if not SMALL.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for p in SMALL.iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, str(SMALL)), duck.execute(entry.oracle_sql()[name])
    cols, names = sorted(got.columns), [c[0] for c in want.description]
    assert cols == sorted(names)
    order = [names.index(c) for c in cols]
    rows = lambda t: sorted((tuple(r) for r in t), key=repr)
    a, b = rows(got.select(cols).collect()), rows([r[i] for i in order] for r in want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and abs(p - q) < 2e-4 * max(1, abs(p))) for p, q in zip(x, y)), (x, y)
