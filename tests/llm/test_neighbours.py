from __future__ import annotations

import numpy as np
import pytest

from tessella.llm import neighbours

SCHEMA = "point_id long, x double, y double, z double, neighbours string"


def brute(rows, k):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1:4] for r in rows], float)
    out = {}
    for i, a in enumerate(v):
        d = np.sqrt(((v - a) ** 2).sum(1))
        out[int(ids[i])] = [int(ids[j]) for j in sorted(range(len(rows)), key=lambda j: (d[j], ids[j])) if j != i][:k]
    return out


@pytest.mark.parametrize("options", [{}, {"per_list": 20, "probes": 2, "block": 16}])
def test_equals_brute_force(spark, options):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(250, 3)), rng.normal(size=(150, 3)) * 0.1 + 8, rng.uniform(-60, 60, size=(12, 3))])
    rows = [(int(i * 7 + 1), *map(float, p), "x") for i, p in enumerate(v)]
    rows += [(10_000 + i, *rows[5][1:4], "copy") for i in range(9)] + [(20_000, *rows[6][1:4], "copy")]
    gaps = [(30_000, None, 1.0, 1.0, None), (30_001, float("nan"), 1.0, 1.0, None), (30_002, float("inf"), 0.0, 0.0, None)]
    got = {r["point_id"]: r["neighbours"] for r in neighbours.nearest_rows(spark.createDataFrame([*rows, *gaps], SCHEMA), "point_id", ["x", "y", "z"], **options).collect()}
    assert got == brute(rows, 5)


def test_ties_and_small_tables(spark):
    rows = [(1, 0.0, 0.0, 0.0, None), (2, 1.0, 0.0, 0.0, None), (3, -1.0, 0.0, 0.0, None), (4, 0.0, 1.0, 0.0, None)]
    found = neighbours.nearest_rows(spark.createDataFrame(rows, SCHEMA), "point_id", ["x", "y", "z"], k=2)
    assert {r["point_id"]: r["neighbours"] for r in found.collect()} == brute(rows, 2)
    assert {tuple(r) for r in neighbours.neighbour_pairs(found, "point_id").collect()} == {(min(a, b), max(a, b)) for a, n in brute(rows, 2).items() for b in n}
    assert neighbours.nearest_rows(spark.createDataFrame([], SCHEMA), "point_id", ["x", "y", "z"]).count() == 0
    assert neighbours.nearest_rows(spark.createDataFrame(rows[:1], SCHEMA), "point_id", ["x", "y", "z"]).first()["neighbours"] == []


def test_few_members_are_reranked(monkeypatch):
    """beyond the codes only members within bound and code error are compared exactly, stray members or not."""
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(4000, 4)), rng.normal(size=(40, 4)) * 1e4])
    index, ids = neighbours.Index.train(v[:3000], 12), np.arange(len(v))
    at, d = neighbours.nearest(v, index.centres)
    index.count, index.radius = np.bincount(at, minlength=12), np.zeros(12)
    np.maximum.at(index.radius, at, d)
    order = np.argsort(at, kind="stable")
    codes, compared, sort = index.encode(v, at), [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, **kw: (compared.append(np.size(keys[0])), sort(keys, **kw))[1])
    for home in range(12):
        q = np.flatnonzero(at == home)
        best, dist = index.search(v[q], q, v[order], ids[order], codes[order], at[order], 5, home)
        for i, b, far in zip(q[::40], best[::40], dist[::40]):
            want = np.sqrt(((v - v[i]) ** 2).sum(1))
            want[i] = np.inf
            assert [int(order[x]) for x in b] == np.argsort(want, kind="stable")[:5].tolist() and np.allclose(far, np.sort(want)[:5])
    assert sum(compared) < 100 * len(v)
