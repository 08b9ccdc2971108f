from __future__ import annotations

import numpy as np
import pytest

from tessella.functions.scalars import GRID_CELL, GRID_SHIFT, GRID_SIDE
from tessella.operators import layout, settle


def rows(n=240, dims=2, seed=5):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.uniform(-170, 170, (n // 2, 2)), rng.uniform(-9, 9, (n - n // 2 - 2, 2)), [[3.0, 3.0], [3.0, 3.0]]])
    return x, 1 + rng.uniform(0, 1, n), rng.choice([-1.0, 0.0, 0.5], n), rng.choice(4, (n, dims)) / 3 + (np.arange(n) % 5 == 0)[:, None] * rng.uniform(0, 0.1, (n, dims))


def table(spark, x, mass, charge, attraction):
    return spark.createDataFrame([(0, i, *map(float, x[i]), float(mass[i]), float(charge[i]), i % 4 / 4, [float(v) for v in attraction[i]]) for i in range(len(x))], "layout_id long, row_idx long, x double, y double, mass double, charge double, viscosity double, attraction array<double>")


def brute(x, charge, attraction, heat):
    f, cell = layout.Forces(), np.clip(np.floor((x + GRID_SHIFT) / GRID_CELL), 0, GRID_SIDE - 1)
    out = np.zeros_like(x)
    for i in range(len(x)):
        o = (np.abs(cell - cell[i]).max(1) <= 1) & (np.arange(len(x)) != i)
        out[i] = [v[0] for v in layout.pair_forces(x[i:i + 1, 0], x[i:i + 1, 1], charge[i:i + 1], attraction[i:i + 1], x[o, 0], x[o, 1], charge[o], attraction[o], heat, f)]
    return out


@pytest.mark.parametrize("block", [37, 1000])
@pytest.mark.parametrize("dims", [0, 1, 2])
def test_blocks_of_cells_equal_single_pairs(spark, block, dims):
    """each two blocks are one unit, each pair is visited once; a crowded cell is split."""
    x, mass, charge, attraction = rows(dims=dims)
    want = (brute(x, charge, attraction, 0.7) - 0.02 * x) / mass[:, None]
    got = {r["row_idx"]: (r["ax"], r["ay"]) for r in layout.grid_acceleration(table(spark, x, mass, charge, attraction), 0.7, block=block).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-9, atol=1e-7)
    assert np.allclose(settle.NearCells(charge, attraction, layout.Forces(), block)(x, 0.7), brute(x, charge, attraction, 0.7), rtol=1e-9, atol=1e-7)


def test_crowded_cell_is_no_row_join(spark):
    """pairs are not rows of a join."""
    plan = layout.grid_acceleration(table(spark, *rows()), 1.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_large_layouts_are_spread(spark):
    """above the row limit steps are jobs, not one task; the result is the kernel's."""
    x, mass, charge, attraction = rows(120, 1)
    state = table(spark, x, mass, charge, attraction)
    one, many = ({r["row_idx"]: (*r[2:6], *r[6:]) for r in settle.settle(state, max_steps=4, grid_rows=g, spread_rows=s).collect()} for g, s in ((50, 1000), (50, 100)))
    assert one.keys() == many.keys() and all(np.allclose(one[i][:4], many[i][:4], rtol=1e-9, atol=1e-7) and one[i][4:] == many[i][4:] for i in one)
    traces = [settle.step_trace(state, max_steps=3, spread_rows=s).orderBy("step").collect() for s in (1000, 100)]
    assert len(traces[0]) == 3 and np.allclose(*[[r[1:4] for r in t] for t in traces])
