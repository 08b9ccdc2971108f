"""Iteration of layouts to a debounced fixpoint: one vectorised task per layout.

Steps depend on each other, so parallelism is across layouts; inside one, pair forces run in numpy
tiles of bounded memory. What a pair's force owes to charge and attraction does not change, so it is
worked out once for layouts of up to ``KEPT`` rows, and each pair is visited once for both ends.
Above ``GRID_ROWS`` rows only rows of neighbouring grid cells act on each other, so a step is no
longer quadratic. A layout of more than ``SPREAD_ROWS`` rows is too much for one task: its steps are
those of ``layout.step``, spread over the cluster, with the same rules. Rows are put into content order first, so their order in the input does not change
the result."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import GRID_CELL, GRID_SHIFT, GRID_SIDE, HALF_LIFE, SPEED_LIMIT, TEMPERATURE_FLOOR, TIME_STEP
from tessella.operators.layout import CELL_BLOCK, Block, Forces, block_forces, half_around, pair_terms
from tessella.operators.layout import step as spread_step
from tessella.runtime import checkpoint

# Fixed values of convergence detection.
WINDOW, DEBOUNCE, STILLNESS, LEAST_DIAGONAL, HISTORY = 30, 45, 0.0015, 1.0, 120
#: More rows than this meet in grid cells only (fixed value); up to KEPT rows the pair terms stay in memory (2 x 8 bytes a pair).
GRID_ROWS, KEPT, TILE = 5000, 2500, 256
#: Above this a step's pairs take one core longer than a step's jobs take a cluster.
SPREAD_ROWS = 50_000
STATE = "layout_id long, row_idx long, x double, y double, vx double, vy double, step int, converged boolean, unstable boolean"


TRACE = "layout_id long, step int, speed double, diagonal double, quiet_run int, converged boolean"


@dataclass
class Detector:
    """Still once the mean speed of the last WINDOW steps has stayed low for DEBOUNCE checks in a row."""

    speeds: deque = field(default_factory=lambda: deque(maxlen=WINDOW))
    quiet: int = 0

    def push(self, speed: float, diagonal: float) -> bool:
        self.speeds.append(speed)
        calm = len(self.speeds) == WINDOW and sum(self.speeds) / WINDOW < STILLNESS * max(diagonal, LEAST_DIAGONAL)
        self.quiet = self.quiet + 1 if calm else 0
        return self.quiet >= DEBOUNCE


class AllPairs:
    """Forces of all pairs. The part of the attraction that is linear in distance needs no pairs at all."""

    def __init__(self, charge: np.ndarray, attraction: np.ndarray, forces: Forces):
        self.charge, self.attraction, self.f, self.n = charge, attraction, forces, len(charge)
        self.kept = pair_terms(charge, attraction, charge, attraction, forces) if self.n <= KEPT else None
        self.room = [np.empty((TILE, TILE)) for _ in range(3)]

    def _terms(self, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray]:
        if self.kept is not None:
            return self.kept[0][i, j], self.kept[1][i, j]
        return pair_terms(self.charge[i], self.attraction[i], self.charge[j], self.attraction[j], self.f)

    def __call__(self, x: np.ndarray, heat: float) -> np.ndarray:
        f = self.f
        ends = np.column_stack([x, np.ones(self.n)])  # positions and a one: a product with the weights gives both sums
        sums = np.zeros((self.n, 3))
        for a in range(0, self.n, TILE):
            i = slice(a, min(a + TILE, self.n))
            for b in range(a, self.n, TILE):
                j = slice(b, min(b + TILE, self.n))
                r2, t, w = (m[:i.stop - i.start, :j.stop - j.start] for m in self.room)
                np.subtract.outer(x[i, 0], x[j, 0], out=r2)
                np.multiply(r2, r2, out=r2)
                np.subtract.outer(x[i, 1], x[j, 1], out=t)
                np.multiply(t, t, out=t)
                r2 += t
                far, near_charge = self._terms(i, j)
                np.add(r2, 1.0, out=t)
                np.divide(near_charge, t, out=w)
                w += far
                w *= heat
                at = np.nonzero(r2 < f.collision_radius**2)
                np.sqrt(r2, out=t)
                np.maximum(t, 1e-6, out=t)
                gap = (f.collision_radius - t[at]) / f.collision_radius
                w[at] += f.collision * gap * gap
                w /= t
                w[at] = np.where(r2[at] == 0, 0.0, w[at])  # a row and itself, or coincident rows
                sums[i] += w @ ends[j]
                if b > a:
                    sums[j] += w.T @ ends[i]
        force = x * sums[:, 2:] - sums[:, :2]
        return force - f.attraction * heat * (self.n * x - x.sum(0)) if f.attraction else force


class NearCells:
    """Forces among rows of the 3 x 3 grid cells around each row's own."""

    def __init__(self, charge: np.ndarray, attraction: np.ndarray, forces: Forces, block: int = CELL_BLOCK):
        self.charge, self.attraction, self.f, self.block = charge, attraction, forces, block

    def __call__(self, x: np.ndarray, heat: float) -> np.ndarray:
        cell = np.clip(np.floor((x + GRID_SHIFT) / GRID_CELL), 0, GRID_SIDE - 1).astype(np.int64)
        number = cell[:, 1] * GRID_SIDE + cell[:, 0]
        order = np.argsort(number, kind="stable")
        edge = np.searchsorted(number[order], np.arange(GRID_SIDE * GRID_SIDE + 1))
        parts = {int(c): [order[s:min(s + self.block, edge[c + 1])] for s in range(edge[c], edge[c + 1], self.block)] for c in np.flatnonzero(np.diff(edge))}
        blocks = {c: [Block(x[o], self.charge[o], self.attraction[o]) for o in own] for c, own in parts.items()}
        force = np.zeros_like(x)
        for c, own in blocks.items():
            for p, a in enumerate(own):
                for o in half_around(c):
                    for q, b in enumerate(blocks.get(o, [])):
                        if o != c or q >= p:
                            fa, fb = block_forces(a, b, heat, self.f)
                            force[parts[c][p]] += fa
                            if b is not a:
                                force[parts[o][q]] += fb
        return force


def run(x: np.ndarray, v: np.ndarray, mass: np.ndarray, charge: np.ndarray, viscosity: np.ndarray, attraction: np.ndarray, forces: Forces, max_steps: int, edges: np.ndarray | None = None, start_step: int = 0, grid_rows: int = GRID_ROWS) -> dict:
    """Positions and velocities at the fixpoint, with the step count, flags, and per step mean speed, diagonal and quiet run."""
    detector, trace = Detector(), []
    n, step, converged, unstable = len(x), start_step, False, False
    if n <= 1:
        return {"x": x, "v": v, "step": step, "converged": True, "unstable": False, "trace": trace}
    damp = (1 - np.minimum(0.98, forces.viscosity + 0.5 * viscosity))[:, None]
    pairs = NearCells(charge, attraction, forces) if n > grid_rows else AllPairs(charge, attraction, forces)
    while not converged and not unstable and step < max_steps:
        heat = TEMPERATURE_FLOOR + (1 - TEMPERATURE_FLOOR) * 0.5 ** (step / HALF_LIFE)
        force = pairs(x, heat) - forces.centering * x
        if edges is not None and len(edges) and forces.spring:
            gap = x[edges[:, 1]] - x[edges[:, 0]]
            r = np.maximum(np.sqrt((gap**2).sum(1)), 1e-6)[:, None]
            pull = forces.spring * (r - forces.spring_length) * gap / r
            np.add.at(force, edges[:, 0], pull)
            np.add.at(force, edges[:, 1], -pull)
        nv = (v + force / mass[:, None] / TIME_STEP) * damp
        speed = np.sqrt((nv**2).sum(1))
        nv *= np.minimum(1.0, SPEED_LIMIT / np.maximum(speed, 1e-300))[:, None]
        nx = x + nv / TIME_STEP
        step += 1
        if not (np.isfinite(nx).all() and np.isfinite(nv).all()):
            unstable = True  # the last sound frame stays
            break
        x, v = nx, nv
        mean, diagonal = float(np.minimum(speed, SPEED_LIMIT).mean()), float(np.hypot(*np.ptp(x, axis=0)))
        converged = detector.push(mean, diagonal)
        trace.append((step, mean, diagonal, detector.quiet, converged))
    return {"x": x, "v": v, "step": step, "converged": converged, "unstable": unstable, "trace": trace}


def _kernel(pdf: pd.DataFrame, forces: Forces, max_steps: int, links: pd.DataFrame | None = None, grid_rows: int = GRID_ROWS) -> tuple[pd.DataFrame, dict]:
    """One layout's rows in content order, and its run."""
    pdf = pdf.assign(_a=[tuple(a) for a in pdf["attraction"]]).sort_values(["mass", "charge", "viscosity", "_a", "x", "y", "row_idx"], kind="stable")
    e = None
    if links is not None and len(links):
        number = {r: i for i, r in enumerate(pdf["row_idx"])}
        e = np.array([(number[a], number[b]) for a, b in zip(links["src"], links["dst"]) if a != b and a in number and b in number], int).reshape(-1, 2)
    return pdf, run(
        pdf[["x", "y"]].to_numpy(float), pdf[["vx", "vy"]].to_numpy(float), pdf["mass"].to_numpy(float), pdf["charge"].to_numpy(float), pdf["viscosity"].to_numpy(float),
        np.array(pdf["attraction"].tolist(), float).reshape(len(pdf), -1), forces, max_steps, e, grid_rows=grid_rows,
    )


def _at_rest(state: DataFrame) -> DataFrame:
    return state if "vx" in state.columns else state.withColumn("vx", F.lit(0.0)).withColumn("vy", F.lit(0.0))


def _divided(state: DataFrame, spread_rows: int) -> tuple[DataFrame, dict]:
    """The layouts that fit one task, and each larger one with its rows and their number."""
    state = _at_rest(state).persist()
    counts = {r["layout_id"]: r["count"] for r in state.groupBy("layout_id").count().where(F.col("count") > spread_rows).collect()}
    large = {i: (state.where(F.col("layout_id").eqNullSafe(F.lit(i))), n) for i, n in counts.items()}
    for i in counts:
        state = state.where(~F.col("layout_id").eqNullSafe(F.lit(i)))
    return state, large


def _spread(state: DataFrame, n: int, forces: Forces, max_steps: int, edges: DataFrame | None = None, grid_rows: int = GRID_ROWS) -> tuple[DataFrame, list]:
    """STATE and trace of one large layout; every step is a job, whose result is checkpointed to cut the lineage."""
    detector, trace, step, converged, unstable = Detector(), [], 0, False, False
    while not converged and not unstable and step < max_steps:
        moved = checkpoint(spread_step(state, step, forces, edges, grid=n > grid_rows))
        step += 1
        sound = sum((F.when(F.abs(F.col(c)) < float("inf"), 0).otherwise(1) for c in ("x", "y", "vx", "vy")), F.lit(0)) == 0
        got = moved.agg(F.bool_and(sound & ~F.isnan("x") & ~F.isnan("y")).alias("sound"), F.avg(F.hypot("vx", "vy")).alias("speed"), *[(F.max(c) - F.min(c)).alias(c) for c in "xy"]).first()
        if not got["sound"]:
            unstable = True  # the last sound frame stays
            break
        state, diagonal = moved, float(np.hypot(got["x"], got["y"]))
        converged = detector.push(got["speed"], diagonal)
        trace.append((step, got["speed"], diagonal, detector.quiet, converged))
    flags = [F.lit(step).cast("int").alias("step"), F.lit(converged).alias("converged"), F.lit(unstable).alias("unstable")]
    return state.select("layout_id", "row_idx", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "vx", "vy")], *flags), trace


def settle(state: DataFrame, forces: Forces = Forces(), max_steps: int = 8000, edges: DataFrame | None = None, grid_rows: int = GRID_ROWS, spread_rows: int = SPREAD_ROWS) -> DataFrame:
    """``state``: layout_id, row_idx, mass, charge, viscosity, attraction, x, y (and vx, vy). Returns STATE."""
    def one(pdf: pd.DataFrame, links: pd.DataFrame | None = None) -> pd.DataFrame:
        pdf, got = _kernel(pdf, forces, max_steps, links, grid_rows)
        return pd.DataFrame({
            "layout_id": pdf["layout_id"].to_numpy(), "row_idx": pdf["row_idx"].to_numpy(), "x": got["x"][:, 0], "y": got["x"][:, 1], "vx": got["v"][:, 0], "vy": got["v"][:, 1],
            "step": np.int32(got["step"]), "converged": got["converged"], "unstable": got["unstable"],
        })
    state, large = _divided(state, spread_rows)
    if edges is None:
        out = state.groupBy("layout_id").applyInPandas(lambda pdf: one(pdf), STATE)
    else:
        out = state.groupBy("layout_id").cogroup(edges.groupBy("layout_id")).applyInPandas(lambda a, b: one(a, b) if len(a) else pd.DataFrame(columns=[f.split()[0] for f in STATE.split(", ")]), STATE)
    for i, (own, n) in large.items():
        links = edges.where(F.col("layout_id").eqNullSafe(F.lit(i))) if edges is not None else None
        out = out.unionByName(_spread(own, n, forces, max_steps, links, grid_rows)[0])
    return out


def step_trace(state: DataFrame, forces: Forces = Forces(), max_steps: int = 8000, last: int | None = HISTORY, spread_rows: int = SPREAD_ROWS) -> DataFrame:
    """TRACE of each layout: mean speed, diagonal and quiet run of its ``last`` steps (None: of all). A layout of one row has no steps."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _kernel(pdf, forces, max_steps)[1]["trace"]
        out = pd.DataFrame(rows[-last:] if last else rows, columns=["step", "speed", "diagonal", "quiet_run", "converged"])
        out.insert(0, "layout_id", pdf["layout_id"].iloc[0])
        return out
    state, large = _divided(state, spread_rows)
    out = state.groupBy("layout_id").applyInPandas(one, TRACE)
    for i, (own, n) in large.items():
        rows = _spread(own, n, forces, max_steps)[1]
        out = out.unionByName(state.sparkSession.createDataFrame([(i, *r) for r in (rows[-last:] if last else rows)], TRACE))
    return out


def perturb(state: DataFrame, row_idx: int, dx: float, dy: float) -> DataFrame:
    """Moves one row; speeds stay. Settling again starts a fresh detector."""
    at = F.col("row_idx") == row_idx
    return state.withColumn("x", F.when(at, F.col("x") + dx).otherwise(F.col("x"))).withColumn("y", F.when(at, F.col("y") + dy).otherwise(F.col("y")))


def moving_average(trace: DataFrame, layout: str = "layout_id", step: str = "step", speed: str = "speed") -> DataFrame:
    """The detector's window as SQL: mean of the last WINDOW speeds (null until there are as many)."""
    from pyspark.sql import Window

    w = Window.partitionBy(layout).orderBy(step).rowsBetween(-(WINDOW - 1), 0)
    return trace.withColumn("moving_average", F.when(F.count(speed).over(w) == WINDOW, F.avg(speed).over(w)))


def run_lengths(averaged: DataFrame, layout: str = "layout_id", step: str = "step", diagonal: str = "diagonal") -> DataFrame:
    """Length of the run of quiet steps that each step ends, and whether it has converged by then."""
    from pyspark.sql import Window

    w = Window.partitionBy(layout).orderBy(step)
    calm = F.coalesce(F.col("moving_average") < STILLNESS * F.greatest(F.col(diagonal), F.lit(LEAST_DIAGONAL)), F.lit(False))
    t = averaged.withColumn("_n", F.row_number().over(w)).withColumn("_calm", calm)
    last = F.coalesce(F.max(F.when(~F.col("_calm"), F.col("_n"))).over(w), F.lit(0))
    t = t.withColumn("quiet_run", (F.col("_n") - last).cast("long"))
    return t.withColumn("converged", F.max("quiet_run").over(w) >= DEBOUNCE).drop("_n", "_calm")
