"""The force layout as DataFrame operators: field resolution, placement, one step's forces, integration.

State is (row_idx, x, y, vx, vy); a field is (row_idx, mass, charge, viscosity, attraction). One step
costs all pairs, or neighbouring grid cells only; the iteration to a fixpoint is in ``settle``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S
from tessella.operators.normalize import MISSING, encode_categorical, minmax_norm, rank_norm
from tessella.operators.pairs import block_pairs
from tessella.runtime import parallelism, small


@dataclass(frozen=True)
class Forces:
    """Coefficients; fixed values that results depend on."""

    centering: float = 0.02
    attraction: float = 1.4
    charge: float = 0.9
    viscosity: float = 0.06
    spring: float = 0.0
    collision: float = 2.2
    rest_length: float = 26.0
    spring_length: float = 4.0
    same_charge: float = 0.15
    least_charge: float = 0.35
    collision_radius: float = 1.4
    start_radius: float = 40.0


@dataclass
class FieldSpec:
    """Which columns carry which force, each with its normalisation ("rank" or "raw")."""

    mass: list[tuple[str, str]]
    attraction: list[tuple[str, str]]
    charge: str | None = None
    charge_is_category: bool = True
    viscosity: list[tuple[str, str]] | None = None
    charge_how: str = "rank"


def _normalised(df: DataFrame, column: str, how: str, out: str, order: str, categorical: set[str], coded: bool) -> DataFrame:
    """A number in [0, 1]. Categories are placed by their code where ``coded``, else they say nothing (0.5)."""
    if column in categorical:
        if not coded:
            return df.withColumn(out, F.lit(MISSING))
        return encode_categorical(df, column, order, prefix=f"{out}_").withColumn(out, F.col(f"{out}_encoded")).drop(f"{out}_code", f"{out}_encoded", f"{out}_charge")
    return rank_norm(df, column, out) if how == "rank" else minmax_norm(df, column, out)


def force_field(df: DataFrame, row: str, spec: FieldSpec, categorical: set[str] = frozenset()) -> DataFrame:
    """Mass is the remapped average of its columns, each attraction column a dimension of its own, charge one column, viscosity an average.

    A category has no amount, so it leaves mass and attraction neutral; charge and viscosity take its code."""
    t, names = df, {"mass": [], "attraction": [], "viscosity": []}
    for kind in names:
        for i, (c, how) in enumerate(getattr(spec, kind) or []):
            out = f"_{kind}{i}"
            t = _normalised(t, c, how, out, row, categorical, kind == "viscosity")
            names[kind].append(out)
    if spec.charge and spec.charge_is_category:
        t = encode_categorical(t, spec.charge, row, prefix="_c_")
        charge: Column = F.col("_c_charge")
    elif spec.charge:
        t = _normalised(t, spec.charge, spec.charge_how, "_c", row, set(), False)
        charge = S.charge_of(F.col("_c"))
    else:
        charge = F.lit(0.0)
    mean = lambda cs: sum((F.col(c) for c in cs), F.lit(0.0)) / len(cs) if cs else F.lit(None).cast("double")
    return t.select(
        F.col(row).alias("row_idx"), S.mass_of(mean(names["mass"])).alias("mass"), charge.alias("charge"),
        F.coalesce(mean(names["viscosity"]), F.lit(0.0)).alias("viscosity"), F.array(*[F.col(c) for c in names["attraction"]]).cast("array<double>").alias("attraction"),
    )


def place(df: DataFrame, seed: Column, row: str = "row_idx", own_stream: Column | None = None, radius: float = Forces.start_radius) -> DataFrame:
    """Uniform start in a disk; each row draws from its own stream, or all share one by row number."""
    if own_stream is not None:
        stream, first = seed.cast("long").bitwiseXOR(own_stream), F.lit(1)
    else:
        stream, first = seed.cast("long"), F.col(row) * 2 + 1
    r, angle = F.lit(radius) * F.sqrt(S.uniform(stream, first)), 2 * F.pi() * S.uniform(stream, first + 1)
    return df.withColumn("x", r * F.cos(angle)).withColumn("y", r * F.sin(angle))


def pair_terms(charge: np.ndarray, attraction: np.ndarray, ocharge: np.ndarray, oattraction: np.ndarray, f: Forces) -> tuple[np.ndarray, np.ndarray]:
    """What two blocks' pair forces owe to attraction (times the rest length) and to charge; neither depends on positions."""
    far, near = np.zeros((len(charge), len(ocharge))), np.zeros((len(charge), len(ocharge)))
    dims = attraction.shape[1]
    if f.attraction and dims:
        for d in range(dims):
            far += (attraction[:, None, d] - oattraction[None, :, d]) ** 2
        far /= dims
        np.sqrt(far, out=far)
        far *= f.attraction * f.rest_length
    if f.charge:
        gap = np.abs(charge[:, None] - ocharge[None])
        near = np.where(gap == 0, -f.same_charge, np.maximum(gap, f.least_charge)) * f.charge
    return far, near


def pair_forces(x: np.ndarray, y: np.ndarray, charge: np.ndarray, attraction: np.ndarray, ox: np.ndarray, oy: np.ndarray, ocharge: np.ndarray, oattraction: np.ndarray, heat: float, f: Forces) -> tuple[np.ndarray, np.ndarray]:
    """Force on each point from all others of a block, before division by mass; coincident points exert none."""
    dx, dy = x[:, None] - ox[None], y[:, None] - oy[None]
    r2 = dx * dx + dy * dy
    r = np.maximum(np.sqrt(r2), 1e-6)
    far, push = pair_terms(charge, attraction, ocharge, oattraction, f)
    push = push / (r2 + 1) + far - f.attraction * r
    push *= heat
    near = np.clip((f.collision_radius - r) / f.collision_radius, 0, None)
    push += f.collision * near * near
    push /= r
    return (dx * push).sum(1), (dy * push).sum(1)


def _arrays(p: pd.DataFrame) -> tuple[np.ndarray, ...]:
    a = np.array(p["attraction"].tolist(), float).reshape(len(p), -1) if len(p) else np.zeros((0, 0))
    return p["x"].to_numpy(float), p["y"].to_numpy(float), p["charge"].to_numpy(float), a


def pair_acceleration(state: DataFrame, heat: float, forces: Forces = Forces(), block: int = 2000) -> DataFrame:
    """(row_idx, ax, ay) from all pairs and centering."""
    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        fx, fy = pair_forces(*_arrays(a), *_arrays(b), heat, forces)
        return pd.DataFrame({"row_idx": a["row_idx"].to_numpy(), "fx": fx, "fy": fy})
    cols = state.select("row_idx", "x", "y", "charge", "attraction")
    total = block_pairs(cols, "row_idx", kernel, "row_idx long, fx double, fy double", block).groupBy("row_idx").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    pulled = state.join(total, "row_idx")
    return pulled.select("row_idx", *[((F.col(f"f{c}") - forces.centering * F.col(c)) / F.col("mass")).alias(f"a{c}") for c in "xy"])


#: Rows of a tile and of a block of one grid cell; what a tile needs stays in the CPU's cache.
TILE, CELL_BLOCK = 256, 16_384
_REACH = 200.0


class Block:
    """Rows that meet another block: sorted by charge and attraction and cut so that tiles are alike in both where values repeat."""

    def __init__(self, x: np.ndarray, charge: np.ndarray, attraction: np.ndarray):
        self.order = np.lexsort((*attraction.T[::-1], charge))
        self.x, self.charge, self.attraction = x[self.order], charge[self.order], attraction[self.order]
        profile = np.column_stack([self.charge, self.attraction])
        starts = np.flatnonzero(np.concatenate([[True], (profile[1:] != profile[:-1]).any(1)])) if len(x) else np.zeros(0, int)
        if len(starts) * TILE > 2 * len(x):  # short runs: only charges are told apart, if there are few
            starts = np.flatnonzero(np.concatenate([[True], self.charge[1:] != self.charge[:-1]]))
            if len(starts) * TILE > 2 * len(x) + 16 * TILE:
                starts = np.zeros(1, int)
        self.tiles = [slice(s, min(s + TILE, z)) for a, z in zip(starts, np.append(starts[1:], len(x))) for s in range(a, z, TILE)]


def tile_terms(a: Block, b: Block, i: slice, j: slice, heat: float, f: Forces) -> tuple[np.ndarray | float, np.ndarray | float]:
    """As ``pair_terms`` times the heat, but a single number where it is the same for the whole tile."""
    ca, cb = a.charge[i], b.charge[j]
    if f.charge and ca[0] == ca[-1] and cb[0] == cb[-1]:
        gap = abs(ca[0] - cb[0])
        near = (-f.same_charge if gap == 0 else max(gap, f.least_charge)) * f.charge * heat
    else:
        near = pair_terms(ca, np.zeros((len(ca), 0)), cb, np.zeros((len(cb), 0)), f)[1] * heat if f.charge else 0.0
    xa, xb, dims = a.attraction[i], b.attraction[j], a.attraction.shape[1]
    if not f.attraction or not dims:
        return 0.0, near
    scale = f.attraction * f.rest_length * heat
    if (xa == xa[0]).all() and (xb == xb[0]).all():
        return float(np.sqrt(((xa[0] - xb[0]) ** 2).sum() / dims)) * scale, near
    if dims == 1:
        far = np.subtract.outer(xa[:, 0] * scale, xb[:, 0] * scale)
        return np.abs(far, out=far), near
    return pair_terms(ca, xa, cb, xb, Forces(attraction=f.attraction, rest_length=f.rest_length * heat, charge=0.0))[0], near


def block_forces(a: Block, b: Block, heat: float, f: Forces) -> tuple[np.ndarray, np.ndarray]:
    """Forces on the rows of both blocks (in their given order), before division by mass; ``a`` itself as ``b`` gives them once, in the first.

    Each pair is visited once for both ends. The part of the attraction that is linear in distance needs no pairs."""
    same = a is b
    sums = np.zeros((len(a.x), 3)), np.zeros((len(b.x), 3))
    near2, room = f.collision_radius**2, [np.empty(TILE * TILE) for _ in range(3)]
    middle = a.x.mean(0) if len(a.x) else np.zeros(2)
    p, q = a.x - middle, b.x - middle
    short = len(p) and len(q) and max(np.abs(p).max(), np.abs(q).max()) < _REACH  # else the product would lose digits
    left = np.column_stack([p, (p * p).sum(1), np.ones(len(p))])
    right = np.ascontiguousarray(np.column_stack([-2 * q, np.ones(len(q)), (q * q).sum(1)]).T)
    ends = np.column_stack([p, np.ones(len(p))]), np.column_stack([q, np.ones(len(q))])
    for n, i in enumerate(a.tiles):
        for j in b.tiles[n:] if same else b.tiles:
            shape = i.stop - i.start, j.stop - j.start
            r2, t, w = (m[:shape[0] * shape[1]].reshape(shape) for m in room)
            if short:
                np.matmul(left[i], right[:, j], out=r2)
            else:
                np.subtract(p[i, 0][:, None], q[j, 0], out=r2)
                np.multiply(r2, r2, out=r2)
                np.subtract(p[i, 1][:, None], q[j, 1], out=t)
                np.multiply(t, t, out=t)
                r2 += t
            far, near = tile_terms(a, b, i, j, heat, f)
            at = np.flatnonzero(r2 < near2 + 1e-6)
            if len(at):
                row, col = np.divmod(at, shape[1])
                close = ((p[i][row] - q[j][col]) ** 2).sum(1)
                r2.ravel()[at] = 1.0
            np.sqrt(r2, out=t)
            r2 += 1.0
            np.multiply(r2, far, out=w)
            w += near
            r2 *= t
            w /= r2
            if len(at):
                r = np.maximum(np.sqrt(close), 1e-6)
                gap = np.maximum((f.collision_radius - r) / f.collision_radius, 0.0)
                pick = lambda v: v if np.isscalar(v) else v[row, col]
                push = pick(near) / (close + 1) + pick(far) + f.collision * gap * gap
                w.ravel()[at] = np.where(close == 0, 0.0, push / r)  # a row and itself, or coincident rows
            sums[0][i] += w @ ends[1][j]
            if not same or j.start > i.start:
                sums[1][j] += w.T @ ends[0][i]
    out = []
    if same:
        sums = (sums[0] + sums[1],)
    for own, other, total, back in ((p, q, sums[0], a.order), (q, p, sums[-1], b.order))[:len(sums)]:
        force = np.empty_like(own)
        force[back] = own * total[:, 2:] - total[:, :2] - f.attraction * heat * (len(other) * own - other.sum(0))
        out.append(force)
    return out[0], out[-1]


def half_around(cell: int) -> list[int]:
    """The cell and those of its 8 neighbours that come after it, so that each pair of neighbouring cells is named once."""
    y, x = divmod(cell, S.GRID_SIDE)
    return [cell] + [v * S.GRID_SIDE + u for v, u in ((y, x + 1), (y + 1, x - 1), (y + 1, x), (y + 1, x + 1)) if u in range(S.GRID_SIDE) and v in range(S.GRID_SIDE)]


def grid_acceleration(state: DataFrame, heat: float, forces: Forces = Forces(), dims: int | None = None, block: int = CELL_BLOCK) -> DataFrame:
    """(row_idx, ax, ay) from rows in the 3 x 3 cells around; farther pairs do not act.

    A cell's rows are dealt into blocks of about ``block`` rows; each two blocks of the same or neighbouring cells meet in one
    task unit, where each pair is visited once for both ends. Work in a crowded cell is quadratic by nature, memory is not."""
    at = state.select("row_idx", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "charge")], "attraction", S.grid_cell(F.col("x"), F.col("y")).alias("_cell")).where("_cell is not null")
    parts = {r["_cell"]: -(-r["count"] // block) for r in at.groupBy("_cell").count().collect()}  # at most 100 cells
    units = [(c, p, o, q) for c in sorted(parts) for p in range(parts[c]) for o in half_around(c) for q in range(p if o == c else 0, parts.get(o, 0))]
    if not units:
        return state.select("row_idx", *[(-forces.centering * F.col(c) / F.col("mass")).alias(f"a{c}") for c in "xy"])
    spark, schema = state.sparkSession, "_cell int, _part int, _unit int"
    meet = pd.DataFrame(units, columns=["_cell", "_part", "_cell2", "_part2"]).astype("int32")
    meet["_unit"] = np.arange(len(meet), dtype=np.int32)
    apart = meet[(meet["_cell"] != meet["_cell2"]) | (meet["_part"] != meet["_part2"])]  # a block and itself come as one side
    other = apart[["_cell2", "_part2", "_unit"]].set_axis(["_cell", "_part", "_unit"], axis=1)
    of = F.create_map(*[F.lit(int(v)) for kv in parts.items() for v in kv])
    at = at.withColumn("_part", F.pmod(F.xxhash64("row_idx"), of[F.col("_cell")]).cast("int"))
    width = min(len(units), 4 * parallelism(spark))
    sides = [t.join(small(spark.createDataFrame(m, schema)), ["_cell", "_part"]).repartition(width, "_unit").groupBy("_unit") for t, m in ((at, meet[["_cell", "_part", "_unit"]]), (at.select([F.col(c).alias(c) for c in at.columns]), other))]

    def rows(t: pa.Table) -> Block:
        flat = t.column("attraction").combine_chunks()
        flat = flat.flatten().to_numpy(zero_copy_only=False).astype(float) if t.num_rows else np.zeros(0)
        wide = dims if dims is not None else len(flat) // max(t.num_rows, 1)
        return Block(np.column_stack([t.column(c).to_numpy() for c in "xy"]), t.column("charge").to_numpy(), flat.reshape(t.num_rows, wide))

    def unit(a: pa.Table, b: pa.Table) -> pa.Table:
        one = rows(a)
        two = rows(b) if b.num_rows else one
        force = block_forces(one, two, heat, forces)
        ids, (x, y) = [a.column("row_idx")] + [b.column("row_idx")] * (two is not one), np.concatenate(force[:1 if two is one else 2]).T
        return pa.table({"row_idx": pa.chunked_array([c for i in ids for c in i.chunks], ids[0].type), "fx": x, "fy": y})
    total = sides[0].cogroup(sides[1]).applyInArrow(unit, f"row_idx {dict(state.dtypes)['row_idx']}, fx double, fy double").groupBy("row_idx").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
    return state.join(total, "row_idx", "left").select("row_idx", *[((F.coalesce(f"f{c}", F.lit(0.0)) - forces.centering * F.col(c)) / F.col("mass")).alias(f"a{c}") for c in "xy"])


def spring_acceleration(state: DataFrame, edges: DataFrame, spring: float, length: float = Forces.spring_length) -> DataFrame:
    """(row_idx, ax, ay) of edges (src, dst); edges out of range or onto themselves do nothing."""
    p = state.select("row_idx", "x", "y", "mass")
    q = p.select(*[F.col(c).alias(c) for c in p.columns])
    e = edges.where("src <> dst").join(p.select([F.col(c).alias(f"s_{c}") for c in p.columns]), F.col("src") == F.col("s_row_idx")).join(q.select([F.col(c).alias(f"d_{c}") for c in p.columns]), F.col("dst") == F.col("d_row_idx"))
    dx, dy = F.col("d_x") - F.col("s_x"), F.col("d_y") - F.col("s_y")
    r = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-6))
    pull = spring * (r - length)
    ends = F.array(*[F.struct(F.col(f"{s}_row_idx").alias("row_idx"), (sign * dx * pull / r / F.col(f"{s}_mass")).alias("ax"), (sign * dy * pull / r / F.col(f"{s}_mass")).alias("ay")) for s, sign in (("s", 1.0), ("d", -1.0))])
    return e.select(F.explode(ends).alias("e")).select("e.*").groupBy("row_idx").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))


def integrate(state: DataFrame, base: float = Forces.viscosity) -> DataFrame:
    """Velocities from accelerations, damped and limited, then positions."""
    damp = S.damping(F.col("viscosity"), base)
    t = state.withColumn("vx", (F.col("vx") + F.col("ax") / S.TIME_STEP) * damp).withColumn("vy", (F.col("vy") + F.col("ay") / S.TIME_STEP) * damp)
    t = t.withColumn("_f", S.clamp_factor(F.col("vx"), F.col("vy")))
    t = t.withColumn("vx", F.col("vx") * F.col("_f")).withColumn("vy", F.col("vy") * F.col("_f")).drop("_f")
    return t.withColumn("x", F.col("x") + F.col("vx") / S.TIME_STEP).withColumn("y", F.col("y") + F.col("vy") / S.TIME_STEP)


def step(state: DataFrame, step_no: int, forces: Forces = Forces(), edges: DataFrame | None = None, grid: bool = False) -> DataFrame:
    """One whole step: heat of this step, pair forces, springs, integration."""
    heat = S.TEMPERATURE_FLOOR + (1 - S.TEMPERATURE_FLOOR) * 0.5 ** (step_no / S.HALF_LIFE)
    acc = grid_acceleration(state, heat, forces) if grid else pair_acceleration(state, heat, forces)
    if edges is not None and forces.spring:
        acc = acc.unionByName(spring_acceleration(state, edges, forces.spring)).groupBy("row_idx").agg(F.sum("ax").alias("ax"), F.sum("ay").alias("ay"))
    return integrate(state.drop("ax", "ay").join(acc, "row_idx"), forces.viscosity).drop("ax", "ay")


def extent(points: DataFrame) -> DataFrame:
    """Bounding box and its diagonal (0 without points)."""
    box = points.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    return box.withColumn("diagonal", F.coalesce(F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")), F.lit(0.0)))


def viewport(points: DataFrame, width: float, height: float, pad: float = 0.12, least: float = 1e-3) -> DataFrame:
    """Scale and offsets that fit all points; without points scale 1 at the centre."""
    b = extent(points)
    w, h = width * (1 - 2 * pad), height * (1 - 2 * pad)
    scale = F.least(w / F.greatest(F.col("max_x") - F.col("min_x"), F.lit(least)), h / F.greatest(F.col("max_y") - F.col("min_y"), F.lit(least)))
    b = b.withColumn("scale", F.coalesce(scale, F.lit(1.0)))
    mid = lambda c, size: size / 2 - F.coalesce((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2, F.lit(0.0)) * F.col("scale")
    return b.select(F.lit(float(width)).alias("width"), F.lit(float(height)).alias("height"), "scale", mid("x", width).alias("offset_x"), mid("y", height).alias("offset_y"))


def to_screen(points: DataFrame, view: DataFrame) -> DataFrame:
    """Points in screen coordinates; the viewport is one row."""
    return points.join(F.broadcast(view)).withColumn("screen_x", F.col("x") * F.col("scale") + F.col("offset_x")).withColumn("screen_y", F.col("y") * F.col("scale") + F.col("offset_y")).drop(*view.columns)
