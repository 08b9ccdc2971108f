"""Pieces of SQL shared by the checking queries; they restate each operator's meaning on the other engine."""

from __future__ import annotations

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}([tT]\d{2}:\d{2}(:\d{2})?(\.\d+)?[zZ]?)?$"


def product(a: str, b: str) -> str:
    return f"((((({a}) >> 16) * ({b})) & 65535) * 65536 + (({a}) & 65535) * ({b})) % 4294967296"


def draws(source: str, keep: str, seed: str, draw: str) -> str:
    """A query giving ``keep`` and ``u``, the draw of the seeded stream, step by step."""
    return f"""SELECT {keep}, xor(t2, t2 >> 14) / 4294967296.0 AS u FROM (
      SELECT {keep}, xor((t + ({product('xor(t, t >> 7)', 't | 61')})) % 4294967296, t) AS t2 FROM (
        SELECT {keep}, {product('xor(a, a >> 15)', 'a | 1')} AS t FROM (
          SELECT {keep}, (CAST({seed} AS BIGINT) + CAST({draw} AS BIGINT) * 1831565813) % 4294967296 AS a FROM {source}) q1) q2) q3"""


def melted(table: str, columns: list[str]) -> str:
    """Every cell as text; the blank between date and time of typed timestamps is a T."""
    text = lambda c: f"CASE WHEN typeof({c}) LIKE 'TIMESTAMP%' THEN replace(CAST({c} AS VARCHAR), ' ', 'T') ELSE CAST({c} AS VARCHAR) END"
    return " UNION ALL ".join(f"SELECT {i} AS ordinal, '{c}' AS name, nullif(trim({text(c)}), '') AS value FROM {table}" for i, c in enumerate(columns))


def profiled(table: str, columns: list[str]) -> str:
    return f"""SELECT ordinal, name, count(value) AS non_null, count(*) - count(value) AS missing, count(DISTINCT value) AS distinct_count, count(x) AS numeric_count,
      bool_and(lower(value) IN ('true', 'yes', 'y', 'false', 'no', 'n')) FILTER (value IS NOT NULL) AS all_boolean,
      bool_and(regexp_full_match(value, '{DATE}')) FILTER (value IS NOT NULL) AS all_date,
      min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_pop(x) AS sigma
      FROM (SELECT *, CASE WHEN regexp_full_match(value, '{NUMBER}') THEN TRY_CAST(value AS DOUBLE) END AS x FROM ({melted(table, columns)})) GROUP BY ordinal, name"""


def typed(table: str, columns: list[str]) -> str:
    return f"""SELECT *, CASE WHEN non_null = 0 THEN 'categorical' WHEN all_boolean THEN 'boolean' WHEN all_date THEN 'date'
      WHEN numeric_count / non_null > 0.9 THEN 'numeric' WHEN distinct_count / (non_null + missing) >= 0.9 THEN 'id-like' ELSE 'categorical' END AS inferred_type,
      CASE WHEN numeric_count <= 1 THEN 0.0 WHEN abs(mean) > 1e-9 THEN sigma / abs(mean) WHEN sigma > 0 THEN 'Infinity'::DOUBLE ELSE 0.0 END AS cv FROM ({profiled(table, columns)})"""


def roles(table: str, columns: list[str]) -> str:
    return f"""WITH t AS ({typed(table, columns)}),
      r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN inferred_type = 'numeric' AND cv < 'Infinity'::DOUBLE THEN cv END DESC NULLS LAST, ordinal) AS top,
        min(CASE WHEN inferred_type = 'categorical' AND distinct_count BETWEEN 2 AND 6 THEN ordinal END) OVER () AS charge FROM t),
      v AS (SELECT *, min(CASE WHEN inferred_type = 'categorical' AND ordinal IS DISTINCT FROM charge THEN ordinal END) OVER () AS viscous FROM r)
      SELECT *, CASE WHEN inferred_type = 'id-like' THEN 'label' WHEN inferred_type = 'numeric' AND cv < 'Infinity'::DOUBLE AND top = 1 THEN 'mass'
        WHEN inferred_type = 'numeric' AND cv < 'Infinity'::DOUBLE AND top = 2 THEN 'attraction' WHEN ordinal = charge THEN 'charge' WHEN ordinal = viscous THEN 'viscosity' ELSE 'excluded' END AS role FROM v"""


def rank(value: str, over: str = "") -> str:
    """Tie-averaged percentile rank as a window expression."""
    part = f"PARTITION BY {over}" if over else ""
    both = f"PARTITION BY {over + ', ' if over else ''}{value}"
    return f"""CASE WHEN {value} IS NULL OR count({value}) OVER ({part}) <= 1 THEN 0.5
      ELSE (rank() OVER ({part} ORDER BY {value}) - 1 + (count(*) OVER ({both}) - 1) / 2.0) / (count({value}) OVER ({part}) - 1) END"""


def push(a: str, b: str, heat: str) -> str:
    """Force over distance between two points with x, y, charge and attraction (a list)."""
    r = f"greatest(sqrt(({a}.x-{b}.x)**2 + ({a}.y-{b}.y)**2), 1e-6)"
    unlike = f"sqrt(list_sum(list_transform(list_zip({a}.attraction, {b}.attraction), lambda z: (z[1]-z[2])**2)) / len({a}.attraction))"
    charge = f"CASE WHEN {a}.charge = {b}.charge THEN -0.15 ELSE greatest(abs({a}.charge - {b}.charge), 0.35) END"
    return f"(-1.4 * {heat} * ({r} - 26.0 * {unlike}) + {charge} * 0.9 * {heat} / (({a}.x-{b}.x)**2 + ({a}.y-{b}.y)**2 + 1) + 2.2 * greatest((1.4 - {r}) / 1.4, 0) ** 2) / {r}"


#: A small state whose every column is an expression of the supplier table.
SUPPLIER_STATE = """SELECT s_suppkey AS row_idx, s_acctbal / 200.0 AS x, ((s_suppkey * 37) % 101) - 50.0 AS y, (s_nationkey % 3) * 0.1 AS vx, 0.0 AS vy, 1.0 + s_nationkey / 24.0 AS mass,
  (s_nationkey % 5) / 2.0 - 1.0 AS charge, (s_nationkey % 4) / 4.0 AS viscosity, [s_nationkey / 24.0, ((s_suppkey * 7) % 10) / 10.0] AS attraction FROM supplier"""
PART_STATE = """SELECT p_partkey AS row_idx, ((p_partkey * 37) % 301) - 150.0 + p_size / 100.0 AS x, ((p_partkey * 53) % 299) - 149.0 AS y, 1.0 + p_size / 50.0 AS mass,
  (p_size % 3) - 1.0 AS charge, [p_size / 50.0] AS attraction FROM part"""


#: The part state at rest, with a viscosity.
PART_REST = f"SELECT *, 0.0 AS vx, 0.0 AS vy, (row_idx % 4) / 4.0 AS viscosity FROM ({PART_STATE})"


def pair_step(state: str, heat: str, near: str = "a.row_idx <> b.row_idx") -> str:
    """(row_idx, ax, ay) of all pairs that meet ``near``, centering included."""
    return f"""SELECT a.row_idx, any_value((coalesce(fx, 0) - 0.02 * a.x) / a.mass) AS ax, any_value((coalesce(fy, 0) - 0.02 * a.y) / a.mass) AS ay FROM ({state}) a LEFT JOIN (
      SELECT a.row_idx, sum((a.x-b.x) * {push('a', 'b', heat)}) AS fx, sum((a.y-b.y) * {push('a', 'b', heat)}) AS fy FROM ({state}) a JOIN ({state}) b ON {near} GROUP BY a.row_idx) f ON a.row_idx = f.row_idx GROUP BY a.row_idx"""


def moved(state: str, acc: str) -> str:
    """The state after integration of (row_idx, ax, ay)."""
    return f"""WITH v AS (SELECT s.row_idx, s.x, s.y, (s.vx + a.ax / 60.0) * (1 - least(0.98, 0.06 + s.viscosity * 0.5)) AS vx, (s.vy + a.ay / 60.0) * (1 - least(0.98, 0.06 + s.viscosity * 0.5)) AS vy FROM ({state}) s JOIN ({acc}) a USING (row_idx)),
      c AS (SELECT *, CASE WHEN sqrt(vx*vx+vy*vy) > 60 THEN 60.0 / sqrt(vx*vx+vy*vy) ELSE 1.0 END AS f FROM v)
      SELECT row_idx, x + vx * f / 60.0 AS x, y + vy * f / 60.0 AS y, vx * f AS vx, vy * f AS vy FROM c"""


def cell(c: str) -> str:
    return f"CAST(least(greatest(floor(({c} + 150.0) / 30.0), 0), 9) AS INTEGER)"
