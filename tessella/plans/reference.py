"""Queries of the analytic operators, each over whole tables, with SQL for the checking engine where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella import api
from tessella.functions import scalars as S
from tessella.operators import analysis, export, layout, normalize, profile, sampling, scoring, settle
from tessella.plans import sql_parts as Q
from tessella.runtime import checkpoint, table
from tessella.sources import csv_text, generators
from tessella.streaming import convergence

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return register


def r6(c, alias: str, digits: int = 6):  # noqa: ANN001, ANN201
    """Rounded for comparison; adding 0 turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, digits) + F.lit(0.0)).alias(alias)


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
PROFILE_SQL = "SELECT ordinal, name, non_null, missing, distinct_count, numeric_count, round(min, 4) + 0.0 AS min, round(max, 4) + 0.0 AS max, round(mean, 4) + 0.0 AS mean, round(sigma, 4) + 0.0 AS sigma FROM ({})"


def _profile(df: DataFrame) -> DataFrame:
    return profile.column_profile(df).select("ordinal", "name", "non_null", "missing", "distinct_count", "numeric_count", *[r6(c, c, 4) for c in ("min", "max", "mean", "sigma")])


@query(PROFILE_SQL.format(Q.profiled("lineitem", LINEITEM)))
def column_profile_lineitem(spark, d):
    return _profile(table(spark, d, "lineitem").select(*LINEITEM))


@query(f"SELECT ordinal, name, inferred_type, round(CASE WHEN inferred_type = 'numeric' THEN cv END, 6) AS variation FROM ({Q.typed('part', PART)})")
def type_inference_part(spark, d):
    return profile.infer_types(table(spark, d, "part").select(*PART)).select("ordinal", "name", "inferred_type", F.round("variation", 6).alias("variation"))


@query(f"SELECT ordinal, name, inferred_type FROM ({Q.typed('events', EVENTS)})")
def type_inference_events(spark, d):
    return profile.infer_types(table(spark, d, "events").select(*EVENTS)).select("ordinal", "name", "inferred_type")


_ROLE_COLUMNS = LINEITEM


@query(f"SELECT ordinal, name, inferred_type, role, CASE WHEN role = 'attraction' THEN 'raw' ELSE 'rank' END AS normalization, missing AS missing_count FROM ({Q.roles('lineitem', _ROLE_COLUMNS)})")
def role_inference_lineitem(spark, d):
    m = profile.mapping(table(spark, d, "lineitem").select(*_ROLE_COLUMNS))
    return m.select("ordinal", "name", "inferred_type", "role", "normalization", F.col("missing.count").alias("missing_count"))


@query(f"""SELECT ordinal, name, CASE WHEN ordinal = 4 THEN 'attraction' ELSE role END AS role,
  CASE WHEN ordinal = 4 THEN 'raw' WHEN ordinal = 5 THEN 'raw' WHEN role = 'attraction' THEN 'raw' ELSE 'rank' END AS normalization FROM ({Q.roles('lineitem', _ROLE_COLUMNS)})""")
def mapping_overrides(spark, d):
    m = profile.mapping(table(spark, d, "lineitem").select(*_ROLE_COLUMNS))
    return profile.with_normalization(profile.with_role(m, 4, "attraction"), 5, "raw").select("ordinal", "name", "role", "normalization")


_REGIONS = "(SELECT 'key ' || r_regionkey AS r_regionkey, r_name FROM region) AS region"


@query(f"""SELECT coalesce(bool_or(role IN ('mass', 'charge', 'attraction', 'viscosity', 'spring-anchor')), false) AS is_usable, count(*) AS n_columns,
  string_agg(name || ': ' || CASE WHEN inferred_type = 'id-like' THEN 'high-cardinality / id-like — offered only as a row label' ELSE 'inferred ' || inferred_type || ', not a usable force role' END, '; ' ORDER BY ordinal) AS message
  FROM ({Q.roles(_REGIONS, ['r_regionkey', 'r_name'])})""")
def zero_usable_columns(spark, d):
    """Both columns of the table are labels here: the key is written as a text."""
    t = table(spark, d, "region").select(F.concat(F.lit("key "), F.col("r_regionkey").cast("string")).alias("r_regionkey"), "r_name")
    return profile.usable(profile.mapping(t)).select("is_usable", F.size("seen_columns").cast("long").alias("n_columns"), "message")


@query(f"SELECT ordinal, name, role FROM ({Q.roles('lineitem', _ROLE_COLUMNS)}) WHERE inferred_type = 'numeric' AND role IN ('mass', 'charge', 'attraction', 'viscosity')")
def force_columns(spark, d):
    return profile.force_columns(profile.mapping(table(spark, d, "lineitem").select(*_ROLE_COLUMNS))).select("ordinal", "name", "role")


@query(f"SELECT l_orderkey, l_linenumber, round({Q.rank('l_extendedprice')}, 6) AS r FROM lineitem")
def rank_norm_price(spark, d):
    return normalize.rank_norm(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "r").select("l_orderkey", "l_linenumber", r6("r", "r"))


@query(f"SELECT o_orderkey, round({Q.rank('o_totalprice', 'o_orderstatus')}, 6) AS r FROM orders")
def rank_norm_by_group(spark, d):
    return normalize.rank_norm(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", "r", "o_orderstatus").select("o_orderkey", r6("r", "r"))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) + 0.0 AS m FROM customer")
def minmax_norm_acctbal(spark, d):
    return normalize.minmax_norm(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "m").select("c_custkey", r6("m", "m"))


_FLAG = """WITH f AS (SELECT l_returnflag AS v, min(l_orderkey * 8 + l_linenumber) AS first FROM lineitem GROUP BY 1), e AS (SELECT v, row_number() OVER (ORDER BY first) - 1 AS code, count(*) OVER () AS k FROM f)"""


@query(_FLAG + " SELECT l_orderkey, l_linenumber, code, round(code / (k - 1.0), 6) AS encoded, round(2.0 * code / (k - 1.0) - 1, 6) + 0.0 AS charge FROM lineitem JOIN e ON l_returnflag = v")
def categorical_encode_flag(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_idx"))
    return normalize.encode_categorical(t, "l_returnflag", "row_idx").select("l_orderkey", "l_linenumber", "code", r6("encoded", "encoded"), r6("charge", "charge"))


@query(_FLAG + f""" SELECT l_orderkey * 8 + l_linenumber AS row_idx, round(0.5 + {Q.rank('l_extendedprice')} * 1.5, 6) AS mass, round(2.0 * code / (k - 1.0) - 1, 6) + 0.0 AS charge, round({Q.rank('l_quantity')}, 6) AS viscosity,
  round((l_discount - min(l_discount) OVER ()) / (max(l_discount) OVER () - min(l_discount) OVER ()), 6) + 0.0 AS a0, round((l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()), 6) + 0.0 AS a1
  FROM lineitem JOIN e ON l_returnflag = v""")
def force_field_lineitem(spark, d):
    t = table(spark, d, "lineitem").withColumn("row_idx", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    spec = layout.FieldSpec([("l_extendedprice", "rank")], [("l_discount", "raw"), ("l_tax", "raw")], "l_returnflag", True, [("l_quantity", "rank")])
    f = layout.force_field(t.select("row_idx", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_quantity"), "row_idx", spec)
    return f.select("row_idx", r6("mass", "mass"), r6("charge", "charge"), r6("viscosity", "viscosity"), r6(F.col("attraction")[0], "a0"), r6(F.col("attraction")[1], "a1"))


_STATUS = _FLAG + ", g AS (SELECT l_linestatus AS w, row_number() OVER (ORDER BY min(l_orderkey * 8 + l_linenumber)) - 1 AS place, count(*) OVER () AS m FROM lineitem GROUP BY 1)"


@query(_STATUS + " SELECT l_orderkey * 8 + l_linenumber AS row_idx, 1.25 AS mass, round(2.0 * code / (k - 1.0) - 1, 6) + 0.0 AS charge, round(CASE WHEN m > 1 THEN place / (m - 1.0) ELSE 0.5 END, 6) AS viscosity, 0.5 AS a0 FROM lineitem JOIN e ON l_returnflag = v JOIN g ON l_linestatus = w")
def force_field_categorical(spark, d):
    """Categories as mass and attraction are neutral, as charge and viscosity they are coded."""
    t = table(spark, d, "lineitem").withColumn("row_idx", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    spec = layout.FieldSpec([("l_returnflag", "rank")], [("l_linestatus", "raw")], "l_returnflag", True, [("l_linestatus", "rank")])
    f = layout.force_field(t.select("row_idx", "l_returnflag", "l_linestatus"), "row_idx", spec, {"l_returnflag", "l_linestatus"})
    return f.select("row_idx", r6("mass", "mass"), r6("charge", "charge"), r6("viscosity", "viscosity"), r6(F.col("attraction")[0], "a0"))


@query("""SELECT c_custkey AS row_idx, 1.0 AS mass, round(2 * (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) - 1, 6) + 0.0 AS charge FROM customer""")
def force_field_raw_charge(spark, d):
    spec = layout.FieldSpec([], [], "c_acctbal", False, charge_how="raw")
    return layout.force_field(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", spec).select("row_idx", "mass", r6("charge", "charge"))


@query(f"SELECT c_custkey AS row_idx, 1.0 AS mass, round(2 * {Q.rank('c_acctbal')} - 1, 6) + 0.0 AS charge FROM customer")
def force_field_rank_charge(spark, d):
    spec = layout.FieldSpec([], [], "c_acctbal", False)
    return layout.force_field(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", spec).select("row_idx", "mass", r6("charge", "charge"))


@query(f"SELECT s_suppkey, round(u, 9) AS u FROM ({Q.draws('supplier', 's_suppkey', '7', 's_suppkey')})")
def prng_uniform(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round(S.uniform(F.lit(7), F.col("s_suppkey")), 9).alias("u"))


_TWO = "(SELECT a.s_suppkey, a.u AS u, b.u AS v FROM ({a}) a JOIN ({b}) b USING (s_suppkey))"
_PAIR = _TWO.format(a=Q.draws("supplier", "s_suppkey", "7", "s_suppkey * 2 + 1"), b=Q.draws("supplier", "s_suppkey", "7", "s_suppkey * 2 + 2"))


@query(f"SELECT s_suppkey, round(sqrt(-2 * ln(u)) * cos(2 * pi() * v), 6) + 0.0 AS g FROM {_PAIR}")
def prng_gaussian(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", r6(S.gaussian(F.lit(7), F.col("s_suppkey") * 2 + 1), "g"))


@query(f"SELECT s_suppkey AS row_idx, round(40 * sqrt(u) * cos(2 * pi() * v), 6) + 0.0 AS x, round(40 * sqrt(u) * sin(2 * pi() * v), 6) + 0.0 AS y FROM {_PAIR}")
def init_positions_supplier(spark, d):
    p = layout.place(table(spark, d, "supplier").select(F.col("s_suppkey").alias("row_idx")), F.lit(7))
    return p.select("row_idx", r6("x", "x"), r6("y", "y"))


_NOISE = " UNION ALL ".join(f"SELECT id, {j} AS d, u FROM ({Q.draws('(SELECT range AS id FROM range(180))', 'id', '2', f'id * 5 + {j} + 1')})" for j in range(5))


@query("SELECT 'row_' || (id + 1) AS id, " + ", ".join(f"max(CASE WHEN d = {j} THEN floor((-10 + u * 20) * 10000 + 0.5) / 10000 END) AS dim_{j + 1}" for j in range(5)) + f" FROM ({_NOISE}) GROUP BY id")
def synthetic_noise(spark, d):
    return generators.noise(spark, 2)


_CENTRE = "CASE WHEN id < 60 THEN {} WHEN id < 120 THEN {} ELSE {} END"
_BLOB = " UNION ALL ".join(
    f"SELECT a.id, {j} AS d, {_CENTRE.format(*[c[j] for c in generators.CENTRES])} + 1.5 * sqrt(-2 * ln(a.u)) * cos(2 * pi() * b.u) AS x FROM ({Q.draws('(SELECT range AS id FROM range(180))', 'id', '1', f'2 * (id * 5 + {j}) + 1')}) a "
    f"JOIN ({Q.draws('(SELECT range AS id FROM range(180))', 'id', '1', f'2 * (id * 5 + {j}) + 2')}) b USING (id)".replace("WHEN id", "WHEN a.id").replace("CASE WHEN a.id < 60", "CASE WHEN a.id < 60")
    for j in range(5)
)


@query("SELECT 'row_' || (id + 1) AS id, " + ", ".join(f"max(CASE WHEN d = {j} THEN floor(x * 10000 + 0.5) / 10000 END) AS dim_{j + 1}" for j in range(5)) + f", any_value(CASE WHEN id < 60 THEN 'cluster_1' WHEN id < 120 THEN 'cluster_2' ELSE 'cluster_3' END) AS label FROM ({_BLOB}) GROUP BY id")
def synthetic_blobs(spark, d):
    return generators.blobs(spark, 1)


@query("SELECT 'row_' || (range + 1) AS id, 5 AS dim_1, 5 AS dim_2, 5 AS dim_3, 'only' AS category FROM range(40)")
def synthetic_degenerate(spark, d):
    return generators.degenerate(spark)


@query("SELECT 'row_1' AS id, CAST(3.14 AS DOUBLE) AS dim_1, CAST(-2.71 AS DOUBLE) AS dim_2, 'solo' AS category")
def synthetic_one_row(spark, d):
    return generators.one_row(spark)


@query("SELECT 'a-' || (range + 1) || '-' || (1000 + 37 * range) AS uuid_a, 'b-' || (9999 - range) || '-' || (91 * range + 7) AS uuid_b FROM range(40)")
def synthetic_ids(spark, d):
    return generators.ids_only(spark)


@query("SELECT range AS step, round(0.15 + 0.85 * 0.5 ** (range / 45.0), 9) AS temperature FROM range(400)")
def temperature_schedule(spark, d):
    return spark.range(400).select(F.col("id").alias("step"), F.round(S.temperature(F.col("id")), 9).alias("temperature"))


def supplier_state(spark, d):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(
        k.alias("row_idx"), (F.col("s_acctbal") / 200.0).alias("x"), ((k * 37) % 101 - 50.0).alias("y"), ((n % 3) * 0.1).alias("vx"), F.lit(0.0).alias("vy"), (1.0 + n / 24.0).alias("mass"),
        ((n % 5) / 2.0 - 1.0).alias("charge"), ((n % 4) / 4.0).alias("viscosity"), F.array(n / 24.0, ((k * 7) % 10) / 10.0).alias("attraction"),
    )


def part_state(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(
        k.alias("row_idx"), ((k * 37) % 301 - 150.0 + s / 100.0).alias("x"), ((k * 53) % 299 - 149.0).alias("y"), (1.0 + s / 50.0).alias("mass"), ((s % 3) - 1.0).alias("charge"), F.array(s / 50.0).alias("attraction"),
    )


_ACC = "SELECT row_idx, round(ax, 6) + 0.0 AS ax, round(ay, 6) + 0.0 AS ay FROM ({})"


@query(_ACC.format(Q.pair_step(Q.SUPPLIER_STATE, "1.0")).replace(", 6)", ", 4)"))
def pairwise_accel_supplier(spark, d):
    return layout.pair_acceleration(supplier_state(spark, d), 1.0).select("row_idx", r6("ax", "ax", 4), r6("ay", "ay", 4))


@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) ** 2)) / len(a.embedding)), 5) AS dissimilarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_dissimilarity_embeddings(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    u = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return t.join(u, "vec_id").select("vec_id", F.round(S.dissimilarity(F.col("e"), F.col("f")), 5).alias("dissimilarity"))


@query(f"SELECT {Q.cell('y')} * 10 + {Q.cell('x')} AS cell, count(*) AS n FROM ({Q.PART_STATE}) GROUP BY 1")
def grid_cells(spark, d):
    return part_state(spark, d).groupBy(S.grid_cell(F.col("x"), F.col("y")).alias("cell")).agg(F.count("*").alias("n"))


@query(f"SELECT cell, CAST(coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_slot FROM (SELECT {Q.cell('y')} * 10 + {Q.cell('x')} AS cell, count(*) AS n FROM ({Q.PART_STATE}) GROUP BY 1)")
def grid_offsets(spark, d):
    w = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 100 cells
    return grid_cells(spark, d).select("cell", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("first_slot"))


@query(f"SELECT row_idx, cell, row_number() OVER (PARTITION BY cell ORDER BY row_idx) AS slot FROM (SELECT row_idx, {Q.cell('y')} * 10 + {Q.cell('x')} AS cell FROM ({Q.PART_STATE}))")
def grid_scatter(spark, d):
    t = part_state(spark, d).select("row_idx", S.grid_cell(F.col("x"), F.col("y")).alias("cell"))
    return t.withColumn("slot", F.row_number().over(Window.partitionBy("cell").orderBy("row_idx")).cast("long"))


_NEAR = f"a.row_idx <> b.row_idx AND abs({Q.cell('a.x')} - {Q.cell('b.x')}) <= 1 AND abs({Q.cell('a.y')} - {Q.cell('b.y')}) <= 1"


@query(_ACC.format(Q.pair_step(Q.PART_STATE, "1.0", _NEAR)).replace(", 6)", ", 4)"))
def grid_accel_part(spark, d):
    return layout.grid_acceleration(part_state(spark, d), 1.0, dims=1).select("row_idx", r6("ax", "ax", 4), r6("ay", "ay", 4))


_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS row_idx, n_nationkey * 1.5 - 10 AS x, (n_nationkey * 7) % 11 - 5.0 AS y, 1.0 + n_regionkey / 4.0 AS mass FROM nation"
_SPRING = "(0.3 * (greatest(sqrt((d.x-s.x)**2 + (d.y-s.y)**2), 1e-6) - 4.0) / greatest(sqrt((d.x-s.x)**2 + (d.y-s.y)**2), 1e-6))"
_EDGES = f"SELECT s.row_idx AS si, d.row_idx AS di, (d.x-s.x) * {_SPRING} AS fx, (d.y-s.y) * {_SPRING} AS fy, s.mass AS sm, d.mass AS dm FROM nation n JOIN ({_NATION}) s ON s.row_idx = n.n_nationkey JOIN ({_NATION}) d ON d.row_idx = n.n_regionkey WHERE n.n_nationkey <> n.n_regionkey"


@query(f"SELECT row_idx, round(sum(ax), 6) + 0.0 AS ax, round(sum(ay), 6) + 0.0 AS ay FROM (SELECT si AS row_idx, fx / sm AS ax, fy / sm AS ay FROM ({_EDGES}) UNION ALL SELECT di, -fx / dm, -fy / dm FROM ({_EDGES})) GROUP BY 1")
def spring_accel_nation_region(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    state = n.select(k.cast("long").alias("row_idx"), (k * 1.5 - 10).alias("x"), ((k * 7) % 11 - 5.0).alias("y"), (1.0 + F.col("n_regionkey") / 4.0).alias("mass"))
    edges = n.select(k.cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return layout.spring_acceleration(state, edges, 0.3).select("row_idx", r6("ax", "ax"), r6("ay", "ay"))


_MOVED = "SELECT row_idx, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy FROM ({})"


@query(_MOVED.format(Q.moved(Q.SUPPLIER_STATE, "SELECT s_suppkey AS row_idx, s_acctbal / 200.0 * 200.0 AS ax, -(s_acctbal / 200.0) * 100.0 AS ay FROM supplier")))
def integrate_step(spark, d):
    t = supplier_state(spark, d)
    return layout.integrate(t.withColumn("ax", F.col("x") * 200.0).withColumn("ay", -F.col("x") * 100.0)).select("row_idx", *[r6(c, c) for c in ("x", "y", "vx", "vy")])


@query(_MOVED.format(Q.moved(Q.SUPPLIER_STATE, Q.pair_step(Q.SUPPLIER_STATE, "(0.15 + 0.85 * 0.5 ** (10 / 45.0))"))))
def one_full_step(spark, d):
    return layout.step(supplier_state(spark, d), 10).select("row_idx", *[r6(c, c) for c in ("x", "y", "vx", "vy")])


_STARTED = _MOVED.format(Q.moved("{state}", Q.pair_step("{state}", "1.0", "{near}"))).replace(", 6)", ", 4)")


def _settled(state: DataFrame, **options) -> DataFrame:
    s = settle.settle(state.withColumn("layout_id", F.lit(0).cast("long")), max_steps=1, **options)
    return s.select("row_idx", *[r6(c, c, 4) for c in ("x", "y", "vx", "vy")])


@query(_STARTED.replace("{state}", Q.SUPPLIER_STATE).replace("{near}", "a.row_idx <> b.row_idx"))
def settle_first_step(spark, d):
    """The kernel's first step from all pairs."""
    return _settled(supplier_state(spark, d))


@query(_STARTED.replace("{state}", Q.PART_REST).replace("{near}", _NEAR))
def settle_grid_step(spark, d):
    """The kernel's first step as above the row limit of all pairs: neighbouring cells only."""
    return _settled(part_state(spark, d).withColumn("viscosity", (F.col("row_idx") % 4) / 4.0), grid_rows=0)


@query(f"SELECT round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 6) AS diagonal FROM ({Q.PART_STATE})")
def bbox_diagonal(spark, d):
    return layout.extent(part_state(spark, d)).select(r6("diagonal", "diagonal"))


@query("SELECT round(avg(sqrt(l_quantity ** 2 + l_discount ** 2)), 6) AS mean_speed, bool_or(isnan(l_quantity) OR isinf(l_quantity)) AS not_finite FROM lineitem")
def mean_speed(spark, d):
    return table(spark, d, "lineitem").agg(r6(F.avg(F.hypot("l_quantity", "l_discount")), "mean_speed"), F.bool_or(S.not_finite(F.col("l_quantity"))).alias("not_finite"))


_VIEW = f"SELECT least(800 * 0.76 / greatest(max(x) - min(x), 1e-3), 600 * 0.76 / greatest(max(y) - min(y), 1e-3)) AS scale, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my FROM ({Q.PART_STATE})"


@query(f"SELECT round(scale, 6) AS scale, round(400 - mx * scale, 6) AS offset_x, round(300 - my * scale, 6) AS offset_y FROM ({_VIEW})")
def viewport_fit(spark, d):
    return layout.viewport(part_state(spark, d), 800, 600).select(*[r6(c, c) for c in ("scale", "offset_x", "offset_y")])


@query(f"""SELECT row_idx, round(x * scale + 400 - mx * scale, 4) + 0.0 AS screen_x, round(y * scale + 300 - my * scale, 4) + 0.0 AS screen_y,
  CASE WHEN row_idx % 7 = 0 THEN '#E8ECF3' WHEN (row_idx % 7 - 1) = 0 THEN '#7FB2F0' WHEN (row_idx % 7 - 1) = 1 THEN '#7BD88F' WHEN (row_idx % 7 - 1) = 2 THEN '#C79BF0' WHEN (row_idx % 7 - 1) = 3 THEN '#5FD3BC'
    WHEN (row_idx % 7 - 1) = 4 THEN '#F2A14B' ELSE '#F2779B' END AS colour,
  CASE WHEN row_idx % 50 = 0 THEN 1.0 ELSE 0.82 END AS alpha, CASE WHEN row_idx % 50 = 0 THEN '#F2A14B' END AS ring FROM ({Q.PART_STATE}), ({_VIEW})""")
def world_to_screen(spark, d):
    p, k = part_state(spark, d), F.col("row_idx")
    t = export.coloured(layout.to_screen(p, layout.viewport(p, 800, 600)), k % 7 - 1, k % 50 == 0)
    return t.select("row_idx", r6("screen_x", "screen_x", 4), r6("screen_y", "screen_y", 4), "colour", "alpha", "ring")


_TRACE = "SELECT user_id AS layout_id, event_id AS step, value AS speed, 20000.0 + (user_id % 7) * 10000 AS diagonal FROM events"
_AVERAGED = f"SELECT *, CASE WHEN count(speed) OVER w = 30 THEN avg(speed) OVER w END AS ma FROM ({_TRACE}) WINDOW w AS (PARTITION BY layout_id ORDER BY step ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"


def _trace(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("layout_id"), F.col("event_id").alias("step"), F.col("value").alias("speed"), (20000.0 + (F.col("user_id") % 7) * 10000).alias("diagonal"))


@query(f"SELECT layout_id, step, round(ma, 6) AS moving_average FROM ({_AVERAGED})")
def convergence_moving_avg(spark, d):
    return settle.moving_average(_trace(spark, d)).select("layout_id", "step", r6("moving_average", "moving_average"))


@query(f"""SELECT layout_id, step, n - coalesce(max(CASE WHEN NOT calm THEN n END) OVER (PARTITION BY layout_id ORDER BY step), 0) AS quiet_run FROM (
  SELECT layout_id, step, row_number() OVER (PARTITION BY layout_id ORDER BY step) AS n, coalesce(ma < 0.0015 * greatest(diagonal, 1.0), false) AS calm FROM ({_AVERAGED}))""")
def convergence_run_length(spark, d):
    return settle.run_lengths(settle.moving_average(_trace(spark, d))).select("layout_id", "step", "quiet_run")


@query("SELECT 0 AS i, 0 AS j, round(covar_samp(l_quantity, l_quantity), 3) AS c FROM lineitem UNION ALL SELECT 0, 1, round(covar_samp(l_quantity, l_discount), 3) + 0.0 FROM lineitem UNION ALL SELECT 1, 1, round(covar_samp(l_discount, l_discount), 3) FROM lineitem")
def covariance_lineitem(spark, d):
    return scoring.covariance(table(spark, d, "lineitem"), ["l_quantity", "l_discount"]).select("i", "j", r6("covariance", "c", 3))


_EIGEN = """SELECT mx, my, a, b, c, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my,
  covar_samp(p_size, p_size) AS a, covar_samp(p_size, p_retailprice) AS b, covar_samp(p_retailprice, p_retailprice) AS c FROM part)"""


@query(f"SELECT round(l1, 3) AS first, round(l2, 3) AS second, round((l1 + l2) / (a + c), 6) AS explained FROM ({_EIGEN})")
def pca_variance_2d(spark, d):
    axes = scoring.principal_axes(table(spark, d, "part"), ["p_size", "p_retailprice"])
    return spark.createDataFrame([(round(float(axes["values"][0]), 3), round(float(axes["values"][1]), 3), round(scoring.explained(axes), 6))], "first double, second double, explained double")


@query(f"SELECT p_partkey, round(abs(((p_size - mx) * b + (p_retailprice - my) * (l1 - a)) / sqrt(b * b + (l1 - a) ** 2)), 4) AS pc1, round(abs(((p_size - mx) * (l1 - a) - (p_retailprice - my) * b) / sqrt(b * b + (l1 - a) ** 2)), 4) AS pc2 FROM part, ({_EIGEN})")
def pca_projection_abs(spark, d):
    t, cols = table(spark, d, "part"), ["p_size", "p_retailprice"]
    return scoring.project(t, cols, scoring.principal_axes(t, cols)).select("p_partkey", r6(F.abs("pc1"), "pc1", 4), r6(F.abs("pc2"), "pc2", 4))


_CENTRES = "(VALUES (0, 10.0, 1000.0), (1, 25.0, 1400.0), (2, 40.0, 1800.0)) AS c(cluster, cx, cy)"
_ASSIGNED = f"SELECT p_partkey, p_size, p_retailprice, arg_min(cluster, d2 * 1000000 + cluster * 1e-9) AS cluster, min(d2) AS d2 FROM (SELECT part.*, cluster, (p_size - cx) ** 2 + (p_retailprice - cy) ** 2 AS d2 FROM part, {_CENTRES}) GROUP BY 1, 2, 3"


def _centres(spark):
    return spark.createDataFrame([(0, 10.0, 1000.0), (1, 25.0, 1400.0), (2, 40.0, 1800.0)], "cluster int, p_size double, p_retailprice double")


@query(f"SELECT p_partkey, cluster, round(d2, 4) AS squared_distance FROM ({_ASSIGNED})")
def kmeans_assign_fixed_centres(spark, d):
    return scoring.assign(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), _centres(spark), ["p_size", "p_retailprice"]).select("p_partkey", "cluster", r6("squared_distance", "squared_distance", 4))


@query(f"SELECT c.cluster, round(coalesce(s, cx), 4) AS p_size, round(coalesce(r, cy), 4) AS p_retailprice FROM {_CENTRES} LEFT JOIN (SELECT cluster, avg(p_size) AS s, avg(p_retailprice) AS r FROM ({_ASSIGNED}) GROUP BY 1) n ON n.cluster = c.cluster")
def kmeans_update(spark, d):
    cols = ["p_size", "p_retailprice"]
    assigned = scoring.assign(table(spark, d, "part").select("p_partkey", *cols), _centres(spark), cols)
    return scoring.update(assigned, _centres(spark), cols).select("cluster", *[r6(c, c, 4) for c in cols])


def _silhouette_sql(points: str) -> str:
    """``points``: id, label, v (list)."""
    return f"""WITH p AS ({points}), z AS (SELECT label, count(*) AS size FROM p GROUP BY 1),
      s AS (SELECT a.id, a.label, b.label AS other, sum(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)))) AS t FROM p a, p b GROUP BY 1, 2, 3),
      q AS (SELECT s.id, max(CASE WHEN s.label = other THEN CASE WHEN size > 1 THEN t / (size - 1) ELSE 0 END END) AS a, min(CASE WHEN s.label <> other THEN t / size END) AS b FROM s JOIN z ON z.label = other GROUP BY 1)
      SELECT count(*) AS n, round(coalesce(avg(CASE WHEN b IS NULL THEN 0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END), 0), 6) + 0.0 AS silhouette FROM q"""


@query(_silhouette_sql("SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings"))
def silhouette_by_label(spark, d):
    t = table(spark, d, "embeddings")
    t = t.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return scoring.silhouette(t, "vec_id", [f"e{i}" for i in range(64)], "label", block=1000).select("n", r6("silhouette", "silhouette"))


@query(_silhouette_sql("SELECT s_suppkey AS id, s_nationkey % 4 AS label, [s_acctbal, CAST(s_nationkey AS DOUBLE)] AS v FROM supplier"))
def silhouette_suppliers(spark, d):
    t = table(spark, d, "supplier").withColumn("label", F.col("s_nationkey") % 4)
    return scoring.silhouette(t, "s_suppkey", ["s_acctbal", "s_nationkey"], "label").select("n", r6("silhouette", "silhouette"))


_NN = "SELECT a.s_suppkey, min(sqrt((a.s_acctbal - b.s_acctbal) ** 2 + (a.s_nationkey - b.s_nationkey) ** 2)) AS nd FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey GROUP BY 1"


@query(f"SELECT s_suppkey, round(nd, 6) AS nearest_distance FROM ({_NN})")
def nn_distance(spark, d):
    return analysis.nearest_distances(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]).select("s_suppkey", r6("nearest_distance", "nearest_distance"))


@query(f"SELECT s_suppkey, round(nd, 6) AS nearest_distance FROM ({_NN}), (SELECT avg(nd) AS m, stddev_pop(nd) AS s, count(*) AS n FROM ({_NN})) WHERE n >= 3 AND s > 1e-9 AND nd > m + 2 * s")
def nn_outliers(spark, d):
    return analysis.outliers(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]).select("s_suppkey", r6("nearest_distance", "nearest_distance"))


_DEFINING = """WITH l AS (SELECT p_brand AS cluster, 0 AS ordinal, 'p_size' AS name, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_brand, 1, 'p_retailprice', p_retailprice FROM part UNION ALL SELECT p_brand, 2, 'p_partkey', p_partkey FROM part),
  p AS (SELECT cluster, ordinal, name, count(*) AS size, avg(v) AS mean, min(v) AS lo, max(v) AS hi FROM l GROUP BY ALL), o AS (SELECT ordinal, avg(v) AS whole FROM l GROUP BY 1),
  r AS (SELECT p.*, abs(mean - whole) AS dev, row_number() OVER (PARTITION BY cluster ORDER BY abs(mean - whole) DESC, p.ordinal) AS r FROM p JOIN o USING (ordinal))"""


def _brands(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size", "p_retailprice", "p_partkey")


@query(_DEFINING + " SELECT cluster, r AS place, name, size, round(lo, 4) AS lo, round(hi, 4) AS hi FROM r WHERE r <= 2")
def cluster_defining_columns(spark, d):
    s = analysis.cluster_summary(_brands(spark, d), "p_brand", ["p_size", "p_retailprice", "p_partkey"])
    t = s.select("cluster", "size", F.posexplode("defining_columns").alias("place", "c"))
    return t.select("cluster", (F.col("place") + 1).cast("long").alias("place"), F.col("c.name").alias("name"), "size", r6("c.min", "lo", 4), r6("c.max", "hi", 4))


_END = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {0}) END"


@query(_DEFINING.replace("FROM part", "FROM (SELECT p_brand, p_size % 7 + 1 AS p_size, 900.5 AS p_retailprice, p_partkey FROM part)") + f""" SELECT cluster, any_value(size) || ' rows — defined by ' || string_agg(name || ' ' || CASE WHEN lo = hi THEN {_END.format('lo')} ELSE {_END.format('lo')} || '–' || {_END.format('hi')} END, ', ' ORDER BY r) AS line FROM r WHERE r <= 3 GROUP BY cluster""")
def report_text(spark, d):
    """One column of the clusters has equal ends."""
    t = _brands(spark, d).withColumn("p_size", F.col("p_size") % 7 + 1).withColumn("p_retailprice", F.lit(900.5))
    return analysis.report(analysis.cluster_summary(t, "p_brand", ["p_size", "p_retailprice", "p_partkey"], top=3))


@query(f"SELECT CASE WHEN count(*) = 0 THEN 'No outliers — every row fits its cluster better than any other.' ELSE count(*) || CASE WHEN count(*) = 1 THEN ' outlier row: ' ELSE ' outlier rows: ' END || string_agg('row ' || (s_suppkey + 1), ', ' ORDER BY s_suppkey) FILTER (place <= 20) || CASE WHEN count(*) > 20 THEN ', ….' ELSE '.' END END AS line FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM ({_NN}), (SELECT avg(nd) AS m, stddev_pop(nd) AS s, count(*) AS n FROM ({_NN})) WHERE n >= 3 AND s > 1e-9 AND nd > m + 2 * s)")
def report_outliers(spark, d):
    return analysis.outlier_text(analysis.outliers(table(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]), "s_suppkey")


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'No variation in the data you mapped — there''s nothing here for either view to separate.'
  WHEN s_nationkey / 24.0 - 0.5 > 0.2 THEN 'Physics separates this data better than the best 2-axis view (' || printf('%.2f', floor(s_nationkey / 24.0 * 100 + 0.5) / 100) || ' vs 0.50) — these columns are doing joint work no single scatter plot shows.'
  ELSE 'No meaningful gain over a 2-axis view (silhouette ' || printf('%.2f', floor(s_nationkey / 24.0 * 100 + 0.5) / 100) || ' vs 0.50) — a scatter plot would show you the same thing.' END AS line,
  printf('%.1fs', floor(s_suppkey / 60.0 * 10 + 0.5) / 10) AS simulated FROM supplier""")
def report_verdicts(spark, d):
    n = F.col("s_nationkey")
    named = S.verdict(F.lit(0.5), n / 24.0, n % 5 != 0)
    return table(spark, d, "supplier").select("s_suppkey", S.verdict_text(named, F.lit(0.5), n / 24.0).alias("line"), S.step_seconds(F.col("s_suppkey")).alias("simulated"))


_QUOTAS = "SELECT o_orderpriority, count(*) AS stratum_rows, CAST(greatest(1, floor(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders) * 500 + 0.5)) AS BIGINT) AS quota FROM orders GROUP BY 1"


@query(_QUOTAS)
def stratum_quotas(spark, d):
    return sampling.stratum_quotas(table(spark, d, "orders"), "o_orderpriority", 500)


_ORDERED = Q.draws("orders", "o_orderkey, o_orderpriority", "11", "o_orderkey + 1")


@query(f"""SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN place <= quota THEN 0 ELSE 1 END, u, o_orderkey) AS n FROM (
  SELECT o.*, row_number() OVER (PARTITION BY o_orderpriority ORDER BY u, o_orderkey) AS place FROM ({_ORDERED}) o) JOIN ({_QUOTAS}) USING (o_orderpriority)) WHERE n <= 500""")
def stratified_sample_orders(spark, d):
    return sampling.stratified_sample(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 500, 11)


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY u, o_orderkey) AS n FROM ({_ORDERED})) WHERE n <= 300")
def simple_sample_orders(spark, d):
    return sampling.simple_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 300, 11)


@query(f"""SELECT event_id, regexp_full_match(props, '{Q.DATE}') AS is_date, lower(event_type) IN ('true', 'yes', 'y', 'false', 'no', 'n') AS is_boolean, floor(value * 100 + 0.5) / 100 AS rounded,
  CASE WHEN regexp_full_match(trim(CAST(user_id AS VARCHAR)), '{Q.NUMBER}') THEN TRY_CAST(user_id AS DOUBLE) END AS parsed FROM events""")
def scalar_predicates_events(spark, d):
    return table(spark, d, "events").select(
        "event_id", S.is_date_text(F.col("props")).alias("is_date"), S.is_boolean_text(F.col("event_type")).alias("is_boolean"), S.round_half_up(F.col("value"), 2).alias("rounded"),
        S.parse_number(F.col("user_id").cast("string")).alias("parsed"),
    )


_CASES = [" 12 ", "0x1F", "0b11", "0o17", "1e3", ".5", "5.", "-7", "1d", "1f", "NaN", "Infinity", "", "1e999", "abc", "1 2"]
_PARSED = ["12", "31", "3", "15", "1000", "0.5", "5", "-7", None, None, None, None, None, None, None, None]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', CAST({v or 'NULL'} AS DOUBLE))" for t, v in zip(_CASES, _PARSED)) + ") AS t(t, n)")
def parse_number_cases(spark, d):
    return spark.createDataFrame([(t,) for t in _CASES], "t string").select("t", S.parse_number(F.col("t")).alias("n"))


@query("""SELECT s_suppkey, CAST(floor((s_nationkey / 24.0) * (greatest(25, 1) - 1) + 0.5) AS BIGINT) AS code, greatest(2, least(s_nationkey, greatest(2, least(12, 99)))) AS k, round(1 - least(CAST(0.98 AS DOUBLE), 0.06 + s_nationkey * CAST(0.05 AS DOUBLE)), 6) AS damp,
  CASE WHEN s_nationkey % 4 = 0 THEN 'static' WHEN s_nationkey % 3 = 0 THEN 'webgpu' WHEN s_nationkey % 2 = 0 THEN 'webgl2' ELSE 'static' END AS profile,
  CASE WHEN s_nationkey % 4 <> 0 AND s_nationkey % 3 = 0 THEN 50000 ELSE 2000 END AS budget,
  CASE WHEN s_nationkey % 5 = 0 THEN 'insufficient-variance' WHEN s_nationkey / 24.0 - 0.5 > 0.2 THEN 'stronger' ELSE 'no-meaningful-gain' END AS verdict, CASE WHEN s_nationkey % 2 = 0 THEN 'raw' ELSE 'rank' END AS normalization FROM supplier""")
def scalar_rules_supplier(spark, d):
    n = F.col("s_nationkey")
    p = S.execution_profile(n % 4 == 0, n % 3 == 0, n % 2 == 0)
    return table(spark, d, "supplier").select(
        "s_suppkey", S.category_code(n / 24.0, F.lit(25)).alias("code"), S.clamp_k(n, F.lit(100)).alias("k"), r6(S.damping(n * 0.1), "damp"), p.alias("profile"), S.row_budget(p).alias("budget"),
        S.verdict(F.lit(0.5), n / 24.0, n % 5 != 0).alias("verdict"), S.default_normalisation(F.when(n % 2 == 0, "attraction").otherwise("mass")).alias("normalization"),
    )


@query("SELECT o_orderkey, 'tessella_seed' || o_custkey || '_step' || (o_orderkey % 900) || '_' || CASE WHEN o_orderstatus = 'F' THEN 'unstable' WHEN o_orderstatus = 'O' THEN 'settled' ELSE 'not-yet-settled' END || '.png' AS file_name FROM orders")
def export_filename(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", S.export_name(F.lit("tessella"), F.col("o_custkey"), F.col("o_orderkey") % 900, s == "F", s == "O").alias("file_name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, d):
    """The table as one text, tokenised by the table function, and cast back."""
    csv_text.register(spark)
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    body = csv_text.csv_lines(n.orderBy("n_nationkey")).agg(F.concat(F.lit("n_nationkey,n_name,n_regionkey\n"), F.array_join(F.collect_list("line"), "\n"), F.lit("\n")).alias("text"))
    body.createOrReplaceTempView("_csv_roundtrip")
    cells = spark.sql("SELECT t.* FROM _csv_roundtrip, LATERAL tokenize_text(text, ',') t WHERE t.row_idx > 0")
    return cells.select(F.get("cells", F.lit(0)).try_cast("int").alias("n_nationkey"), F.get("cells", F.lit(1)).alias("n_name"), F.get("cells", F.lit(2)).try_cast("int").alias("n_regionkey"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) || ',' || event_type || ',' || CASE WHEN regexp_matches(props, '["\\n,]') THEN '"' || replace(props, '"', '""') || '"' ELSE coalesce(props, '') END AS line FROM events""")
def csv_lines_events(spark, d):
    t = table(spark, d, "events")
    return t.select("event_id", F.concat_ws(",", F.col("event_id").cast("string"), F.col("event_type"), csv_text.cell_text(F.col("props"))).alias("line"))


@query("""SELECT n_name, printf('%08x', xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(n_name) + 1), lambda i: CAST(ascii(substr(n_name, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))))) AS crc FROM nation""")
def crc32_names(spark, d):
    return table(spark, d, "nation").select("n_name", S.crc32_hex(F.encode("n_name", "utf-8")).alias("crc"))


def _state_of(spark, d, name: str, columns: list[str], budget: int, layout_id: int = 0) -> api.Built:
    t = table(spark, d, name).select(*columns)
    key = F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))  # rows are told apart by their content
    return api.build(api.parse_and_infer(spark, t.withColumn("row_idx", key)), budget=budget)


def _lineitem(spark, d, budget: int = S.BUDGETS["static"]) -> api.Built:
    return _state_of(spark, d, "lineitem", LINEITEM, budget)


@query()
def settle_trace(spark, d):
    """Mean speed, diagonal and quiet run of the last steps before the fixpoint."""
    return settle.step_trace(_lineitem(spark, d).field)


@query()
def layout_report(spark, d):
    """The readable report of the settled layout: verdict, clusters with their defining columns, outliers."""
    b = _lineitem(spark, d)
    positions, gain, _ = api.run(b)
    k = gain.first()["k"]
    labels = scoring.kmeans_clusters(positions, ["x", "y"], k, analysis.ANALYSIS_SEED) if k else positions.select("row_idx", F.lit(0).alias("cluster")).limit(0)
    named = b.features.select("row_idx", *[F.col(f"raw_{i}").alias(c) for i, c in enumerate(b.columns)])
    return analysis.full_report(analysis.cluster_summary(named.join(labels, "row_idx"), "cluster", b.columns), gain, analysis.outliers(positions, "row_idx", ["x", "y"]))


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"""SELECT vec_id, round(list_sum(list_transform(list_zip(v, list_reverse(v)), lambda z: z[1] * z[2])), 4) + 0.0 AS dotted, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) AS length,
  round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 4) + 0.0 AS first, round(list_sum(v), 4) + 0.0 AS row_sum FROM (SELECT vec_id, {_V} AS v FROM embeddings)""")
def vector_operations(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    ones = F.array(F.transform("v", lambda x: F.lit(1.0)))
    return t.select("vec_id", r6(S.dot(F.col("v"), F.reverse("v")), "dotted", 4), r6(S.norm(F.col("v")), "length", 4), r6(S.normalised(F.col("v"))[0], "first", 4), r6(S.mat_vec(ones, F.col("v"))[0], "row_sum", 4))


@query("SELECT count(*) AS n_rows, count(DISTINCT (n_nationkey, n_name, n_regionkey)) AS n_streams FROM nation")
def row_streams(spark, d):
    """Rows of other content have other streams, equal ones the same."""
    t = table(spark, d, "nation")
    return t.agg(F.count("*").alias("n_rows"), F.count_distinct(S.row_stream("n_nationkey", "n_name", "n_regionkey")).alias("n_streams"))


@query("""SELECT * FROM (VALUES ('palmer-penguins', 'Palmer Penguins (real data)', 'supplied'), ('blobs-3-known', '3 known clusters (synthetic)', 'generated'), ('uncorrelated-random', 'Uncorrelated noise (synthetic)', 'generated')) AS t(id, label, origin)""")
def dataset_catalogue(spark, d):
    return generators.catalogue(spark).select("id", "label", "origin")


def _orders(spark, d) -> api.Outcome:
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_totalprice", "o_orderpriority")
    return api.Outcome("ready", t, profile.mapping(t.drop("row_idx")))


@query(f"""WITH s AS (SELECT o.* FROM orders o JOIN ({ORACLES['stratified_sample_orders']}) k USING (o_orderkey)), e AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code, count(*) OVER () AS k FROM s GROUP BY 1)
  SELECT o_orderkey AS row_idx, round(0.5 + 1.5 * {Q.rank('o_totalprice')}, 6) AS mass, round(2.0 * code / (k - 1.0) - 1, 6) + 0.0 AS charge FROM s JOIN e ON o_orderpriority = v""")
def sampled_field_orders(spark, d):
    """Rows are sampled to the budget first; ranks and codes are those of the rows shown."""
    return api.build(_orders(spark, d), budget=500, seed=11).field.select("row_idx", r6("mass", "mass"), r6("charge", "charge"))


@query()
def settle_layout(spark, d):
    """Positions at the fixpoint of a row-budget sample."""
    return settle.settle(_lineitem(spark, d).field)


@query()
def separation_gain(spark, d):
    return api.run(_lineitem(spark, d))[1]


@query()
def results_analysis(spark, d):
    return api.run(_lineitem(spark, d))[2]


@query()
def perturb_resettle(spark, d):
    b = _lineitem(spark, d)
    moved = checkpoint(settle.settle(b.field))
    one = moved.agg(F.min("row_idx")).first()[0]
    field = b.field.select("row_idx", "mass", "charge", "viscosity", "attraction")
    return settle.settle(settle.perturb(moved, one, 25.0, -25.0).drop("step", "converged", "unstable").join(field, "row_idx"))


@query()
def layout_image(spark, d):
    """One PNG of the settled layout with its settings inside."""
    b = _lineitem(spark, d)
    p = settle.settle(b.field).persist()
    odd = analysis.outliers(p, "row_idx", ["x", "y"]).select("row_idx", F.lit(True).alias("odd"))
    hue = b.field.select("row_idx", F.dense_rank().over(Window.partitionBy("layout_id").orderBy("charge")).alias("hue"))  # a row budget at most
    shown = layout.to_screen(p, layout.viewport(p, 640, 480)).join(odd, "row_idx", "left").join(hue, "row_idx")
    screen = export.coloured(shown, F.col("hue") - 1 if b.stratum else None, F.col("odd"))
    meta = export.metadata_json(F.lit(api.SEED), F.col("step"), F.col("converged"), F.col("unstable"), F.lit(b.shown), F.array(*map(F.lit, b.columns)))
    return export.images(screen.withColumn("metadata", meta), 640, 480)


_LAST30 = "SELECT t.*, (SELECT CASE WHEN count(*) = 30 THEN avg(speed) END FROM t AS u WHERE u.layout_id = t.layout_id AND u.place > t.place - 30 AND u.place <= t.place) AS ma FROM t"


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY layout_id ORDER BY step) AS place FROM ({_TRACE})), c AS (SELECT *, ma IS NOT NULL AND ma < 0.0015 * greatest(diagonal, 1.0) AS calm FROM ({_LAST30})),
  g AS (SELECT *, count(*) FILTER (NOT calm) OVER (PARTITION BY layout_id ORDER BY place) AS spell FROM c)
  SELECT layout_id, CAST(step AS INTEGER) AS step, count(*) FILTER (calm) OVER (PARTITION BY layout_id, spell ORDER BY place) AS quiet_run FROM g""")
def streaming_convergence(spark, d):
    """The detector as a stateful stream over the trace, written to the shared folder and read back."""
    known = table(spark, d, "events")
    many = "/events.parquet/" in known.inputFiles()[0]
    trace = spark.readStream.schema(known.schema).option("pathGlobFilter", "*.parquet" if many else "events.parquet").parquet(f"{d}/events.parquet" if many else d)
    stream = trace.select(F.col("user_id").alias("layout_id"), F.col("event_id").cast("int").alias("step"), F.col("value").alias("speed"), (20000.0 + (F.col("user_id") % 7) * 10000).alias("diagonal"))
    checkpoint(spark.range(1))  # makes sure that the shared folder is set
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    q = convergence.detect(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(convergence.OUTPUT).parquet(f"{base}/out").select("layout_id", "step", F.col("quiet_run").cast("long").alias("quiet_run"))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline on a row-budget sample: settled positions with the run's verdict."""
    positions, gain, _ = api.run(_lineitem(spark, d))
    return positions.join(F.broadcast(gain.select("pca2d_silhouette", "physics_silhouette", "k", "verdict")))
