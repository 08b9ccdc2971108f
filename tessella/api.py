"""Two-phase use: infer a mapping from any table, then build, settle, score and analyse it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import parse_number, row_stream
from tessella.operators import analysis, layout, normalize, profile, sampling, scoring, settle
from tessella.runtime import small
from tessella.sources import csv_text

#: Seed of headless runs.
SEED = 20260809


@dataclass
class Outcome:
    """``status``: ready, parse-error, empty or zero-usable-columns; then the message or the columns seen."""

    status: str
    table: DataFrame | None = None
    mapping: DataFrame | None = None
    message: str | None = None
    seen_columns: list | None = None


@dataclass
class Built:
    field: DataFrame
    features: DataFrame
    columns: list[str]
    stratum: str | None
    shown: int
    total: int

    @property
    def sampled(self) -> bool:
        return self.shown < self.total


def parse_and_infer(spark: SparkSession, source: str | DataFrame) -> Outcome:
    """From a text or a table to a mapping.

    Codes follow first appearance, so rows need an order: a table's ``row_idx``, or else the order of its content (a text's
    rows have their line order). Repeated rows of a table without ``row_idx`` are told apart by a running number."""
    if isinstance(source, str):
        got = csv_text.parse(source)
        if not got.ok:
            return Outcome("empty" if got.reason == "empty" else "parse-error", message=got.message)
        names = [h if got.headers.index(h) == i else f"{h}_{i}" for i, h in enumerate(got.headers)]
        table = spark.createDataFrame([(i, *r) for i, r in enumerate(got.rows)], "row_idx long, " + ", ".join(f"`{n}` string" for n in names))
    else:
        table = source if "row_idx" in source.columns else with_row_number(source)
    mapped = profile.mapping(table.drop("row_idx")).persist()
    state = profile.usable(mapped).first()
    if not state["is_usable"]:
        return Outcome("zero-usable-columns", table, mapped, message=state["message"], seen_columns=state["seen_columns"])
    return Outcome("ready", table, mapped)


def with_row_number(df: DataFrame, chunk: int = 65_536) -> DataFrame:
    """Adds ``row_idx`` from the content: 31 bits of its hash, then a number among the rows of that hash, so partitioning plays no part.

    Equal rows are counted map-side and written out again in chunks, so a content that holds much of the table is not one task's."""
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_n"))
    code = F.xxhash64(*[F.struct(F.lit(i), F.col(f"`{c}`")) for i, c in enumerate(df.columns)])
    t = counted.withColumn("_code", code).withColumn("_h", F.shiftrightunsigned("_code", 33))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_h").orderBy("_code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("_first", F.col("_h") * (1 << 32) + before).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / chunk).cast("int"))))
    t = t.repartition("_code", "_chunk")
    low = F.col("_chunk").cast("long") * chunk
    return t.withColumn("_k", F.explode(F.sequence(low, F.least(low + chunk, F.col("_n")) - 1))).select((F.col("_first") + F.col("_k")).alias("row_idx"), *[F.col(f"`{c}`") for c in df.columns])


def budget_sample(outcome: Outcome, budget: int, seed: int = SEED) -> tuple[DataFrame, int]:
    """The rows to lay out, and how many there are in all: proportional by the charge column's categories if there is one."""
    total = outcome.table.count()
    if total <= budget:
        return outcome.table, total
    charge = outcome.mapping.where("role = 'charge' and inferred_type <> 'numeric'").orderBy("ordinal").first()
    base = outcome.table.select("row_idx", *([F.col(f"`{charge['name']}`").cast("string").alias("stratum")] if charge else []))
    kept = sampling.stratified_sample(base, "row_idx", "stratum", budget, seed) if charge else sampling.simple_sample(base, "row_idx", budget, seed)
    # a row budget is a few thousand rows: the table is scanned once more and never shuffled
    return outcome.table.join(small(kept.select("row_idx")), "row_idx", "left_semi"), total


def build(outcome: Outcome, budget: int | None = None, seed: int = SEED) -> Built:
    """Samples to the budget first, then normalises and resolves the field from the rows that are shown."""
    rows = {r["name"]: r for r in outcome.mapping.orderBy("ordinal").collect()}
    t, total = budget_sample(outcome, budget, seed) if budget is not None else (outcome.table, outcome.table.count())
    t = t.select("row_idx", *[
        (parse_number(F.col(f"`{n}`").cast("string")) if r["inferred_type"] == "numeric" else F.col(f"`{n}`").cast("string")).alias(n) for n, r in rows.items()
    ]).persist()
    by: dict[str, list] = {}
    for r in rows.values():
        by.setdefault(r["role"], []).append(r)
    pick = lambda role: [(r["name"], r["normalization"]) for r in by.get(role, [])]
    charge = by.get("charge", [None])[0]
    category = charge is not None and charge["inferred_type"] != "numeric"
    spec = layout.FieldSpec(pick("mass"), pick("attraction"), charge["name"] if charge else None, category, pick("viscosity"), charge["normalization"] if charge else "rank")
    kinds = {n for n, r in rows.items() if r["inferred_type"] != "numeric"}
    field = layout.force_field(t, "row_idx", spec, kinds)
    used = [n for n, r in rows.items() if r["inferred_type"] == "numeric" and r["role"] in ("mass", "charge", "attraction", "viscosity")]
    features = t.select("row_idx", *[F.col(f"`{c}`").alias(f"raw_{i}") for i, c in enumerate(used)], *([F.col(f"`{charge['name']}`").alias("stratum")] if category else []))
    for i, c in enumerate(used):
        features = normalize.minmax_norm(features, f"raw_{i}", f"norm_{i}") if rows[c]["normalization"] == "raw" else normalize.rank_norm(features, f"raw_{i}", f"norm_{i}")
    content = t.select("row_idx", row_stream(*[F.col(f"`{c}`") for c in rows]).alias("stream"))
    placed = layout.place(field.join(content, "row_idx"), F.lit(seed), own_stream=F.col("stream")).drop("stream").withColumn("layout_id", F.lit(0).cast("long"))
    return Built(placed, features, used, "stratum" if category else None, min(total, budget or total), total)


def run(built: Built, seed: int = SEED, forces: layout.Forces = layout.Forces(), max_steps: int = 8000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(settled positions, gain row, analysis row)."""
    positions = settle.settle(built.field, forces, max_steps).persist()
    norms = [f"norm_{i}" for i in range(len(built.columns))]
    features = built.features.persist()
    gain = scoring.separation_gain(positions, features, norms, seed, stratum=built.stratum).persist()
    k = gain.first()["k"]
    named = features.select("row_idx", *[F.col(f"raw_{i}").alias(c) for i, c in enumerate(built.columns)])
    results = analysis.results(positions, named, built.columns, k) if k else gain.sparkSession.createDataFrame([], "cluster_count long, clusters array<struct<index:int,size:long,defining_columns:array<struct<name:string,min:double,max:double>>>>, outlier_row_indices array<long>")
    return positions, gain, results


def load_dataset(spark: SparkSession, source: str | DataFrame, seed: int = SEED) -> tuple[Outcome, tuple | None]:
    """All of it, without a row budget."""
    outcome = parse_and_infer(spark, source)
    return outcome, run(build(outcome, seed=seed), seed) if outcome.status == "ready" else None
