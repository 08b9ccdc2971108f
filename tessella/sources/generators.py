"""Seeded tables whose every cell is an expression of its row number, so they are made in parallel and alike everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.scalars import gaussian, round_half_up, uniform_range

# Fixed values
CENTRES = [[0, 0, 0, 0, 0], [9, 9, -7, 4, 6], [-9, 7, 8, -5, -4]]
DEVIATION = 1.5


def _named(i: str = "id") -> Column:
    return F.concat(F.lit("row_"), (F.col(i) + 1).cast("string"))


def blobs(spark: SparkSession, seed: int, rows_per_cluster: int = 60) -> DataFrame:
    """Three gaussian groups in five dimensions; ``label`` is for checks only."""
    dims = len(CENTRES[0])
    t = spark.range(rows_per_cluster * len(CENTRES)).withColumn("_c", F.floor(F.col("id") / rows_per_cluster).cast("int"))
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in CENTRES])
    value = lambda d: round_half_up(F.get(F.get(centres, F.col("_c")), F.lit(d)) + DEVIATION * gaussian(F.lit(seed), 2 * (F.col("id") * dims + d) + 1), 4)
    return t.select(_named().alias("id"), *[value(d).alias(f"dim_{d + 1}") for d in range(dims)], F.concat(F.lit("cluster_"), (F.col("_c") + 1).cast("string")).alias("label"))


def noise(spark: SparkSession, seed: int, n: int = 180, dims: int = 5) -> DataFrame:
    """Uniform values in [-10, 10)."""
    return spark.range(n).select(_named().alias("id"), *[round_half_up(uniform_range(F.lit(seed), F.col("id") * dims + d + 1, -10.0, 10.0), 4).alias(f"dim_{d + 1}") for d in range(dims)])


def degenerate(spark: SparkSession, n: int = 40) -> DataFrame:
    return spark.range(n).select(_named().alias("id"), *[F.lit(5).alias(f"dim_{d}") for d in (1, 2, 3)], F.lit("only").alias("category"))


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(_named().alias("id"), F.lit(3.14).alias("dim_1"), F.lit(-2.71).alias("dim_2"), F.lit("solo").alias("category"))


def ids_only(spark: SparkSession, n: int = 40) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit("a-"), (i + 1).cast("string"), F.lit("-"), (1000 + 37 * i).cast("string")).alias("uuid_a"),
        F.concat(F.lit("b-"), (9999 - i).cast("string"), F.lit("-"), (91 * i + 7).cast("string")).alias("uuid_b"),
    )


def catalogue(spark: SparkSession) -> DataFrame:
    """Data sets that come along: id, label, description, and whether rows are generated here or supplied by the caller (a table or CSV of that schema)."""
    # Fixed values
    rows = [
        ("palmer-penguins", "Palmer Penguins (real data)", "342 penguins, 3 species, Palmer Station Antarctica LTER — CC0.", "supplied"),
        ("blobs-3-known", "3 known clusters (synthetic)", "Synthetic, generated for this demo — 3 seeded Gaussian clusters in 5 dimensions.", "generated"),
        ("uncorrelated-random", "Uncorrelated noise (synthetic)", "Synthetic, generated for this demo — deliberately structureless, tests the death-condition guard.", "generated"),
    ]
    return spark.createDataFrame(rows, "id string, label string, description string, origin string")


def load(spark: SparkSession, name: str, supplied: DataFrame | None = None) -> DataFrame:
    """A data set of the catalogue by id."""
    if name == "blobs-3-known":
        return blobs(spark, 1)
    if name == "uncorrelated-random":
        return noise(spark, 2)
    if name == "palmer-penguins" and supplied is not None:
        return supplied
    raise ValueError(f"no data set {name!r}, or its rows are not supplied")
