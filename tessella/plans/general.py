"""Queries of the general data-preparation operators (problems 1 and 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import fill_missing, reject_rows
from tessella.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_fills(spark, sf_dir).select("table_name", "row_key", "field_name")


def p1_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_missing.fill_observations(table(spark, sf_dir, "penguins"), table(spark, sf_dir, "column_mappings"))


def _parsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "raw_files")
    return reject_rows.parse_records(table(spark, sf_dir, "raw_rows"), files), files


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_rows.rejects(_parsed(spark, sf_dir)[0])


def p2_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_rows.typed_cells(*_parsed(spark, sf_dir))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of failing records per file and reason."""
    parsed, _ = _parsed(spark, sf_dir)
    return parsed.groupBy("file_id").agg(
        F.count("*").alias("n_records"),
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("quoting", "column_count", "invalid_value")],
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_fills, p2_found, p2_typed, p2_rates)}
ORACLES: dict[str, str] = {}
