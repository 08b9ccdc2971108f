"""Queries of the corpus operators; each runs over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, calibrated, clustering, moderation, neighbours, packing
from tessella.runtime import table


DIMS = [f"dim_{i}" for i in range(1, 6)]


def _clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, rows = clustering.fit(table(spark, sf_dir, "blobs"), "point_id", dict.fromkeys(DIMS, 1.0))
    return clustering.assignments(rows, clusters, "point_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probed pairs whose rows are in the same group."""
    groups = _clustered(spark, sf_dir).where("group_no is not null").select("point_id", "group_no")
    probes = table(spark, sf_dir, "similarity_probes").select("point_a", "point_b")
    a = groups.select(F.col("point_id").alias("point_a"), F.col("group_no").alias("group_a"))
    b = groups.select(F.col("point_id").alias("point_b"), F.col("group_no").alias("group_b"))
    return probes.join(a, "point_a").join(b, "point_b").where("group_a = group_b").select("point_a", "point_b").distinct()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.describe(_clustered(spark, sf_dir).persist(), "point_id")


def p3_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir)


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return calibrated.calibrated_sample(*(table(spark, sf_dir, t) for t in ("penguins", "sample_infos", "sample_targets")))


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[0]


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with the rows drawn, the share reached and whether it could not be met."""
    drawn, solved = _sampled(spark, sf_dir)
    got = drawn.groupBy("sample_id", "category").agg(F.count("*").alias("drawn"))
    return solved.join(got, ["sample_id", "category"], "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).drop("probability", "seed")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir)[1].where("unmet").select("sample_id", "species")


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(table(spark, sf_dir, "blobs"), "point_id", DIMS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(p5_neighbours(spark, sf_dir), "point_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = bpe.count_tokens(table(spark, sf_dir, "documents"))
    return packing.pack_items(counted.persist(), table(spark, sf_dir, "containers"))


def p7_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_rates(p7_packed(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = moderation.fit_model(table(spark, sf_dir, "moderation_examples"), documents)
    return moderation.score_texts(documents, model, extra=("source",))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("score >= 0.5").select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.source_rates(_scored(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p3_found, p3_groups, p3_assignments, p4_found, p4_sample, p4_report, p5_found, p5_neighbours, p6_ids, p7_packed, p7_fill_rates, p8_found, p8_scores, p8_source_rates)}
ORACLES: dict[str, str] = {}
