"""Exact-size samples by seeded order: simple, stratified, and to a row budget.

The order key of a row is its own draw of the seeded stream, so a sample does not depend on row
order or partitioning and no shuffle of the table by one task is needed. The top of a stratum is
cut by rank; Spark limits ranks below the shuffle, so a stratum that holds most rows sends only
its quota per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import uniform


def with_order(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("_order", uniform(F.lit(seed), F.col(key).cast("long") + 1))


def simple_sample(df: DataFrame, key: str, budget: int, seed: int) -> DataFrame:
    """All rows if they fit, else the ``budget`` first in seeded order."""
    return with_order(df, key, seed).orderBy("_order", key).limit(budget).drop("_order")


def stratum_quotas(df: DataFrame, stratum: str, budget: int) -> DataFrame:
    """Rows and quota of each stratum: its rounded share of the budget, at least one."""
    per = df.groupBy(stratum).agg(F.count("*").alias("stratum_rows"))
    total = per.agg(F.sum("stratum_rows").alias("_n"))
    share = F.col("stratum_rows") / F.col("_n") * F.lit(float(budget))
    return per.join(F.broadcast(total)).select(stratum, "stratum_rows", F.greatest(F.lit(1), F.floor(share + 0.5)).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, key: str, stratum: str, budget: int, seed: int) -> DataFrame:
    """Exactly ``budget`` rows (all if fewer): quotas by stratum, then trimmed or topped up in seeded order."""
    ordered = with_order(df, key, seed)
    same = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))  # noqa: E731  null is a stratum
    quotas = stratum_quotas(df.withColumn("_s", same(stratum)), "_s", budget)
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_order", key))
    # more than the budget of one stratum can never be used: ranks beyond it stop before the join
    ranked = ordered.withColumn("_s", same(stratum)).withColumn("_rank", rank).where(F.col("_rank") <= budget).join(F.broadcast(quotas), "_s")
    chosen_first = F.when(F.col("_rank") <= F.col("quota"), 0).otherwise(1)
    return ranked.withColumn("_late", chosen_first).orderBy("_late", "_order", key).limit(budget).drop("_s", "_rank", "_late", "_order", "stratum_rows", "quota")
