"""Feature encodings that hold at scale: tie-averaged ranks, min-max, ordinals in first-appearance order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import small

MISSING = 0.5


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def cumulative_counts(per_value: DataFrame, value: str, n: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``before``, the rows with a smaller value (within ``parts``).

    Without parts a global window would fall on one task. Values are range-partitioned instead:
    each partition adds up its own rows, the few partition totals are added up in order, and the
    sums meet by partition number."""
    if parts:
        return per_value.withColumn("before", F.coalesce(F.sum(n).over(Window.partitionBy(*parts).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranged = per_value.repartitionByRange(value).withColumn("_p", F.spark_partition_id()).persist()
    totals = ranged.groupBy("_p").agg(F.sum(n).alias("_t"), F.min(value).alias("_low"))
    offset = totals.withColumn("_o", F.coalesce(F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    inner = F.coalesce(F.sum(n).over(Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_i", inner).join(F.broadcast(offset), "_p").withColumn("before", F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def rank_norm(df: DataFrame, column: str, out: str, *parts: str) -> DataFrame:
    """Percentile rank with ties averaged; missing and single values are 0.5. Works on distinct values, which are joined back."""
    x = df.withColumn("_x", _finite(column))
    per = x.where("_x is not null").groupBy(*parts, "_x").agg(F.count("*").alias("_n"))
    counted = cumulative_counts(per, "_x", "_n", parts)
    if parts:
        total = F.sum("_n").over(Window.partitionBy(*parts))
        ranks = counted.withColumn("_m", total)
    else:
        ranks = counted.join(F.broadcast(per.agg(F.sum("_n").alias("_m"))))
    ranks = ranks.select(*parts, "_x", F.when(F.col("_m") > 1, (F.col("before") + (F.col("_n") - 1) / 2.0) / (F.col("_m") - 1)).otherwise(MISSING).alias(out))
    return x.join(small(ranks), [*parts, "_x"], "left").withColumn(out, F.coalesce(out, F.lit(MISSING))).drop("_x")


def minmax_norm(df: DataFrame, column: str, out: str) -> DataFrame:
    """Position between minimum and maximum; constant columns and missing values are 0.5."""
    x = _finite(column)
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    placed = F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.join(F.broadcast(ends)).withColumn(out, F.coalesce(placed, F.lit(MISSING))).drop("_lo", "_hi")


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values with codes in order of first appearance, and their number."""
    first = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_first"))
    return first.select("value", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first", "value")) - 1).cast("long").alias("code"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("categories"))


def encode_categorical(df: DataFrame, column: str, order: str, prefix: str = "") -> DataFrame:
    """Adds ``encoded`` in [0, 1] and ``charge`` in [-1, 1]; missing and single categories are neutral."""
    d = dictionary(df, column, order)
    many = F.col("categories") > 1
    coded = d.select(F.col("value").alias("_v"), F.col("code").alias(f"{prefix}code"), F.when(many, F.col("code") / (F.col("categories") - 1)).otherwise(MISSING).alias(f"{prefix}encoded"), F.when(many, 2.0 * F.col("code") / (F.col("categories") - 1) - 1).otherwise(0.0).alias(f"{prefix}charge"))
    out = df.join(small(coded), F.col(column) == F.col("_v"), "left").drop("_v")
    return out.withColumn(f"{prefix}encoded", F.coalesce(f"{prefix}encoded", F.lit(MISSING))).withColumn(f"{prefix}charge", F.coalesce(f"{prefix}charge", F.lit(0.0)))
