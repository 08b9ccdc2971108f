"""Column profiles, type and role inference, and the mapping that the layout is built from.

Any table is profiled in one melted pass: every value as text under its column's ordinal, then
partial aggregates per (column, value) and per column, so wide tables do not expand per distinct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import default_normalisation, is_boolean_text, is_date_text, parse_number

# Fixed values
NUMERIC_SHARE, ID_SHARE, MEAN_EPSILON = 0.9, 0.9, 1e-9
CHARGE_MIN, CHARGE_MAX = 2, 6
STRATEGY = "median-rank"
FORCE_ROLES = ["mass", "charge", "attraction", "viscosity", "spring-anchor"]


WHOLE, REAL, DAYS = ("tinyint", "smallint", "int", "bigint"), ("float", "double"), ("date", "timestamp", "timestamp_ntz")


def melt(df: DataFrame) -> DataFrame:
    """(ordinal, name, whole, real, value) of every cell: numbers stay numbers, dates are written with a T before the time, all else
    is text; blanks are null."""
    def cell(i: int, c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        text = F.translate(x.cast("string"), " ", "T") if kind in DAYS else x.cast("string")
        return F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("name"), (x.cast("long") if kind in WHOLE else F.lit(None).cast("long")).alias("whole"),
            (F.when(~F.isnan(x), x.cast("double")) if kind in REAL else F.lit(None).cast("double")).alias("real"),
            (F.lit(None).cast("string") if kind in WHOLE + REAL else F.when(F.trim(text) != "", text)).alias("value"),
        )
    return df.select(F.explode(F.array(*[cell(i, c, k) for i, (c, k) in enumerate(df.dtypes)])).alias("c")).select("c.*")


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: non-null, missing, exact distinct, numeric moments, and the tests that type inference needs.

    Text tests run once per distinct value, not per cell."""
    per_value = melt(df).groupBy("ordinal", "name", "whole", "real", "value").agg(F.count("*").alias("n"))
    n = F.col("n")
    known = F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("value").isNotNull()
    x = F.coalesce(F.col("whole").cast("double"), F.when(F.abs("real") < float("inf"), F.col("real")), parse_number(F.col("value")))
    rated = per_value.withColumn("x", x).persist()
    base = rated.groupBy("ordinal", "name").agg(
        F.coalesce(F.sum(F.when(known, n)), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("missing"),
        F.count_if(known).alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("x").isNotNull(), n)), F.lit(0)).alias("numeric_count"),
        F.bool_and(F.when(known, F.coalesce(is_boolean_text(F.col("value")), F.lit(False)))).alias("all_boolean"),
        F.bool_and(F.when(known, F.coalesce(is_date_text(F.col("value")), F.lit(False)))).alias("all_date"),
        F.sum(F.col("x") * n).alias("sx"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    mean = F.col("sx") / F.col("numeric_count")
    base = base.withColumn("mean", F.when(F.col("numeric_count") > 0, mean))
    # second pass over the few distinct values only: deviations from the mean keep the variance accurate
    spread = rated.where("x is not null").select("ordinal", "n", "x").join(base.select("ordinal", "mean"), "ordinal").groupBy("ordinal").agg(
        F.sum(n * (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))).alias("ss")
    )
    return base.join(spread, "ordinal", "left").select(
        "ordinal", "name", "non_null", "missing", "distinct_count", "numeric_count", "all_boolean", "all_date", "min", "max", "mean",
        F.when(F.col("numeric_count") > 0, F.sqrt(F.col("ss") / F.col("numeric_count"))).alias("sigma"),
    )


def inferred_type(p: DataFrame) -> Column:
    rows = p["non_null"] + p["missing"]
    return (
        F.when(p["non_null"] == 0, "categorical").when(p["all_boolean"], "boolean").when(p["all_date"], "date")
        .when(p["numeric_count"] / p["non_null"] > NUMERIC_SHARE, "numeric").when(p["distinct_count"] / rows >= ID_SHARE, "id-like").otherwise("categorical")
    )


def variation(p: DataFrame) -> Column:
    """Coefficient of variation; infinite for spread around zero, 0 without spread or with one value."""
    return (
        F.when(p["numeric_count"] <= 1, F.lit(0.0)).when(F.abs(p["mean"]) > MEAN_EPSILON, p["sigma"] / F.abs(p["mean"]))
        .when(p["sigma"] > 0, F.lit(float("inf"))).otherwise(0.0)
    )


def infer_types(df: DataFrame) -> DataFrame:
    p = column_profile(df)
    typed = p.withColumn("inferred_type", inferred_type(p))
    return typed.withColumn("variation", F.when(F.col("inferred_type") == "numeric", variation(typed)))


def infer_roles(typed: DataFrame) -> DataFrame:
    """Roles from a typed profile: the two most varied numeric columns carry mass and attraction, the first
    category of 2 to 6 values charge, the next one viscosity, ids label. One row per column, so one partition."""
    top = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.when((F.col("inferred_type") == "numeric") & (F.col("variation") < float("inf")), F.col("variation"))), "ordinal"))
    numeric = (F.col("inferred_type") == "numeric") & (F.col("variation") < float("inf"))
    category = F.col("inferred_type") == "categorical"
    whole = Window.partitionBy(F.lit(0))
    fits = category & F.col("distinct_count").between(CHARGE_MIN, CHARGE_MAX)
    one = typed.withColumn("_top", top).withColumn("_charge", F.min(F.when(fits, F.col("ordinal"))).over(whole))
    two = one.withColumn("_viscous", F.min(F.when(category & ~F.coalesce(F.col("ordinal") == F.col("_charge"), F.lit(False)), F.col("ordinal"))).over(whole))
    role = (
        F.when(F.col("inferred_type") == "id-like", "label").when(numeric & (F.col("_top") == 1), "mass").when(numeric & (F.col("_top") == 2), "attraction")
        .when(F.col("ordinal") == F.col("_charge"), "charge").when(F.col("ordinal") == F.col("_viscous"), "viscosity").otherwise("excluded")
    )
    return two.withColumn("role", role).drop("_top", "_charge", "_viscous")


def mapping(df: DataFrame) -> DataFrame:
    """Ordinal, name, type, role, normalisation and missing (count, strategy) of every column."""
    roles = infer_roles(infer_types(df))
    return roles.select(
        "ordinal", "name", "inferred_type", "role", default_normalisation(F.col("role")).alias("normalization"),
        F.struct(F.col("missing").alias("count"), F.lit(STRATEGY).alias("strategy")).alias("missing"), "distinct_count", "variation",
    )


def with_role(mapped: DataFrame, ordinal: int, role: str) -> DataFrame:
    """Sets a column's role; its normalisation falls back to the role's default."""
    at = F.col("ordinal") == ordinal
    return mapped.withColumn("normalization", F.when(at, default_normalisation(F.lit(role))).otherwise(F.col("normalization"))).withColumn("role", F.when(at, role).otherwise(F.col("role")))


def with_normalization(mapped: DataFrame, ordinal: int, kind: str) -> DataFrame:
    return mapped.withColumn("normalization", F.when(F.col("ordinal") == ordinal, kind).otherwise(F.col("normalization")))


def usable(mapped: DataFrame) -> DataFrame:
    """One row: whether any column carries a force, a message if none does, and for every column why it carries none (null: it does)."""
    carries = F.col("role").isin(FORCE_ROLES)
    reason = F.when(carries, F.lit(None).cast("string")).when(F.col("inferred_type") == "id-like", "high-cardinality / id-like — offered only as a row label").otherwise(
        F.concat(F.lit("inferred "), F.col("inferred_type"), F.lit(", not a usable force role")))
    seen = mapped.agg(
        F.coalesce(F.bool_or(carries), F.lit(False)).alias("is_usable"),
        F.array_sort(F.collect_list(F.struct("ordinal", "name", "inferred_type", "role", reason.alias("reason")))).alias("seen_columns"),
    )
    told = F.array_join(F.transform("seen_columns", lambda c: F.concat(c["name"], F.lit(": "), c["reason"])), "; ")
    return seen.withColumn("message", F.when(~F.col("is_usable"), told))


def force_columns(mapped: DataFrame) -> DataFrame:
    """Numeric columns with a force role: those that are scored and whose ranges are reported."""
    return mapped.where((F.col("inferred_type") == "numeric") & F.col("role").isin("mass", "charge", "attraction", "viscosity"))
