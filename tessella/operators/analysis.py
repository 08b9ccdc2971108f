"""What a layout shows: clusters with their defining columns, outliers by nearest neighbour, and a readable report."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import range_text, verdict_text
from tessella.operators.pairs import block_pairs

# Fixed values
DEFINING_COLUMNS, OUTLIER_SIGMAS, SHOWN_OUTLIERS, ANALYSIS_SEED = 2, 2.0, 20, 20260809


def cluster_columns(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Per cluster and column: rows, mean, range, and how far its mean lies from that of all rows, in raw units."""
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    long = df.select(F.col(cluster).alias("cluster"), F.explode(cells).alias("c")).select("cluster", "c.*")
    per = long.groupBy("cluster", "ordinal", "name").agg(F.count("*").alias("size"), F.sum("value").alias("_s"), F.count("value").alias("_n"), F.min("value").alias("min"), F.max("value").alias("max"))
    whole = Window.partitionBy("ordinal")
    mean, overall = F.col("_s") / F.col("_n"), F.sum("_s").over(whole) / F.sum("_n").over(whole)
    return per.withColumn("mean", mean).withColumn("deviation", F.abs(mean - overall)).drop("_s", "_n")


def cluster_summary(df: DataFrame, cluster: str, columns: list[str], top: int = DEFINING_COLUMNS) -> DataFrame:
    """Clusters by descending size, each with its most deviating columns and their ranges."""
    ranked = cluster_columns(df, cluster, columns).withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("deviation"), "ordinal"))).where(F.col("_r") <= top)
    best = F.array_sort(F.collect_list(F.struct("_r", "name", "min", "max")))
    return ranked.groupBy("cluster").agg(F.max("size").alias("size"), F.transform(best, lambda x: F.struct(x["name"].alias("name"), x["min"].alias("min"), x["max"].alias("max"))).alias("defining_columns")).orderBy(F.desc("size"), "cluster")


def nearest_distances(df: DataFrame, key: str, columns: list[str], block: int = 2000) -> DataFrame:
    """(key, nearest_distance): distance of each row to its nearest other one, in blocks."""
    xs = [f"x{i}" for i in range(len(columns))]
    points = df.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(columns, xs)])

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, right, rid = [], b[xs].to_numpy(float), b["id"].to_numpy()
        for s in range(0, len(a), 256):
            part = a.iloc[s:s + 256]
            d2 = np.zeros((len(part), len(b)))
            for x, column in enumerate(xs):
                d2 += (part[column].to_numpy(float)[:, None] - right[None, :, x]) ** 2
            d2[part["id"].to_numpy()[:, None] == rid[None]] = np.inf
            out.append(np.sqrt(d2.min(1)))
        return pd.DataFrame({"id": a["id"].to_numpy(), "d": np.concatenate(out)})
    return block_pairs(points, "id", kernel, "id long, d double", block).groupBy(F.col("id").alias(key)).agg(F.min("d").alias("nearest_distance")).where(F.col("nearest_distance") < float("inf"))


def outliers(df: DataFrame, key: str, columns: list[str], sigmas: float = OUTLIER_SIGMAS) -> DataFrame:
    """Rows whose nearest neighbour is farther than the mean plus ``sigmas`` deviations; none for fewer than three rows or without spread."""
    d = nearest_distances(df, key, columns).persist()
    level = d.agg(F.count("*").alias("_n"), F.avg("nearest_distance").alias("_m"), F.stddev_pop("nearest_distance").alias("_s"))
    return d.join(F.broadcast(level)).where((F.col("_n") >= 3) & (F.col("_s") > 1e-9) & (F.col("nearest_distance") > F.col("_m") + sigmas * F.col("_s"))).select(key, "nearest_distance")


def results(positions: DataFrame, features: DataFrame, columns: list[str], k: int, seed: int = ANALYSIS_SEED) -> DataFrame:
    """One row: number of clusters, the clusters, and the outlying rows in order."""
    from tessella.operators.scoring import kmeans_clusters

    labels = kmeans_clusters(positions, ["x", "y"], k, seed)
    summary = cluster_summary(features.join(labels, "row_idx"), "cluster", columns)
    packed = summary.agg(F.count("*").alias("cluster_count"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("_o"), "cluster", "size", "defining_columns"))).alias("clusters"))
    packed = packed.withColumn("clusters", F.transform("clusters", lambda c: F.struct(c["cluster"].alias("index"), c["size"].alias("size"), c["defining_columns"].alias("defining_columns"))))
    odd = outliers(positions, "row_idx", ["x", "y"]).agg(F.array_sort(F.collect_list("row_idx")).alias("outlier_row_indices"))  # of a row budget at most
    return packed.join(odd)


def report(summary: DataFrame) -> DataFrame:
    """One line per cluster: its rows and the ranges of its defining columns (fixed wording)."""
    parts = F.transform("defining_columns", lambda c: F.concat(c["name"], F.lit(" "), range_text(c["min"], c["max"])))
    defined = F.when(F.size("defining_columns") > 0, F.concat(F.lit(" — defined by "), F.array_join(parts, ", "))).otherwise("")
    return summary.select("cluster", F.concat(F.col("size").cast("string"), F.lit(" rows"), defined).alias("line"))


def outlier_text(odd: DataFrame, key: str, shown: int = SHOWN_OUTLIERS) -> DataFrame:
    """One sentence: how many rows stand out and the first of them, counted from 1. Only ``shown`` rows leave their partitions."""
    first = odd.select(F.col(key).alias("i")).orderBy("i").limit(shown).agg(F.array_sort(F.collect_list("i")).alias("a"))
    both = odd.agg(F.count("*").alias("n")).join(F.broadcast(first))
    listed = F.array_join(F.transform("a", lambda i: F.concat(F.lit("row "), (i + 1).cast("string"))), ", ")
    many = F.concat(F.col("n").cast("string"), F.lit(" outlier row"), F.when(F.col("n") == 1, "").otherwise("s"), F.lit(": "), listed, F.when(F.col("n") > shown, ", …").otherwise(""), F.lit("."))
    return both.select(F.when(F.col("n") == 0, "No outliers — every row fits its cluster better than any other.").otherwise(many).alias("line"))


def full_report(summary: DataFrame, gain: DataFrame, odd: DataFrame, key: str = "row_idx") -> DataFrame:
    """(place, line): the verdict, the number of clusters, a line for each, the outliers."""
    head = gain.select(F.lit(0).cast("long").alias("place"), verdict_text(F.col("verdict"), F.col("pca2d_silhouette"), F.col("physics_silhouette")).alias("line"))
    count = summary.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(1).cast("long").alias("place"), F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " cluster").otherwise(" clusters"), F.lit(" found, largest first:")).alias("line"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "cluster"))  # one row per cluster
    lines = report(summary).join(summary.select("cluster", (rank + 1).cast("long").alias("place")), "cluster").select("place", "line")
    return head.unionByName(count).unionByName(lines).unionByName(outlier_text(odd, key).select(F.lit(1 << 40).alias("place"), "line"))
