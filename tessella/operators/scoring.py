"""Scores of a layout: two-axis projection, k-means, silhouette, and the gain of the layout over the projection."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.scalars import GAIN_THRESHOLD, VARIANCE_EPSILON
from tessella.operators.pairs import block_pairs

# Fixed values
METRIC_ROWS, RESTARTS, ITERATIONS, K_CHOICES, K_MOST = 2000, 5, 100, (2, 3, 4), 12


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, covariance) with n - 1, the upper triangle in one aggregate."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("covariance")) for i, j in pairs])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def principal_axes(df: DataFrame, columns: list[str]) -> dict:
    """Mean, the two leading axes and eigenvalues; only the d x d covariance reaches the driver."""
    d = len(columns)
    if not d:
        return {"mean": np.zeros(0), "axes": np.zeros((2, 0)), "values": np.zeros(2), "trace": 0.0}
    m = np.zeros((d, d))
    for r in covariance(df, columns).collect():
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["covariance"] or 0.0
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    values, vectors = np.linalg.eigh(m)
    axes, top = np.zeros((2, d)), np.zeros(2)
    for k in range(min(2, d)):
        axes[k], top[k] = vectors[:, d - 1 - k], max(0.0, values[d - 1 - k])
    return {"mean": np.array([means[c] or 0.0 for c in columns]), "axes": axes, "values": top, "trace": float(np.trace(m))}


def project(df: DataFrame, columns: list[str], axes: dict) -> DataFrame:
    """Adds pc1 and pc2; the second is 0 for a single column."""
    for k in (0, 1):
        terms = [(F.col(c) - float(axes["mean"][i])) * float(axes["axes"][k, i]) for i, c in enumerate(columns)]
        df = df.withColumn(f"pc{k + 1}", sum(terms, F.lit(0.0)))
    return df


def explained(axes: dict) -> float:
    return float(axes["values"].sum() / axes["trace"]) if axes["trace"] > 0 else 0.0


# k-means

def assign(points: DataFrame, centres: DataFrame, columns: list[str]) -> DataFrame:
    """Nearest centre of each point, the lower number on ties. ``centres`` (cluster and the columns) is a few rows."""
    c = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct("cluster", *[F.col(x).alias(f"c_{x}") for x in columns]))).alias("_centres")))
    d2 = lambda k: sum(((F.col(x) - k[f"c_{x}"]) * (F.col(x) - k[f"c_{x}"]) for x in columns), F.lit(0.0))
    best = F.array_min(F.transform("_centres", lambda k: F.struct(d2(k).alias("d2"), k["cluster"].alias("cluster"))))
    return points.join(c).withColumn("_best", best).withColumn("cluster", F.col("_best.cluster")).withColumn("squared_distance", F.col("_best.d2")).drop("_best", "_centres")


def update(assigned: DataFrame, centres: DataFrame, columns: list[str]) -> DataFrame:
    """Means of the clusters; an empty one keeps its centre."""
    new = assigned.groupBy("cluster").agg(*[F.avg(c).alias(f"n_{c}") for c in columns])
    return centres.join(new, "cluster", "left").select("cluster", *[F.coalesce(f"n_{c}", c).alias(c) for c in columns])


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, restarts: int = RESTARTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels, centres and inertia of the best of some k-means++ starts that share one random stream."""
    best = None
    k = max(1, min(k, len(points)))
    for _ in range(restarts):
        centres = points[[rng.integers(len(points))]]
        d = ((points - centres[0]) ** 2).sum(1)
        while len(centres) < k:
            i = rng.choice(len(points), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(points))
            centres = np.concatenate([centres, points[[i]]])
            d = np.minimum(d, ((points - points[i]) ** 2).sum(1))
        labels = None
        for _ in range(ITERATIONS):
            d2 = ((points[:, None] - centres[None]) ** 2).sum(2)
            near = d2.argmin(1)
            if labels is not None and (near == labels).all():
                break
            labels = near
            n = np.bincount(labels, minlength=k)
            means = np.stack([np.bincount(labels, points[:, j], minlength=k) for j in range(points.shape[1])], 1) / np.maximum(n, 1)[:, None]
            centres = np.where(n[:, None] > 0, means, centres)
        inertia = float(((points - centres[labels]) ** 2).sum())
        if best is None or inertia < best[2]:
            best = (labels, centres, inertia)
    return best


def silhouette_of(points: np.ndarray, labels: np.ndarray, tile: int = 512) -> float:
    """Mean Euclidean silhouette; a row alone in its cluster counts 1, one cluster or no rows 0."""
    names, own = np.unique(labels, return_inverse=True)
    if len(points) == 0 or len(names) < 2:
        return 0.0
    size, total = np.bincount(own), 0.0
    member = np.eye(len(names))[own]
    for s in range(0, len(points), tile):
        d = np.sqrt(((points[s:s + tile, None] - points[None]) ** 2).sum(2))
        sums = d @ member
        mine = own[s:s + tile]
        i = np.arange(len(mine))
        a = np.where(size[mine] > 1, sums[i, mine] / np.maximum(size[mine] - 1, 1), 0.0)
        other = sums / size[None]
        other[i, mine] = np.inf
        b = other.min(1)
        top = np.maximum(a, b)
        total += np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0).sum()
    return float(total / len(points))


def silhouette(df: DataFrame, key: str, columns: list[str], label: str, block: int = 2000) -> DataFrame:
    """One row with the silhouette of given labels, from block-wise sums of distances per (row, cluster)."""
    points = df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("string").alias("label"))
    xs = [f"x{i}" for i in range(len(columns))]

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = a[xs].to_numpy(float), b[xs].to_numpy(float)
        names, own = np.unique(b["label"].to_numpy(str), return_inverse=True)
        member = np.eye(len(names))[own]
        sums = np.concatenate([np.sqrt(np.maximum(((left[s:s + 256, None] - right[None]) ** 2).sum(2), 0)) @ member for s in range(0, len(left), 256)])
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), len(names)), "label": np.repeat(a["label"].to_numpy(), len(names)), "other": np.tile(names, len(a)), "total": sums.ravel()})
    sizes = points.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("size"))
    sums = block_pairs(points, "id", kernel, "id long, label string, other string, total double", block).groupBy("id", "label", "other").agg(F.sum("total").alias("total")).join(F.broadcast(sizes), "other")
    same = F.col("label") == F.col("other")
    per = sums.groupBy("id").agg(
        F.max(F.when(same, F.when(F.col("size") > 1, F.col("total") / (F.col("size") - 1)).otherwise(0.0))).alias("a"),
        F.min(F.when(~same, F.col("total") / F.col("size"))).alias("b"),
    )
    top = F.greatest("a", "b")
    s = F.when(F.col("b").isNull(), 0.0).when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return per.agg(F.count("*").alias("n"), F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette"))


def separation_gain(positions: DataFrame, features: DataFrame, columns: list[str], seed: int, k: int | None = None, stratum: str | None = None, threshold: float = GAIN_THRESHOLD, metric_rows: int = METRIC_ROWS) -> DataFrame:
    """One row: silhouettes of k-means on the two-axis projection and on the layout, k, verdict, and whether rows were sampled.

    ``positions``: row_idx, x, y. ``features``: row_idx, the normalised columns, and the stratum. The
    projection is fitted on all rows; the quadratic scores use at most ``metric_rows`` of them."""
    from tessella.operators.sampling import simple_sample, stratified_sample

    shape = "pca2d_silhouette double, physics_silhouette double, k int, verdict string, sampled boolean, n long"
    n = features.count()
    spread = features.agg(*[F.var_pop(c).alias(c) for c in columns]).first() if columns and n else None
    if n < 2 or not columns or all((spread[c] or 0.0) < VARIANCE_EPSILON for c in columns):
        return features.sparkSession.createDataFrame([(0.0, 0.0, 0, "insufficient-variance", False, n)], shape)
    if k is None and stratum is not None:
        found = features.agg(F.count_distinct(stratum)).first()[0]
        k = int(min(found, K_MOST)) if found >= 2 else None
    both = project(features, columns, principal_axes(features, columns)).join(positions.select("row_idx", "x", "y"), "row_idx")
    if n > metric_rows:
        both = stratified_sample(both, "row_idx", stratum, metric_rows, seed) if stratum else simple_sample(both, "row_idx", metric_rows, seed)

    def score(batches: pd.DataFrame) -> pd.DataFrame:
        pdf = batches.sort_values(["pc1", "pc2", "x", "y"], kind="stable")
        flat, moved = pdf[["pc1", "pc2"]].to_numpy(float), pdf[["x", "y"]].to_numpy(float)
        m = len(pdf)
        clamp = lambda v: max(2, min(v, max(2, min(K_MOST, m - 1))))
        choices = [clamp(k)] if k else sorted({clamp(v) for v in K_CHOICES})
        scored = [(silhouette_of(flat, kmeans(flat, v, np.random.default_rng(seed))[0]), v) for v in choices]
        pca, chosen = max(scored, key=lambda t: (t[0], -t[1]))
        physics = silhouette_of(moved, kmeans(moved, chosen, np.random.default_rng(seed))[0])
        return pd.DataFrame({"pca2d_silhouette": [pca], "physics_silhouette": [physics], "k": np.int32(chosen), "verdict": ["stronger" if physics - pca > threshold else "no-meaningful-gain"], "sampled": [n > metric_rows], "n": [n]})
    return both.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(score, shape)


def kmeans_clusters(positions: DataFrame, columns: list[str], k: int, seed: int, key: str = "row_idx") -> DataFrame:
    """(key, cluster) of k-means on a layout that fits one task, e.g. within a row budget."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*columns, key], kind="stable")
        return pd.DataFrame({key: pdf[key].to_numpy(), "cluster": kmeans(pdf[columns].to_numpy(float), k, np.random.default_rng(seed))[0].astype(np.int32)})
    return positions.select(key, *columns).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(one, f"{key} long, cluster int")
