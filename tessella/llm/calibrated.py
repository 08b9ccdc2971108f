"""Samples whose category shares match given targets, with floors, and a report of unmet targets.

Method: the rows of each category are counted once per data set (map-side first). For every sample
the inclusion probabilities are calibrated by exponential tilting: probabilities
``p_c = min(1, d * exp(lambda_c))`` with the design probability d = wanted / rows, where Newton
iterations on the dual make ``rows_c * p_c`` meet the wanted rows of every category. The wanted
rows are the target shares of the sample size (scaled to it if the shares do not add to 1), raised
to the floors where the rows allow and lowered elsewhere, capped by the rows there are; what a
scarce category leaves goes to the others in proportion. Rows are then drawn with these
probabilities by the pivotal method: two undecided rows meet, one takes as much probability as it
can from the other, until all are decided, so sizes are exact.

Scale: the pivotal rounds run per block of about ``block`` rows within a category, each block
leaves at most one undecided row, and these meet in a second step; no task sees a whole data set.

Defined results
- categories are compared apart from case and surrounding blanks; rows with a null or blank
  category are in no target. Repeated target rows count once; if they differ, the largest share
  and floor hold. A null share is 0, a null floor is 0; negative ones count as 0.
- a null or negative sample size is 0; a sample without targets, or of an unknown data set, is
  empty, and each of its positive targets is reported.
- copies among the rows are rows of their own. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import small


def category(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), F.lit(""))


def wanted_rows(rows: np.ndarray, share: np.ndarray, floor: np.ndarray, size: float) -> np.ndarray:
    """Wanted rows per category: shares of the size, at least the floors, at most the rows, adding to the size where possible."""
    low = np.minimum(floor, rows)
    size = min(size, rows.sum())
    if low.sum() >= size > 0:  # floors alone fill the sample: they go before shares
        return low * (size / low.sum()) if low.sum() > size else low
    total = share.sum()
    goal = share / total * size if total > 0 else np.zeros_like(rows)
    out = np.clip(goal, low, rows)
    for _ in range(100):  # water-filling of what clipping leaves over or lacks
        gap = size - out.sum()
        if abs(gap) < 1e-9:
            break
        free = (out < rows - 1e-12) if gap > 0 else (out > low + 1e-12)
        base = np.where(free, np.maximum(goal if total > 0 else rows, 1e-12), 0.0)
        base[(share <= 0) & free & (gap > 0) & (base[share > 0].sum() > 0)] = 0.0
        if base.sum() <= 0:
            break
        out = np.clip(out + gap * base / base.sum(), low, rows)
    return out


def calibrate(rows: np.ndarray, wanted: np.ndarray, size: float, rounds: int = 60) -> tuple[np.ndarray, int]:
    """Inclusion probabilities per category from Newton iterations on the tilting dual, and the rounds they took."""
    if not rows.sum() or size <= 0:
        return np.zeros(len(rows)), 0
    design = min(1.0, size / rows.sum())
    alive = (wanted > 0) & (rows > 0)
    lam, step = np.zeros(len(rows)), 0
    for step in range(1, rounds + 1):
        p = design * np.exp(np.clip(lam, -50, 50))
        moment = rows * p - wanted  # gradient of the dual; the Hessian is diagonal, as categories are disjoint
        if np.abs(moment[alive]).max(initial=0.0) <= 1e-10 * max(1.0, size):
            break
        lam[alive] -= np.clip(moment[alive] / np.maximum(rows[alive] * p[alive], 1e-12), -4, 4)
    return np.where(alive, np.minimum(1.0, design * np.exp(lam)), 0.0), step


def pivotal(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Sequential pivotal method: 0 or 1 for each unit, at most one left undecided (its probability), the sum kept."""
    out = p.copy()
    at, held = -1, 0.0
    for i, x in enumerate(p.tolist()):
        if x <= 1e-12 or x >= 1 - 1e-12:
            out[i] = 0.0 if x <= 1e-12 else 1.0
            continue
        if at < 0:
            at, held = i, x
            continue
        total = held + x
        if total < 1:  # one of both ends with nothing
            if u[i] * total < x:
                out[at], at = 0.0, i
            else:
                out[i] = 0.0
            held = total
        else:  # one of both is taken
            if u[i] * (2 - total) < 1 - x:
                out[at], at = 1.0, i
            else:
                out[i] = 1.0
            held = total - 1
        if held <= 1e-12 or held >= 1 - 1e-12:
            out[at] = 0.0 if held <= 1e-12 else 1.0
            at, held = -1, 0.0
        else:
            out[at] = held
    return out


def targets_table(samples: DataFrame, targets: DataFrame, counts: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """One row per sample and target category: rows there are, wanted rows, inclusion probability, and whether a target cannot be met."""
    t = (
        targets.select("sample_id", "species", category(F.col("species")).alias("category"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("min_rows", F.lit(0)), F.lit(0)).alias("floor"))
        .groupBy("sample_id", "category").agg(F.min("species").alias("species"), F.max("share").alias("share"), F.max("floor").alias("floor"))
    )
    s = samples.select("sample_id", dataset, F.greatest(F.coalesce("shown", F.lit(0)), F.lit(0)).alias("size"), F.coalesce("seed", F.lit(0)).alias("seed"))
    joined = t.join(s, "sample_id").join(counts, [dataset, "category"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                n, share, floor = (np.array([x[k] for x in r.cells], float) for k in ("rows", "share", "floor"))
                want = wanted_rows(n, share, floor, float(r.size))
                p, _ = calibrate(n, want, float(r.size))
                yield pd.DataFrame({
                    "sample_id": r.sample_id, dataset: getattr(r, dataset), "seed": r.seed, "size": r.size, "category": [x["category"] for x in r.cells], "species": [x["species"] for x in r.cells],
                    "share": share, "floor": floor.astype(int), "rows": n.astype(int), "wanted": want, "probability": p,
                })
    cells = joined.groupBy("sample_id", dataset, "seed", "size").agg(F.array_sort(F.collect_list(F.struct("category", "species", "share", "floor", "rows"))).alias("cells"))
    solved = cells.mapInPandas(solve, f"sample_id long, {dataset} long, seed int, size long, category string, species string, share double, floor int, rows long, wanted double, probability double")
    need = F.col("share") * F.col("size")
    short = (F.col("rows") < need - 1e-9 * F.greatest(need, F.lit(1.0))) | (F.col("rows") < F.col("floor"))
    return solved.withColumn("unmet", short)


def draw(data: DataFrame, solved: DataFrame, key: str, name: str = "species", dataset: str = "dataset_id", block: int = 20_000) -> DataFrame:
    """The rows drawn: sample_id, key, category. Exact sizes per category up to rounding of the wanted rows."""
    cells = solved.where("probability > 0").select("sample_id", dataset, "seed", F.col("category"), "probability", F.greatest(F.lit(1), F.ceil(F.col("rows") / block)).cast("int").alias("blocks"))
    rows = data.select(F.col(key).alias("_key"), dataset, category(F.col(name)).alias("category")).where(F.col("category").isNotNull())
    mixed = F.xxhash64("_key", "sample_id", "seed")
    units = rows.join(small(cells), [dataset, "category"]).select("sample_id", "category", F.pmod(mixed, F.col("blocks")).cast("int").alias("part"), "_key", "probability", "blocks", F.xxhash64(F.lit(1), "_key", "sample_id", "seed").alias("h"), F.xxhash64(F.lit(2), "_key", "sample_id", "seed").alias("h2"))
    kind = dict(data.dtypes)[key]
    shape = f"sample_id long, category string, _key {kind}, h long, h2 long, p double"

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "_key"], kind="stable")
        u = (pdf["h2"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        pdf["p"] = pivotal(pdf["probability"].to_numpy(float), u)
        return pdf.loc[pdf["p"] > 0, ["sample_id", "category", "_key", "h", "h2", "p"]]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        """Undecided rows of all blocks of a sample, category by category, so that leftovers meet their own kind first."""
        pdf = pdf.sort_values(["category", "h", "_key"], kind="stable")
        u = (pdf["h"].to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
        p = pivotal(pdf["p"].to_numpy(float), u)
        left = (p > 0) & (p < 1)  # the sample's size is not whole: round at random
        p[left] = (u[left] < p[left]).astype(float)
        pdf["p"] = p
        return pdf.loc[pdf["p"] > 0.5, ["sample_id", "category", "_key", "h", "h2", "p"]]
    once = units.groupBy("sample_id", "category", "part").applyInPandas(decide, shape).persist()
    whole = once.where("p = 1.0")
    rest = once.where("p < 1.0").groupBy("sample_id").applyInPandas(settle, shape)
    return whole.unionByName(rest).select("sample_id", F.col("_key").alias(key), "category")


def calibrated_sample(data: DataFrame, samples: DataFrame, targets: DataFrame, key: str = "obs_id", name: str = "species", dataset: str = "dataset_id", **options) -> tuple[DataFrame, DataFrame]:
    """(rows drawn, target report)."""
    counts = data.select(dataset, category(F.col(name)).alias("category")).where(F.col("category").isNotNull()).groupBy(dataset, "category").agg(F.count("*").alias("rows"))
    solved = targets_table(samples, targets, counts, dataset).persist()
    return draw(data, solved, key, name, dataset, **options), solved
