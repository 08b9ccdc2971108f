"""Pack items of varying length into containers of fixed capacity, balancing their cost.

Method: cost-balanced packing. An item of n tokens costs ``linear * n + quadratic * n * n`` (the
second term is attention within the item). Items are taken in descending length; each goes to the
lowest-cost container that still has room, and a container is added when none has room. "Lowest cost with enough room" is one query on
a segment tree over remaining capacity whose leaves are heaps by cost.

Scale: items are dealt by key hash into shards of about ``shard_items``, each packed in one task,
so no task sees an unbounded group and each shard wastes at most a few containers' tails. Whole
capacities of longer items are cut off as full containers of their own before that, row by row.

Defined results: an item is split only if it exceeds the capacity, then into full containers and
one remainder that is packed like an item. Items without tokens (null, empty) are put into a
container as well and take no room. A null or non-positive capacity gets no containers. Repeated
container rows are separate containers to fill, told apart by ``container_copy``. Ties go to the smaller key.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Containers are a parameter list; more than this is not one.
MAX_CONTAINERS = 1000


# Cost of a token, and of a pair of tokens in one item.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def cost_of(n):  # noqa: ANN001, ANN201
    """Of an item with ``n`` tokens (an array or a column)."""
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC, slack: float = 0.005) -> np.ndarray:
    """Container number of each length (all at most ``capacity``, in descending order).

    Starts from as many containers as the tokens need. If more than ``slack`` above that are used
    in the end, it also starts from the items above half the capacity (no two of which fit
    together) and opens the rest on demand; the result with fewer containers holds."""
    least = max(1, -(-int(lengths.sum()) // capacity))
    out = pack_from(lengths, capacity, least, linear, quadratic)
    if len(out) and out.max() + 1 > (1 + slack) * least:
        other = pack_from(lengths, capacity, max(1, int((2 * lengths > capacity).sum())), linear, quadratic)
        out = min(out, other, key=np.max)
    return out


def pack_from(lengths: np.ndarray, capacity: int, opened: int, linear: float, quadratic: float) -> np.ndarray:
    """One greedy pass from ``opened`` containers; empty ones at the end are not numbered."""
    out = np.empty(len(lengths), np.int64)
    if not len(lengths):
        return out
    width = 1 << capacity.bit_length()  # leaves are remaining capacities 0..capacity
    none = (math.inf, -1)
    tree = [none] * (2 * width)
    heaps: dict[int, list] = {}

    def refresh(left: int) -> None:
        heap = heaps.get(left)
        node = left + width
        tree[node] = heap[0] if heap else none
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            small = a if a <= b else b
            if tree[node] == small:
                break
            tree[node] = small
            node >>= 1

    def best(least: int) -> tuple[float, int]:
        low, high, found = least + width, 2 * width, none
        while low < high:
            if low & 1:
                if tree[low] < found:
                    found = tree[low]
                low += 1
            low >>= 1
            high >>= 1
        return found

    heaps[capacity] = [(0.0, i) for i in range(opened)]
    refresh(capacity)
    room = [capacity] * opened
    for i, n in enumerate(lengths.tolist()):
        cost, at = best(n)
        if at < 0:
            cost, at = 0.0, opened
            opened += 1
            room.append(capacity)
        else:
            left = room[at]
            heappop(heaps[left])  # the leaf's first entry is the one found
            refresh(left)
        out[i] = at
        left = room[at] = room[at] - n
        heappush(heaps.setdefault(left, []), (cost + linear * n + quadratic * n * n, at))
        refresh(left)
    return np.unique(out, return_inverse=True)[1]


def pack_items(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens", shard_items: int = 20_000) -> DataFrame:
    """One row per piece: container kind and capacity, container key, item key, piece number, first token, tokens.

    ``items``: key and size. ``containers``: container_id, container_kind, capacity_tokens."""
    kinds = containers.select("container_id", "container_kind", "capacity_tokens").where("capacity_tokens > 0").limit(MAX_CONTAINERS + 1).collect()
    if len(kinds) > MAX_CONTAINERS:
        raise ValueError(f"more than {MAX_CONTAINERS} containers")
    key_type = dict(items.dtypes)[key]
    fields = f"container_id int, container_kind string, capacity_tokens int, container_copy int, container_key string, {key} {key_type}, piece_no int, first_token long, n_tokens long, cost double"
    if not kinds:
        return items.sparkSession.createDataFrame([], fields)
    shards = max(1, math.ceil(items.count() / shard_items))
    kinds = sorted(kinds, key=lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2]))
    copy = [sum(o[0] == r[0] for o in kinds[:i]) for i, r in enumerate(kinds)]  # rows of one id are told apart by number
    choices = F.array(*[F.struct(F.lit(r[0]).cast("int").alias("container_id"), F.lit(r[1]).alias("container_kind"), F.lit(int(r[2])).alias("capacity_tokens"), F.lit(c).alias("container_copy")) for r, c in zip(kinds, copy)])
    each = items.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), F.explode(choices).alias("c")).select(key, "size", "c.*")
    whole = F.floor(F.col("size") / F.col("capacity_tokens")).cast("int")
    rest = F.col("size") % F.col("capacity_tokens")
    full = (
        each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), whole))).where(F.col("piece_no") < whole)
        .select(
            "container_id", "container_kind", "capacity_tokens", "container_copy",
            F.concat(F.lit("full-"), F.col(key).cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_key"), key, "piece_no",
            (F.col("piece_no").cast("long") * F.col("capacity_tokens")).alias("first_token"), F.col("capacity_tokens").cast("long").alias("n_tokens"),
            cost_of(F.col("capacity_tokens").cast("double")).alias("cost"),
        )
    )
    parts = each.where((rest > 0) | (whole == 0)).select(
        "container_id", "container_kind", "capacity_tokens", "container_copy", F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), key, whole.alias("piece_no"),
        (whole.cast("long") * F.col("capacity_tokens")).alias("first_token"), rest.cast("long").alias("n_tokens"),
    )

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", key], ascending=[False, True], kind="stable")
        at = pack(pdf["n_tokens"].to_numpy(), int(pdf["capacity_tokens"].iloc[0]))
        pdf["container_key"] = [f"{s}-{a}" for s, a in zip(pdf["shard"], at)]
        pdf["cost"] = cost_of(pdf["n_tokens"].to_numpy(float))
        return pdf[["container_id", "container_kind", "capacity_tokens", "container_copy", "container_key", key, "piece_no", "first_token", "n_tokens", "cost"]]

    return full.unionByName(parts.groupBy("container_id", "container_copy", "capacity_tokens", "shard").applyInPandas(fill, fields))


def fill_rates(packed: DataFrame) -> DataFrame:
    """Per kind and copy: containers, pieces, tokens, the share of capacity used, and how evenly cost is spread over containers."""
    by = ("container_id", "container_kind", "capacity_tokens", "container_copy")
    per = packed.groupBy(*by, "container_key").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.sum("cost").alias("c"))
    return per.groupBy(*by).agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"),
        (F.sum("t") / (F.count("*") * F.first("capacity_tokens"))).alias("used_share"), F.avg("c").alias("mean_cost"), F.coalesce(F.stddev_pop("c"), F.lit(0.0)).alias("cost_deviation"), F.max("c").alias("most_cost"),
    )
