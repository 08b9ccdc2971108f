"""The k most similar vectors of every vector, by an inverted file with product-quantised residuals.

Method: equal vectors are taken once (with the smallest ids of their copies). Coarse centroids and
the codebooks of residuals are fitted on at most ``train_limit`` vectors in hash order; every
vector is then put into the list of its nearest centroid with its residual's codes. The queries of
a list meet the members of the ``probes`` nearest lists in one task: asymmetric distances to the
members' codes bound each query's k-th distance, and every member that the bound and the error of
the codes leave open is reranked by exact distance.

A second round makes the result whole: the distance from a query to the plane between its centroid
and another one (or to the other list's ball) bounds the distance to all members of that list, and
every list whose bound is below the query's k-th distance so far is searched as well.

Scale: lists hold about ``per_list`` vectors up to ``max_lists`` lists; queries of a long list are
split into blocks; nothing is sent to the driver but the sample, list sizes and radii. A group of
copies costs one search; its rows are expanded by joins afterwards.

Defined results
- only rows with all dimensions finite take part. Distance is Euclidean, ties go to the smaller id.
- copies are rows of their own, at distance 0 of each other; a row is never its own neighbour.
- fewer than k other rows: as many as there are. An empty table gives no rows.
- ids are taken to be unique; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import small, widen


def lloyd(points: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means; in one dimension it starts half from quantiles and half from an even grid, so that the tails are coded well."""
    rng = np.random.default_rng(seed)
    if points.shape[1] == 1 and len(points) > k:
        low, high = np.quantile(points, [0.002, 0.998])
        centres = np.sort(np.concatenate([np.quantile(points, np.linspace(0, 1, k // 2)), np.linspace(low, high, k - k // 2)]))[:, None]
    else:
        centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = _codeword(points, centres)
        n = np.bincount(near, minlength=len(centres))
        for j in range(points.shape[1]):
            t = np.bincount(near, points[:, j], minlength=len(centres))
            centres[:, j] = np.where(n > 0, t / np.maximum(n, 1), centres[:, j])
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point and the distance, in blocks."""
    at, d = np.empty(len(points), np.int64), np.empty(len(points))
    norm = (centres * centres).sum(1)
    for s in range(0, len(points), 4096):
        x = points[s:s + 4096]
        at[s:s + 4096] = (norm[None] - 2 * x @ centres.T).argmin(1)
        d[s:s + 4096] = np.sqrt(((x - centres[at[s:s + 4096]]) ** 2).sum(1))
    return at, d


@dataclass
class Index:
    """Coarse centroids, codebooks of residual sub-vectors, and per list its size and radius."""

    centres: np.ndarray
    books: list[np.ndarray]  # per sub-space: codewords x its width
    parts: list[slice]
    count: np.ndarray | None = None
    radius: np.ndarray | None = None

    @classmethod
    def train(cls, sample: np.ndarray, lists: int, sub: int = 1, words: int = 256, seed: int = 1) -> Index:
        centres = lloyd(sample, lists, 8, seed)
        residual = sample - centres[nearest(sample, centres)[0]]
        parts = [slice(s, min(s + sub, sample.shape[1])) for s in range(0, sample.shape[1], sub)]
        return cls(centres, [lloyd(residual[:, p], words, 12, seed + 1) for p in parts], parts)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = x - self.centres[lists]
        return np.stack([_codeword(residual[:, p], b).astype(np.uint8) for p, b in zip(self.parts, self.books)], 1)

    def decode(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return self.centres[lists] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)

    def search(self, q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, codes: np.ndarray, lists: np.ndarray, k: int, home: int | None = None, worst: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the k nearest members other than the query itself (-1: none) and their distances; members are sorted by list.

        Asymmetric distances, from queries to members as coded, come from one product a list. Those in the queries' own list ``home``
        (or ``worst``, where it is known) bound the k-th distance; a member whose code is farther than the bound and its own code error
        cannot be among the k nearest, all others are reranked by exact distance. Lists that lie behind the bound are left out."""
        best, dist = np.full((len(q), k), -1), np.full((len(q), k), np.inf)
        edge = np.flatnonzero(np.diff(lists, prepend=-1, append=-1)) if len(x) else np.zeros(1, int)
        spans = {int(lists[s]): (s, z) for s, z in zip(edge[:-1], edge[1:])}
        coded = {}
        for l, (s, z) in spans.items():
            local = self.decode(codes[s:z], lists[s:z]) - self.centres[l]
            error = np.sqrt(((x[s:z] - self.centres[l] - local) ** 2).sum(1)) * (1 + 1e-9)
            norm = (local * local).sum(1)
            coded[l] = np.concatenate([-2 * local.T, norm[None]]), np.concatenate([-2 * local.T, (norm - error * error)[None], -2 * error[None]]), error, norm.max()

        def relative(part: np.ndarray, l: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Queries as seen from a list's centroid, their squared norms, and what rounding can make of a distance."""
            own = part - self.centres[l]
            norm = (own * own).sum(1)
            return own, norm, 1e-13 * (norm + coded[l][3])
        step = max(16, 4_000_000 // max(len(x), 1))
        for s in range(0, len(q), step):
            part, ids = q[s:s + step], q_id[s:s + step]
            bound = np.full(len(part), np.inf) if worst is None else worst[s:s + step].astype(float)
            if home in spans and worst is None and spans[home][1] - spans[home][0] > k + 1:
                own, norm, off = relative(part, home)
                most = np.sqrt(np.maximum(np.column_stack([own, np.ones(len(own))]) @ coded[home][0] + (norm + off)[:, None], 0)) + coded[home][2]
                bound = np.partition(most, k, axis=1)[:, k]
            bound = np.minimum(bound * (1 + 1e-9), 1e100)
            rows, cols = [], []
            for l, (a, z) in spans.items():
                at = np.arange(len(part)) if home is None or l == home else np.flatnonzero(self._may_hold(part, home, bound, np.array([l]))[:, 0])
                if len(at):
                    own, norm, off = relative(part[at], l)
                    row, col = np.nonzero(np.column_stack([own, np.ones(len(at)), bound[at]]) @ coded[l][1] <= (bound[at] ** 2 + off - norm)[:, None])  # coded distance within bound and error
                    rows.append(at[row])
                    cols.append(col + a)
            if not rows:
                continue
            row, col = np.concatenate(rows), np.concatenate(cols)
            other = x_id[col] != ids[row]
            row, col = row[other], col[other]
            d = np.zeros(len(row))
            for j in range(q.shape[1]):
                d += (x[col, j] - part[row, j]) ** 2
            d = np.sqrt(d)
            order = np.lexsort((x_id[col], d, row))
            row, col, d = row[order], col[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row]
            first = place < k
            best[s + row[first], place[first]], dist[s + row[first], place[first]] = col[first], d[first]
        return best, dist

    def _may_hold(self, q: np.ndarray, home: int, worst: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Whether (queries x lists) a list could hold a vector within ``worst``: by the plane between its centroid and ``home``'s, and by its ball."""
        c = self.centres[lists]
        gap = np.sqrt(np.maximum(((c - self.centres[home]) ** 2).sum(1), 1e-24))
        from_home = ((q - self.centres[home]) ** 2).sum(1)
        away = np.sqrt(from_home)
        d2 = from_home[:, None] + (gap * gap)[None] - 2 * (q - self.centres[home]) @ (c - self.centres[home]).T
        limit = (worst * (1 + 1e-8) + 1e-9 * (1 + away))[:, None]
        slack = 1e-12 * (from_home[:, None] + (gap * gap)[None])
        return (d2 - slack <= 2 * gap[None] * limit + from_home[:, None]) & (d2 - slack <= (limit + self.radius[lists][None]) ** 2)

    def open_lists(self, q: np.ndarray, home: int, worst: np.ndarray, searched: np.ndarray) -> list[np.ndarray]:
        """For each query of list ``home`` the lists, other than those ``searched``, that could hold a vector within ``worst``."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        left = self.count > 0
        left[searched] = False
        left = np.flatnonzero(left)
        half = np.sqrt(((self.centres[left] - self.centres[home]) ** 2).sum(1)) / 2
        near = np.argsort(half, kind="stable")
        left, half = left[near], half[near]
        need = (worst + np.sqrt(((q - self.centres[home]) ** 2).sum(1))) * (1 + 1e-7) + 1e-8  # a plane is half its gap from home's centroid
        order = np.argsort(need, kind="stable")
        for s in range(0, len(q), 256):  # queries that see alike far
            at = order[s:s + 256]
            cols = left[:np.searchsorted(half, need[at[-1]], "right")]
            if len(cols):
                row, col = np.nonzero(self._may_hold(q[at], home, worst[at], cols))
                for i, own in zip(at, np.split(cols[col], np.searchsorted(row, np.arange(1, len(at))))):
                    out[i] = own
        return out


def _codeword(values: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Number of the nearest codeword; by bisection in one dimension."""
    if book.shape[1] > 1:
        return nearest(values, book)[0]
    order = np.argsort(book[:, 0], kind="stable")
    sorted_ = book[order, 0]
    return order[np.searchsorted((sorted_[1:] + sorted_[:-1]) / 2, values[:, 0])]


def _matrix(t: pa.Table, dims: list[str]) -> np.ndarray:
    return np.stack([t.column(d).to_numpy() for d in dims], 1) if t.num_rows else np.zeros((0, len(dims)))


def _codes(t: pa.Table, m: int) -> np.ndarray:
    col = t.column("codes").combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, m)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in values])]), pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _flat(best: np.ndarray, dist: np.ndarray, members: pa.Table, k: int) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids and distances of the k nearest rows from those of the k nearest vectors, copies included."""
    ids = members.column("ids").combine_chunks() if members.num_rows else pa.array([], pa.list_(pa.int64()))
    vid = members.column("vid").to_numpy() if members.num_rows else np.zeros(0, np.int64)
    copies = pc.list_value_length(ids).to_numpy(zero_copy_only=False) if members.num_rows else np.zeros(0, int)
    if not members.num_rows:
        return _lists([np.zeros(0)] * len(best), pa.int64()), _lists([np.zeros(0)] * len(best), pa.float64())
    kept = best >= 0
    size = kept.sum(1)
    out_i, out_d = vid[np.maximum(best, 0)], dist
    has = ((copies[np.maximum(best, 0)] > 1) & kept).any(1)
    if has.any():
        out_i, out_d = out_i.copy(), dist.copy()
        for r in np.flatnonzero(has):
            own = best[r][best[r] >= 0]
            rows = sorted((float(dist[r, c]), i) for c, o in enumerate(own) for i in ids[int(o)].as_py()[:k])[:k]
            size[r] = len(rows)
            out_i[r, :len(rows)], out_d[r, :len(rows)] = [i for _, i in rows], [d for d, _ in rows]
    full = np.arange(best.shape[1]) < size[:, None]
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(out_i[full], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(out_d[full], pa.float64()))


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that two uses of one table can meet."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def nearest_rows(df: DataFrame, key: str, dims: list[str], k: int = 5, per_list: int = 300, max_lists: int = 3000, probes: int = 16, train_limit: int = 60_000, block: int = 2048) -> DataFrame:
    """``key`` and ``neighbours`` (ids, nearest first) of every row with all dimensions."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), *[(F.col(d).cast("double") + F.lit(0.0)).alias(d) for d in dims])
    rows = rows.where(" and ".join(f"{d} is not null and not isnan({d}) and abs({d}) < double('Infinity')" for d in dims))
    rank = F.row_number().over(Window.partitionBy(*dims).orderBy("id"))
    firsts = rows.withColumn("_rank", rank).where(F.col("_rank") <= k + 1)
    heads = firsts.groupBy(*dims).agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("vid", F.col("ids")[0])
    heads = widen(heads.select("vid", "ids", *dims)).persist()
    schema_out = f"{key} long, neighbours array<long>"
    n = heads.count()
    if not n:
        return spark.createDataFrame([], schema_out)
    sample = heads.select(*dims, "vid").orderBy(F.xxhash64("vid"), "vid").limit(train_limit).select(*dims).toPandas().to_numpy(float)
    index = Index.train(sample, int(np.clip(n // per_list, 1, max_lists)))
    m, nlist = len(index.books), len(index.centres)

    def assign(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            x = _matrix(t, dims)
            at, d = nearest(x, index.centres)
            codes = index.encode(x, at)
            raw = codes.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(at, pa.int32()), pa.array(d), pa.array([raw[i * m:(i + 1) * m] for i in range(len(at))], pa.binary())],
                names=[*b.schema.names, "list", "radius", "codes"],
            )
    fields = "vid long, ids array<long>, " + ", ".join(f"{d} double" for d in dims)
    indexed = heads.mapInArrow(assign, fields + ", list int, radius double, codes binary").persist()
    index.count, index.radius = np.zeros(nlist, np.int64), np.zeros(nlist)
    for r in indexed.groupBy("list").agg(F.count("*").alias("n"), F.max("radius").alias("r")).collect():
        index.count[r["list"]], index.radius[r["list"]] = r["n"], r["r"]
    norm = (index.centres**2).sum(1)
    apart = norm[:, None] - 2 * index.centres @ index.centres.T + norm[None]
    apart[:, index.count == 0] = np.inf
    np.fill_diagonal(apart, -1)
    near = np.argsort(apart, 1)[:, :min(probes, nlist)]
    del apart
    blocks = np.maximum(1, -(-index.count // block))
    edges = pd.DataFrame([(int(b), int(a), t) for a in np.flatnonzero(index.count) for t in range(blocks[a]) for b in near[a]], columns=["list", "home", "part"])
    edges = spark.createDataFrame(edges, "list int, home int, part int")
    block_of = spark.createDataFrame(pd.DataFrame({"list": np.arange(nlist), "blocks": blocks}), "list int, blocks int")
    queries = indexed.join(small(block_of), "list").select(F.col("list").alias("home"), F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int").alias("part"), "vid", "ids", *dims)
    members = indexed.drop("radius").join(small(edges), "list")

    def first(q: pa.Table, x: pa.Table) -> pa.Table:
        order = np.argsort(x.column("list").to_numpy(), kind="stable") if x.num_rows else np.zeros(0, int)
        x = x.take(pa.array(order))
        v, qid = _matrix(q, dims), q.column("vid").to_numpy()
        home = int(q.column("home")[0].as_py()) if q.num_rows else -1
        best, dist = index.search(v, qid, _matrix(x, dims), x.column("vid").to_numpy(), _codes(x, m), x.column("list").to_numpy().astype(np.int64), k, home)
        ids, d = _flat(best, dist, x, k)
        more = _lists([o.astype(np.int32) for o in index.open_lists(v, home, dist[:, k - 1], near[home])] if len(v) else [], pa.int32())
        return pa.table([q.column("vid"), q.column("ids"), *(q.column(c) for c in dims), ids, d, more], names=["vid", "ids", *dims, "found", "far", "more"])

    shape = fields + ", found array<long>, far array<double>, more array<int>"
    one = _fresh(queries).groupBy("home", "part").cogroup(members.groupBy("home", "part")).applyInArrow(first, shape).persist()
    worst = F.when(F.size("far") < k, float("inf")).otherwise(F.array_max("far")).alias("worst")
    asked = one.where(F.size("more") > 0).select("vid", *dims, worst, F.explode("more").alias("list"))
    # only lists that are asked are sent again, in as many copies as their queries need tasks
    need = asked.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).persist()
    asked = asked.join(small(need), "list").select("vid", *dims, "worst", "list", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int").alias("part"))
    again = indexed.drop("radius").join(small(_fresh(need)), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def second(q: pa.Table, x: pa.Table) -> pa.Table:
        best, dist = index.search(_matrix(q, dims), q.column("vid").to_numpy(), _matrix(x, dims), x.column("vid").to_numpy(), _codes(x, m), x.column("list").to_numpy().astype(np.int64), k, worst=q.column("worst").to_numpy())
        ids, d = _flat(best, dist, x, k)
        return pa.table([q.column("vid"), ids, d], names=["vid", "found", "far"])

    two = _fresh(asked).groupBy("list", "part").cogroup(again.groupBy("list", "part")).applyInArrow(second, "vid long, found array<long>, far array<double>")
    pairs = F.arrays_zip(F.col("far"), F.col("found"))
    open_ = one.where(F.size("more") > 0)
    merged = (
        open_.select("vid", pairs.alias("p")).unionByName(two.select("vid", pairs.alias("p")))
        .groupBy("vid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
        .join(open_.select("vid", "ids"), "vid").select("vid", "ids", F.transform("p", lambda x: x["found"]).alias("others"))
    )
    done = one.where(F.size("more") == 0).select("vid", "ids", F.col("found").alias("others")).unionByName(merged)
    # rows: each of the first copies sees the other copies, then the other vectors' rows
    listed = done.select("ids", "others", F.explode("ids").alias("id")).select("id", F.slice(F.concat(F.array_remove("ids", F.col("id")), "others"), 1, k).alias("neighbours"))
    crowded = heads.where(F.size("ids") > k).select("ids", *dims)
    rest = rows.join(crowded, dims).where(~F.array_contains("ids", F.col("id"))).select("id", F.slice("ids", 1, k).alias("neighbours"))
    return listed.unionByName(rest).withColumnRenamed("id", key)


def neighbour_pairs(neighbours: DataFrame, key: str) -> DataFrame:
    """Each pair of rows, smaller id first, of which at least one is a neighbour of the other."""
    pairs = neighbours.select(F.col(key).alias("_i"), F.explode("neighbours").alias("_j"))
    return pairs.select(F.least("_i", "_j").alias("point_a"), F.greatest("_i", "_j").alias("point_b")).distinct()
