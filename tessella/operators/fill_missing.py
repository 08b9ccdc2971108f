"""Fill missing numbers and categories from similar records, marking every fill.

Method: expectation-maximisation for a mixture whose components hold a joint Gaussian over the
numeric fields and one category distribution per categorical field. Each pass over all rows emits
sufficient statistics per batch, which Spark adds up per component (map-side first); the driver
holds only the parameters. A missing number is filled with its conditional expectation given what
the row does show, a missing category with its posterior mode. Rows of the same individual then
refine the fill: a known category of the individual decides a missing one (it does not change),
and the individual's mean residual, shrunk by its number of observations, shifts a missing number.

Defined results
- missing number: null, NaN, infinite, zero or negative, all nines (three digits or more), or
  beyond ``reach`` times the 95th percentile of the usable values; light or heavy real ones stay.
- missing text: null, without any letter or digit, or one of ``NO_VALUE`` apart from case, blanks
  and punctuation. Misspelt values are kept and count as the frequent value within two edits.
- empty table: no fills. No usable value in a field at all: the fill is null and still marked.
- ties of modes go to the alphabetically first value. Repeated rows are filled alike, each under
  its own key. Extra columns are ignored; a null individual is an individual of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.runtime import widen

#: Texts that name no value; compared without punctuation and blanks.
NO_VALUE = [
    "absent", "blank", "empty", "indet", "missing", "na", "nan", "nd", "nil", "no data", "no value", "none", "not available", "not given",
    "not known", "not recorded", "not specified", "null", "pending", "sp indet", "species indet", "tba", "tbc", "tbd", "undefined",
    "undetermined", "unidentified", "unk", "unknown", "unspecified", "void",
]


def text_missing(c: Column) -> Column:
    plain = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return c.isNull() | (plain == "") | plain.isin([w.replace(" ", "") for w in NO_VALUE])


def number_missing(c: Column, upper: float | None, zero_is_value: bool = False) -> Column:
    x = c.cast("double")
    low = (x < 0) if zero_is_value else (x <= 0)
    nines = F.abs(x).cast("string").rlike(r"^9{3,}\.[09]$|^9{2,}\.9+$")
    high = (x > upper) if upper is not None else F.lit(False)
    return F.coalesce(c.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | low | nines | high, F.lit(True))


def plain_text(c: Column) -> Column:
    """Case, blanks and trailing remarks ("(ad.)", "?", "sp.") removed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(\s*\(.*?\)|\s+sp\.?|[?!.*])+\s*$|^\s+", ""))


def upper_bounds(df: DataFrame, fields: list[str], reach: float = 3.0) -> dict[str, float | None]:
    if not fields:
        return {}
    usable = [F.percentile_approx(F.when(~number_missing(F.col(f), None), F.col(f).cast("double")), 0.95, 1000).alias(f) for f in fields]
    got = df.agg(*usable).first()
    return {f: None if got[f] is None else reach * got[f] for f in fields}


def frequent_values(df: DataFrame, name: str) -> dict[str, str]:
    """Plain values that are categories, with their usual spelling, most frequent first.

    A value is a misspelling, not a category, if it is within two edits of one at least twenty times as frequent; every other
    value is a category, however rare. Values are compared within blocks that such a pair must share (its first or last two
    letters), so the work follows the number of distinct values, which the driver holds: a categorical field has few."""
    known = df.where(~text_missing(F.col(name))).select(plain_text(F.col(name)).alias("v"), F.trim(F.col(name)).alias("raw")).groupBy("v", "raw").agg(F.count("*").alias("n"))
    per = known.groupBy("v").agg(F.sum("n").alias("n"), F.min(F.struct(-F.col("n"), F.col("raw")))["raw"].alias("raw"))
    rows = sorted(((r["v"], r["n"], r["raw"]) for r in per.collect()), key=lambda r: (-r[1], r[0]))
    kept: dict[str, str] = {}
    blocks: dict[str, list[tuple[str, int]]] = {}
    for v, n, raw in rows:
        near = [k for at in _ends(v) for k in blocks.get(at, ())] if len(v) > 4 else []
        if not any(m >= 20 * n and abs(len(k) - len(v)) <= 2 and _edits(v, k) <= 2 for k, m in near):
            kept[v] = raw
            for at in _ends(v):
                blocks.setdefault(at, []).append((v, n))
    return kept


def _ends(v: str) -> set[str]:
    """Blocks of a value: its first two, its last two and its middle letters."""
    return {f"<{v[:2]}", f"{v[-2:]}>", f"-{v[len(v) // 2:len(v) // 2 + 2]}"}


def _edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cost = min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, prev2[j - 2] + 1)
            cur.append(cost)
        prev2, prev = prev, cur
    return prev[-1]


class Coder:
    """Codes of category values; -1 is missing or too far from all categories."""

    def __init__(self, values: list[str]):
        self.values, self.seen = values, {v: i for i, v in enumerate(values)}

    def __call__(self, text: str | None) -> int:
        if text is None:
            return -1
        if text not in self.seen:
            near = min(((_edits(text, v), i) for i, v in enumerate(self.values) if abs(len(v) - len(text)) <= 2), default=(9, -1))
            if len(self.seen) > 100_000:
                return near[1] if near[0] <= 2 else -1
            self.seen[text] = near[1] if near[0] <= 2 else -1
        return self.seen[text]


@dataclass
class Mixture:
    """Parameters of the mixture: weights, means, covariances and category distributions."""

    numeric: list[str]
    categorical: dict[str, list[str]]
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray
    cats: list[np.ndarray]
    history: list[float] = field(default_factory=list)

    def log_density(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Log of weight times density of what each row shows, per component."""
        n, g = len(x), len(self.weight)
        out = np.repeat(np.log(np.maximum(self.weight, 1e-300))[None], n, 0)
        for c, table in enumerate(self.cats):
            known = codes[:, c] >= 0
            out[known] += np.log(table[:, codes[known, c]]).T
        for at, seen, _ in self._patterns(x):
            if seen.any():
                part = x[np.ix_(at, seen)]
                for k in range(g):
                    low = np.linalg.cholesky(self.cov[k][np.ix_(seen, seen)])
                    z = (part - self.mean[k, seen]) @ np.linalg.inv(low).T
                    out[at, k] -= 0.5 * np.einsum("ij,ij->i", z, z) + np.log(np.diag(low)).sum() + 0.5 * seen.sum() * np.log(2 * np.pi)
        return out

    @staticmethod
    def _patterns(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        known = ~np.isnan(x)
        key = known @ (1 << np.arange(x.shape[1]))
        for k in np.unique(key):
            at = np.flatnonzero(key == k)
            yield at, known[at[0]], ~known[at[0]]

    @staticmethod
    def posterior(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = logs.max(1, keepdims=True)
        e = np.exp(logs - top)
        total = e.sum(1, keepdims=True)
        return e / total, (top + np.log(total))[:, 0]

    def expectation(self, x: np.ndarray, k: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Rows with missing numbers replaced by their conditional mean in component k, and for each
        pattern with missing numbers its rows and the conditional covariance they share."""
        filled, rest, d = x.copy(), [], x.shape[1]
        for at, seen, gone in self._patterns(x):
            if not gone.any():
                continue
            s, block = self.cov[k], np.zeros((d, d))
            b = np.linalg.solve(s[np.ix_(seen, seen)], s[np.ix_(seen, gone)]) if seen.any() else np.zeros((0, gone.sum()))
            filled[np.ix_(at, gone)] = self.mean[k, gone] + (x[np.ix_(at, seen)] - self.mean[k, seen]) @ b
            block[np.ix_(gone, gone)] = s[np.ix_(gone, gone)] - s[np.ix_(gone, seen)] @ b
            rest.append((at, block))
        return filled, rest

    def statistics(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """One row per component: log-likelihood, mass, first moments, second moments, category masses."""
        resp, like = self.posterior(self.log_density(x, codes))
        rows = []
        for k in range(len(self.weight)):
            filled, rest = self.expectation(x, k)
            r = resp[:, k]
            second = (filled * r[:, None]).T @ filled + sum((r[at].sum() * block for at, block in rest), np.zeros((x.shape[1],) * 2))
            parts = [np.array([like.sum() if k == 0 else 0.0, r.sum()]), r @ filled, second.ravel()]
            parts += [np.bincount(codes[codes[:, c] >= 0, c], r[codes[:, c] >= 0], len(t[k])) for c, t in enumerate(self.cats)]
            rows.append(np.concatenate(parts))
        return np.array(rows)

    def maximise(self, sums: np.ndarray, floor: np.ndarray) -> Mixture:
        d = len(self.numeric)
        mass = np.maximum(sums[:, 1], 1e-9)
        mean = np.where(sums[:, 1:2] > 1e-6, sums[:, 2:2 + d] / mass[:, None], self.mean)
        second = sums[:, 2 + d:2 + d + d * d].reshape(-1, d, d)
        cov = second / mass[:, None, None] - mean[:, :, None] * mean[:, None, :]
        cov = np.where((sums[:, 1] > 2 * d)[:, None, None], cov, self.cov)
        cov = (cov + cov.transpose(0, 2, 1)) / 2 + np.diag(floor)
        at, cats = 2 + d + d * d, []
        for t in self.cats:
            own = sums[:, at:at + t.shape[1]] + 0.5 / t.shape[1]
            cats.append(own / own.sum(1, keepdims=True))
            at += t.shape[1]
        return Mixture(self.numeric, self.categorical, mass / mass.sum(), mean, cov, cats, [*self.history, float(sums[:, 0].sum())])


def prepare(df: DataFrame, numeric: list[str], categorical: list[str], bounds: dict[str, float | None], keys: list[str], counts: frozenset[str] = frozenset()) -> DataFrame:
    """Keys, numbers with missing ones as NaN, and plain texts with missing ones as null."""
    return df.select(
        *keys,
        *[F.when(number_missing(F.col(f), bounds.get(f), f in counts), F.lit(float("nan"))).otherwise(F.col(f).cast("double")).alias(f"n_{f}") for f in numeric],
        *[F.when(~text_missing(F.col(f)), F.coalesce(F.nullif(plain_text(F.col(f)), F.lit("")), F.lower(F.trim(F.col(f))))).alias(f"c_{f}") for f in categorical],
    )


def _arrays(pdf: pd.DataFrame, numeric: list[str], coders: dict[str, Coder]) -> tuple[np.ndarray, np.ndarray]:
    x = pdf[[f"n_{f}" for f in numeric]].to_numpy(float)
    codes = np.empty((len(pdf), len(coders)), np.int64)
    for j, (f, coder) in enumerate(coders.items()):
        num, texts = pd.factorize(pdf[f"c_{f}"])
        of = np.array([coder(t) for t in texts] + [-1], np.int64)
        codes[:, j] = of[num]
    return x, codes


def fit(prepared: DataFrame, numeric: list[str], categories: dict[str, list[str]], components: int = 12, rounds: int = 12, tolerance: float = 1e-4, seed: int = 7) -> Mixture | None:
    """Runs EM over all rows; stops when the mean log-likelihood gains less than ``tolerance``."""
    moments = prepared.agg(
        F.count("*").alias("n"),
        *[F.avg(F.nanvl(F.col(f"n_{f}"), F.lit(None).cast("double"))).alias(f"m_{f}") for f in numeric],
        *[F.var_pop(F.nanvl(F.col(f"n_{f}"), F.lit(None).cast("double"))).alias(f"v_{f}") for f in numeric],
    ).first()
    if not moments["n"]:
        return None
    d = len(numeric)
    mean = np.array([moments[f"m_{f}"] or 0.0 for f in numeric])
    var = np.array([moments[f"v_{f}"] or 1.0 for f in numeric])
    rng = np.random.default_rng(seed)
    cats = [np.full((components, max(1, len(v))), 1.0 / max(1, len(v))) for v in categories.values()]
    start = np.repeat(mean[None], components, 0) + rng.normal(size=(components, d)) * np.sqrt(var)
    lead = next(iter(categories), None)
    if lead and categories[lead]:  # components start at the categories of the first field, repeats apart
        size = len(categories[lead])
        for k in range(components):
            cats[0][k] = 0.1 / size
            cats[0][k, k % size] += 0.9
    model = Mixture(numeric, categories, np.full(components, 1.0 / components), start, np.repeat(np.diag(var)[None], components, 0), cats)
    width = 2 + d + d * d + sum(t.shape[1] for t in cats)
    names = [f"s{i}" for i in range(width)]
    schema = "component int, " + ", ".join(f"{s} double" for s in names)
    for _ in range(rounds):
        def step(batches: Iterator[pd.DataFrame], m: Mixture = model) -> Iterator[pd.DataFrame]:
            coders = {f: Coder(v) for f, v in categories.items()}
            total = None
            for pdf in batches:
                if len(pdf):
                    s = m.statistics(*_arrays(pdf, numeric, coders))
                    total = s if total is None else total + s
            if total is not None:
                out = pd.DataFrame(total, columns=names)
                out.insert(0, "component", np.arange(len(total), dtype=np.int32))
                yield out
        got = prepared.mapInPandas(step, schema).groupBy("component").agg(*[F.sum(s).alias(s) for s in names]).toPandas()
        sums = got.sort_values("component")[names].to_numpy()
        model = model.maximise(sums, 1e-6 * var + 1e-9)
        h = model.history
        if len(h) > 1 and abs(h[-1] - h[-2]) < tolerance * moments["n"]:
            break
    return model


def predict(prepared: DataFrame, model: Mixture, keys: list[str], key_types: list[str]) -> DataFrame:
    """Per row: the expected value of each number from the row's other fields, and the modal category of each text."""
    numeric, categories = model.numeric, model.categorical
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(keys, key_types)), *(f"e_{f} double, n_{f} double" for f in numeric), *(f"p_{f} string, k_{f} string, g_{f} boolean" for f in categories)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders = {f: Coder(v) for f, v in categories.items()}
        for pdf in batches:
            x, codes = _arrays(pdf, numeric, coders)
            out = pdf[keys].copy()
            for j, f in enumerate(numeric):  # leave the field itself out, so that residuals are honest
                hidden = x.copy()
                hidden[:, j] = np.nan
                resp, _ = model.posterior(model.log_density(hidden, codes))
                out[f"e_{f}"] = sum(resp[:, k] * model.expectation(hidden, k)[0][:, j] for k in range(len(model.weight)))
                out[f"n_{f}"] = x[:, j]
            resp, _ = model.posterior(model.log_density(x, codes))
            for c, (f, values) in enumerate(categories.items()):
                out[f"g_{f}"] = pdf[f"c_{f}"].isna()  # gone: an odd text is too far from all categories, but present
                if values:
                    order = np.argsort(np.array(values), kind="stable")
                    best = order[(resp @ model.cats[c])[:, order].argmax(1)]
                    names = np.array([*values, None], object)
                    out[f"p_{f}"], out[f"k_{f}"] = names[best], names[codes[:, c]]
                else:
                    out[f"p_{f}"] = out[f"k_{f}"] = None
            yield out[[c.split()[0] for c in schema.split(", ")]]
    return prepared.mapInPandas(run, schema)


def fill(df: DataFrame, key: str, individual: str, numeric: list[str], targets: list[str], categorical: list[str], category_targets: list[str], prior: float = 1.0, counts: frozenset[str] = frozenset(), **fit_options) -> DataFrame:
    """One row per missing value: key, field, the filled number or text, and how it was found. Of ``counts``, 0 is a value and none is too large.

    The individual's rows are pre-aggregated before they are joined; null individuals get keys of
    their own, so they do not meet in one task."""
    bounds = upper_bounds(df, [f for f in numeric if f not in counts])
    spelling = {f: frequent_values(df, f) for f in categorical}
    categories = {f: list(v) for f, v in spelling.items()}
    types = dict(df.dtypes)
    prepared = widen(prepare(df, numeric, categorical, bounds, [key, individual], counts)).persist()
    model = fit(prepared, numeric, categories, **fit_options)
    schema = "row_key long, field_name string, filled_number double, filled_text string, method string, filled boolean"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    rows = predict(prepared, model, [key, individual], [types[key], types[individual]])
    rows = rows.withColumn("_who", F.coalesce(F.col(individual).cast("string"), F.concat(F.lit("\0"), F.col(key).cast("string"))))
    rows = rows.persist()  # used per individual and per gap
    seen = lambda f: F.col(f"n_{f}").isNotNull() & ~F.isnan(f"n_{f}")
    per = rows.groupBy("_who").agg(
        *[F.avg(F.when(seen(f), F.col(f"n_{f}") - F.col(f"e_{f}"))).alias(f"r_{f}") for f in targets],
        *[F.count(F.when(seen(f), True)).alias(f"o_{f}") for f in targets],
    )
    modes = {}
    for f in category_targets:
        counts = rows.where(F.col(f"k_{f}").isNotNull()).groupBy("_who", f"k_{f}").count()
        modes[f] = counts.groupBy("_who").agg(F.min(F.struct(-F.col("count"), F.col(f"k_{f}")))[f"k_{f}"].alias(f"m_{f}"))
    gone = rows.where(" or ".join([*(f"n_{f} is null or isnan(n_{f})" for f in targets), *(f"g_{f}" for f in category_targets)]))
    joined = gone.join(per, "_who", "left")
    for m in modes.values():
        joined = joined.join(m, "_who", "left")
    number = [F.when(~seen(f), F.struct(
        F.lit(f).alias("field_name"),
        (F.col(f"e_{f}") + F.coalesce(F.col(f"r_{f}") * F.col(f"o_{f}") / (F.col(f"o_{f}") + prior), F.lit(0.0))).alias("filled_number"),
        F.lit(None).cast("string").alias("filled_text"),
        F.when(F.col(f"o_{f}") > 0, "em-mean+individual").otherwise("em-mean").alias("method"),
    )) for f in targets]
    text = [F.when(F.col(f"g_{f}"), F.struct(
        F.lit(f).alias("field_name"), F.lit(None).cast("double").alias("filled_number"),
        F.coalesce(f"m_{f}", f"p_{f}").alias("filled_text"),
        F.when(F.col(f"m_{f}").isNotNull(), "individual").otherwise("em-mode").alias("method"),
    )) for f in category_targets]
    fills = joined.select(F.col(key).alias("row_key"), F.explode(F.array_compact(F.array(*number, *text))).alias("x")).select("row_key", "x.*", F.lit(True).alias("filled"))
    usual = [x for f in category_targets for v, raw in spelling[f].items() for x in (F.lit(f"{f}\0{v}"), F.lit(raw))]
    if usual:
        fills = fills.withColumn("filled_text", F.coalesce(F.create_map(*usual)[F.concat("field_name", F.lit("\0"), "filled_text")], F.col("filled_text")))
    return fills


def fill_mappings(mappings: DataFrame, data: DataFrame, columns: list[str], **fit_options) -> DataFrame:
    """The same mixture over mappings, whose individual is the data set: expected counts and modal strategies of all missing ones.

    Where the data set's own rows are there, their nulls and blanks (which is how such counts are taken) replace the expected count."""
    numeric = [c for c in ("missing_count", "ordinal") if c in mappings.columns]
    categorical = [c for c in ("missing_strategy", "column_name", "inferred_type", "force_role", "normalization") if c in mappings.columns]
    filled = fill(mappings, "mapping_id", "dataset_id", numeric, ["missing_count"], categorical, ["missing_strategy"], counts=frozenset(numeric), **fit_options)
    per = data.groupBy("dataset_id").agg(*[F.count(F.when(F.trim(F.col(c).cast("string")).isNull() | (F.trim(F.col(c).cast("string")) == ""), True)).alias(c) for c in columns])
    counts = per.unpivot(["dataset_id"], columns, "column_name", "own_count")
    owner = mappings.select(F.col("mapping_id").alias("row_key"), "dataset_id", "column_name")
    joined = filled.join(owner, "row_key").join(counts, ["dataset_id", "column_name"], "left")
    own = (F.col("field_name") == "missing_count") & F.col("own_count").isNotNull()
    number = F.when(own, F.col("own_count").cast("double")).when(F.col("field_name") == "missing_count", F.greatest(F.round("filled_number"), F.lit(0.0)))
    return joined.select("row_key", "field_name", number.alias("filled_number"), F.lower("filled_text").alias("filled_text"), F.when(own, F.concat("method", F.lit("+own-rows"))).otherwise(F.col("method")).alias("method"), "filled")


def fill_observations(penguins: DataFrame, mappings: DataFrame, **options) -> DataFrame:
    """All fills of both tables, keyed by table name, row key and field name."""
    birds = fill(
        penguins, "obs_id", "tag_id", ["bill_length_mm", "bill_depth_mm", "flipper_length_mm", "body_mass_g"], ["bill_length_mm", "body_mass_g"],
        ["species", "island"], ["species"], **options,
    )
    maps = fill_mappings(mappings, penguins, ["species", "island", "bill_length_mm", "bill_depth_mm", "flipper_length_mm", "body_mass_g"], **options)
    return birds.select(F.lit("penguins").alias("table_name"), "*").unionByName(maps.select(F.lit("column_mappings").alias("table_name"), "*"))
