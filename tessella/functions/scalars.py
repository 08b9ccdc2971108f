"""Scalar column expressions: parsing, seeded numbers, remappings, vectors, verdicts, formats. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexicon, patterns and constants that results depend on.
BOOLEAN_WORDS = ["true", "yes", "y", "false", "no", "n"]
DATE_PATTERN = r"(?i)^\d{4}-\d{2}-\d{2}(t\d{2}:\d{2}(:\d{2})?(\.\d+)?z?)?$"
DECIMAL_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
BLANKS = " \t\n\r\f\v\u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
RADIX = {"x": 16, "o": 8, "b": 2}
RADIX_PATTERN = r"^0([xX][0-9a-fA-F]+|[oO][0-7]+|[bB][01]+)$"
GOLDEN_STEP = 1831565813
WORD = 4294967296
MASS_LOW, MASS_HIGH = 0.5, 2.0
TEMPERATURE_FLOOR, HALF_LIFE = 0.15, 45.0
SPEED_LIMIT, TIME_STEP = 60.0, 60.0
GRID_SHIFT, GRID_CELL, GRID_SIDE = 150.0, 30.0, 10
GAIN_THRESHOLD, VARIANCE_EPSILON = 0.2, 1e-9
BUDGETS = {"webgpu": 50000, "webgl2": 2000, "static": 2000}


def blank_to_null(c: Column) -> Column:
    """Trims every kind of blank, byte-order marks included; what is empty then is null."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def parse_number(c: Column) -> Column:
    """Decimal, exponent, hexadecimal, octal and binary texts as doubles; all else and what overflows is null."""
    t = blank_to_null(c)
    base = F.when(t.rlike(RADIX_PATTERN), F.create_map(*[F.lit(x) for kv in RADIX.items() for x in kv])[F.lower(F.substring(t, 2, 1))])
    whole = F.call_function("conv", F.substring(t, 3, 64), base, F.lit(10)).try_cast("double")
    out = F.when(t.rlike(DECIMAL_PATTERN), t.try_cast("double")).when(t.startswith("0"), whole)
    return F.when(F.abs(out) < float("inf"), out)


def is_boolean_text(c: Column) -> Column:
    return F.lower(c).isin(BOOLEAN_WORDS)


def is_date_text(c: Column) -> Column:
    return c.rlike(DATE_PATTERN)


def round_half_up(c: Column, digits: int) -> Column:
    """Halves go towards positive infinity, also below zero."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def temperature(step: Column) -> Column:
    return F.lit(TEMPERATURE_FLOOR) + (1.0 - TEMPERATURE_FLOOR) * F.pow(F.lit(0.5), step / HALF_LIFE)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, so that expressions of expressions stay small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _word_product(a: Column, b: Column) -> Column:
    """Product of two unsigned words modulo 2^32, by halves, so that no intermediate overflows."""
    high = F.shiftright(a, 16) * b
    return ((high.bitwiseAND(F.lit(65535)) * 65536) + (a.bitwiseAND(F.lit(65535)) * b)) % WORD


def uniform(seed: Column, draw: Column) -> Column:
    """The ``draw``-th number (from 1) in [0, 1) of the stream ``seed``; any draw can be computed on its own."""
    first = (seed.cast("long") + F.pmod(draw.cast("long"), F.lit(WORD)) * GOLDEN_STEP) % WORD
    fold = lambda t, shift, mark: _word_product(t.bitwiseXOR(F.shiftright(t, shift)), t.bitwiseOR(F.lit(mark)))
    t = _bind(first, lambda a: fold(a, 15, 1))
    t = _bind(t, lambda t: ((t + fold(t, 7, 61)) % WORD).bitwiseXOR(t))
    return _bind(t, lambda t: t.bitwiseXOR(F.shiftright(t, 14)) / F.lit(float(WORD)))


def uniform_range(seed: Column, draw: Column, low: float, high: float) -> Column:
    return low + uniform(seed, draw) * (high - low)


def gaussian(seed: Column, first_draw: Column) -> Column:
    """Box-Muller of two successive draws; a zero (chance 2^-32) is nudged instead of drawn again."""
    u, v = uniform(seed, first_draw), uniform(seed, first_draw + 1)
    return F.sqrt(-2.0 * F.ln(F.greatest(u, F.lit(2.0**-33)))) * F.cos(2.0 * F.pi() * v)


def row_stream(*columns: Column) -> Column:
    """A 32-bit stream number from a row's content (nulls included, positions kept)."""
    return F.xxhash64(*[F.struct(F.lit(i), c) for i, c in enumerate(columns)]).bitwiseAND(F.lit(WORD - 1))


def mass_of(average: Column) -> Column:
    """Normalised average to a positive mass; unmapped (null) is 1."""
    return F.coalesce(MASS_LOW + average * (MASS_HIGH - MASS_LOW), F.lit(1.0))


def charge_of(normalised: Column) -> Column:
    return 2.0 * normalised - 1.0


def category_code(encoded: Column, distinct: Column) -> Column:
    """The category number behind an ordinal encoding; null is the middle one."""
    return F.floor(F.coalesce(encoded, F.lit(0.5)) * (F.greatest(distinct, F.lit(1)) - 1) + 0.5).cast("long")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dissimilarity(a: Column, b: Column) -> Column:
    """Root mean squared difference; 0 without dimensions."""
    return F.when(F.size(a) > 0, F.sqrt(squared_distance(a, b) / F.size(a))).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 1e-12, F.transform(a, lambda x: x / length)).otherwise(a)


def mat_vec(rows: Column, v: Column) -> Column:
    return F.transform(rows, lambda r: dot(r, v))


def not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def clamp_factor(vx: Column, vy: Column, limit: float = SPEED_LIMIT) -> Column:
    speed = F.hypot(vx, vy)
    return F.when(speed > limit, limit / speed).otherwise(1.0)


def damping(viscosity: Column, base: float = 0.06) -> Column:
    return 1.0 - F.least(F.lit(0.98), base + viscosity * 0.5)


def grid_coordinate(p: Column) -> Column:
    return F.least(F.greatest(F.floor((p + GRID_SHIFT) / GRID_CELL), F.lit(0)), F.lit(GRID_SIDE - 1)).cast("int")


def grid_cell(x: Column, y: Column) -> Column:
    return grid_coordinate(y) * GRID_SIDE + grid_coordinate(x)


def execution_profile(reduced_motion: Column, webgpu: Column, webgl2: Column) -> Column:
    return F.when(reduced_motion, "static").when(webgpu, "webgpu").when(webgl2, "webgl2").otherwise("static")


def row_budget(profile: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in BUDGETS.items() for x in kv])[profile]


def verdict(pca: Column, layout: Column, usable: Column | None = None, threshold: float = GAIN_THRESHOLD) -> Column:
    named = F.when(layout - pca > threshold, "stronger").otherwise("no-meaningful-gain")
    return named if usable is None else F.when(~usable, "insufficient-variance").otherwise(named)


def default_normalisation(role: Column) -> Column:
    return F.when(role == "attraction", "raw").otherwise("rank")


def clamp_k(k: Column, rows: Column) -> Column:
    return F.greatest(F.lit(2), F.least(k, F.greatest(F.lit(2), F.least(F.lit(12), rows - 1))))


def crc32_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0")


def range_text(low: Column, high: Column) -> Column:
    """A range with whole numbers as such and others with two decimals; equal ends are one number."""
    one = lambda x: F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.format_string("%.2f", x))
    return F.when(low == high, one(low)).otherwise(F.concat(one(low), F.lit("–"), one(high)))


def two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", x)


def step_seconds(steps: Column) -> Column:
    """Simulated time of a number of steps."""
    return F.format_string("%.1fs", steps / TIME_STEP)


def verdict_text(verdict_: Column, pca: Column, layout: Column) -> Column:
    """The sentence shown for a verdict (fixed wording)."""
    return (
        F.when(verdict_ == "insufficient-variance", "No variation in the data you mapped — there's nothing here for either view to separate.")
        .when(verdict_ == "stronger", F.concat(
            F.lit("Physics separates this data better than the best 2-axis view ("), two_decimals(layout), F.lit(" vs "), two_decimals(pca),
            F.lit(") — these columns are doing joint work no single scatter plot shows.")))
        .otherwise(F.concat(
            F.lit("No meaningful gain over a 2-axis view (silhouette "), two_decimals(layout), F.lit(" vs "), two_decimals(pca),
            F.lit(") — a scatter plot would show you the same thing.")))
    )


def export_name(product: Column, seed: Column, step: Column, unstable: Column, converged: Column) -> Column:
    state = F.when(unstable, "unstable").when(converged, "settled").otherwise("not-yet-settled")
    return F.concat(product, F.lit("_seed"), seed.cast("string"), F.lit("_step"), step.cast("string"), F.lit("_"), state, F.lit(".png"))
